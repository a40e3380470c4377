import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import line_dedup as ld
from gridloom.llm.common import connected_components


def brute(rows, min_chars=24, k=8):
    """All pairs of distinct lines by exact Jaccard; lines of under min_chars are alike only if they are equal."""
    where, sets = {}, {}
    for i, t in rows:
        if i is None or not t:
            continue
        for j, line in enumerate(t.split("\n")):
            n = line.strip(" ")
            if n.strip():
                where.setdefault(n, []).append((i, j))
                sets[n] = {n[x : x + k] for x in range(len(n) - k + 1)} if len(n) >= min_chars else {(n,)}
    up = {n: n for n in where}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ns = list(where)
    for a in range(len(ns)):
        for b in range(a):
            x, y = sets[ns[a]], sets[ns[b]]
            if 100 * len(x & y) >= 80 * len(x | y):
                up[root(ns[a])] = root(ns[b])
    groups = {}
    for n in ns:
        groups.setdefault(root(n), []).extend(where[n])
    return {(i, j): min(g) for g in groups.values() for i, j in g if (i, j) != min(g)}


def data(seed, n=60):
    r = random.Random(seed)
    line = lambda: " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 25)))
    pool = [line() for _ in range(25)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(r.randint(1, 8)):
            x = r.random()
            t = r.choice(pool) if x < 0.4 else line()
            if x < 0.2 and len(t) > 60:
                p = r.randrange(len(t))
                t = t[:p] + r.choice(["", "zz", "Q"]) + t[p + 1 :]
            out.append(t.upper() if x < 0.05 else t)
        rows.append((i, "\n".join(out)))
    return rows


def test_against_brute_force(spark):
    rows = data(1) + [(100, None), (101, ""), (102, "\n\n"), (103, "short"), (None, data(1)[0][1]), (104, "é" * 30), (105, "É" * 30), (106, "日本語" * 9 + "\n" + "日本語" * 9)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, line_no int").repartition(3)
    got = {(x.doc_id, x.line_no): (x.keep_doc, x.keep_line) for x in ld.duplicate_lines(df, bands=24).collect()}
    want = brute(rows)
    assert got == want and len(want) > 40
    rep = {x.doc_id: x for x in ld.line_report(df, bands=24).collect()}
    for i, t in rows:
        if i is None:
            continue
        gone = sorted(j for x, j in want if x == i)
        assert rep[i].removed == gone and rep[i].n_lines == (len(t.split("\n")) if t else 0)
        assert rep[i].text == (t if not gone else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone))
    kept = {x.doc_id: x.text for x in ld.dedup_lines(df, bands=24).collect()}
    assert all(kept[i] == rep[i].text for i in kept if i is not None) and {100, 101, 102, 103} <= set(kept) and 105 in kept
    assert ld.duplicate_lines(df.limit(0)).count() == 0


def test_recall_at_production_parameters(spark):
    rows = data(2, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = {(x.doc_id, x.line_no) for x in ld.duplicate_lines(df).collect()}, set(brute(rows))
    assert got <= want and len(got) >= 0.97 * len(want)


def test_large_bucket_of_near_copies(spark):
    r = random.Random(3)
    base = "".join(r.choice("abcdefghijklmnop ") for _ in range(200))
    rows = [(i, base[: (p := r.randrange(200))] + r.choice("0123456789") + base[p + 1 :]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ld.duplicate_lines(df).count() == 199


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame(data(4, 5), "doc_id long, text string")
    df.write.mode("overwrite").parquet(p := ld.Scratch(spark, "t").path())
    ld.line_report(spark.read.parquet(p)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_short_lines_go_only_as_exact_copies(spark):
    rows = [(0, "a heading\n  \n\nx"), (1, "a heading\na headinh"), (2, " a heading \n\t\nx y"), (3, "x\n\t\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_id, x.line_no): (x.keep_doc, x.keep_line) for x in ld.duplicate_lines(df).collect()} == {(1, 0): (0, 0), (2, 0): (0, 0), (3, 0): (0, 3)} == brute(rows)


def test_clashing_names_and_long_texts(spark):
    own = "This line stands in two of the documents, so it goes once"
    r = random.Random(7)
    long = "\n".join("".join(r.choice("abcdefghijklmnop ") for _ in range(60)) for _ in range(4000))
    rows = [(1, own, "r", 1, None, "b"), (2, f"{own}\n{long}", "r", 2, 3, None), (2, None, None, None, None, None), (None, own, "x", 4, 5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __removed string, __id long, removed long, h1 string")
    out = ld.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=str)
    kept = {(i, r): t for i, t, r, *_ in got}
    assert kept[1, "r"] == own and kept[None, "x"] == own and kept[2, None] is None and own not in kept[2, "r"]
    assert len(kept[2, "r"].split("\n")) == 4000
    assert {tuple(r[2:]) for r in got} == {tuple(r[2:]) for r in rows}


def test_dense_groups_in_blocks(spark):
    """Groups that neither the least nor the greatest line of a bucket joins, cut into blocks; every line in one component."""
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    head, lines = word(120), []
    for _ in range(6):
        own = word(50)
        for _ in range(25):
            p = r.randrange(50)
            lines.append(f"{head}#{own[:p]}{r.choice('0123456789')}{own[p + 1:]}#")
    rows = list(enumerate(lines))
    got = {(x.doc_id, x.line_no): (x.keep_doc, x.keep_line) for x in ld.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=8).collect()}
    assert got == brute(rows)


def test_sketches_lose_no_link(spark):
    r = random.Random(9)
    rows = []
    for i in range(300):
        t = "".join(r.choice("abcdefgh ") for _ in range(r.choice([24, 40, 300, 2000])))
        cut = r.randrange(len(t))
        rows.append((i, t, t[:cut] + "".join(r.choice("xyz") for _ in range(r.randint(0, max(1, len(t) // 40)))) + t[cut:]))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    sa, sb = (ld._sketches(df.select(F.expr(f"i * 2 + {k}").alias("h1"), F.col(c).alias("norm"))) for k, c in enumerate("ab"))
    both = sa.selectExpr("h1 div 2 as i", "struct(n, lev, sk) as sa").join(sb.selectExpr("h1 div 2 as i", "struct(n, lev, sk) as sb"), "i").select("i", F.expr(ld._may_link("sa", "sb", 80)).alias("may"), "sa.n")
    sets = lambda t: {t[x : x + 8] for x in range(len(t) - 7)}
    for x in both.collect():
        a, b = sets(rows[x.i][1]), sets(rows[x.i][2])
        assert x.n >= len(a) and (x.may or 100 * len(a & b) < 80 * len(a | b))
    assert sum(x.may for x in both.collect()) > 100 and ld._sketches(df.limit(0).selectExpr("i as h1", "a as norm")).count() == 0


def test_families_of_one_template(spark):
    """Buckets full of lines that are alike but under the limit hold the pairs that reach it."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    head, tail, lines = word(90), word(90), []
    for _ in range(250):
        own = word(30)
        lines += [f"{head}#{own}#{tail}", f"{head}#{own}#{tail[:60]}{r.choice('0123456789')}{tail[61:]}"]
    rows = list(enumerate(lines))
    got = {(x.doc_id, x.line_no) for x in ld.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = set(brute(rows))
    assert got <= want and 240 <= len(want) <= 260 and len(got) >= 0.97 * len(want)


def test_recall_of_short_lines(spark):
    """Pairs of lines that just reach the limit, with 25 and 40 shingles in their union."""
    r, rows = random.Random(6), []
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for both, one, other in ((20, 2, 3), (32, 4, 4)):
        for _ in range(1000):
            mid = word(both + ld.SHINGLE - 1)
            rows += [word(one) + mid, mid + word(other)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [x.doc_id for x in ld.duplicate_lines(df).collect()]
    assert sum(i < 2000 for i in got) >= 970 and sum(i >= 2000 for i in got) >= 970


def test_queries_fold_case_and_white_space(spark):
    import corpus_pipeline

    line = "The quick brown fox jumps over a lazy dog"
    texts = [line, line.upper(), line.replace(" ", "\t"), line.replace(" ", "   "), f"  {line}\r", line.replace(" ", "\f \v"), "a line of its own, without any copy"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{(p := ld.Scratch(spark, 't').path())}/documents.parquet")
    assert {x.doc_id: x.n_removed for x in ld.op2_line_dedup(spark, p).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}
    assert {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, df, p).collect()} == {0: texts[0], 6: texts[6]}


def test_components_that_have_not_settled_are_an_error(spark):
    path = spark.range(40).selectExpr("id as a", "id + 1 as b")
    with pytest.raises(RuntimeError, match="not settled"):
        connected_components(path, ld.Scratch(spark, "t"), most=2)
    assert {x.component for x in connected_components(path, ld.Scratch(spark, "t")).collect()} == {0}


def test_strided_hashes_hold_all_shingles(spark):
    """Several shingles in a row: the same sets as one by one, in a quarter of the rows."""
    r = random.Random(41)
    lines = ["".join(r.choice("ab ö𝄞") for _ in range(n)) for n in [*range(1, 45), 300]]
    texts = spark.createDataFrame(list(enumerate(lines)), "h1 long, norm string")
    for least in (0, 24):
        one = {x.h1: set(x.s) for x in ld.shingle_hashes(texts, ["h1"], least).groupBy("h1").agg(F.collect_set("h").alias("s")).collect()}
        rows = ld.strided_hashes(texts, ["h1"], least).collect()
        some = {}
        for x in rows:
            some.setdefault(x.h1, set()).update(x[f"g{j}"] for j in range(ld.STRIDE))
        assert some == one and len(rows) == sum(1 + (max(1, len(t.encode("utf-16-be")) // 2 - 7) - 1) // ld.STRIDE if len(t.encode("utf-16-be")) >= 2 * least else 1 for t in lines)


def test_blocks_meet_in_turns(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(6))
    head = " ".join(word() for _ in range(14))
    lines = [head + " " + " ".join(word() for _ in range(9)) for _ in range(90)]
    lines += [t[:-1] + "q" for t in lines[20:40]]
    rows = list(enumerate(lines))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made, put = [], ld.Scratch.table
    monkeypatch.setattr(ld.Scratch, "table", lambda self, df, name="t", compression="snappy": made.append((name, out := put(self, df, name, compression))) or out)
    monkeypatch.setattr(ld, "TURN", 1)
    got = {(x.doc_id, x.line_no): (x.keep_doc, x.keep_line) for x in ld.duplicate_lines(df, block=8).collect()}
    assert got == brute(rows) and len(got) == 20
    # many pairs of blocks: no table holds them all, and they come in several turns
    assert [n for n, _ in made].count("rest") > 3 and not {"apart", "blocks"} & {n for n, _ in made}


def test_lengths_tell_lines_apart(spark):
    r = random.Random(9)
    line = lambda n: "".join(r.choice("abcdefghijklm ") for _ in range(n))
    a, b = line(120), line(480)
    texts = [a, a[:-3] + "qqq", b, a + b, "abcdefgh" * 4, "abcdefgh" * 40, "abcdefgh" * 40 + "xyz"]
    sk = ld._sketches(spark.createDataFrame(list(enumerate(texts)), "h1 long, norm string"))
    f = lambda x: F.struct(*[F.col(c) for c in sk.columns]).alias(x)
    got = {(x.a, x.b) for x in sk.select(f("x")).crossJoin(sk.select(f("y"))).where(ld._like_size("x", "y", 80) + " and " + ld._may_link("x", "y", 80)).selectExpr("x.h1 as a", "y.h1 as b").collect()}
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y)}
    assert want <= got and (4, 5) in got and not {(0, 2), (0, 3)} & got
