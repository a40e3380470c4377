import hashlib
import random

import numpy as np
import pytest

from gridloom.llm import fingerprints as fp
from gridloom.llm import packing, token_files


def slow_walk(text):
    """The walk of one text, a step at a time."""
    syms, at, out, step = [int(x) for x in fp._symbols(text)], 0, [], 0
    sampled = {int(s): k for k, s in enumerate(fp.STEPS[:2000])}
    while at < len(syms):
        moves, bits = fp._random(step // fp._CHUNK)
        if step in sampled:
            out.append(int(bits[sampled[step] - int(np.searchsorted(fp.STEPS, step // fp._CHUNK * fp._CHUNK))][syms[at]]))
        at += int(moves[step % fp._CHUNK][syms[at]])
        step += 1
    return out


def test_walk_against_one_by_one():
    r = random.Random(1)
    texts = ["", "a", "é", "\x00b"] + ["".join(r.choice("abc é日 \n") for _ in range(r.randint(1, 4000))) for _ in range(25)]
    got = fp.walk(texts)
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == slow_walk(t)
    assert [w.tolist() for w in fp.walk(texts[::-1])][::-1] == [g.tolist() for g in got]


def test_near_orders_texts():
    r = random.Random(2)
    a = "".join(r.choice("abcdefghij ") for _ in range(6000))
    b = "".join(r.choice("abcdefghij ") for _ in range(6000))
    few = a[:1500] + "zz" + a[1500:4000] + a[4003:]
    wa, wb, wf, wh = fp.walk([a, b, few, a[:3000] + b[3000:]])
    assert fp.near(wa, wa) == 1 and fp.near(wa, wb) < 0.3 < fp.near(wa, wh) < fp.near(wa, wf) < 1


def test_documents(spark):
    r = random.Random(3)
    rows = [(i * 5, "".join(r.choice("ab é\n") for _ in range(r.randint(0, 300)))) for i in range(60)] + [(7, None), (8, ""), (9, "x"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(4)
    got = {x.doc_id: x for x in fp.fingerprint_documents(df).collect()}
    want = sorted((i, t or "") for i, t in rows if i is not None)
    assert sorted(got) == [i for i, _ in want]
    for k, (i, t) in enumerate(want):
        nxt = want[(k + 1) % len(want)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        wt, we, wn = fp.walk([t, e, nxt])
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (fp.to_text(wt), fp.to_text(we))
        assert (g.near_edited, g.near_next) == (fp.near(wt, we), fp.near(wt, wn))
    assert fp.fingerprint_documents(df.limit(0)).count() == 0
    one = fp.fingerprint_documents(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_near_pairs(spark):
    r = random.Random(4)
    rows = []
    for i in range(20):
        t = "".join(r.choice("abcdefgh ") for _ in range(800))
        rows += [(3 * i, t), (3 * i + 1, t[:400] + "!" + t[401:790]), (3 * i + 2, t if i % 4 == 0 else "".join(r.choice("abcdefgh ") for _ in range(800)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.a, x.b) for x in fp.near_pairs(df).collect()}
    assert len(got & {(3 * i, 3 * i + 1) for i in range(20)}) >= 18 and all(a // 3 == b // 3 for a, b in got)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edit(r, t, n, letters):
    out = list(t)
    for _ in range(n):
        kind = r.randrange(3)
        at = r.randrange(len(out) + (kind == 0)) if out or kind == 0 else 0
        if kind == 0:
            out.insert(at, r.choice(letters))
        elif out:
            out[at : at + 1] = [r.choice(letters)] if kind == 1 else []
    return "".join(out)


def test_edit_distance_against_the_table():
    r = random.Random(8)
    for _ in range(500):
        a = "".join(r.choice("abé日") for _ in range(r.randint(0, 50)))
        b = edit(r, a, r.randint(0, 9), "abx") if r.random() < 0.9 else "".join(r.choice("ab") for _ in range(30))
        for most in (0, 3, 100):
            assert fp.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def test_bands_reach_the_whole_text():
    """A change of 6 % at the head, in the middle or at the tail leaves a band alike."""
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    keys = lambda t: set(fp.band_keys((fp.walk([t])[0], fp.walk([t[::-1]])[0])))
    for at in (0, 1410, 2820):
        found = 0
        for _ in range(40):
            t = text(3000)
            found += bool(keys(t) & keys(t[:at] + text(180) + t[at + 180 :]))
        assert found >= 36
    assert all(len(keys(text(200)) & keys(text(200))) == 0 for _ in range(50))


def test_near_classes_against_brute_force(spark):
    r = random.Random(10)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([12, 60, 300, 900]))) for _ in range(25)]
    rows = list(enumerate(texts))
    for i in range(90):
        t = r.choice(texts)
        rows.append((100 + i, edit(r, t, r.choice([0, 1, max(1, len(t) // 60)]), "xyz")))
    rows += [(300, None), (301, ""), (302, "ab"), (303, "ab"), (None, texts[0]), (304, "long " * 15_000), (305, "long " * 15_000 + "end")]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, near_id string, key int").repartition(4)
    own = [(i, t or "") for i, t in rows if i is not None]
    up = {i: i for i, _ in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in own:
        for j, t in own:
            if i < j and s and t and (s == t or max(len(s), len(t)) < 2000 and abs(len(s) - len(t)) < 40 and levenshtein(s, t) <= max(len(s), len(t)) // 10 or {i, j} == {304, 305}):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {x.doc_id: x.near_id for x in fp.near_classes(df, block=3).collect()}  # the usual size is in test_near_pairs
    assert set(got) == set(up)
    wrong = [i for i in up if got[i] != root(i)]
    assert len(wrong) <= 3 and all(got[i] >= root(i) for i in up)
    assert fp.near_classes(df.limit(0)).count() == 0 and fp.near_pairs(df.limit(0)).count() == 0


def test_candidates_against_brute_force():
    """Pairs of a block come packed, a row for two groups, each in the first bucket that its texts share."""
    import pyarrow as pa

    r = random.Random(22)
    rows = [{"id": i, "chars": r.choice([100, 105, 200]), "c": r.randrange(20), "keys": r.sample(range(-6, 6), r.randint(1, 5))} for i in range(150)]
    got, packed = [], 0
    for key in range(-6, 6):
        own = [x for x in rows if key in x["keys"]]
        blocks = [own[::2], own[1::2]]
        kind = pa.list_(pa.struct([("id", pa.int64()), ("chars", pa.int64()), ("c", pa.int64()), ("keys", pa.list_(pa.int64()))]))
        cells = [(key, x, y, blocks[x], blocks[y]) for x, y in ((0, 0), (0, 1), (1, 1))]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*cells, strict=True), (pa.int64(), pa.int32(), pa.int32(), kind, kind), strict=True)], names=["key", "x", "y", "l", "r"])
        for out in fp._candidates(iter([batch]), 0.1, 2):
            packed += out.num_rows
            for a, b in zip(out.column(2).to_pylist(), out.column(3).to_pylist(), strict=True):
                got += zip(a, b, strict=True)
    near = [(x, y) for x in rows for y in rows if x["id"] < y["id"] and x["c"] != y["c"] and abs(x["chars"] - y["chars"]) <= max(x["chars"], y["chars"]) // 10]
    assert sorted(got) == [(x["id"], y["id"]) for x, y in near if len({*x["keys"]} & {*y["keys"]}) >= fp.SHARED]
    assert packed <= 12 * 3 * 3 < len(got)


def test_near_texts_travel_in_turns(spark, monkeypatch):
    """Texts that share a passage, each at 12 % or more from the others: links don't depend on how many texts travel at a time."""
    r, turns = random.Random(21), []
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    common = text(2000)
    rows = [(i, text(700) + common) for i in range(40)]
    rows += [(100 + i, t[:40] + "!" + t[41:]) for i, t in rows[::4]]

    def table(self, d, name="t", *more, inner=fp.Scratch.table):
        turns.append(name)
        return inner(self, d, name, *more)

    monkeypatch.setattr(fp.Scratch, "table", table)
    monkeypatch.setattr(fp, "WAVE_CHARS", 1 << 12)
    got = {x.doc_id: x.near_id for x in fp.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i, _ in rows}
    assert turns.count("near") > turns.count("needs") == 3


def test_texts_that_cannot_be_near_do_not_travel(spark, monkeypatch):
    """Texts that share bands, but whose lengths tell them apart, aren't compared; sketches count what walks have in common."""
    r, star = random.Random(23), []
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    heads = [text(1000) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(heads)] + [(100 + i, t + text(150)) for i, t in enumerate(heads)] + [(200, heads[0][:500] + "!" + heads[0][501:])]
    keys = [set(fp.band_keys((fp.walk([t])[0], fp.walk([t[::-1]])[0]))) for _, t in rows]
    assert all(keys[i] & keys[6 + i] for i in range(6))

    def table(self, d, name="t", *more, inner=fp.Scratch.table):
        out = inner(self, d, name, *more)
        star.extend((x.a, x.b) for x in out.collect()) if name == "star" else None
        return out

    monkeypatch.setattr(fp.Scratch, "table", table)
    got = {x.doc_id: x.near_id for x in fp.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i == 200 else i for i, _ in rows} and (0, 200) in star and not {(i, 100 + i) for i in range(6)} & set(star)

    walks = [(fp.walk([t])[0], fp.walk([t[::-1]])[0]) for t in (heads[0], rows[-1][1], heads[1])]
    sketches = [fp.bands_of([w])[0][2][:4] for w in walks]
    at = fp._marks(fp._lengths(len(walks[0][0]))[0])
    want = [int((walks[0][0][at] == w[0][at]).sum()) for w in walks]
    df = spark.createDataFrame([(sketches[0], s) for s in sketches], "u array<long>, v array<long>")
    assert [x[0] for x in df.select(fp._alike("u", "v")).collect()] == want and want[0] == fp.MARKS and want[1] >= fp.ALIKE > want[2]


def naive(sizes, sources, clusters, cap):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(cap - sum(sizes[j] for j in b), k) for k, b in enumerate(bins)]
        fit = [x for x in fit if x[0] >= sizes[i] and not any(sources[i] >= 0 and sources[j] == sources[i] or clusters[i] >= 0 and clusters[j] == clusters[i] for j in bins[x[1]])]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append([])
        bins[k].append(i)
        out[i] = k
    return out


def test_best_fit_against_naive():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(0, 80)
        sizes = [r.choice([1, 7, 50, r.randint(1, 100)]) for _ in range(n)]
        src, clu = [r.choice([-1, 0, 0, 1, 2, 3]) for _ in range(n)], [r.choice([-1, -1, 0, 1]) for _ in range(n)]
        assert packing.best_fit(sizes, src, clu, 100)[0] == naive(sizes, src, clu, 100)


def test_pack_documents(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    enc = token_files.Encoder(path)
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["wall", "sun", "der", "x1"]) for _ in range(r.choice([0, 3, 40, 100, 101, 250, r.randint(1, 90)]))) + ("" if i % 3 else f" x{i}"), r.choice([None, "a", "b", "c"]), 9) for i in range(300)]
    rows += [(300, None, "a", 9), (301, " \n", "a", 9), (None, "q r", None, 9), (None, "q r", "a", 9), (300, "dup id", "a", 9), (302, "twice", None, 9), (302, "twice", None, 9), (303, "word " * 20_000, "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int")
    out = packing.pack_documents(df, path, capacity=100, shard_rows=60).collect()
    whole = {}
    for b in out:
        assert b.n_tokens == len(b.tokens) <= 100 and b.n_pieces == len(b.doc_ids) == len(b.pieces) == len(b.starts) == len(b.sources)
        named = [x for x in b.sources if x is not None]
        assert len(set(named)) == len(named)
        ends = [*b.starts[1:], b.n_tokens]
        for d, p, x, s, e in zip(b.doc_ids, b.pieces, b.sources, b.starts, ends, strict=True):
            whole.setdefault((str(d), str(x)), []).append((p, tuple(b.tokens[s:e])))
    want = {}
    for i, t, x, _ in rows:
        ids = enc.whole(t or "").tolist()
        if ids:
            ids.append(2)
            want.setdefault((str(i), str(x)), []).extend((k, tuple(ids[100 * k : 100 * k + 100])) for k in range(-(-len(ids) // 100)))
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({b.bin_id for b in out}) == len(out)
    again = packing.pack_documents(df.repartition(7), path, capacity=100, shard_rows=60).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert packing.pack_documents(df.limit(0), path).count() == 0
    assert packing.pack_documents(df.drop("source"), path).count() > 0


def test_pack_repeated_rows_and_clusters(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    df = spark.createDataFrame([(None, "the same words in every row", None, k % 2) for k in range(900)], "doc_id long, text string, source string, grp long")
    out = packing.pack_documents(df, path, capacity=50, shard_rows=20).collect()
    assert sum(b.n_pieces for b in out) == 900 == len(out) and len({b.bin_id for b in out}) == 900  # copies don't share a bin
    assert len({b.bin_id >> 14 for b in out}) > 20
    rows = [(i, f"text {i}", None, i // 5) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, grp long")
    out = packing.pack_documents(df, path, capacity=50, cluster_col="grp").collect()
    assert all(len({d // 5 for d in b.doc_ids}) == b.n_pieces for b in out) and sum(b.n_pieces for b in out) == 100


def test_only_texts_of_a_turn_are_shuffled(spark, monkeypatch):
    """Before texts are dealt out, a filter leaves those of a turn, a share of the corpus."""
    r, held = random.Random(23), []
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = [(i, text(1500)) for i in range(120)]
    rows += [(1000 + i, t[:40] + "!" + t[41:]) for i, t in rows]

    def among(found, keys, key, inner=fp.among):
        out = inner(found, keys, key)
        if key == "id":
            held.append(sum(len(x.text) for x in out.collect()))
        return out

    monkeypatch.setattr(fp, "among", among)
    monkeypatch.setattr(fp, "WAVE_CHARS", 1 << 10)
    got = {x.doc_id: x.near_id for x in fp.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert len(held) >= fp.TURNS and max(held) < sum(len(t) for _, t in rows) / 2
