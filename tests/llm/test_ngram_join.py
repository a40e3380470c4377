import random
import re

from gridloom.llm import ngram_join
from gridloom.llm.ngram_join import ngram_dedup, ngram_jaccard_classes


def brute(rows, n=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    hot = [r.choice(vocab) for _ in range(60)]
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if kind < 0.35 and texts:
            w = list(r.choice(texts))
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        elif kind < 0.6:
            w = list(hot)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(vocab)
        elif kind < 0.7:
            w = [r.choice(vocab[:3]) for _ in range(r.randint(0, 5))]
        else:
            w = [r.choice(vocab) for _ in range(r.randint(3, 90))]
        texts.append(w)
        rows.append((i * 3 + 1, r.choice([" ", "\n", "  ", "\t"]).join(x.upper() if r.random() < 0.1 else x for x in w)))
    return rows


def check(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_classes(df, **more).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, [*corpus(1), (1000, None), (1001, ""), (1002, " \n"), (1003, "é a b c d e f"), (1004, "É a b c d e f")])


def test_hot_buckets_in_blocks(spark):
    check(spark, corpus(2), hot_bucket=3, block=500)


def test_repeated_rows(spark):
    rows = corpus(4, 40)
    df = spark.createDataFrame([*rows, *rows], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_classes(df).collect()}
    assert got == brute(rows)


def test_links_between_is_exact():
    rows = corpus(3, 60)
    import numpy as np

    from gridloom.llm.common import shingles, text_buffers, words
    import pyarrow as pa

    raw, off = text_buffers(pa.array([t for _, t in rows]))
    h, _, _, r = words(raw, off)
    sets = [(i, s) for (i, _), s in zip(rows, shingles(h, r), strict=True) if len(s)]
    got = ngram_join.links_between(sets, None, 80)
    f = {i: i for i, _ in sets}
    for a, b in got:
        a, b = sorted((f[a], f[b]))
        f = {k: a if v == b else v for k, v in f.items()}
    want = brute(rows)
    assert {i: v for i, v in f.items()} == {i: want[i][1] for i in f}
    assert np.all([a != b for a, b in got])


def test_empty_and_missing_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_classes(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A  b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard_classes(df).select("doc_id", "component_id").collect())) == [(1, 1), (1, 1), (2, 1)]
    assert sorted(r.doc_id for r in ngram_dedup(df.where("doc_id is not null")).collect()) == [1, 1]


def test_clashing_names_and_long_texts(spark):
    r = random.Random(7)
    long = [f"w{r.randrange(9000)}" for _ in range(25_000)]
    near = [*long[:12_000], "other", *long[12_001:]]
    rows = [(1, " ".join(long), "a", 1, 2), (2, " ".join(near), "b", 2, 3), (3, None, "c", 3, 4), (None, " ".join(long), "d", 4, 5), (4, "a few words here", "e", 5, 6), (4, "a few words here", "f", 6, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, own long, gone long")
    out = ngram_dedup(df)
    assert out.columns == df.columns and sorted(x["own"] for x in out.collect()) == [1, 3, 4, 5, 6]
