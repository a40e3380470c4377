import math
import random
import re
from collections import Counter

import numpy as np

from gridloom.llm import decontamination as dc


def words_of(t):
    return re.findall(r"[a-z0-9éß]+", t.lower())


def bm25(items, passage):
    toks = [words_of(t) for t in items]
    n, mean = len(items), sum(map(len, toks)) / len(items)
    df = Counter(w for t in toks for w in set(t))
    out = []
    for t in toks:
        tf = Counter(t)
        out.append(sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (dc.K1 + 1) / (tf[w] + dc.K1 * (1 - dc.B + dc.B * len(t) / mean)) for w in set(passage) if w in tf))
    return out


def data(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(600)] + ["the", "of", "é"] * 30
    items = [" ".join(r.choice(vocab) for _ in range(r.randint(8, 60))).capitalize() + ". " + " ".join(r.choice(vocab) for _ in range(r.randint(1, 12))) + "." for _ in range(70)]
    docs = []
    for i in range(150):
        w = " ".join(r.choice(vocab) for _ in range(r.randint(0, 300)))
        leak = r.choice(items) if i % 3 == 0 else ""
        at = r.randint(0, len(w))
        docs.append(w[:at] + " " + leak.upper().replace(".", " ;") + " " + w[at:] if leak else w)
    return items, docs


def test_retrieval_equals_bm25(monkeypatch):
    items, docs = data(1)
    ix = dc.Index.of(list(enumerate(items)))
    passages, want = np.full((60, 64), -1), set()
    for i, d in enumerate(docs[:60]):
        x = ix.lookup(dc.text_tokens(" ".join(w := words_of(d)[:64])))
        passages[i, : len(x)] = x
        scores = bm25(items, w)
        want |= {(i, ix.ids[k], round(scores[ix.ids[k]], 6)) for k in range(len(items)) if scores[ix.ids[k]] >= ix.least[k]}
    for cells in (dc.CELLS, 1, 300):
        monkeypatch.setattr(dc, "CELLS", max(cells, 64))
        got = {(r, ix.ids[k], round(x, 6)) for r, k, x in ix.retrieve(passages)}
        assert got == want and len(want) > 5


def test_bounds_hold_for_thresholds_of_any_kind():
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(80)]
    items = [" ".join(r.choice(vocab[: r.choice([5, 20, 80])]) for _ in range(r.choice([1, 3, 30, 200]))) for _ in range(300)]
    ix = dc.Index.of(list(enumerate(items)))
    passages = np.array([[ix.lookup(dc.text_tokens(r.choice(vocab[: r.choice([8, 80])])))[0] for _ in range(64)] for _ in range(200)])
    got = {(a, b): c for a, b, c in ix.retrieve(passages)}
    for i, p in enumerate(passages):
        t = np.unique(p[p >= 0])
        some = np.isin(ix.term, t)
        score = np.bincount(ix.item[some], ix.impact[some], minlength=300)
        assert {k for k in range(300) if score[k] >= ix.least[k]} == {b for a, b in got if a == i}


def test_split_indexes_score_alike(spark):
    items, docs = data(3)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    it = spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    one, many = ({tuple(x)[:2]: tuple(x)[2:] for x in dc.benchmark_leaks(df, it, items_per_index=n).collect()} for n in (1000, 12))
    assert one and set(one) == set(many) and all(np.allclose(one[k], many[k]) for k in one)


def test_clashing_names_and_long_texts(spark):
    items, docs = data(4)
    long = " ".join(f"x{i}" for i in range(20_000)) + " " + items[5] + " " + " ".join(f"y{i}" for i in range(9_000))
    df = spark.createDataFrame([(1, long, "b", 1), (2, docs[1], None, 2), (1, "clean", "c", 3), (None, items[5], "d", 4)], "doc_id long, text string, __bad string, id long")
    it = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    out = dc.decontaminate(df, it)
    assert out.columns == df.columns and {(r[0], r[3]) for r in out.collect()} == {(2, 2), (None, 4)}


def test_leaks_are_found_and_clean_documents_left(spark):
    items, docs = data(2)
    want = {(i, k) for i, d in enumerate(docs) for k, t in enumerate(items) if " ".join(words_of(t)) in " ".join(words_of(d))}
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)] + [(900, None, "x"), (901, "", "x"), (None, items[0], "x")], "doc_id long, text string, item_id string").repartition(3)
    it = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(500, None), (501, " "), (None, "x")], "item_id long, text string")
    for bound in (20_000, 25):
        got = {(x.doc_id, x.item_id) for x in dc.benchmark_leaks(df, it, items_per_index=bound).collect()}
        assert got == want and len(want) == 50
    left = {x.doc_id for x in dc.decontaminate(df, it).collect()}
    assert left == {i for i in range(150) if i % 3} | {900, 901, None}
    assert dc.benchmark_leaks(df.limit(0), it).count() == 0 and dc.benchmark_leaks(df, it.limit(0)).count() == 0


def test_odd_items():
    ix = dc.Index.of([(1, "one"), (2, "..."), (3, "a b c"), (4, "a b c")])

    def found(ix, t):
        h = dc.text_tokens(t)
        return {x[1] for x in ix.leaks(h, np.array([0, len(h)]))}

    assert {ix.ids[k] for k in found(ix, "x one y")} == {1}
    assert {ix.ids[k] for k in found(ix, "a b c")} == {3, 4}
    assert found(dc.Index.of([]), "a") == found(ix, "") == set()
