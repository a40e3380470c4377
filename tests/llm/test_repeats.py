import random
from collections import defaultdict

import numpy as np

from gridloom.llm import repeats


def brute(rows, least):
    seqs = {(i, tuple((t or "").translate({c: c + 32 for c in range(65, 91)}).split())) for i, t in rows if i is not None}
    texts = defaultdict(set)
    where = defaultdict(set)
    for i, w in seqs:
        texts[w].add(i)
    for w in texts:
        for s in range(len(w) - least + 1):
            where[w[s : s + least]].add(w)
    out = set()
    for i, w in seqs:
        if len(w) < least:
            continue
        if len(texts[w]) > 1:
            out.add((i, 0, len(w), True))
            continue
        hit = [s for s in range(len(w) - least + 1) if len(where[w[s : s + least]]) > 1]
        spans = []
        for s in hit:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = s + least
            else:
                spans.append([s, s + least])
        out |= {(i, a, b, False) for a, b in spans}
    return out


def test_minimisers_and_grams():
    r = np.random.default_rng(1)
    for n, least, k in [(5, 9, 3), (30, 9, 3), (200, 20, 7), (60, 50, 16), (51, 50, 16), (49, 50, 16)]:
        h = r.integers(0, 2**64, n, dtype=np.uint64)
        g, at = repeats.minimisers(h, least, k)
        all_g = repeats.grams(h, k, 3)
        w = least - k + 1
        want = [s + int(np.argmin(all_g[s : s + w])) for s in range(max(0, n - least + 1))]
        assert at.tolist() == want and g.tolist() == [int(all_g[x]) for x in want]
    h = r.integers(0, 2**64, 300, dtype=np.uint64)
    h[200:250] = h[20:70]
    g = repeats.grams(h, 50, 5)
    assert len(g) == 251 and g[20] == g[200] and len(set(g.tolist())) == 250


def test_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: f"w{r.randrange(400)}"
    passages = [[word() for _ in range(r.randint(9, 40))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            w += [word() for _ in range(r.randint(0, 15))] + (p if r.random() < 0.5 else p[a:])
        rows.append((i, " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, None), (203, ""), (None, rows[4][1]), (5, rows[5][1]), (6, "x " + rows[7][1]), (204, "z " * 60), (205, "z\n" * 80)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    for options in ({}, {"run": 40, "by_filter": False}):  # short runs cut grams; positions instead of a filter
        got = [(x.doc_id, x.start_word, x.end_word, x.whole) for x in repeats.repeated_spans(df, min_words=12, k=5, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 12)
    assert repeats.repeated_spans(df.limit(0)).count() == 0


def test_one_passage_everywhere_and_a_long_text(spark):
    """A hot gram: sorted by what follows it, cut into runs; contexts that agree to one side only are no repeat."""
    r = random.Random(4)
    word = lambda: f"w{r.randrange(5000)}"
    hot = [word() for _ in range(14)]
    rows = [(i, " ".join([word() for _ in range(r.randint(0, 9))] + hot + [word() for _ in range(r.randint(0, 9))])) for i in range(300)]
    part = [word() for _ in range(9)]
    rows += [(300 + i, " ".join([f"a{i % 3}"] * 4 + part + [f"b{i // 3}"] * 4)) for i in range(9)]
    long = [word() for _ in range(30_000)]
    rows += [(400, " ".join(long)), (401, " ".join(long[20_000:20_500] + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {(x.doc_id, x.start_word, x.end_word, x.whole) for x in repeats.repeated_spans(df, min_words=12, k=6, run=50).collect()}
    assert got == brute(rows, 12) and (400, 20_000, 20_500, False) in got and sum(i < 300 for i, *_ in got) == 300
