"""Passages that repeat across documents, by a sparse suffix array.

Of a document's suffixes only those at content-selected positions are kept: minimisers, the least hash among
consecutive K-word grams. Any passage of MIN_WORDS words holds one, at the same place wherever it stands. Suffixes whose leading
gram stands in two different documents are written with the words around the gram and sorted, by ranges of gram and following
words, so that a gram that is everywhere is split by what follows it. Neighbours are compared: the words that two of them share to
the right, and, in the order of the words before the gram, to the left, tell how far the match of each suffix can be
extended, left and right together, to MIN_WORDS words or more. Grams that lie across the end of a range leave one row for
each distinct extension, which are compared between ranges. Overlapping extensions are joined to maximal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _STEP, Scratch, filter_bits, hash_filter, in_filter, join_weighted, mix, shuffle_partitions, signature, slices, text_buffers, words

#: A repeat has this many words at least; a passage of so many holds MIN_WORDS - K + 1 grams of K words.
MIN_WORDS, K = 50, 25
#: Sorted suffixes that a task compares at once (46 MB).
RUN = 200_000
SUFFIX = "key long, c1 long, c2 long, at int, n int, left binary, right binary"
FOUND = "k2 long, done boolean, c1 long, c2 long, s int, e int"


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of k words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        # doubling: runs of 1, 2, 4, ... words are joined to runs of k
        have, done, span, n = h, None, 1, k
        at = 0
        while n:
            if n & 1:
                if done is None:
                    done, at = have, span
                else:
                    m = min(len(done), len(have) - at)
                    done, at = done[:m] * _STEP[seed] + mix(have[at : at + m], seed), at + span
            n >>= 1
            if n:
                have = have[: len(have) - span] * _STEP[seed + 1] + mix(have[span:], seed)
                span *= 2
        return mix(done[: len(h) - k + 1], seed + 7)


def minimisers(h: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram and its position that each passage of ``least`` words selects (leftmost of equals)."""
    g = grams(h, k, 3)
    w = least - k + 1
    if len(g) < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(len(g))
    best, span = at, 1
    while span * 2 <= w:  # the least of 1, 2, 4, ... grams
        a, b = best[: len(best) - span], best[span:]
        best = np.where(g[b] < g[a], b, a)
        span *= 2
    a, b = best[: len(g) - w + 1], best[w - span : w - span + len(g) - w + 1]
    best = np.where(g[b] < g[a], b, a)
    return g[best], best


def kept_suffixes(h: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct selected positions, ascending, and their grams."""
    g, at = minimisers(h, least, k)
    new = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
    return g[new], at[new]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Batch, row in it and word hashes of each document; its columns begin with the id and the text."""
    for b in batches:
        raw, off = text_buffers(b.column(1))
        for i, j in slices(off):
            h, _, _, rows = words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            for x, a, e in zip(range(i, j), rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                yield b, x, h[a:e]


def _class(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a sequence of words, as two signed longs."""
    with np.errstate(over="ignore"):
        return signature(mix(h) + np.arange(len(h), dtype=np.uint64) * _STEP[9])


class Seen:
    """The classes that a task has met, up to a bound: it saves work, the result doesn't need it."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, set()

    def __call__(self, c) -> bool:
        if c in self.known:
            return True
        if len(self.known) < self.most:
            self.known.add(c)
        return False


def _anchors(batches: Iterator[pa.RecordBatch], least: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, n, c1, c2), and rows of kept suffixes (key, c1)."""
    docs: list[tuple] = []
    keys, cls, held, seen = [], [], 0, Seen()

    def flush():
        m, x = len(docs), [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (keys, cls)]
        none = pa.nulls(len(x[0]), pa.int64())
        cols = [pa.array([d[j] for d in docs], pa.int64()) for j in range(4)]
        more = [none, none, pa.array(x[1], pa.int64()), none]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(v) for v in zip(cols, more, strict=True)] + [pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(x[0], pa.int64())])], names=["doc_id", "n", "c1", "c2", "key"])

    for b, i, h in _rows(batches):
        if len(h) < least:
            continue
        c = _class(h)
        docs.append((b.column(0)[i].as_py(), len(h), *c))
        if not seen(c):
            one = np.unique(kept_suffixes(h, least, k)[0]).view(np.int64)
            keys.append(one)
            cls.append(np.full(len(one), c[0], np.int64))
            held += len(one)
        if held > 200_000 or len(docs) > 20_000:
            yield flush()
            docs, keys, cls, held = [], [], [], 0
    yield flush()


def _places(batches: Iterator[pa.RecordBatch], least: int, k: int) -> Iterator[pa.RecordBatch]:
    """All kept suffixes with their document: key, doc_id, c1, c2, at."""
    seen = Seen()
    for b, i, h in _rows(batches):
        if len(h) < least or seen(c := _class(h)):
            continue
        g, at = kept_suffixes(h, least, k)
        m = len(g)
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array([b.column(0)[i].as_py()] * m, pa.int64()), pa.array(np.full(m, c[0], np.int64)), pa.array(np.full(m, c[1], np.int64)), pa.array(at.astype(np.int32))], names=["key", "doc_id", "c1", "c2", "at"])


def _suffixes(batches: Iterator[pa.RecordBatch], least: int, k: int, shared=None) -> Iterator[pa.RecordBatch]:
    """The suffixes whose gram may be shared, each with least - k words before and after the gram (less at the ends).

    shared: a filter of grams; without one the batches have columns c1, c2 and at, the class and the positions.
    """
    names, reach = [f.split()[0] for f in SUFFIX.split(", ")], least - k
    out: list[list] = [[] for _ in names]
    held, seen = 0, Seen()

    def flush():
        cols = [np.concatenate(x) for x in out[:5]]
        flat = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * reach), len(cols[0]), [None, pa.py_buffer(np.concatenate(x).astype(">u4").tobytes())]).cast(pa.binary()) for x in out[5:]] if reach else [pa.array([b""] * len(cols[0]), pa.binary())] * 2
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], *flat], names=names)

    for b, i, h in _rows(batches):
        if len(h) < least:
            continue
        if shared is not None:
            g, at = kept_suffixes(h, least, k)
            some = in_filter(shared.value, g)
            if not some.any():
                continue
            g, at = g[some], at[some]
            c = _class(h)
        else:
            c, at = _class(h), np.array(b.column(4)[i].as_py(), np.int64)
            if c != (b.column(2)[i].as_py(), b.column(3)[i].as_py()):
                continue
            g = grams(h, k, 3)[at]
        if seen(c):
            continue
        wide = np.concatenate([np.zeros(reach, np.uint32), (h >> np.uint64(32)).astype(np.uint32), np.zeros(reach, np.uint32)])
        step, m = np.arange(reach), len(at)
        for x, v in zip(out, (g.view(np.int64), np.full(m, c[0], np.int64), np.full(m, c[1], np.int64), at.astype(np.int32), np.full(m, len(h), np.int32), wide[at[:, None] + reach - 1 - step], wide[at[:, None] + reach + k + step]), strict=True):
            x.append(v)
        held += m
        if held > 50_000:
            yield flush()
            out, held = [[] for _ in names], 0
    if held:
        yield flush()


def _shared_words(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many leading words each row shares with the row before it; 0 where a group begins."""
    same = np.zeros(a.shape, bool)
    same[1:] = (a[1:] == a[:-1]) & ~first[1:, None]
    return np.logical_and.accumulate(same, axis=1).sum(1)


def compare(key: np.ndarray, c1: np.ndarray, at: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, list]:
    """For suffixes sorted by gram and the words after it: the first and end word of what each repeats of another class
    (0, 0: nothing), and, per reach to the left, the suffixes that have it, the number of their extension and whether it repeats."""
    reach, m = least - k, len(key)
    first = np.append(True, key[1:] != key[:-1])
    right_shared = _shared_words(right, first)
    group = np.cumsum(first)
    o = pc.sort_indices(pa.table({"g": group, "w": pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * reach), m, [None, pa.py_buffer(left.astype(">u4").tobytes())])}), [("g", "ascending"), ("w", "ascending")]).to_numpy() if reach else np.arange(m)
    left_shared = _shared_words(left[o], np.append(True, group[o[1:]] != group[o[:-1]]))
    s, e = np.zeros(m, np.int64), np.zeros(m, np.int64)
    each = []
    lid = np.empty(m, np.int64)
    new_left, new_right = np.append(True, group[o[1:]] != group[o[:-1]]), first
    for x in range(reach + 1):  # x words before the gram, reach - x after it
        lid[o] = np.cumsum(new_left | (left_shared < x))
        rid = np.cumsum(new_right | (right_shared < reach - x))
        can = np.flatnonzero((at >= x) & (n - at - k >= reach - x))
        same = lid[can] * (m + 1) + rid[can]
        p = np.argsort(same, kind="stable")
        can, same = can[p], same[p]
        start = np.flatnonzero(np.append(True, same[1:] != same[:-1])) if len(can) else np.zeros(0, np.int64)
        some = np.repeat(np.minimum.reduceat(c1[can], start) != np.maximum.reduceat(c1[can], start), np.diff(np.append(start, len(can)))) if len(can) else np.zeros(0, bool)
        hit = can[some]
        e[hit] = np.where(e[hit] == 0, at[hit] - x + least, e[hit])
        s[hit] = at[hit] - x  # x ascends: the furthest to the left comes last
        each.append((can, same, some))
    return s, e, each


def _open(rows: np.ndarray, key, c1, c2, at, left, right, each) -> list[np.ndarray]:
    """Of suffixes of grams that other runs may hold too (rows: a mask), for each extension: its hash, whether it is found to
    repeat, class and first word. Extensions that repeat leave two classes, others all their suffixes (of one class)."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    with np.errstate(over="ignore"):
        lh, rh = [mix(key.view(np.uint64), 31)], [np.zeros(len(key), np.uint64)]
        for j in range(left.shape[1]):
            lh.append(mix(lh[-1] * _STEP[7] + left[:, j].astype(np.uint64), 32))
            rh.append(mix(rh[-1] * _STEP[8] + right[:, j].astype(np.uint64), 33))
        for x, (can, same, some) in enumerate(each):
            own = rows[can]
            if not own.any():
                continue
            i, same, some = can[own], same[own], some[own]
            p = np.lexsort((c1[i], same))  # the least and the greatest class of an extension stand at its ends
            i, same, some = i[p], same[p], some[p]
            new = np.append(True, same[1:] != same[:-1])
            take = ~some | new | np.append(new[1:], True)
            i = i[take]
            h = mix(lh[x][i] * _STEP[10] + rh[len(each) - 1 - x][i] + np.uint64(x), 34)
            for v, y in zip(out, (h.view(np.int64), some[take], c1[i], c2[i], (at[i] - x).astype(np.int64)), strict=True):
                v.append(y)
    return [np.concatenate(v) if v else np.zeros(0, np.int64) for v in out]


def _neighbours(batches: Iterator[pa.RecordBatch], least: int, k: int, run: int) -> Iterator[pa.RecordBatch]:
    """What sorted suffixes repeat: rows s, e of a class; and rows k2, done, s of extensions at the ends of a run."""
    reach = least - k

    def words_of(col) -> np.ndarray:
        return np.frombuffer(b"".join(col.to_pylist()), ">u4").reshape(len(col), reach).astype(np.uint32)

    def done(t: pa.Table, first: bool, last: bool) -> pa.RecordBatch:
        key, c1, c2, at, n = (t.column(j).to_numpy().astype(np.int64) for j in range(5))
        left, right = words_of(t.column(5)), words_of(t.column(6))
        s, e, each = compare(key, c1, at, n, left, right, least, k)
        hit = np.flatnonzero(e)
        edge = (key == key[0]) & first | (key == key[-1]) & last
        k2, told, o1, o2, start = _open(edge, key, c1, c2, at, left, right, each) if edge.any() else [np.zeros(0, np.int64)] * 5
        none, m = pa.nulls(len(hit)), len(k2)
        cols = [(none, k2), (none, told.astype(bool)), (c1[hit], o1), (c2[hit], o2), (s[hit], start), (e[hit], start + least)]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(y) if isinstance(x, pa.Array) else pa.array(x).cast(y), pa.array(z[:m]).cast(y)]) for (x, z), y in zip(cols, types, strict=True)], names=["k2", "done", "c1", "c2", "s", "e"])

    held: list[pa.RecordBatch] = []
    size, cut = 0, True  # cut: the run's first gram may have begun before it
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= run:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column(0).to_numpy()
            to = int(np.searchsorted(keys == keys[-1], True))  # the last gram goes on with the next run
            whole = to > 0
            to = to or size
            yield done(t.slice(0, to), cut, not whole)
            held, size = t.slice(to).to_batches(), size - to
            cut = not whole
    if size:
        yield done(pa.Table.from_batches(held).combine_chunks(), cut, True)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, by_filter: bool = True) -> DataFrame:
    """One row per maximal span of words of a document all of which lie in passages of ``min_words`` words that stand in
    another, different document too: doc_id, start_word, end_word (exclusive), n_words, whole (the document's text is one that
    stands in several documents; then the span is all of it).

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. Documents without such a passage, with
    fewer words, null or empty texts and rows without an id have no row; rows that repeat an id with different
    texts are different documents, with one text they are the same one. Other columns are ignored; an empty table
    gives an empty result. Words around a gram are compared by 32 bits of their hash, grams by 64, whole texts by 128.

    Shared grams reach the documents as a filter, or, where there are too many for one (or by_filter is False), as
    positions, by a join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    both = scratch.table(src.mapInArrow(partial(_anchors, least=min_words, k=k), "doc_id long, n long, c1 long, c2 long, key long"), "anchors")
    shared = scratch.table(both.where("key is not null").groupBy("key").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a <> b").select("key"), "shared")
    scratch.release()
    bits = filter_bits(shared.count())
    if bits is not None and by_filter:
        held = spark.sparkContext.broadcast(hash_filter(shared, bits))
        rows = src.mapInArrow(partial(_suffixes, least=min_words, k=k, shared=held), SUFFIX)
    else:
        places = src.mapInArrow(partial(_places, least=min_words, k=k), "key long, doc_id long, c1 long, c2 long, at int").join(shared, "key", "left_semi")
        places = places.groupBy("doc_id", "c1", "c2").agg(F.sort_array(F.collect_set("at")).alias("at")).withColumnRenamed("doc_id", "id")
        rows = src.join(places, src.doc_id == places.id).select("doc_id", "text", "c1", "c2", "at")
        rows = rows.mapInArrow(partial(_suffixes, least=min_words, k=k), SUFFIX)
    rows = scratch.table(rows, "suffixes")
    scratch.release()
    order = ["key", "right", "c1", "at"]  # ties of gram and words after it are split too
    found = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    found = scratch.table(found.mapInArrow(partial(_neighbours, least=min_words, k=k, run=run), FOUND), "found")
    scratch.drop(rows, shared)
    scratch.release()
    # extensions at the ends of runs: a few rows for each run that has one
    ends = found.where("k2 is not null")
    across = ends.groupBy("k2").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a <> b").select("k2")
    late = ends.where("not done").join(across, "k2", "left_semi").select("c1", "c2", "s", "e")
    pieces = found.where("k2 is null").select("c1", "c2", "s", "e").unionByName(late)
    w = W.partitionBy("c1", "c2").orderBy("s", "e")  # pieces of one text
    marked = pieces.withColumn("new", F.when(F.col("s") > F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)), 1).otherwise(0))
    spans = marked.withColumn("no", F.sum("new").over(w)).groupBy("c1", "c2", "no").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = scratch.table(spans.select(F.col("c1").alias("s1"), F.col("c2").alias("s2"), F.col("s").cast("long").alias("start_word"), F.col("e").cast("long").alias("end_word")), "spans")
    scratch.drop(found)

    texts = both.where("doc_id is not null").select("doc_id", "n", "c1", "c2")
    classes = scratch.table(texts.groupBy("c1", "c2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("rows")).withColumnsRenamed({"c1": "k1", "c2": "k2"}), "classes")
    told = join_weighted(texts, classes, [("c1", "k1"), ("c2", "k2")], "rows").distinct()
    whole = told.where("a <> b").select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.lit(True).alias("whole"))
    single = classes.where("a = b").select(F.col("a").alias("doc_id"), "k1", "k2")
    part = single.join(spans, (single.k1 == spans.s1) & (single.k2 == spans.s2)).select("doc_id", "start_word", "end_word", F.lit(False).alias("whole"))
    out = whole.unionByName(part)
    return out.select(F.col("doc_id").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "whole")


def op7_suffix_array_repeats(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
