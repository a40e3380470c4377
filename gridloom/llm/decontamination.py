"""Benchmark decontamination: BM25 over an inverted index of test items, queried by every passage of the corpus.

Word counts of all items are taken first, then items are dealt to blocks of at most about ITEMS items and WORDS words, and
the index of each block is made in a task and broadcast by itself, so what is held at once has a fixed bound. A passage is
PASSAGE words (every STRIDE words, the last one at the end). Its score for an item is BM25 summed over the distinct words of the passage; an
item is retrieved where the score reaches ALPHA of the item's score against itself. A retrieved item leaks where enough of
its question's and of its answer's word runs stand in the passage's surroundings.

Retrieval is block-max WAND for many passages at once. A passage's posting lists are ordered by their greatest impact; those before
the pivot can't reach the least threshold all together, so only blocks of items that a list from the pivot on holds are
looked at; their bounds are summed from the blocks' greatest impacts, first with the lists before the pivot taken at their
whole list's greatest, then at the block's; the postings of blocks that may still reach their threshold are scored.
Items are numbered by their threshold, so that a block's items have thresholds alike.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIGNS, Scratch, mix, slices, text_buffers, words

K1, B = 1.2, 0.75
PASSAGE, STRIDE, ALPHA = 64, 32, 0.5
#: Items and words of one index (about 100 MB), and items of one block of a posting list.
ITEMS, WORDS, BLOCK = 100_000, 4_000_000, 16
#: Cells (passages by blocks of items) that are summed at once.
CELLS = 1 << 21
#: Least share of the question's and of the answer's word runs.
QUESTION, ANSWER, RUN = 0.6, 0.5, 5
_SIGN_START = np.zeros(256, bool)
_SIGN_START[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased text without signs, and the index of each row's first (n+1)."""
    h, first, _, rows = words(raw, off, SIGNS)
    keep = ~_SIGN_START[raw[first]] if len(first) else np.zeros(0, bool)
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[rows]


def text_tokens(text: str) -> np.ndarray:
    return tokens(*text_buffers(pc.utf8_lower(pa.array([text], pa.large_string()))))[0]


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence (or line) is the answer, what stands before it the question; of one sentence, its last third of words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    cut = len(w) - len(w) // 3
    return " ".join(w[:cut]), " ".join(w[cut:])


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the runs of k words (of all words, if fewer)."""
    k = min(k, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        s = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            s = mix(s, 3) + h[j : j + len(s)]
    return np.unique(mix(s, 20 + k))


def item_words(text: str) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Distinct words of an item, how often each stands in it, and the runs of its question and its answer."""
    w, c = np.unique(text_tokens(text or ""), return_counts=True)
    return w, c, tuple((min(RUN, len(h := text_tokens(p))), runs(h, RUN)) for p in question_and_answer(text or ""))


def _less(x):
    """A bound that rounding doesn't miss."""
    return x * (1 - 1e-9)


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start to before its end, and the place of each number's range."""
    n = end - start
    who = np.repeat(np.arange(len(n)), n)
    return np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + start[who], who


class Index:
    """Inverted index of items: postings with impacts in order of word and item, cut into blocks of BLOCK items with the
    greatest impact of each.

    items: id, runs (see question_and_answer) and the word numbers and counts of each; df, n and mean: how many of all
    items have each word of vocab (sorted), how many items there are, and their mean length.
    """

    def __init__(self, items: list[tuple[int, tuple, np.ndarray, np.ndarray]], vocab: np.ndarray, df: np.ndarray, n: int, mean: float):
        lengths = np.array([int(c.sum()) for _, _, _, c in items], np.int64)
        sizes = np.array([len(w) for _, _, w, _ in items], np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *[w for _, _, w, _ in items]])
        tf = np.concatenate([np.zeros(0, np.int64), *[c for _, _, _, c in items]])
        item = np.repeat(np.arange(len(items)), sizes)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / max(1.0, mean)))[item])
        own = np.bincount(item, impact, minlength=len(items))
        # a long item can't have all its words in one passage: STRIDE + STRIDE / 2 of them are sure to be
        least = ALPHA * own * np.minimum(1, (PASSAGE - STRIDE / 2) / np.maximum(1, lengths))
        least[lengths == 0] = np.inf
        order = np.argsort(least, kind="stable")
        rank = np.empty(len(items), np.int64)
        rank[order] = np.arange(len(items))
        self.ids, self.runs = [items[i][0] for i in order], [items[i][1] for i in order]
        self.length, self.least, self.vocab = lengths[order], least[order], vocab
        o = np.lexsort((rank[item], term))
        self.term, self.item, self.impact = term[o], rank[item[o]], impact[o]
        v, self.blocks = len(vocab), max(1, -(-len(items) // BLOCK))
        self.best = np.zeros(v + 1)
        np.maximum.at(self.best, self.term, self.impact)
        # blocks of posting lists: their key (word and block), first posting and greatest impact
        key = self.term * self.blocks + self.item // BLOCK
        self.first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.key = key[self.first]
        self.block_best = np.maximum.reduceat(self.impact, self.first) if len(key) else np.zeros(0)
        self.first = np.append(self.first, len(key))
        self.block_start = np.searchsorted(self.key, np.arange(v + 2) * self.blocks)
        self.block_least = np.full(self.blocks, np.inf)
        np.minimum.at(self.block_least, np.arange(len(items)) // BLOCK, self.least)
        bits = 16
        self.shift = np.uint64(64 - bits)
        slot = (self.vocab >> self.shift).astype(np.int64)
        self.bucket = np.searchsorted(slot, np.arange((1 << bits) + 1))
        self.deep = int(np.diff(self.bucket).max()) if v else 0

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index:
        """Of all items there are."""
        rows = [item_words(t) for _, t in items]
        vocab, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *[w for w, _, _ in rows]]), return_counts=True)
        mean = sum(int(c.sum()) for _, c, _ in rows) / max(1, len(rows))
        return cls([(i, r, np.searchsorted(vocab, w), c) for (i, _), (w, c, r) in zip(items, rows, strict=True)], vocab, df, len(items), mean)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no item has."""
        out = np.full(len(h), -1, np.int64)
        if not self.deep:
            return out
        slot = (h >> self.shift).astype(np.int64)
        lo, hi = self.bucket[slot], self.bucket[slot + 1]
        some = np.flatnonzero(hi > lo)
        for d in range(self.deep):
            at = lo[some] + d
            ok = at < hi[some]
            some, at = some[ok], at[ok]
            hit = self.vocab[at] == h[some]
            out[some[hit]] = at[hit]
        return out

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, int, float]]:
        """(row, item number, score) for the rows of word numbers (-1: none) whose score reaches the item's least."""
        v, least = len(self.vocab), self.least[0] if len(self.least) else np.inf
        t = np.sort(np.where(terms < 0, v, terms), axis=1)
        t[:, 1:][t[:, 1:] == t[:, :-1]] = v
        o = np.argsort(self.best[t], axis=1)
        t = np.take_along_axis(t, o, 1)
        most = np.cumsum(self.best[t], axis=1)
        rows = np.flatnonzero(most[:, -1] >= _less(least))
        out = []
        for lo in range(0, len(rows), step := max(1, CELLS // self.blocks)):
            some = rows[lo : lo + step]
            out += [(int(some[r]), i, x) for r, i, x in self._reached(t[some], most[some], least)]
        return out

    def _reached(self, t: np.ndarray, most: np.ndarray, least: float) -> list[tuple[int, int, float]]:
        """For rows of words in order of their lists' greatest impacts, whose running sums are ``most``."""
        n, width = t.shape
        pivot = (most < _less(least)).sum(1)
        before = np.where(pivot > 0, most[np.arange(n), np.maximum(pivot - 1, 0)], 0.0)
        r, c = np.nonzero((np.arange(width) >= pivot[:, None]) & (t < len(self.vocab)))
        at, who = _expand(self.block_start[t[r, c]], self.block_start[t[r, c] + 1])
        bound = np.bincount(r[who] * self.blocks + self.key[at] % self.blocks, self.block_best[at], minlength=n * self.blocks).reshape(n, self.blocks)
        r, blk = np.nonzero((bound > 0) & (bound + before[:, None] >= _less(self.block_least)))
        out = []
        for lo in range(0, len(r), step := CELLS // width):
            out += self._scored(r[lo : lo + step], blk[lo : lo + step], t)
        return out

    def _scored(self, r: np.ndarray, blk: np.ndarray, t: np.ndarray) -> list[tuple[int, int, float]]:
        """Items of blocks ``blk`` that rows ``r`` of t reach."""
        pair, c = np.nonzero(t[r] < len(self.vocab))
        key = t[r[pair], c] * self.blocks + blk[pair]
        at = np.searchsorted(self.key, key)
        has = at < len(self.key)
        has[has] = self.key[at[has]] == key[has]
        pair, at = pair[has], at[has]
        may = np.bincount(pair, self.block_best[at], minlength=len(r)) >= _less(self.block_least[blk])
        pair, at = pair[may[pair]], at[may[pair]]
        post, who = _expand(self.first[at], self.first[at + 1])
        score = np.bincount(pair[who] * BLOCK + self.item[post] % BLOCK, self.impact[post], minlength=len(r) * BLOCK).reshape(len(r), BLOCK)
        item = blk[:, None] * BLOCK + np.arange(BLOCK)
        least = np.append(self.least, np.full(BLOCK, np.inf))[item]
        return [(int(r[p]), int(item[p, k]), float(score[p, k])) for p, k in zip(*np.nonzero(score >= _less(least)), strict=True)]

    def leaks(self, h: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, item number, best score, question share, answer share) for rows of word hashes (n+1 indexes of first words)."""
        if not len(h) or not len(self.ids) or not self.deep:
            return []
        term = np.append(self.lookup(h), -1)
        first, last = rows[:-1], rows[1:]
        size = last - first
        per = np.where(size > 0, 1 + np.maximum(0, -(-(size - PASSAGE) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(size)), per)
        no = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = first[doc] + np.minimum(no * STRIDE, np.maximum(0, size[doc] - PASSAGE))
        end = np.minimum(start + PASSAGE, last[doc])
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for lo in range(0, len(doc), 16_384):
            at = start[lo : lo + 16_384, None] + np.arange(PASSAGE)
            at[at >= end[lo : lo + 16_384, None]] = len(h)
            for p, item, score in self.retrieve(term[at]):
                d, n = int(doc[lo + p]), int(self.length[item])
                a, e = max(int(first[d]), int(start[lo + p]) - n), min(int(last[d]), int(end[lo + p]) + n)
                share = [float(np.isin(r, runs(h[a:e], k), assume_unique=True).mean()) if len(r) else 1.0 for k, r in self.runs[item]]
                if share[0] >= QUESTION and share[1] >= ANSWER:
                    old = best.get((d, item), (0.0, 0.0, 0.0))
                    best[d, item] = tuple(max(x) for x in zip(old, (score, *share), strict=True))
        return [(d, item, *v) for (d, item), v in best.items()]


_HELD: list = []


def _held(index) -> Index:
    """One index per worker process: the last one that its tasks have used."""
    mark = zlib.crc32(index.value)
    if not _HELD or _HELD[0] != mark:
        _HELD[:] = [mark, pickle.loads(zlib.decompress(index.value))]
    return _HELD[1]


def _search(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    ix = _held(index)
    for b in batches:
        ids = b.column(0).to_pylist()
        raw, off = text_buffers(pc.utf8_lower(b.column(1)))
        out = []
        for i, j in slices(off):
            h, rows = tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            out += [(ids[i + d], ix.ids[k], *v) for d, k, *v in ix.leaks(h, rows)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score", "question_share", "answer_share"])


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (as bytes), their counts and the pickled runs of each item."""
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            rows = [item_words(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w.view(np.int64) for w, _, _ in rows], pa.list_(pa.int64())), pa.array([c for _, c, _ in rows], pa.list_(pa.int32())), pa.array([pickle.dumps(r) for _, _, r in rows], pa.binary())], names=["item_id", "words", "counts", "runs"])


def _build(table: pa.Table, n: int, mean: float) -> pa.Table:
    """The index of a block of items: one row each, with the counts (df) of its words among all items."""
    cols = [table.column(x).to_pylist() for x in ("item_id", "words", "counts", "df", "runs")]
    order = sorted(range(len(cols[0])), key=lambda i: (cols[0][i], cols[4][i]))
    flat = np.array([w for i in order for w in cols[1][i]], np.int64).view(np.uint64)
    vocab, at, inv = np.unique(flat, return_index=True, return_inverse=True)
    df = np.array([d for i in order for d in cols[3][i]], np.int64)[at]
    ends = np.cumsum([0] + [len(cols[1][i]) for i in order])
    items = [(cols[0][i], pickle.loads(cols[4][i]), inv[ends[k] : ends[k + 1]].astype(np.int64), np.array(cols[2][i], np.int64)) for k, i in enumerate(order)]
    blob = zlib.compress(pickle.dumps(Index(items, vocab, df, n, mean)), 1)
    return pa.table({"blk": pa.array([table.column("blk")[0].as_py()], pa.int32()), "index": pa.array([blob], pa.large_binary()).cast(pa.binary())})


def build_indexes(items: DataFrame, scratch: Scratch, items_per_index: int = ITEMS) -> tuple[DataFrame, int]:
    """A table of indexes (blk, index), each made in a task, and their number. items: item_id, text."""
    rows = scratch.table(items.mapInArrow(_item_rows, "item_id long, words array<long>, counts array<int>, runs binary").withColumn("no", F.expr("uuid()")), "items")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.expr("aggregate(counts, 0L, (s, c) -> s + c)")), F.lit(0))).first()
    if not n:
        return rows, 0
    blocks = 1 if n <= items_per_index and total <= WORDS else int(max(-(-2 * n // items_per_index), -(-2 * total // WORDS)))  # half full each, so none is over the bound
    words_of = rows.select("no", F.posexplode("words").alias("at", "word"))
    df = words_of.groupBy("word").agg(F.count("*").alias("df"))
    counted = words_of.join(df, "word").groupBy("no").agg(F.expr("transform(sort_array(collect_list(struct(at, df))), x -> x.df)").alias("df"))
    full = rows.join(counted, "no").withColumn("blk", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int")).drop("no")
    mean = total / n
    return scratch.table(full.groupBy("blk").applyInArrow(lambda t: _build(t, n, mean), "blk int, index binary"), "indexes"), blocks


def benchmark_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", items_per_index: int = ITEMS) -> DataFrame:
    """One row per document and test item whose text leaks into it: doc_id, item_id, score (the best passage's BM25),
    question_share and answer_share (of their runs of five words, found around that passage).

    Null or empty texts and items leak nowhere; rows without an id take no part; documents that repeat give a row
    each, items that repeat count once; other columns are ignored; an empty table gives an empty result. Documents are read once
    for each index and never shuffled. With several indexes, what the documents of one give is written before the next is held.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    it = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and trim(text) <> ''").distinct()
    schema = "doc_id long, item_id long, score double, question_share double, answer_share double"
    indexes, blocks = build_indexes(it, scratch, items_per_index)
    out = None
    for blk in range(blocks):
        row = indexes.where(F.col("blk") == blk).select("index").first()  # of bounded size
        if row is None:
            continue
        held = spark.sparkContext.broadcast(bytes(row[0]))
        found = src.mapInArrow(partial(_search, index=held), schema)
        if blocks > 1:
            found = scratch.table(found, "found")
            held.unpersist()
        out = found if out is None else out.unionByName(found)
    out = out if out is not None else spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_id_col})


def decontaminate(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """docs without the documents into which an item leaks. Documents without an id, and those with null or empty texts, stay; of
    rows that repeat an id all go if one does. Columns keep their names, whatever they are."""
    id_col = columns.get("id_col", "doc_id")
    bad = benchmark_leaks(docs, items, **columns).select(F.col(id_col).alias("id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("own"))
    return rows.join(bad, rows.own == bad.id, "left_anti").select("row.*")


def op9_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    return benchmark_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
