"""Best-fit packing of token sequences with conflicts.

Texts are encoded and cut into pieces of at most a sequence. Pieces are dealt by a hash of the id, the text and the piece's
number to shards of bounded size; within a shard they go, largest first, each to the compatible bin with the least room that
still holds it: bins are kept in order of their residual, the search starts at the successor of the piece's size and goes on
until a bin whose bitmaps of sources and duplicate clusters hold neither the piece's source nor its cluster. A bin's
pieces are put together where they are packed: token lists are shuffled once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, text_buffers
from .token_files import END_ID, encoder

#: Tokens of a sequence and pieces of a shard; a shard of over FULL times as many pieces is split.
CAPACITY, SHARD, FULL = 2048, 2000, 4
PIECE = "id long, piece int, source string, cluster binary, n int, h long, tokens array<int>"
BIN = "bin_id long, n_tokens int, n_pieces int, doc_ids array<long>, pieces array<int>, starts array<int>, sources array<string>, tokens array<int>"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; sources and clusters are small numbers, -1 conflicts with nothing."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    free: list[tuple[int, int]] = []  # (residual, bin), ascending
    taken: list[tuple[int, int]] = []  # bitmaps of sources and clusters
    for i in order:
        n = sizes[i]
        s, c = 1 << sources[i] if sources[i] >= 0 else 0, 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(free, (n, -1))
        while at < len(free) and (taken[free[at][1]][0] & s or taken[free[at][1]][1] & c):
            at += 1
        if at < len(free):
            room, b = free.pop(at)
            taken[b] = taken[b][0] | s, taken[b][1] | c
        else:
            room, b = capacity, len(taken)
            taken.append((s, c))
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            insort(free, (room - n, b))
    return bins, offsets


def _numbers(x: list, least: int) -> list[int]:
    """Small numbers for values that occur at least so often; -1 for others and nulls."""
    counts: dict = {}
    for v in x:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    ids = {v: k for k, v in enumerate(v for v, n in counts.items() if n >= least)}
    return [ids.get(v, -1) for v in x]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of documents (id, text, source, cluster, h): the ids of their texts, and end_id, cut after each capacity."""
    enc = encoder(path)
    for b in batches:
        raw, off = text_buffers(b.column(1))
        for i, j in slices(off):
            ids, start = enc.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
            size = np.diff(start)
            size[size == 1] = 0  # the end id alone: no text
            per = -(-size // capacity)
            row = np.repeat(np.arange(j - i), per)
            no = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            first = start[:-1][row] + no * capacity
            n = np.minimum(capacity, size[row] - no * capacity)
            at = pa.array(row + i)
            take = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids[take]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(no.astype(np.int32)), b.column(2).take(at), b.column(3).take(at), pa.array(n.astype(np.int32)), b.column(4).take(at), tokens], names=[f.split()[0] for f in PIECE.split(", ")])


def _pack(key, table: pa.Table, capacity: int) -> pa.Table:
    """The bins of a shard."""
    shard, sub = (k.as_py() for k in key)
    ids, piece, source, cluster, n = (table.column(c).to_pylist() for c in ("id", "piece", "source", "cluster", "n"))
    order = sorted(range(len(ids)), key=lambda i: (-n[i], ids[i] is None, ids[i] or 0, cluster[i] or b"", piece[i]))
    ids, piece, source, cluster, n = ([x[i] for i in order] for x in (ids, piece, source, cluster, n))
    bins, starts = best_fit(n, _numbers(source, 1), _numbers(cluster, 2), capacity)
    tokens = table.column("tokens").combine_chunks()
    flat, off = tokens.values.to_numpy(), tokens.offsets.to_numpy()
    held: dict[int, list[int]] = {}
    for k, b in enumerate(bins):
        held.setdefault(b, []).append(k)
    rows = []
    for b, ks in sorted(held.items()):
        rows.append(((shard << 32) | (sub << 14) | b, sum(n[k] for k in ks), len(ks), [ids[k] for k in ks], [piece[k] for k in ks], [starts[k] for k in ks], [source[k] for k in ks], np.concatenate([flat[off[order[k]] : off[order[k] + 1]] for k in ks])))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in BIN.split(", ")])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard_rows: int = SHARD, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", cluster_col: str | None = None) -> DataFrame:
    """One row per sequence: bin_id, n_tokens (capacity at most), n_pieces, and, in order of their places, doc_ids, pieces (from 0),
    starts (tokens before each), sources and tokens.

    A document is its ids and end_id; one longer than a sequence is cut into pieces, the last of them shorter. No bin holds two
    pieces of one source or of one duplicate cluster (cluster_col, or equal texts); a null source or cluster conflicts with
    nothing; a source_col that docs lacks is none. Null and empty texts, and those without any id, are in no sequence. Rows without an
    id are packed like others; rows that repeat are rows of their own. An empty table gives an empty result. Other
    columns are ignored, whatever their names. A bin's content doesn't depend on how the input is partitioned, but where over FULL shards' worth of rows
    repeat id and text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    text = F.col(text_col)
    cluster = F.col(cluster_col).cast("string").cast("binary") if cluster_col else F.when(text.isNotNull(), F.unhex(F.md5(text.cast("binary"))))
    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), source.alias("source"), cluster.alias("cluster"), F.xxhash64(F.col(id_col).cast("long"), text).alias("h")).where("text <> ''")
    pieces = scratch.table(rows.mapInArrow(partial(_pieces, path=tokenizer, end_id=end_id, capacity=capacity), PIECE), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("h", "piece"), F.lit(shards)).cast("int"))
    over = dealt.groupBy("shard").agg(F.count("*").alias("k")).where(F.col("k") > FULL * shard_rows).select(F.col("shard").alias("o"), F.expr(f"cast(k div {shard_rows} as int)").alias("subs"))
    # a row for each shard of repeated rows: at most a row in FULL * shard_rows
    dealt = dealt.join(F.broadcast(over), dealt.shard == over.o, "left").withColumn("sub", F.when(F.col("subs").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("subs"))).cast("int"))
    return dealt.drop("o", "subs", "h").groupBy("shard", "sub").applyInArrow(lambda k, t: _pack(k, t, capacity), BIN)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
