"""What the operators share: scratch tables, word hashes, bounded sketches, packed rows and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage; drop() removes those that no lazy result reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}_{name}"

    def table(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        df.write.parquet(p := self.path(name), compression=compression)
        out = self.spark.read.schema(df.schema).parquet(p)
        out._scratch_path = p
        return out

    def drop(self, *tables: DataFrame | str | None) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            p = t if isinstance(t, str) else getattr(t, "_scratch_path", None)
            if p:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Lets go of the shuffle files of steps whose results are written: Spark's cleaner takes them once nothing refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# ---------------------------------------------------------------- words and shingles

_rng = np.random.default_rng(20240229)
_CHAR = _rng.integers(1, 2**64, (64, 256), dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHAR[:, _SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Cuts between an ASCII letter and an ASCII digit or sign other than the apostrophe; between letters (any beyond ASCII) and ASCII signs.
ASCII_SIGNS, SIGNS = np.zeros(256, np.uint8), np.ones(256, np.uint8)
ASCII_SIGNS[33:127], ASCII_SIGNS[97:123], ASCII_SIGNS[39] = 2, 1, 0
SIGNS[33:127], SIGNS[48:58], SIGNS[97:123] = 2, 1, 1
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that scatters them (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows; null is empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    arr = arr.fill_null("").cast(pa.large_string())
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, len(arr) + 1, arr.offset * 8) if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about SLICE_BYTES at most (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word [^\\x20\\x09-\\x0D]+ (A-Z lower-cased), and the index of each row's first word (n+1).

    cut: a kind for each byte; words are also cut between bytes of kinds 1 and 2.
    """
    if not len(raw):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    data = _LOWER[raw]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if cut is not None:
        kind = cut[data]
        edge[1:-1] |= kind[1:] * kind[:-1] == 2
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    first = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    rows = np.searchsorted(first, offsets)
    if not len(first):
        return np.zeros(0, np.uint64), first, end, rows
    begin = first if first[0] == 0 else np.concatenate([[0], first])
    at = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
    with np.errstate(over="ignore"):
        term = _CHAR[at & 63, data]
        if (end - first).max() > 64:
            far = at > 63
            term[far] *= _STEP[(at[far] >> 6) & 63] + np.uint64(2) * (at[far] >> 12).astype(np.uint64)
        total = np.add.reduceat(term, first)
        return mix(total + (end - first).astype(np.uint64)), first, end, rows


def shingles(h: np.ndarray, rows: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; with fewer words the whole sequence as one; none without words."""
    with np.errstate(over="ignore"):
        if len(h) >= k:
            n = len(h) - k + 1
            s = np.zeros(n, np.uint64)
            for j in range(k):
                s += h[j : j + n] * _STEP[j]
            s = mix(s, 1)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                yield mix((h[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a), 2)
            else:
                yield np.zeros(0, np.uint64)


def signature(sets: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set of hashes, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix(sets, 3).sum(), mix(sets, 4).sum()
        pair = mix(np.array([a + np.uint64(len(sets)), b], np.uint64), 5)
    x, y = pair.view(np.int64).tolist()
    return x, y


# ---------------------------------------------------------------- a sketch of fixed size

#: Counters of a sketch: fixed, so what is collected and broadcast doesn't grow with the data.
SKETCH_BITS, SKETCH_BLOCKS = 22, 64


class Sketch:
    """Counts by hash slot in one task, at most 255 each; emitted as compressed blocks."""

    def __init__(self, bits: int = SKETCH_BITS):
        self.bits, self.c = bits, np.zeros(1 << bits, np.int32)

    def add(self, h: np.ndarray) -> None:
        np.add.at(self.c, (h >> np.uint64(64 - self.bits)).astype(np.int64), np.int32(1))

    def blocks(self) -> list[tuple[int, bytes]]:
        parts = np.minimum(self.c, 255).astype(np.uint8).reshape(SKETCH_BLOCKS, -1)
        return [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(parts) if p.any()]


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(z), np.uint8).astype(np.int64)
            total[i] = total[i] + x if i in total else x
    for i, x in total.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "z": pa.array([zlib.compress(np.minimum(x, 2**31 - 1).astype(np.int32).tobytes(), 1)], pa.binary())})


def merged_sketch(parts: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Sum of all tasks' blocks (block int, z binary): 2**bits counters, whatever the input."""
    out = np.zeros((SKETCH_BLOCKS, (1 << bits) // SKETCH_BLOCKS), np.int32)
    for i, z in parts.repartition(SKETCH_BLOCKS, "block").mapInArrow(_sum_blocks, "block int, z binary").collect():
        out[i] = np.frombuffer(zlib.decompress(z), np.int32)
    return out.ravel()


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = Sketch()
    for b in batches:
        s.add(mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 9))
    if blocks := s.blocks():
        yield pa.RecordBatch.from_pydict({"block": pa.array([i for i, _ in blocks], pa.int32()), "z": pa.array([z for _, z in blocks], pa.binary())})


def id_filter(ids: DataFrame) -> np.ndarray:
    """Packed bits of a one-hash Bloom filter of a long column: fixed size, false hits possible, no misses."""
    return np.packbits(merged_sketch(ids.mapInArrow(_id_blocks, "block int, z binary")) > 0)


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = (mix(ids.astype(np.int64).view(np.uint64), 9) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


#: A filter of hashes has 16 bits a hash, 2**FILTER_BITS (32 MB) at most; whoever needs more goes by a join.
FILTER_BITS = 28


def filter_bits(n: int) -> int | None:
    """Size of a filter of n hashes as a power of two; None where that is over the bound."""
    bits = max(16, (16 * n).bit_length())
    return bits if bits <= FILTER_BITS else None


def _filter_blocks(batches: Iterator[pa.RecordBatch], n_bits: int) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << n_bits >> 3, np.uint8)
    for b in batches:
        slot = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(64 - n_bits)
        np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (slot & np.uint64(7)).astype(np.uint8))
    for i, x in enumerate(bits.reshape(SKETCH_BLOCKS, -1)):
        if x.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "z": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})


def hash_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of a one-hash Bloom filter of a long column of hashes: 2**bits, false hits possible, no misses.
    The hashes are dealt by their first bits, so a task holds one of SKETCH_BLOCKS parts of the filter alone."""
    out = np.zeros((SKETCH_BLOCKS, (1 << bits) // SKETCH_BLOCKS // 8), np.uint8)
    column = F.col(f"`{hashes.columns[0]}`")
    dealt = hashes.repartition(SKETCH_BLOCKS, F.shiftrightunsigned(column, 64 - SKETCH_BLOCKS.bit_length() + 1))
    for i, z in dealt.mapInArrow(partial(_filter_blocks, n_bits=bits), "block int, z binary").collect():
        out[i] |= np.frombuffer(zlib.decompress(z), np.uint8)
    return out.ravel()


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return ((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)


# ---------------------------------------------------------------- joins with hot keys

#: Keys with a share of 1 / HOT_SHARE of all rows or more: HOT_SHARE at most.
HOT_SHARE = 1024


def join_weighted(rows: DataFrame, table: DataFrame, on: list[tuple[str, str]], weight: str) -> DataFrame:
    """rows joined (inner) with a table of one row per key that tells how many rows the key has: keys that hold a
    share of 1 / HOT_SHARE or more of all rows, HOT_SHARE at most, are broadcast, the others shuffled."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot, rare = (table.where(F.col(weight) * HOT_SHARE >= total), table.where(F.col(weight) * HOT_SHARE < total))

    def same(other: DataFrame):
        out = F.lit(True)
        for a, b in on:
            out = out & (rows[a] == other[b])
        return out

    few, names = hot.select(*[b for _, b in on]), F.broadcast(hot)
    return rows.join(names, same(names), "inner").unionByName(rows.join(F.broadcast(few), same(few), "left_anti").join(rare, same(rare), "inner"))


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, scratch: Scratch, most: int = 40) -> DataFrame:
    """Distributed union-find over edges (a long, b long): returns node, component (smallest node reachable).

    Alternating large-star and small-star steps until no edge changes; every step is a join and a
    grouped minimum whose rows are linear in the edges, and is cut by a table in the shared folder.
    Nodes without an edge have no row; an empty input gives an empty result. Edges that still change after ``most`` rounds are an error.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.table(e, "edges")

    def mark(t: DataFrame) -> tuple:
        r = t.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first()
        return r[0], r[1]

    at = mark(e)
    for _ in range(most):
        if not at[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, large.u == low.k)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        new = scratch.table(small, "edges")
        scratch.drop(e)
        e, was, at = new, at, mark(new)
        if at == was:
            break
    else:
        raise RuntimeError(f"components of {at[0]} edges have not settled in {most} rounds")
    # every edge now runs from a node to the smallest node of its component
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
