"""N-gram Jaccard join by vertical partitioning.

The global order of all n-grams (by a class of their estimated count, rarest first, then by hash) is
cut into fragments. A pair with Jaccard >= t shares an n-gram among the first n - ceil(t n) + 1 of
either set in that order, so only those are dealt out to find candidates; candidates are verified by
counting the overlap of each fragment separately and summing per pair.

Copies: equal sets are one class, represented by their smallest id. A bucket of over HOT sets is not
expanded to pairs: its sets join a group (the components over such buckets), which is cut into blocks
of bounded size, and each pair of blocks is compared in one task that emits only the links that join
parts not yet joined (a spanning forest, so components are exact).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SKETCH_BITS, Scratch, Sketch, connected_components, id_filter, join_weighted, may_hold, merged_sketch, shingles, shuffle_partitions, signature, slices, text_buffers, words

#: Sets that share a prefix n-gram are paired one by one up to this many, beyond it in blocks.
HOT = 128
#: N-grams of one block of a hot group (8 MB), and the fragments of the order that verification sums over.
BLOCK, FRAGMENTS = 1 << 20, 8
#: N-grams that a task looks through at once for repeats; the others are rare enough to stay out of the sketch.
RUN = 8 << 20
FOUND = ["a", "b", "hot", "na", "nb", "k"]


def need(na, nb, pct: int):
    """Least overlap with 100 * overlap >= pct * union."""
    return -(-(pct * (na + nb)) // (100 + pct))


def _rows(batches: Iterator[pa.RecordBatch], n: int, keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        take = np.ones(len(ids), bool) if keep is None else may_hold(keep, ids)
        if not take.all():
            b = b.filter(pa.array(take))
            ids = ids[take]
        raw, off = text_buffers(b.column(1))
        for i, j in slices(off):
            h, _, _, rows = words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            yield from zip(ids[i:j].tolist(), shingles(h, rows, n), strict=True)


def _profile(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """id, set size and signature of each document; after them this task's counts, of n-grams that repeat within a run of sets, as blocks."""
    sketch, out, most = Sketch(), [], 20_000
    run, held = [], 0

    def repeated():
        x, c = np.unique(np.concatenate(run), return_counts=True)
        sketch.add(np.repeat(x[c > 1], c[c > 1]))


    def batch(rows, blocks=()):
        k, m = len(rows), len(blocks)
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        return pa.RecordBatch.from_pydict({"id": pa.array([*cols[0], *[None] * m], pa.int64()), "n": pa.array([*cols[1], *[None] * m], pa.int64()), "h1": pa.array([*cols[2], *[None] * m], pa.int64()), "h2": pa.array([*cols[3], *[None] * m], pa.int64()), "block": pa.array([None] * k + [x for x, _ in blocks], pa.int32()), "z": pa.array([None] * k + [z for _, z in blocks], pa.binary())})

    for i, s in _rows(batches, n):
        out.append((i, len(s), *signature(s)))
        run.append(s)
        held += len(s)
        if held >= RUN:
            repeated()
            run, held = [], 0
        if len(out) >= most:
            yield batch(out)
            out = []
    if run:
        repeated()
    yield batch(out, sketch.blocks())


def order_classes(counts: np.ndarray) -> np.ndarray:
    """A class per sketch slot: 0 for n-grams no commoner than the noise of the sketch allows to tell, then by powers of two."""
    mean = float(counts.mean())
    rare = 16 + mean + 6 * mean**0.5
    return np.clip(np.ceil(np.log2(np.maximum(counts, 1) / rare)), 0, 15).astype(np.uint8)


def _ordered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in the global order: 4 bits of class, 60 of hash."""
    c = classes[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((c << np.uint64(60)) | (s >> np.uint64(4)))


def _pack(a: np.ndarray, *more: np.ndarray) -> bytes:
    return b"".join(x.tobytes() for x in (a, *more))


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, pct: int, classes, parts: int) -> Iterator[pa.RecordBatch]:
    """Prefix n-grams, dealt by n-gram: one row per part with packed (n-gram, class of sets, size)."""
    keys, ids, sizes, seen, held = [], [], [], set(), 0
    classes = classes.value

    def flush():
        k, i, m = (np.concatenate(x) for x in (keys, ids, sizes))
        part = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
        o = np.argsort(part, kind="stable")
        k, i, m, part = k[o], i[o], m[o], part[o]
        cut = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
        ends = np.append(cut[1:], len(part))
        return pa.RecordBatch.from_pydict({"part": pa.array(part[cut].astype(np.int32)), "k": pa.array((ends - cut).astype(np.int32)), "z": pa.array([_pack(k[a:b], i[a:b], m[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())})

    for _, s in _rows(batches, n):
        if not len(s):
            continue
        sig = signature(s)[0]
        if sig in seen:
            continue
        if len(seen) < 200_000:
            seen.add(sig)
        o = _ordered(s, classes)
        m = len(o) + (-len(o) * pct // 100) + 1
        keys.append(o[:m])
        ids.append(np.full(m, sig, np.int64))
        sizes.append(np.full(m, len(o), np.int32))
        held += m
        if held > 2_000_000:
            yield flush()
            keys, ids, sizes, held = [], [], [], 0
    if held:
        yield flush()


def _candidates(batches: Iterator[pa.RecordBatch], pct: int, limit: int) -> Iterator[pa.RecordBatch]:
    """All entries of some parts: pairs from small buckets; (member, least member) and hot = true from large ones."""
    ks, cs, ns = [], [], []
    for b in batches:
        for k, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            ks.append(np.frombuffer(z, np.uint64, k))
            cs.append(np.frombuffer(z, np.int64, k, 8 * k))
            ns.append(np.frombuffer(z, np.int32, k, 16 * k))
    if not ks:
        return
    k, c, n = (np.concatenate(x) for x in (ks, cs, ns))
    ks = cs = ns = None
    o = np.lexsort((c, k))
    k, c, n = k[o], c[o], n[o].astype(np.int64)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    k, c, n = k[new], c[new], n[new]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(start, len(k)))

    def batch(x, y):
        """Per pair of classes: sizes and the prefix n-grams of these parts that they share."""
        pairs, at, inv = np.unique(np.stack([c[x], c[y]]), axis=1, return_index=True, return_inverse=True)
        inv, m = inv.ravel(), pairs.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (pairs[0], pairs[1], np.zeros(m, bool), n[x][at], n[y][at], np.bincount(inv, minlength=m))], names=FOUND)

    found, held = [], 0
    for g in range(2, limit + 1):
        at = start[size == g]
        if not len(at):
            continue
        i, j = np.triu_indices(g, 1)
        for lo in range(0, len(at), step := max(1, 4_000_000 // len(i))):
            x, y = (at[lo : lo + step, None] + i).ravel(), (at[lo : lo + step, None] + j).ravel()
            ok = np.minimum(n[x], n[y]) * 100 >= pct * np.maximum(n[x], n[y])
            if ok.any():
                found.append(np.stack([x[ok], y[ok]]))
                held += int(ok.sum())
            if held > 2_000_000:
                yield batch(*np.concatenate(found, 1))
                found, held = [], 0
    if found:
        yield batch(*np.concatenate(found, 1))
    big = np.flatnonzero(size > limit)
    if len(big):
        x = np.concatenate([np.arange(start[g], start[g] + size[g]) for g in big])
        pairs = np.unique(np.stack([np.repeat(c[start[big]], size[big]), c[x]]), axis=1)
        zero = pa.array(np.zeros(pairs.shape[1], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.ones(pairs.shape[1], bool)), *[zero] * 3], names=FOUND)


def _segments(batches: Iterator[pa.RecordBatch], n: int, classes, keep) -> Iterator[pa.RecordBatch]:
    """The fragments of the sets of documents that may be candidates."""
    ids, sigs, frags, blobs, held = [], [], [], [], 0

    def batch():
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "sig": pa.array(sigs, pa.int64()), "frag": pa.array(frags, pa.int32()), "grams": pa.array(blobs, pa.binary())})

    cuts = (np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(60)) // np.uint64(FRAGMENTS - 1)  # rarest class in ranges, the commoner classes last
    for i, s in _rows(batches, n, keep.value):
        sig = signature(s)[0]
        for f, x in enumerate(np.split(o := _ordered(s, classes.value), np.searchsorted(o, cuts))):
            if len(x):
                ids.append(i)
                sigs.append(sig)
                frags.append(f)
                blobs.append(x.tobytes())
                held += x.nbytes
        if held > 16 << 20:
            yield batch()
            ids, sigs, frags, blobs, held = [], [], [], [], 0
    if ids:
        yield batch()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlap of the two segments of each row."""
    for b in batches:
        out = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())], names=["a", "b", "f_a", "part"])


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def links_between(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, pct: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (Jaccard >= pct %) within one block, or between two."""
    both = [*left, *(right or [])]
    order = sorted(range(len(both)), key=lambda i: (len(both[i][1]), both[i][0]))
    ids, sets = [both[i][0] for i in order], [both[i][1] for i in order]
    side = np.array([i >= len(left) for i in order])
    n = np.array([len(s) for s in sets], np.int64)
    if not len(sets):
        return []
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.concatenate([[0], np.cumsum(n)])
    mark, forest, out = np.zeros(len(universe), np.uint8), Forest(len(sets)), []
    for i in range(len(sets) - 1):
        last = int(np.searchsorted(n, n[i] * 100 // pct, "right"))
        if last <= i + 1:
            continue
        mine = flat[off[i] : off[i + 1]]
        mark[mine] = 1
        run = flat[off[i + 1] : off[last]]
        shared = np.add.reduceat(mark[run].astype(np.int64), off[i + 1 : last] - off[i + 1])
        mark[mine] = 0
        hit = np.flatnonzero(shared >= need(n[i], n[i + 1 : last], pct)) + i + 1
        if right is not None:
            hit = hit[side[hit] != side[i]]
        out += [(ids[i], ids[j]) for j in hit.tolist() if forest.join(i, j)]
    return out


def _block_links(key, table: pa.Table, pct: int) -> pa.Table:
    x, y = key[1].as_py(), key[2].as_py()
    sides: dict[int, dict[int, list]] = {x: {}, y: {}}
    for i, blk, z in zip(table.column("id").to_pylist(), table.column("blk").to_pylist(), table.column("grams").to_pylist(), strict=True):
        sides[blk].setdefault(i, []).append(np.frombuffer(z, np.uint64))
    sets = {b: [(i, np.unique(np.concatenate(v))) for i, v in d.items()] for b, d in sides.items()}
    found = links_between(sets[x], None if x == y else sets[y], pct)
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def ngram_jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity_pct: int = 80, hot_bucket: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_shingles, rep (smallest id with the same set) and component_id.

    Words are maximal runs of other bytes than ASCII white space, A-Z lower-cased; a set holds the distinct n-word
    shingles, or the whole sequence where it has fewer words. Two documents link when
    100 * |intersection| >= similarity_pct * |union|; component_id is the smallest id reachable by links.
    Empty or null texts have n_shingles 0 and link with nothing (rep and component_id are their own id). Rows without
    an id take no part and are not returned; rows that repeat an id keep their own n_shingles and share the component of the id. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    parts = shuffle_partitions(spark)

    both = scratch.table(src.mapInArrow(partial(_profile, n=n), "id long, n long, h1 long, h2 long, block int, z binary"), "profile")
    profile = both.where("id is not null").select("id", "n", "h1", "h2")
    classes = spark.sparkContext.broadcast(order_classes(merged_sketch(both.where("block is not null").select("block", "z"))))
    reps = scratch.table(profile.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "reps")

    dealt = src.mapInArrow(partial(_prefixes, n=n, pct=similarity_pct, classes=classes, parts=4 * parts), "part int, k int, z binary")
    found = dealt.repartition(4 * parts, "part").mapInArrow(partial(_candidates, pct=similarity_pct, limit=hot_bucket), "a long, b long, hot boolean, na long, nb long, k long")
    # The prefix that ends first in the order holds all that the two share up to its end: k n-grams; beyond it the
    # other's or its own rest, n - prefix, is the most. N-grams of hot buckets are missing from k, but pairs that share
    # one are compared in their group.
    found = found.groupBy("a", "b", "hot").agg(F.sum("k").alias("k"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    pct = similarity_pct
    found = scratch.table(found.where(f"hot or k + ({pct} * greatest(na, nb) + 99) div 100 - 1 >= ({pct} * (na + nb) + {99 + pct}) div {100 + pct}").select("a", "b", "hot"), "found")

    ra, rb = (reps.select(F.col("h1").alias(f"h_{s}"), F.col("rep").alias(s), F.col("n").alias(f"n{s}")) for s in "xy")
    mapped = scratch.table(found.join(ra, found.a == ra.h_x).join(rb, found.b == rb.h_y).select("x", "y", "nx", "ny", "h_x", "h_y", "hot"), "mapped")
    pairs = mapped.where("not hot and x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.expr("if(x < y, nx, ny)").alias("na"), F.expr("if(x < y, ny, nx)").alias("nb"), F.expr("if(x < y, h_x, h_y)").alias("ha"), F.expr("if(x < y, h_y, h_x)").alias("hb"))
    star = mapped.where("hot").select(F.col("x").alias("a"), F.col("y").alias("b"))

    # hot groups: components over the large buckets, each cut into blocks by a hash of the id
    sizes = mapped.where("hot").selectExpr("stack(2, x, nx, h_x, y, ny, h_y) as (id, n, sig)").distinct()
    groups = connected_components(star, scratch).withColumnsRenamed({"node": "id", "component": "grp"})
    members = scratch.table(groups.join(sizes, "id"), "members")
    # so many blocks that one has ``block`` n-grams at most, and that a task's share of a group of N sets is about sqrt(N) of them
    blocks = members.groupBy("grp").agg(F.expr(f"cast(ceil(greatest(sum(n) / {block}, sqrt(count(*)) / 4)) as int)").alias("nb"))
    placed = members.join(blocks, "grp").select("id", "sig", "grp", "nb", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("blk"))
    placed = scratch.table(placed, "placed")

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(placed.select("id"))
    keep = spark.sparkContext.broadcast(id_filter(ids))
    segments = scratch.table(src.mapInArrow(partial(_segments, n=n, classes=classes, keep=keep), "id long, sig long, frag int, grams binary"), "segments")

    sa, sb = (segments.select(F.col("id").alias(f"id_{s}"), F.col("sig").alias(f"s_{s}"), F.col("frag").alias(f"f_{s}"), F.col("grams").alias(f"g_{s}")) for s in "ab")
    side = pairs.join(sa, (pairs.a == sa.id_a) & (pairs.ha == sa.s_a)).select("a", "b", "hb", "f_a", "g_a")
    cut = side.join(sb, (side.b == sb.id_b) & (side.f_a == sb.f_b) & (side.hb == sb.s_b)).select("a", "b", "f_a", "g_a", "g_b")
    overlap = cut.mapInArrow(_overlaps, "a long, b long, f_a int, part long").groupBy("a", "b", "f_a").agg(F.max("part").alias("part")).groupBy("a", "b").agg(F.sum("part").alias("shared"))
    links = pairs.join(overlap, ["a", "b"]).where(f"100 * shared >= {similarity_pct} * (na + nb - shared)").select("a", "b")

    spread = placed.select("id", "sig", "grp", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    spread = spread.select("id", "sig", "grp", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), "blk")
    hot = segments.join(spread, ["id", "sig"]).groupBy("grp", "x", "y").applyInArrow(lambda k, t: _block_links(k, t, similarity_pct), "a long, b long")
    linked = scratch.table(links.unionByName(hot), "links")

    comp = scratch.table(connected_components(linked, scratch), "components")
    scratch.drop(found, mapped, members, placed, segments, linked)
    final = reps.join(comp, reps.rep == comp.node, "left").select("h1", "h2", "n", "copies", "rep", F.coalesce("component", "rep").alias("component_id"))
    empty = profile.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("rep"), F.col("id").alias("component_id"))
    final = scratch.table(final.withColumnsRenamed({"h1": "k1", "h2": "k2", "n": "k"}), "final")
    out = join_weighted(profile.where("n > 0"), final, [("h1", "k1"), ("h2", "k2"), ("n", "k")], "copies").select("id", F.col("n").alias("n_shingles"), "rep", "component_id")
    return out.unionByName(empty).withColumnRenamed("id", id_col)


def ngram_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity_pct: int = 80) -> DataFrame:
    """docs without the documents that link to one of a smaller id: one row (the smallest id) of each component stays. Rows without
    an id, and those with null or empty texts, stay; rows that repeat an id go or stay together. Columns keep their names,
    whatever they are."""
    out = ngram_jaccard_classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", n, similarity_pct)
    gone = out.where("component_id <> id").select(F.col("id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("own"))
    return rows.join(gone, rows.own == gone.gone, "left_anti").select("row.*")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
