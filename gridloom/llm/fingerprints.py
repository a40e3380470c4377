"""Document fingerprints by a randomised edit embedding.

All texts take the same random walk: at step j the symbol under the reader is written, and the reader moves on or stays by
a random bit that depends on j and the symbol alone. Texts at a small edit distance meet again after an edit, so their
walks are at a small Hamming distance. A fingerprint keeps two bits of the walk at fixed sampled steps, SAMPLES an
octave, so that any length is covered to its end; near() weighs a sample by the steps that it stands for.

Near duplicates: bands of the fingerprint and of that of the reversed text, each of a few samples drawn from the whole walk in
proportion to the steps that they stand for, so that an edit anywhere leaves one of the two walks alike up to it. Texts that
share a band are compared by their edit distance: each with the least text of its bucket, and those that are not joined by that
with all that they share SHARED bands with. A text and the least one of its bucket are compared if their lengths allow it
and they share SHARED bands, or one and enough of a sketch of the walk.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, join_weighted, mix, shuffle_partitions
from .url_filter import among

SAMPLES, OCTAVES, ROWS_BYTES = 64, 40, 12 << 20
_CHUNK = 4096
#: Bands of a walk and samples (2 bits) of a band; texts are near at an edit distance of up to this part of the longer one.
BANDS, DRAWN, NEAR = 16, 12, 0.1
#: Samples of a sketch of the walk that goes with its bands, and how many agree at least in texts that share one band alone: a share p of
#: samples alike makes a band alike by p**DRAWN, so of texts below that (0.45) one pair in 200 shares one of 64 bands, by chance.
MARKS, ALIKE = 128, 58
#: Texts of a block in which a bucket is compared, after its least text, and bands that two texts then share at least.
BLOCK, SHARED = 512, 2
#: Texts that meet with a bucket's least text in a row. The texts that are compared in full after that form GROUPS groups or more, of about
#: GROUP_CHARS characters; two groups meet in a row. Texts travel to their rows in turns of a share of the corpus' characters (1 / TURNS), WAVE_CHARS at least.
STAR, GROUPS, GROUP_CHARS, WAVE_CHARS, TURNS = 32, 16, 1 << 20, 1 << 26, 4


def sampled_steps(samples: int = SAMPLES, octaves: int = OCTAVES) -> tuple[np.ndarray, np.ndarray]:
    """The sampled steps in order and their weights: all of the first ``samples``, then ``samples`` of every octave."""
    rng, steps, weights, lo = np.random.default_rng(7), [np.arange(samples)], [np.ones(samples)], samples
    for _ in range(octaves):
        steps.append(lo + np.sort(rng.choice(min(lo, 1 << 24), samples, replace=False)) * max(1, lo >> 24))
        weights.append(np.full(samples, lo / samples))
        lo *= 2
    return np.concatenate(steps), np.concatenate(weights)


STEPS, WEIGHTS = sampled_steps()
_TOTAL = np.concatenate([[0.0], np.cumsum(WEIGHTS)])


def _symbols(text: str) -> np.ndarray:
    """A symbol from 1 to 255 for each code point."""
    if text.isascii():
        c = np.frombuffer(text.encode(), np.uint8)
        return c | (c == 0)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, 128 + (c * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(127)).astype(np.uint8) | (c == 0)


_BITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _random(chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves of _CHUNK steps by symbol, and two bits by symbol for the samples among them."""
    if chunk not in _BITS:
        if len(_BITS) > 64:
            _BITS.clear()
        rng = np.random.default_rng((11, chunk))
        moves = rng.integers(0, 2, (_CHUNK, 256), np.uint8)  # a worker keeps up to 65 chunks: a byte a move
        moves[:, 0] = 0  # the end of a text
        lo, hi = np.searchsorted(STEPS, (chunk * _CHUNK, (chunk + 1) * _CHUNK))
        bits = np.random.default_rng((13, chunk)).integers(0, 4, (hi - lo, 256), np.uint8)
        bits[:, 0] = 255
        _BITS[chunk] = moves, bits
    return _BITS[chunk]


def walk(texts: list[str]) -> list[np.ndarray]:
    """The sampled symbols (0..3) of each text's walk, as many as it has steps for."""
    syms = [_symbols(t) for t in texts]
    n = np.array([len(s) for s in syms])
    flat = np.concatenate([np.concatenate([s, [np.uint8(0)]]) for s in syms]) if syms else np.zeros(0, np.uint8)
    pos = np.concatenate([[0], np.cumsum(n + 1)[:-1]]).astype(np.intp) if len(n) else np.zeros(0, np.intp)
    who = np.argsort(-n, kind="stable")
    pos = pos[who]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = taken = 0
    while True:
        alive = flat[pos] != 0
        if not alive.all():
            who, pos = who[alive], pos[alive]
        if not len(who):
            break
        moves, bits = _random(step // _CHUNK)
        first = int(np.searchsorted(STEPS, step // _CHUNK * _CHUNK))
        rows, at, c, by = [], step % _CHUNK, np.empty(len(pos), np.uint8), np.empty(len(pos), np.intp)
        for j, move in enumerate(moves[at : at + 128].astype(np.intp), step):
            # positions and symbols are in bounds; another mode than "raise" takes them without a copy
            flat.take(pos, out=c, mode="wrap")
            if taken < len(STEPS) and STEPS[taken] == j:
                rows.append(bits[taken - first][c])
                taken += 1
            move.take(c, out=by, mode="wrap")
            pos += by
        step += 128
        if rows:
            out.append((who, np.stack(rows, 1)))
    got: list[list[np.ndarray]] = [[] for _ in texts]
    for w, rows in out:
        for i, r in zip(w.tolist(), rows, strict=True):
            got[i].append(r)
    done = [np.concatenate(g) if g else np.zeros(0, np.uint8) for g in got]
    return [g[g != 255] for g in done]


_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def to_text(samples: np.ndarray) -> str:
    """Four bits a digit: two samples, the last alone as g, h, i or j."""
    even = len(samples) // 2 * 2
    return _DIGITS[samples[:even:2] * 4 + samples[1:even:2]].tobytes().decode() + ("ghij"[int(samples[-1])] if len(samples) % 2 else "")


def near(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness from 0 to 1 of two walks: 1 where all samples agree, about 0 for unlike texts; two empty texts are alike."""
    k, most = min(len(a), len(b)), max(len(a), len(b))
    if not most:
        return 1.0
    same = float(WEIGHTS[:k][a[:k] == b[:k]].sum())
    return float(min(1.0, max(0.0, (same - (_TOTAL[k] - same) / 3) / _TOTAL[most])))


def _edited(text: str, after: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


def _lengths(m: int) -> list[int]:
    """How many of m samples the bands of a walk are drawn from; a walk that just reaches a length also has the bands of the one before."""
    if m < 8:
        return []
    steps = [8, 16, 32, *range(SAMPLES, m + 1, SAMPLES)]
    steps = [x for x in steps if x <= m]
    return steps[-2:] if len(steps) > 1 and m - steps[-1] < max(2, steps[-1] // 16) else steps[-1:]


_DRAWS: dict[tuple[int, int], np.ndarray] = {}


def _draws(length: int, way: int) -> np.ndarray:
    """The samples of each band, drawn from the first ``length`` by their weights."""
    if (length, way) not in _DRAWS:
        rng, p = np.random.default_rng((19, length, way)), WEIGHTS[:length] / WEIGHTS[:length].sum()
        _DRAWS[length, way] = np.stack([np.sort(rng.choice(length, min(DRAWN, length), replace=False, p=p)) for _ in range(BANDS)])
    return _DRAWS[length, way]


def band_keys(walks: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Keys of the bands of a text's walk forwards and backwards; none for texts of a few characters, whose only near texts are equal."""
    values, kinds, _ = bands_of([walks])[0]
    v, at = np.array(values, np.uint64), np.arange(len(values))
    return mix(v | (np.array(kinds, np.uint64)[at // BANDS] * np.uint64(BANDS) + (at % BANDS).astype(np.uint64)) << np.uint64(32), 41).view(np.int64).tolist()


def bands_of(walks: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[list[int], list[int], list[int]]]:
    """For each text the values of its bands, and for each BANDS of them their kind (length and way) and a sketch of that walk: MARKS samples at
    equal distances by weight, 32 in a long."""
    out: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in walks]
    for way in range(2):
        same: dict[int, list[int]] = {}
        for i, w in enumerate(walks):
            for length in _lengths(len(w[way])):
                same.setdefault(length, []).append(i)
        for length, who in sorted(same.items()):
            at, marks = _draws(length, way), _marks(length)
            w = np.stack([walks[i][way][:length] for i in who]).astype(np.int64)
            values = (w[:, at] << (2 * np.arange(at.shape[1]))).sum(2)
            sketch = (w[:, marks].reshape(len(who), -1, 32) << (2 * np.arange(32))).sum(2)
            for i, v, m in zip(who, values.tolist(), sketch.tolist(), strict=True):
                out[i][0].extend(v)
                out[i][1].append(2 * length + way)
                out[i][2].extend(m)
    return out


def _marks(length: int) -> np.ndarray:
    """The samples of a sketch of a walk's first ``length``."""
    return np.searchsorted(_TOTAL[1 : length + 1], (np.arange(MARKS) + 0.5) / MARKS * _TOTAL[length], "right")


def _letters(t: str) -> np.ndarray:
    return np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) & 255, minlength=256)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance by bit vectors, a column of the table in a few operations on long integers; most + 1 where it is more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    k = len(os.path.commonprefix([a, b]))
    a, b = a[k:], b[k:]
    k = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if not m:
        return min(len(a), most + 1)
    spare = _letters(a) - _letters(b)  # an edit takes one letter away and brings one
    if max(spare[spare > 0].sum(), -spare[spare < 0].sum()) > most:
        return most + 1
    codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    where = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score, left = full, 0, m, len(a)
    for c in a:
        eq = where.get(c, 0)
        x = eq | down
        y = (((eq & up) + up) ^ up) | eq
        plus, minus = down | full & ~(y | up), up & y
        score += bool(plus & last) - bool(minus & last)
        left -= 1
        if score - left > most:
            return most + 1
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | full & ~(x | plus), plus & x
    return min(score, most + 1)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
MORE = ", t1 long, t2 long, bands array<int>, kinds array<int>, marks array<long>"


def _results(ids: list, texts: list[str], following: list[str]) -> list[tuple]:
    """texts[i] is followed by following[i]."""
    if not ids:
        return []
    edited = [_edited(t, f) for t, f in zip(texts, following, strict=True)]
    distinct = list(dict.fromkeys([*texts, *edited, *following]))
    own = list(dict.fromkeys(texts))
    both = walk([*distinct, *(t[::-1] for t in own)])  # at once: a step costs much the same for few texts as for many
    walks, back = dict(zip(distinct, both, strict=False)), dict(zip(own, both[len(distinct) :], strict=True))
    bands = bands_of([(walks[t], back[t]) for t in own])
    more = {t: (*np.frombuffer(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.int64).tolist(), *b) for t, b in zip(own, bands, strict=True)}
    digits = {t: to_text(walks[t]) for t in dict.fromkeys([*texts, *edited])}
    return [
        (i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), digits[t], digits[e], near(walks[t], walks[e]), near(walks[t], walks[f]), *more[t])
        for i, t, e, f in zip(ids, texts, edited, following, strict=True)
    ]


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
_NAMES = [f.split()[0] for f in (RESULT + MORE).split(", ")]


def _batch(rows: list[tuple], part: int, head: str | None, tail: tuple | None) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in _NAMES]
    more = [("head", head, None)] if head is not None else []
    more += [("tail", tail[1], tail[0])] if tail is not None else []
    k, m = len(rows), len(more)
    arrays = [pa.array(c + ([x[2] for x in more] if j == 0 else [None] * m), t) for j, (c, t) in enumerate(zip(cols, _TYPES, strict=True))]
    arrays += [pa.array([part] * (k + m), pa.int32()), pa.array([None] * k + [x[0] for x in more], pa.string()), pa.array([None] * k + [x[1] for x in more], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=[*_NAMES, "part", "edge", "edge_text"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of ids in order: results of all rows but the last; its first and last text go to the next step."""
    from pyspark import TaskContext

    part, held, size, head = TaskContext.get().partitionId(), [], 0, None
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = t or ""
            if head is None:
                head = t
                yield _batch([], part, head, None)
            held.append((i, t))
            size += len(t)
            if size > ROWS_BYTES and len(held) > 1:
                yield _batch(_results([x for x, _ in held[:-1]], [x for _, x in held[:-1]], [x for _, x in held[1:]]), part, None, None)
                held = held[-1:]
                size = len(held[0][1])
    if held:
        yield _batch(_results([x for x, _ in held[:-1]], [x for _, x in held[:-1]], [x for _, x in held[1:]]), part, None, held[-1])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = _results(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
        yield _batch(rows, 0, None, None).select(range(len(_NAMES)))


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of RESULT with a 128-bit hash of the text and its band keys: tables in the shared folder."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    ordered = src.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    t = scratch.table(ordered.mapInArrow(_run, f"{RESULT}{MORE}, part int, edge string, edge_text string"), "ranges", "zstd")
    scratch.release()
    ends = t.where("edge is not null").groupBy("part").agg(F.max(F.when(F.col("edge") == "head", F.col("edge_text"))).alias("head"), F.max(F.when(F.col("edge") == "tail", F.col("edge_text"))).alias("tail"), F.max("doc_id").alias("doc_id"))
    # one row per task
    follow = ends.selectExpr("doc_id", "tail", "coalesce(lead(head) over (order by part), first(head) over (order by part)) as following")
    return t.where("edge is null").drop("part", "edge", "edge_text").unionByName(scratch.table(follow.mapInArrow(_edges, RESULT + MORE), "edges"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document in the contract's columns: its fingerprint, that of its edited text (the last floor(n/2) code
    points replaced by the first as many, or all, of the next document by id; after the last comes the first) and likenesses.

    Null texts are empty (fingerprint ''). Rows without an id are not returned; rows that repeat an id are ordered by
    their text. A single document follows itself. Other columns are ignored; an empty table gives an empty result.

    Documents are dealt by ranges of ids, so only the texts at the edges of a range (two a task) are handled apart.
    """
    return _prints(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), *_NAMES[1:7])


# ---------------------------------------------------------------- near duplicates by fingerprint


def _candidates(batches: Iterator[pa.RecordBatch], most: float, groups: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks of a bucket (key, x, y, l, r) that share SHARED bands, aren't joined yet and may be near by their lengths, in
    the first bucket that they share: for each two of ``groups`` groups of texts a row of its pairs."""
    for b in batches:
        rows = []
        for key, x, y, ls, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
            (i, n, c, k, at), (o, m, d, q, to) = (
                (*(s.values.field(f).to_numpy() for f in ("id", "chars", "c")), s.values.field("keys").flatten().to_numpy(), s.values.field("keys").value_lengths().to_numpy()) for s in (ls, rs)
            )
            ok = (c[:, None] != d) & (np.abs(n[:, None] - m) <= np.floor(np.maximum(n[:, None], m) * most))
            if x == y:
                ok &= i[:, None] < o
            if not ok.any():
                continue
            both = np.intersect1d(k, q)
            mine, theirs = np.zeros((len(i), len(both)), np.float32), np.zeros((len(o), len(both)), np.float32)
            for held, keys, per in ((mine, k, at), (theirs, q, to)):
                slot = np.minimum(np.searchsorted(both, keys), len(both) - 1)
                fits = both[slot] == keys
                held[np.repeat(np.arange(len(per)), per)[fits], slot[fits]] = 1
            before = int(np.searchsorted(both, key))
            ok &= (mine @ theirs.T >= SHARED) & (mine[:, :before] @ theirs[:, :before].T == 0)
            u, v = np.nonzero(ok)
            lo, hi = np.minimum(i[u], o[v]), np.maximum(i[u], o[v])
            g, h = ((mix(z.view(np.uint64), 43) % np.uint64(groups)).astype(np.int64) for z in (lo, hi))
            cell = np.minimum(g, h) * groups + np.maximum(g, h)
            order = np.argsort(cell, kind="stable")
            cut = np.flatnonzero(np.diff(cell[order])) + 1
            rows += [(int(cell[z[0]]) // groups, int(cell[z[0]]) % groups, lo[z], hi[z]) for z in np.split(order, cut) if len(z)]
        if rows:
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(z), t) for z, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), longs, longs), strict=True)], names=["x", "y", "a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    """Of the pairs of a cell (a, b: lists; held: its texts by id), those that are near and not joined yet by others of the cell, with their distance."""
    for b in batches:
        found = []
        for x, y, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
            texts, up = {h["id"]: h["text"] for h in held}, {}

            def root(z, up=up):
                while (w := up.get(z, z)) != z:
                    up[z] = z = up.get(w, w)
                return z

            for s, t in sorted(zip(x, y, strict=True)):
                if (u := root(s)) != (v := root(t)):
                    limit = int(max(len(texts[s]), len(texts[t])) * most)
                    if (d := edit_distance(texts[s], texts[t], limit)) <= limit:
                        found.append((s, t, d))
                        up[u] = v
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "distance"])


def _alike(a: str, b: str) -> Column:
    """How many of their samples two sketches have in common."""
    differ = [f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {0x5555555555555555}L)" for x in (f"({a}[{i}] ^ {b}[{i}])" for i in range(MARKS // 32))]
    return F.expr(f"{MARKS} - ({' + '.join(differ)})")


def _near_links(prints: DataFrame, docs: DataFrame, most: float, block: int, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, distance) between distinct texts, each named by its least id, and the texts (t1, t2, rep, n)."""
    parts = shuffle_partitions(docs.sparkSession)
    found = prints.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.max("n_chars").alias("chars"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("bands", "kinds", "marks")])
    found = scratch.table(found, "found", "zstd")
    scratch.release()
    one = scratch.table(found.select("t1", "t2", "rep", "chars", "n"), "texts")
    corpus = one.agg(F.sum(F.col("chars") * F.col("n"))).first()[0] or 0
    words = MARKS // 32
    keys = found.where("size(bands) > 0").select(F.col("rep").alias("id"), "chars", "kinds", "marks", F.posexplode("bands").alias("at", "v"))
    keys = keys.select("id", "chars", F.expr(f"xxhash64(kinds[at div {BANDS}], at % {BANDS}, v)").alias("key"), F.expr(f"slice(marks, cast({words} * (at div {BANDS}) + 1 as int), {words})").alias("marks"))
    sizes = scratch.table(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo")).where("n > 1"), "sizes")
    scratch.release()
    # most keys have one text: they are gone before the join
    members = scratch.table(among(keys, sizes.select("key"), "key").join(sizes, "key"), "members")
    scratch.drop(found, sizes)
    scratch.release()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def check(cells: DataFrame, name: str) -> DataFrame:
        """Near pairs of cells (x, y, lists a and b). A cell's texts meet in its row; so many cells at a time that their
        texts, repeated for each cell, are a share of the corpus. Only texts that a turn needs are shuffled: a filter goes over
        the others where they are read."""
        cells = scratch.table(cells, name)
        needs = scratch.table(cells.select("x", "y", F.explode(F.array_distinct(F.concat("a", "b"))).alias("id")), "needs")
        chars = needs.join(one.select(F.col("rep").alias("id"), "chars"), "id").agg(F.sum("chars")).first()[0] or 0
        waves, out = max(1, -(-chars // max(WAVE_CHARS, corpus // TURNS))), []
        for w in range(waves):
            mine = F.pmod(F.xxhash64("x", "y", F.lit("wave")), F.lit(waves)) == w
            need = needs.where(mine)
            # of rows that repeat an id the least text stands for it
            texts = among(src, need.select("id").distinct(), "id").groupBy("id").agg(F.min("text").alias("text"))
            rows = texts.join(need, "id").select("x", "y", F.struct("id", "text").alias("held"), F.lit(None).cast("struct<a: array<bigint>, b: array<bigint>>").alias("pairs"))
            rows = rows.unionByName(cells.where(mine).select("x", "y", F.lit(None).cast("struct<id: bigint, text: string>").alias("held"), F.struct("a", "b").alias("pairs")))
            rows = rows.repartition(parts, "x", "y").groupBy("x", "y").agg(F.max("pairs").alias("p"), F.collect_list("held").alias("held"))
            out.append(scratch.table(rows.select("p.a", "p.b", "held").mapInArrow(partial(_verify, most=most), "a long, b long, distance long"), "near"))
            scratch.release()
        scratch.drop(cells, needs)
        return reduce(DataFrame.unionByName, out)

    def by_least(pairs: DataFrame) -> DataFrame:
        """Cells of pairs (a, b, n) with the least text a of a bucket of n texts."""
        placed = pairs.withColumn("y", F.expr(f"pmod(xxhash64(b), cast((n + {STAR - 1}) div {STAR} as bigint))"))
        return placed.groupBy(F.col("a").alias("x"), "y").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    # each text with the least text with which it shares most bands, then with those of its buckets that it isn't joined with by that
    least = members.where("id = lo").select("key", F.col("chars").alias("least_chars"), F.col("marks").alias("least_marks"))
    star = members.where("id <> lo").join(least, "key").where(f"abs(chars - least_chars) <= floor(greatest(chars, least_chars) * {most!r}D)")
    # of the pairs that share one band most do so by chance: they are told by their sketches, before any text travels
    star = star.groupBy(F.col("lo").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.max(_alike("marks", "least_marks")).alias("alike"))
    star = scratch.table(star.where(f"k >= {SHARED} or alike >= {ALIKE}").drop("alike"), "star")
    best = star.groupBy("b").agg(F.max(F.struct("k", (-F.col("a")).alias("a"), "n")).alias("z")).select((-F.col("z.a")).alias("a"), "b", "z.n")
    first = check(by_least(best), "best")
    comp = connected_components(first.select("a", "b"), scratch)
    ca, cb = (comp.select(F.col("node").alias(f"n{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
    more = star.join(best.select(F.col("a").alias("a0"), F.col("b").alias("b0")), (F.col("a") == F.col("a0")) & (F.col("b") == F.col("b0")), "left_anti")
    more = more.join(ca, F.col("a") == F.col("na"), "left").join(cb, F.col("b") == F.col("nb"), "left").where("coalesce(ca, a) <> coalesce(cb, b)")
    first = first.unionByName(check(by_least(more.select("a", "b", "n")), "more"))
    comp = connected_components(first.select("a", "b"), scratch)
    # what a bucket's least text hasn't joined is compared in full, block by block
    inner = members.where("n > 2 and id <> lo").join(comp, F.col("id") == F.col("node"), "left").select("key", "id", "chars", F.coalesce("component", "id").alias("c"))
    inner = scratch.table(inner, "inner")
    split = inner.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.expr(f"cast((count(*) + {block - 1}) div {block} as int)").alias("nb")).where("c0 <> c1").select("key", "nb")
    left = scratch.table(inner.join(split, "key"), "left")
    own = left.groupBy(F.col("id").alias("own")).agg(F.collect_list("key").alias("keys"), F.max("chars").alias("own_chars")).where(f"size(keys) >= {SHARED}")
    own = scratch.table(own, "own")
    groups = max(GROUPS, -(-(own.agg(F.sum("own_chars")).first()[0] or 0) // GROUP_CHARS))
    placed = left.join(own, F.col("id") == F.col("own")).withColumn("blk", F.expr("cast(pmod(xxhash64(id, key), nb) as int)"))
    placed = scratch.table(placed.groupBy("key", "nb", "blk").agg(F.collect_list(F.struct("id", "chars", "c", "keys")).alias("m")), "blocks")
    ls = placed.select("key", F.col("blk").alias("x"), F.explode(F.sequence("blk", F.col("nb") - 1)).alias("y"), F.col("m").alias("l"))
    rs = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("x"), F.col("blk").alias("y"), F.col("m").alias("r"))
    pairs = ls.repartition(parts, "key", "x", "y").join(rs.repartition(parts, "key", "x", "y"), ["key", "x", "y"]).select("key", "x", "y", "l", "r")
    pairs = pairs.mapInArrow(partial(_candidates, most=most, groups=groups), "x long, y long, a array<bigint>, b array<bigint>")
    rest = check(pairs.groupBy("x", "y").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b")), "rest")
    scratch.drop(members, star, inner, left, own, placed)
    return first.unionByName(rest), one


def near_pairs(docs: DataFrame, most: float = NEAR, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b, distance), a < b, of documents whose edit distance is at most ``most`` of the longer text.

    Equal texts are one document, that of the least id. Links that are implied by others of a bucket may be left out, so it is
    their components that are whole: texts are found near with high probability, not with certainty. Null and empty
    texts link with nothing; rows without an id take no part; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near")
    links, _ = _near_links(_prints(docs, id_col, text_col), docs, most, block, scratch, id_col, text_col)
    return links.distinct()


def near_classes(docs: DataFrame, most: float = NEAR, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint_documents() with near_id: the smallest id that can be reached by links of near or equal texts; empty texts have their own."""
    scratch = Scratch(docs.sparkSession, "near")
    prints = _prints(docs, id_col, text_col)
    links, one = _near_links(prints, docs, most, block, scratch, id_col, text_col)
    comp = connected_components(links.select("a", "b"), scratch)
    table = one.where("chars > 0").join(comp, one.rep == comp.node, "left").select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "n", F.coalesce("component", "rep").alias("near_id"))
    table = scratch.table(table, "classes")
    cols = [F.col("doc_id").alias(id_col), *_NAMES[1:7]]
    found = join_weighted(prints.where("n_chars > 0"), table, [("t1", "k1"), ("t2", "k2")], "n").select(*cols, "near_id")
    return found.unionByName(prints.where("n_chars = 0").select(*cols, F.col("doc_id").alias("near_id")))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
