"""Operators on pixel tables (x, y and sample columns) and on lists of sizes, as DataFrame expressions.

Aggregations have partial sums before the shuffle, so a raster of any size is reduced in bands by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")


def crop(px: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The pixels of a half-open rectangle, moved to its corner."""
    if width <= 0 or height <= 0 or x < 0 or y < 0:
        raise ValueError("an empty or negative region")
    inside = px.where((F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height))
    return inside.withColumns({"x": (F.col("x") - x).cast("long"), "y": (F.col("y") - y).cast("long")})


def _mean(c: str) -> Column:
    """Box mean, halves up, in integers."""
    return F.expr(f"(2 * sum({c}) + count({c})) div (2 * count({c}))").cast("long").alias(c)


def box_resample(px: DataFrame, width: int, height: int, to_width: int, to_height: int, channels: tuple = CHANNELS, by: tuple = ()) -> DataFrame:
    """Box filter: output o averages the sources from floor(o*S/D) to floor((o+1)*S/D); enlarging is refused."""
    if not (0 < to_width <= width and 0 < to_height <= height):
        raise ValueError("the box filter only makes rasters smaller")
    if (width, height) == (to_width, to_height):
        return px
    ox, oy = F.expr(f"(x * {to_width} + {to_width - 1}) div {width}"), F.expr(f"(y * {to_height} + {to_height - 1}) div {height}")
    return px.groupBy(*by, oy.cast("long").alias("y"), ox.cast("long").alias("x")).agg(*[_mean(c) for c in channels])


def halve(px: DataFrame, channels: tuple = CHANNELS) -> DataFrame:
    """Blocks of 2 by 2."""
    return px.groupBy(F.expr("y div 2").cast("long").alias("y"), F.expr("x div 2").cast("long").alias("x")).agg(*[_mean(c) for c in channels])


def level_dims(width: int, height: int, least: int = 1, count: int | None = None) -> list[tuple[int, int]]:
    """Sizes of a pyramid: halved (1 at least) until the longer side is at most ``least``, or ``count`` levels are there."""
    out = [(width, height)]
    while (len(out) < count if count else max(out[-1]) > least) and out[-1] != (1, 1):
        w, h = out[-1]
        out.append((max(1, w // 2), max(1, h // 2)))
    return out


def level_sizes(pages: DataFrame, count: int) -> DataFrame:
    """The sizes of ``count`` levels of many pages (src, w, h): src, level, width, height, each half of the one before, 1 at least."""
    level = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    half = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / F.pow(F.lit(2), F.col("level")))).cast("long")
    return pages.select("src", "w", "h", level.alias("level")).select("src", "level", half("w").alias("width"), half("h").alias("height"))


def unpack_bits(px: DataFrame, value: str, bits: int = 8) -> DataFrame:
    """A row per bit of a value, the highest first: i and bit."""
    out = px.select("x", "y", value, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bits - 1).cast("long"))).alias("i"))
    return out.select("x", "y", "i", F.expr(f"cast(shiftright({value}, cast({bits - 1} - i as int)) & 1 as bigint)").alias("bit"))


def pack_bits(px: DataFrame, value: str) -> DataFrame:
    """The lowest bits of a row's values, eight to a byte, the first in the highest place: y, byte, v."""
    return px.groupBy("y", F.expr("x div 8").alias("byte")).agg(F.sum(F.expr(f"shiftleft({value} & 1, cast(7 - x % 8 as int))")).alias("v"))


def strip_rows(px: DataFrame, rows_per_strip: int) -> DataFrame:
    """Strips of a raster: strip, first_row (the rows of all strips before it) and n. A row per strip is windowed, not the pixels."""
    n = px.groupBy(F.expr(f"y div {rows_per_strip}").alias("strip")).agg(F.countDistinct("y").alias("n"))
    return n.select("strip", (F.sum("n").over(W.orderBy("strip").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("first_row"), "n")


def sample_at(px: DataFrame, x: int, y: int, channels: tuple = CHANNELS) -> DataFrame:
    """The samples of one pixel."""
    return px.where((F.col("x") == x) & (F.col("y") == y)).select(*channels)


def drop_alpha(px: DataFrame, alpha: str = "a") -> DataFrame:
    """Pixels without their opacity."""
    return px.drop(alpha)


def pyramid(px: DataFrame, width: int, height: int, count: int, base: bool = True, channels: tuple = CHANNELS) -> DataFrame:
    """Level, x, y and channels of all levels, each made from the one before it (as each rounds, not from the base)."""
    dims, level, out = level_dims(width, height, count=count), px.select("x", "y", *channels), []
    for k, (w, h) in enumerate(dims):
        if k:
            level = box_resample(level, *dims[k - 1], w, h, channels)
        if k or base:
            out.append(level.select(F.lit(k).cast("long").alias("level"), "x", "y", *channels))
    all_levels = out[0]
    for x in out[1:]:
        all_levels = all_levels.unionByName(x)
    return all_levels


def assemble_region(px: DataFrame, x: int, y: int, width: int, height: int, shift: int, channels: tuple = CHANNELS) -> DataFrame:
    """A composite at 1 / 2**shift: samples every max(1, 2**shift / 8) pixels of the region, (sum + n/2) div n per block."""
    stride = max(1, (1 << shift) // 8)
    grid = crop(px, x, y, width, height).where((F.col("x") % stride == 0) & (F.col("y") % stride == 0))
    mean = [F.expr(f"(sum({c}) + count({c}) div 2) div count({c})").cast("long").alias(c) for c in channels]
    return grid.groupBy(F.shiftright("y", shift).cast("long").alias("y"), F.shiftright("x", shift).cast("long").alias("x")).agg(*mean)


def sparse_overview(px: DataFrame, across: int, down: int, tile: int, most: int = 24) -> DataFrame:
    """Pixels of at most most x most evenly spaced tiles: tile_x, tile_y and the tile's pixels."""
    def pick(n: int) -> list[int]:
        k = min(n, most)
        return sorted({i * n // k for i in range(k)})

    tx, ty = F.expr(f"x div {tile}"), F.expr(f"y div {tile}")
    return px.where(tx.isin(pick(across)) & ty.isin(pick(down))).withColumns({"tile_x": tx.cast("long"), "tile_y": ty.cast("long")})


def fill_sparse(px: DataFrame, grid: DataFrame, channels: tuple = CHANNELS) -> DataFrame:
    """Every cell of a grid (x, y); what is missing is 0 in all samples, before any colour is made of them."""
    joined = grid.join(px, ["x", "y"], "left")
    return joined.select("x", "y", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in channels])


def apply_predictor(px: DataFrame, channels: tuple = CHANNELS, modulus: int = 256, by: tuple = ()) -> DataFrame:
    w = W.partitionBy(*by, "y").orderBy("x")
    return px.select(*by, "x", "y", *[F.pmod(F.col(c) - F.lag(c, 1, 0).over(w), F.lit(modulus)).cast("long").alias(c) for c in channels])


def undo_predictor(px: DataFrame, channels: tuple = CHANNELS, modulus: int = 256, by: tuple = ()) -> DataFrame:
    w = W.partitionBy(*by, "y").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    return px.select(*by, "x", "y", *[F.pmod(F.sum(c).over(w), F.lit(modulus)).cast("long").alias(c) for c in channels])


def runs(px: DataFrame, value: str = "r") -> DataFrame:
    """Runs of equal values along each row: y, value, first_x, n."""
    a, b = W.partitionBy("y").orderBy("x"), W.partitionBy("y", value).orderBy("x")
    marked = px.select("y", "x", value, (F.row_number().over(a) - F.row_number().over(b)).alias("__island"))
    return marked.groupBy("y", value, "__island").agg(F.min("x").cast("long").alias("first_x"), F.count("*").cast("long").alias("n")).select("y", F.col(value).alias("value"), "first_x", "n")


def packbits_length(run_table: DataFrame) -> DataFrame:
    """Bytes that PackBits takes per row of runs(): y, n_bytes. Rests of one byte join into literals between repeats."""
    r = run_table.withColumns({"repeats": F.expr("n div 128 + if(n % 128 >= 2, 1, 0)"), "single": F.expr("if(n % 128 = 1, 1, 0)")})
    w = W.partitionBy("y").orderBy("first_x")
    # a literal begins where a single byte doesn't follow one directly; repeats before the byte cut it off
    r = r.withColumn("begins", F.expr("if(single = 1, 1, 0)") * F.when((F.lag("single", 1, 0).over(w) == 0) | (F.col("repeats") > 0), 1).otherwise(0))
    r = r.withColumn("literal", F.sum("begins").over(w))
    lit = r.where("single = 1").groupBy("y", "literal").agg(F.count("*").alias("k")).groupBy("y").agg(F.sum(F.expr("k + (k + 127) div 128")).alias("lit_bytes"))
    rep = r.groupBy("y").agg(F.sum(F.col("repeats") * 2).alias("rep_bytes"))
    return rep.join(lit, "y", "left").select("y", (F.col("rep_bytes") + F.coalesce("lit_bytes", F.lit(0))).cast("long").alias("n_bytes"))


def chunk_offsets(chunks: DataFrame, size: str, by: str, order: str, start: int = 0) -> DataFrame:
    """Each chunk's offset in its file: the sizes before it, from ``start``."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return chunks.withColumn("offset", (F.sum(size).over(w) - F.col(size) + start).cast("long"))


def tile_stats(px: DataFrame, tile: int, value: str = "r") -> DataFrame:
    return px.groupBy(F.expr(f"y div {tile}").cast("long").alias("ty"), F.expr(f"x div {tile}").cast("long").alias("tx")).agg(F.count(value).alias("n"), F.min(value).cast("long").alias("lo"), F.max(value).cast("long").alias("hi"), F.sum(value).cast("long").alias("total"))


def tiles_of_regions(regions: DataFrame, tile: int) -> DataFrame:
    """Regions (id, x, y, width, height) to the tiles they touch: an equality join key instead of a range join."""
    tx, ty = (F.explode(F.expr(f"sequence({a} div {tile}, ({a} + {n} - 1) div {tile})")) for a, n in (("x", "width"), ("y", "height")))
    return regions.withColumn("tx", tx).withColumn("ty", ty)


def nearest_tiles(tiles: DataFrame, cx: int, cy: int, limit: int, exclude: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` tiles (tx, ty) by Chebyshev ring about (cx, cy); in a ring the top row from the left, the bottom row,
    the left column from the top, the right column."""
    t = tiles.join(exclude.select("tx", "ty"), ["tx", "ty"], "left_anti") if exclude is not None else tiles
    dx, dy = F.col("tx") - cx, F.col("ty") - cy
    ring = F.greatest(F.abs(dx), F.abs(dy))
    t = t.withColumn("ring", ring.cast("long"))
    seg = F.when(dy == -F.col("ring"), 0).when(dy == F.col("ring"), 1).when(dx == -F.col("ring"), 2).otherwise(3)
    t = t.withColumn("seg", seg.cast("long")).withColumn("seq", F.when(F.col("seg") < 2, F.col("tx")).otherwise(F.col("ty")).cast("long"))
    return t.orderBy("ring", "seg", "seq").limit(limit)


def visible_range(origin: Column, extent: Column, tile: int, tiles: Column, margin: int = 0) -> tuple[Column, Column]:
    """First and last tile of an axis; the far edge is the floor of the exclusive edge, so an aligned edge takes one tile more."""
    top = tiles - 1
    clamp = lambda v: F.greatest(F.lit(0), F.least(top, v)).cast("long")
    return clamp(F.floor(origin / tile) - margin), clamp(F.floor((origin + extent) / tile) + margin)


def needs_fetch(wanted: DataFrame, *have: DataFrame, on: list[str]) -> DataFrame:
    for h in have:
        wanted = wanted.join(h.select(*on).distinct(), on, "left_anti")
    return wanted


def one_per_width(pages: DataFrame) -> DataFrame:
    """Of pages (src, w, h) the first of each width, widest first."""
    first = pages.groupBy("w").agg(F.min(F.struct("src", "h")).alias("first"))
    return first.select("first.src", "w", "first.h").orderBy(F.desc("w"))
