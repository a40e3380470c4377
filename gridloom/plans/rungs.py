"""Which pages of a file are reduced copies of another, how they are cut for display, and what overview is made of them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sizing import MIB, bytes_per_pixel

# fixed values: longest side of an overview and of a preview, its tiles, the most pixels an overview reads in full, the widest band
OVERVIEW, PREVIEW, OVERVIEW_TILE, FULL_PIXELS, WIDEST = 4096, 1024, 512, 128_000_000, 4096


@dataclass(frozen=True)
class Rung:
    """What planning needs to know of a page."""

    width: int
    height: int
    tile: tuple[int, int] | None = None
    rows_per_strip: int = 0
    spp: int = 3
    bits: int = 8
    compression: int = 1
    photometric: int = 2
    planar: int = 1

    @classmethod
    def of(cls, page) -> Rung:
        """Of a page of a raster file."""
        tile = (int(page.one(322)), int(page.one(323))) if page.tiled else None
        return cls(page.width, page.height, tile, int(page.one(278, page.height)), page.spp, page.bits, int(page.one(259, 1)), int(page.one(262, -1)), int(page.one(284, 1)))


@dataclass(frozen=True)
class Level:
    width: int
    height: int
    tile_width: int
    tile_height: int
    downsample_x: float
    downsample_y: float
    rung: int
    strips: bool = False
    native_jpeg: bool = False


@dataclass(frozen=True)
class Overview:
    rung: int
    width: int
    height: int
    sparse: bool = False


def rung_downsample(rung: Rung, base: Rung) -> tuple[float, float] | None:
    """How many pixels of the base one of the rung covers across and down; None if it is no reduced copy.

    The nearest power of two wins if on both axes the rung holds the reduced extent with less than a tile of padding;
    otherwise the ratios count if they are within a fifth of each other.
    """
    if rung.width >= base.width or rung.height > base.height:
        return None
    across, down = base.width / rung.width, base.height / rung.height
    power = float(2 ** math.floor(math.log2(across) + 0.5))
    pads = rung.tile or (1, 1)
    spare = [have - whole / power for have, whole in ((rung.width, base.width), (rung.height, base.height))]
    if all(-1 <= s < pad for s, pad in zip(spare, pads, strict=True)):
        return power, power
    return (across, down) if abs(across - down) <= 0.2 * across else None


def find_rungs(pages: list[Rung], base: int = 0, extra: list[Rung] = ()) -> list[Rung]:
    """The base and its reduced copies, widest first, the first page of each width."""
    of_width: dict[int, Rung] = {}
    for p in [*pages, *extra]:
        if rung_downsample(p, pages[base]):
            of_width.setdefault(p.width, p)
    return [pages[base], *(of_width[w] for w in sorted(of_width, reverse=True))]


def band_rows(p: Rung, most: int = 16 * MIB) -> int:
    """Rows of a display band: whole strips up to ``most`` bytes, or rows of one larger strip; at most WIDEST."""
    line = p.width * bytes_per_pixel(p.spp, p.bits)
    strip = min(max(p.rows_per_strip, 1), p.height)
    rows = strip * (most // (strip * line)) or max(1, most // line)
    if rows > WIDEST:
        rows = WIDEST // strip * strip or WIDEST
    return min(rows, p.height)


def band_rows_column(width: Column, height: Column, rows_per_strip: Column, spp: int, bits: int, most: int = 16 * MIB) -> Column:
    """band_rows() for many pages."""
    line = width * bytes_per_pixel(spp, bits)
    strip = F.least(F.greatest(rows_per_strip, F.lit(1)), height)
    rows = strip * F.floor(F.lit(most) / (strip * line))
    rows = F.when(rows > 0, rows).otherwise(F.greatest(F.lit(1), F.floor(F.lit(most) / line)))
    whole = F.floor(F.lit(WIDEST) / strip) * strip
    return F.least(height, F.when(rows > WIDEST, F.when(whole > 0, whole).otherwise(WIDEST)).otherwise(rows)).cast("long")


def downsample_columns(pairs: DataFrame, tile: int = 1) -> DataFrame:
    """rung_downsample() for rows of a base (w, h) and a rung (rw, rh) with tiles of that size: rows of rungs that are reduced
    in size, with across and down (null: no reduced copy)."""
    across, down = F.col("w") / F.col("rw"), F.col("h") / F.col("rh")
    power = F.pow(F.lit(2.0), F.floor(F.log2(across) + 0.5))
    spare = [F.col("rw") - F.col("w") / power, F.col("rh") - F.col("h") / power]
    fits = (spare[0] >= -1) & (spare[0] < tile) & (spare[1] >= -1) & (spare[1] < tile)
    near = F.abs(across - down) <= 0.2 * across
    return pairs.where("rw < w and rh <= h").withColumns({"across": F.when(fits, power).when(near, across), "down": F.when(fits, power).when(near, down)})


def native_jpeg(p: Rung) -> bool:
    """Can its tiles go to a JPEG decoder as they are?"""
    return p.tile is not None and p.compression == 7 and p.planar != 2 and p.bits == 8 and p.photometric in {3: (2, 6), 1: (1,)}.get(p.spp, ())


def level_of(p: Rung, base: Rung, rung: int = 0) -> Level:
    tw, th = p.tile or (min(p.width, WIDEST), band_rows(p))
    x, y = rung_downsample(p, base) or (base.width / p.width, base.height / p.height)
    return Level(p.width, p.height, tw, th, x, y, rung, p.tile is None, native_jpeg(p))


def plan_overview(rungs: list[Rung], most: int = OVERVIEW) -> Overview:
    """The last rung whose longer side is ``most`` or more (else the base), shrunk to ``most``; large tiled ones are sampled."""
    k = max((i for i, p in enumerate(rungs) if max(p.width, p.height) >= most), default=0)
    p = rungs[k]
    scale = most / max(p.width, p.height)
    if scale >= 1:
        return Overview(k, p.width, p.height)
    shrunk = [min(n, max(1, math.floor(n * scale + 0.5))) for n in (p.width, p.height)]
    return Overview(k, *shrunk, p.tile is not None and p.width * p.height > FULL_PIXELS)


def describe(rungs: list[Rung]) -> tuple[list[Level], Overview, Level]:
    """(levels, overview, its level): a source without a small rung gets the overview as its last level, unless it is sampled."""
    levels = [level_of(p, rungs[0], k) for k, p in enumerate(rungs)]
    small = max(rungs[-1].width, rungs[-1].height) <= OVERVIEW
    plan = plan_overview(rungs, PREVIEW if small else OVERVIEW)
    src = levels[plan.rung]
    over = Level(plan.width, plan.height, OVERVIEW_TILE, OVERVIEW_TILE, src.downsample_x * src.width / plan.width, src.downsample_y * src.height / plan.height, -1)
    return levels + [over] * (not small and not plan.sparse), plan, over


def overview_plans(rungs: DataFrame, most: int = OVERVIEW) -> DataFrame:
    """plan_overview for many sources: src, rung (0: base), w, h to src, rung, width, height. One shuffle on src."""
    side = F.greatest("w", "h")
    chosen = rungs.withColumn("enough", side >= most).withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("enough"), F.when(F.col("enough"), -F.col("rung")).otherwise(F.col("rung"))))).where("k = 1")
    scale = F.least(F.lit(1.0), F.lit(float(most)) / side)
    fit = [F.greatest(F.lit(1), F.round(F.col(c) * scale)).cast("long").alias(n) for c, n in (("w", "width"), ("h", "height"))]
    return chosen.select("src", F.col("rung").cast("long").alias("rung"), *fit)
