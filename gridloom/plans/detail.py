"""Level-of-detail choices as columns: which level and reduction a zoom shows, what is visible, the order of loading and painting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sizing

#: Tiles that a viewport asks for at most, and the part of the cache that they may fill.
WANTED, SHARE = 4096, 0.8


def target_level(scale: Column, downsamples: list[float], upsample: float = 1.3) -> Column:
    """The coarsest level (by its place) whose pixels are at most ``upsample`` screen pixels wide; 0 if none is."""
    out = F.lit(0)
    for k, d in enumerate(downsamples):
        out = F.when(scale * d <= upsample, k).otherwise(out)
    return out.cast("long")


def level_at(scale: Column, downsamples: list[float], upsample: float = 1.3) -> Column:
    """The level that a zoom shows and its downsampling, as a struct."""
    level = target_level(scale, downsamples, upsample)
    return F.struct(level.alias("level"), F.array(*[F.lit(float(d)) for d in downsamples])[level.cast("int")].alias("downsample"))


def level_label(level: Column, downsample: Column) -> Column:
    """L{level} · 1:1, or 1/x with a decimal below 10 where it has one."""
    small = F.regexp_replace(F.format_string("%.1f", downsample), r"\.0$", "")
    ratio = F.when(F.round(downsample) <= 1, "1:1").otherwise(F.concat(F.lit("1/"), F.when(downsample < 10, small).otherwise(F.round(downsample).cast("long").cast("string"))))
    return F.concat(F.lit("L"), level.cast("string"), F.lit(" · "), ratio)


def tile_plan(scale: Column, downsample: Column, tile: int, dpr: float = 1.0, native: bool = False, upsample: float = 1.3) -> dict[str, Column]:
    """span (by logical size, it bounds the number of tiles) and reduction (by physical pixels, it bounds the sharpness)."""
    texel = downsample * scale
    span = sizing.select_span(texel * tile)
    deep = max(3, tile.bit_length() - 3) if native else 16
    near, far = (sizing.select_reduction(texel * dpr, upsample, most) for most in (3, deep))
    return {"span": span, "reduction": F.when(span == 0, near).otherwise(far)}


def tiles_in(first_x: Column, last_x: Column, first_y: Column, last_y: Column) -> Column:
    """Tiles of an inclusive range; none where it is empty."""
    return (F.greatest(F.lit(0), last_x - first_x + 1) * F.greatest(F.lit(0), last_y - first_y + 1)).cast("long")


def in_range(tx: Column, ty: Column, first_x: Column, last_x: Column, first_y: Column, last_y: Column) -> Column:
    return tx.between(first_x, last_x) & ty.between(first_y, last_y)


def visible_rect(scale: Column, x: Column, y: Column, view_w: float, view_h: float, width: Column, height: Column) -> dict[str, Column]:
    """The part of an image that a viewport shows; x, y: where the image's corner lies in the viewport."""
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(top.cast("double"), v))
    return {"x0": clamp(-x / scale, width), "y0": clamp(-y / scale, height), "x1": clamp((view_w - x) / scale, width), "y1": clamp((view_h - y) / scale, height)}


def fit_view(width: Column, height: Column, view_w: float, view_h: float) -> dict[str, Column]:
    """Scale and origin that show the whole image in the middle."""
    scale = F.least(F.lit(view_w) / width, F.lit(view_h) / height)
    return {"scale": scale, "x": (width - view_w / scale) / 2, "y": (height - view_h / scale) / 2}


def zoom_about(scale: Column, x: Column, y: Column, focus_x: Column, focus_y: Column, factor: Column, fit: Column, most: float) -> dict[str, Column]:
    """The view after a zoom that keeps the image's point under the focus; the scale stays from half the fit to ``most``."""
    low = fit / 2
    new = F.greatest(low, F.least(F.greatest(low, F.lit(most)), scale * factor))
    return {"scale": new, "x": x + focus_x / scale - focus_x / new, "y": y + focus_y / scale - focus_y / new}


def wheel_factor(delta: Column) -> Column:
    return F.exp(-delta / 200)


def preview_shift(width: Column, height: Column, longest: int = 1024) -> Column:
    """The smallest shift by which the longer side is at most ``longest``."""
    out = F.lit(31)
    for s in range(30, -1, -1):
        out = F.when(sizing.reduced_extent(F.greatest(width, height), s) <= longest, s).otherwise(out)
    return out.cast("long")


def fallback_order(layers: DataFrame, by: str) -> DataFrame:
    """Cached layers (level, span, downsample) in the order of painting: ``place``, the coarsest first."""
    w = W.partitionBy(by).orderBy(F.desc("downsample"), F.desc("span"), "level")
    return layers.withColumn("place", F.row_number().over(w).cast("long"))


def sharpest(tiles: DataFrame, cell: list[str], value: str, downsample: str = "downsample", reduction: str = "reduction", extent: Column | None = None) -> DataFrame:
    """What a painter leaves on top of each cell who paints the tiles with the largest texels first; tiles under two pixels (extent) are left out."""
    seen = tiles if extent is None else tiles.where(extent >= 2)
    texel = F.col(downsample) * F.pow(F.lit(2), F.col(reduction))
    return seen.groupBy(*cell).agg(F.max_by(value, F.struct(-texel, F.col(value))).alias(value))


def wanted_tiles(core: DataFrame, margin: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Tiles (tx, ty, ring) to load: those on screen first, then those of the margin, each once, ``limit`` at most; with priority 0 or 1."""
    both = core.withColumn("priority", F.lit(0).cast("long")).unionByName(margin.withColumn("priority", F.lit(1).cast("long")))
    return both.groupBy("tx", "ty").agg(F.min(F.struct("priority", *order)).alias("p")).select("tx", "ty", "p.*").orderBy("priority", *order, "ty", "tx").limit(limit)


def tile_limit(cache_bytes: int, tile_w: int, tile_h: int, reduction: int = 0, pressed: bool = False) -> int:
    """How many tiles a viewport may ask for: what fits in its part of the cache, half of that under memory pressure."""
    shrink = lambda n: -(-n >> reduction) if reduction else n
    size = max(1, shrink(tile_w) * shrink(tile_h) * 4)
    return max(1, min(WANTED, int(cache_bytes * SHARE * (0.5 if pressed else 1)) // size))


def may_store(wanted: Column, cached_bytes: Column, size: Column, budget: int, old_version: Column, old_reduction: Column, version: Column, reduction: Column) -> Column:
    """Whether a finished tile goes to the cache: one that nobody wants only if it fits, a blurrier one never over a sharper one of its version."""
    blurrier = F.coalesce((old_version == version) & (old_reduction < reduction), F.lit(False))
    return (wanted | (cached_bytes + size <= budget)) & ~blurrier


def not_failed(requests: DataFrame, failures: DataFrame, on: list[str]) -> DataFrame:
    """Requests without those that have failed before."""
    return requests.join(failures.select(*on).distinct(), on, "left_anti")


def model_point(x: Column, y: Column, tie: Column, scale: Column) -> dict[str, Column]:
    """A raster point in the model's coordinates, by one tie point (i, j, k, x, y, z) and the pixel's size."""
    return {"mx": tie[3] + (x - tie[0]) * scale[0], "my": tie[4] - (y - tie[1]) * scale[1]}


# fixed values: names of codes
PHOTOMETRIC = {0: "white is zero", 1: "black is zero", 2: "RGB", 3: "palette", 4: "mask", 5: "CMYK", 6: "YCbCr", 8: "CIELab"}
COMPRESSION = {1: "none", 2: "CCITT RLE", 3: "CCITT group 3", 4: "CCITT group 4", 5: "LZW", 6: "old JPEG", 7: "JPEG", 8: "Deflate", 32773: "PackBits", 32946: "old Deflate"}
PLANAR = {1: "chunky", 2: "planar"}
TYPES = {1: "byte", 2: "ascii", 3: "short", 4: "long", 5: "rational", 6: "signed byte", 7: "undefined", 8: "signed short", 9: "signed long", 10: "signed rational", 11: "float", 12: "double", 13: "directory", 16: "long8", 17: "signed long8", 18: "directory8"}


def code_name(code: Column, names: dict[int, str]) -> Column:
    """A code's name; null for codes without one."""
    return F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[code.cast("int")]
