"""Planning arithmetic: bands, workers, budgets, level-of-detail choices. Plain functions, and columns where tables are planned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIB = 1 << 20


def bytes_per_pixel(spp: int, bits: int) -> int:
    """Samples in the narrowest type and four bytes of colour."""
    return spp * (1 if bits <= 8 else 2 if bits <= 16 else 4) + 4


def chunk_plan(width: int, height: int, natural: int, spp: int, bits: int, budget: int, least: int = 1) -> list[tuple[int, int]]:
    """Bands (y, height): the natural chunk height, or what the budget allows, ``least`` at least."""
    if budget <= 0 or least <= 0:
        raise ValueError("budget and least height must be positive")
    h = min(natural, budget // (width * bytes_per_pixel(spp, bits)), height)
    h = min(height, max(h, least))
    return [(y, min(h, height - y)) for y in range(0, height, h)]


def chunk_bands(pages: DataFrame, natural: int, spp: int, bits: int, budget: int, least: int = 1) -> DataFrame:
    """chunk_plan() for many pages (src, w, h): a row per band with y, height and n_bytes."""
    if budget <= 0 or least <= 0:
        raise ValueError("budget and least height must be positive")
    fit = F.floor(F.lit(budget) / (F.col("w") * bytes_per_pixel(spp, bits)))
    tall = F.least(F.col("h"), F.greatest(F.least(F.lit(natural), fit, F.col("h")), F.lit(least))).cast("long")
    bands = pages.withColumn("tall", tall).select("src", "w", "h", "tall", F.explode(F.expr("sequence(0L, h - 1, tall)")).alias("y"))
    height = F.least(F.col("tall"), F.col("h") - F.col("y"))
    return bands.select("src", "y", height.alias("height"), (height * F.col("w") * bytes_per_pixel(spp, bits)).alias("n_bytes"))


def workers_column(aggregate: int, band_bytes: Column, cpus: int) -> Column:
    """workers() for many plans."""
    return F.greatest(F.lit(1), F.least(F.floor(F.lit(aggregate) / band_bytes), F.lit(cpus))).cast("long")


def memory(text: str | None = None) -> tuple[int | None, int | None]:
    """(total, available) bytes of this machine as its kernel tells them (text: instead of /proc/meminfo); None where it doesn't. Never an error."""
    try:
        if text is None:
            with open("/proc/meminfo") as f:
                text = f.read()
        kib = {k: int(v.split()[0]) for k, v in (x.split(":", 1) for x in text.splitlines() if ":" in x)}
        return (kib["MemTotal"] << 10 if "MemTotal" in kib else None), (kib["MemAvailable"] << 10 if "MemAvailable" in kib else None)
    except (OSError, ValueError, IndexError):
        return None, None


def progress(steps: DataFrame, by: str) -> DataFrame:
    """Of each source's steps (by, step, units) the part of all units done after them, from 0 to 1."""
    w = W.partitionBy(by)
    done = F.sum("units").over(w.orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow))
    return steps.select(by, "step", (done.cast("double") / F.sum("units").over(w)).alias("fraction"))


def workers(aggregate: int, band: int, cpus: int) -> int:
    return max(1, min(aggregate // band, cpus))


def decode_budget(total: int | None, available: int | None, cpus: int) -> tuple[int, int]:
    """(all bands together, one band) in bytes."""
    if total is None or available is None:
        return 512 * MIB, max(16 * MIB, 512 * MIB // max(1, cpus - 1))
    usable = max(0, available - max(768 * MIB, int(total * 0.12)))
    aggregate = int(min(6 * 1024 * MIB, max(64 * MIB, usable * 0.55 / 1.5)))
    return aggregate, max(16 * MIB, aggregate // max(1, cpus - 1))


def select_span(size: Column, most: int = 10) -> Column:
    """Smallest s with size * 2**s >= 64, by comparisons."""
    out = F.lit(most)
    for s in range(most - 1, -1, -1):
        out = F.when(size * (1 << s) >= 64, s).otherwise(out)
    return out.cast("long")


def select_reduction(pixels_per_texel: Column, upsample: float = 1.3, most: int = 3) -> Column:
    """Largest s with pixels_per_texel * 2**s <= upsample."""
    out = F.lit(0)
    for s in range(1, most + 1):
        out = F.when(pixels_per_texel * (1 << s) <= upsample, s).otherwise(out)
    return out.cast("long")


def reduced_extent(extent: Column, shift: Column | int) -> Column:
    """ceil(extent / 2**shift)."""
    size = F.lit(1 << shift) if isinstance(shift, int) else F.pow(F.lit(2), shift).cast("long")
    return F.floor((extent + size - 1) / size).cast("long")


def initial_view(width: Column, height: Column, view_w: float, view_h: float, dpr: float = 1.0, budget: int = 4_000_000) -> dict[str, Column]:
    """Centred region of at most the budget's pixels, and its zoom."""
    w, h = F.least(F.lit(view_w * dpr), width.cast("double")), F.least(F.lit(view_h * dpr), height.cast("double"))
    shrink = F.when(w * h > budget, F.sqrt(F.lit(float(budget)) / (w * h))).otherwise(1.0)
    rw = F.least(width, F.greatest(F.lit(1), F.round(w * shrink))).cast("long")
    rh = F.least(height, F.greatest(F.lit(1), F.round(h * shrink))).cast("long")
    x, y = F.floor((width - rw) / 2).cast("long"), F.floor((height - rh) / 2).cast("long")
    return {"vx": x, "vy": y, "vw": rw, "vh": rh, "zoom": F.least(F.lit(view_w * dpr) / rw, F.lit(view_h * dpr) / rh)}


def zoom_label(scale: Column) -> Column:
    """Percent: none, one or two decimals by size."""
    p = scale * 100
    return F.when(p >= 10, F.format_string("%.0f%%", p)).when(p >= 1, F.format_string("%.1f%%", p)).otherwise(F.format_string("%.2f%%", p))
