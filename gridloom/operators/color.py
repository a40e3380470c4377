"""Colour and tone as column expressions. Samples are long columns; results are long columns from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(x: Column) -> Column:
    """Rounded half away from zero and clamped."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.round(x).cast("long")))


def scale_to_byte(v: Column, bits: int) -> Column:
    return v if bits == 8 else _byte(v * F.lit(255.0) / F.lit(float(2**bits - 1)))


def gray(v: Column, bits: int = 8, invert: bool = False) -> tuple[Column, Column, Column, Column]:
    g = scale_to_byte(v, bits)
    g = (F.lit(255) - g) if invert else g
    return g, g, g, F.lit(255).cast("long")


def rgb(r: Column, g: Column, b: Column, a: Column | None = None, bits: int = 8) -> tuple[Column, ...]:
    """A fourth sample is alpha."""
    return (*(scale_to_byte(x, bits) for x in (r, g, b)), scale_to_byte(a, bits) if a is not None else F.lit(255).cast("long"))


def palette(index: Column, color_map: Column, bits: int) -> tuple[Column, ...]:
    """color_map: an array of 3 * 2**bits 16-bit values, all reds, then greens, then blues."""
    n = 2**bits
    return (*(F.shiftright(F.try_element_at(color_map, (index + 1 + k * n).cast("int")), 8) for k in range(3)), F.lit(255).cast("long"))


def cmyk(c: Column, m: Column, y: Column, k: Column, bits: int = 8) -> tuple[Column, ...]:
    top = F.lit(float(2**bits - 1))
    return (*(_byte(F.lit(255.0) * (1 - x / top) * (1 - k / top)) for x in (c, m, y)), F.lit(255).cast("long"))


def ycbcr(y: Column, cb: Column, cr: Column) -> tuple[Column, ...]:
    """BT.601, one chroma sample a pixel."""
    u, v = cb - 128, cr - 128
    return _byte(y + F.lit(1.402) * v), _byte(y - F.lit(0.344136) * u - F.lit(0.714136) * v), _byte(y + F.lit(1.772) * u), F.lit(255).cast("long")


def adjust(v: Column, brightness: float = 0.0, contrast: float = 1.0, gamma: float = 1.0) -> Column:
    """Gamma, then contrast about 127.5, then brightness; the defaults change nothing. Alpha isn't adjusted."""
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    if (brightness, contrast, gamma) == (0.0, 1.0, 1.0):
        return v
    x = F.pow(v / F.lit(255.0), F.lit(1.0 / gamma)) * 255.0
    return _byte((x - 127.5) * F.lit(float(contrast)) + 127.5 + F.lit(float(brightness)))
