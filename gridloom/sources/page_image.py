"""Pages of raster files as colour images, reduced, and written as pyramids; bands bound the memory of one file."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import RasterDataError
from ..functions import codecs
from ..operators.raster import level_dims
from .raster_file import COLOR_MAP, COMPRESSION, PHOTOMETRIC, Bytes, Page, Spec, read_pages, write_file

SUBSAMPLING = 530
DIRECT_PIXELS, BAND_BYTES = 64_000_000, 128 << 20
# fixed values: modes of Spark's image structs for 8-bit channels
MODES = {1: 0, 3: 16, 4: 24}


def _byte(v: np.ndarray) -> np.ndarray:
    """Rounded (halves up) and held to 0..255."""
    return np.clip(np.floor(v + 0.5), 0, 255).astype(np.uint8)


def _scaled(s: np.ndarray, bits: int) -> np.ndarray:
    return s.astype(np.uint8) if bits == 8 else _byte(s * (255.0 / (2**bits - 1)))


def to_rgba(page: Page, s: np.ndarray) -> np.ndarray:
    """Samples (height, width, spp) of a page as 8-bit RGBA. JPEG chunks are grey or RGB already, whatever the page says."""
    kind, bits, spp = page.one(PHOTOMETRIC), page.bits, s.shape[2]
    if int(page.one(COMPRESSION, 1)) == codecs.JPEG:
        if spp not in (1, 3):
            raise RasterDataError(f"JPEG of {spp} channels")
        kind = 1 if spp == 1 else 2
    need = {0: 1, 1: 1, 2: 3, 3: 1, 5: 4, 6: 3}.get(kind)
    if need is None or spp < need:
        raise RasterDataError(f"photometric {kind} of {spp} channels has no colour")
    out = np.full((*s.shape[:2], 4), 255, np.uint8)
    if kind in (0, 1):
        out[:, :, :3] = (_scaled(s[:, :, :1], bits) if kind else 255 - _scaled(s[:, :, :1], bits))
    elif kind == 2:
        n = min(spp, 4)
        out[:, :, :n] = _scaled(s[:, :, :n], bits)
    elif kind == 3:
        table = np.asarray(page.tags.get(COLOR_MAP, ()), np.uint32)
        if len(table) < 3 << bits:
            raise RasterDataError("the colour map is missing or too short")
        out[:, :, :3] = (table[: 3 << bits].reshape(3, -1).T >> 8).astype(np.uint8)[s[:, :, 0]]
    elif kind == 5:
        ink = s[:, :, :4] / float(2**bits - 1)
        out[:, :, :3] = _byte(255.0 * (1 - ink[:, :, :3]) * (1 - ink[:, :, 3:]))
    else:
        if tuple(page.tags.get(SUBSAMPLING, (2, 2))) != (1, 1):
            raise RasterDataError("subsampled YCbCr")
        y, cb, cr = (s[:, :, k].astype(np.float64) - (128 if k else 0) for k in range(3))
        out[:, :, :3] = _byte(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2))
    return out


def box_reduce(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Box filter to width x height: target o covers [o*S//D, (o+1)*S//D); (2*sum + n) // (2*n) per channel."""
    h, w = a.shape[:2]
    if width > w or height > h or width < 1 or height < 1:
        raise ValueError("a reduced size must be between 1 and the size")
    if (width, height) == (w, h):
        return a
    return _fold(a, np.arange(height) * h // height, np.arange(width) * w // width)


def _fold(a: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    total = np.add.reduceat(np.add.reduceat(a, rows, 0, dtype=np.int64), cols, 1)
    n = np.outer(np.diff(rows, append=a.shape[0]), np.diff(cols, append=a.shape[1]))[:, :, None]
    return ((2 * total + n) // (2 * n)).astype(a.dtype)


def reduce_page(page: Page, src: Bytes, width: int, height: int, band_bytes: int = BAND_BYTES) -> np.ndarray:
    """box_reduce of a page's RGBA, read in bands of whole target rows of at most band_bytes of source (one target row at least)."""
    rows, cols = np.append(np.arange(height) * page.height // height, page.height), np.arange(width) * page.width // width
    per_row, out, a = page.width * (page.spp * codecs.dtype_for(page.bits)().nbytes + 4), [], 0
    while a < height:
        b = max(a + 1, int(np.searchsorted(rows, rows[a] + band_bytes // per_row, "right")) - 1)
        y0, y1 = int(rows[a]), int(rows[b])
        rgba = to_rgba(page, page.decode(src, (0, y0, page.width, y1 - y0)))
        out.append(_fold(rgba, rows[a:b] - y0, cols))
        a = b
    return np.concatenate(out)


def pyramid_file(page: Page, src: Bytes, mode: str = "tiled_pyramid", tile: int = 512, least: int = 512, count: int | None = None, compression: int = codecs.DEFLATE, direct_pixels: int = DIRECT_PIXELS, band_bytes: int = BAND_BYTES) -> bytes:
    """A file of 8-bit RGB tiles: the base ("tiled_only"), the base and its halvings ("tiled_pyramid"), the halvings ("levels_only"),
    or those from the first of direct_pixels at most, which is read in bands ("large_levels"). count: levels written."""
    if mode not in ("tiled_only", "tiled_pyramid", "levels_only", "large_levels"):
        raise ValueError(mode)
    if tile <= 0 or least <= 0 or direct_pixels <= 0 or band_bytes <= 0 or (count is not None and count <= 0):
        raise ValueError("tile, least, count, direct_pixels and band_bytes must be positive")
    skips = mode in ("levels_only", "large_levels")
    dims = [(page.width, page.height)] if mode == "tiled_only" else level_dims(page.width, page.height, least, count and count + skips)
    if skips and len(dims) == 1:
        raise ValueError("there is no smaller level to build")
    first = 0
    if mode == "large_levels":
        first = next((k for k in range(1, len(dims)) if dims[k][0] * dims[k][1] <= direct_pixels), len(dims) - 1)
    level = reduce_page(page, src, *dims[first], band_bytes)
    kept = [] if mode == "levels_only" else [level]
    for w, h in dims[first + 1 :]:
        level = box_reduce(level, w, h)
        kept.append(level)
    return write_file([Spec(np.ascontiguousarray(x[:, :, :3]), photometric=2, compression=compression, tile=(tile, tile)) for x in kept])


def to_image(page: Page, src: Bytes, origin: str = "") -> dict:
    """The fields of Spark's image struct: RGBA in its order (blue first)."""
    rgba = to_rgba(page, page.decode(src))
    return {"origin": origin, "height": page.height, "width": page.width, "nChannels": 4, "mode": MODES[4], "data": rgba[:, :, [2, 1, 0, 3]].tobytes()}


def to_spec(image: dict, keep_alpha: bool = False, **options) -> Spec:
    """A page to write from an image struct of 8-bit channels: RGB, or RGBA if asked for and there."""
    n = image["nChannels"]
    if MODES.get(n) != image["mode"]:
        raise RasterDataError(f"image mode {image['mode']} of {n} channels")
    a = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], n)
    order = [0, 0, 0] if n == 1 else [2, 1, 0, 3] if n == 4 and keep_alpha else [2, 1, 0]
    return Spec(np.ascontiguousarray(a[:, :, order]), photometric=2, **options)


def _build(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    for b in batches:
        levels, sizes = [], []
        for path, target, no in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            src = Bytes(path=path)
            try:
                data = pyramid_file(read_pages(src)[no], src, **options)
            finally:
                src.close()
            with open(part := f"{target}.{uuid.uuid4().hex}.part", "wb") as f:
                f.write(data)
            os.replace(part, target)
            levels.append(len(read_pages(Bytes(data))))
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(levels, pa.int32()), pa.array(sizes, pa.int64())], names=["target", "levels", "bytes"])


def build_pyramids(files: DataFrame, **options) -> DataFrame:
    """Files (path, target, page) that executors see by open(): writes a pyramid for each and tells target, levels, bytes.

    A target appears whole, by renaming; a task that runs again writes the same bytes."""
    return files.select("path", "target", "page").mapInArrow(partial(_build, options=options), "target string, levels int, bytes long")
