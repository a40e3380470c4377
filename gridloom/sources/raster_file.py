"""Tagged raster files: header, directories and tags to records, chunks to samples, and the writer; classic and 64-bit, either byte order.

A Spark data source ("tagraster") reads and writes such files (raster_source).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..errors import RasterDataError
from ..functions import codecs, fax, jpeg, jpeg_parts

# fixed values: tag type code -> (bytes, struct code)
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
# fixed values: tag ids
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SPP, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, COLOR_MAP = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, EXIF, GPS = 322, 323, 324, 325, 34665, 34853
T4_OPTIONS, T6_OPTIONS, JPEG_TABLES = 292, 293, 347
GEO_SCALE, GEO_TIEPOINTS, GEO_TRANSFORM, GEO_KEYS, GEO_DOUBLES, GEO_ASCII = 33550, 33922, 34264, 34735, 34736, 34737


#: Bytes that a file is asked for at least, so that headers and directories come in a few requests.
WINDOW = 64 << 10


def open_file(path: str):
    """A file to seek in: local, or of a store that Arrow knows by the path's scheme."""
    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file://"), "rb")
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    return fs.open_input_file(inner)


class Bytes:
    """Random access to bytes in memory, to a path, or to a file object of one's own; out of range is a data error. Of files a
    window of WINDOW bytes is kept."""

    def __init__(self, data: bytes | None = None, path: str | None = None, file=None):
        self.data, self.file = data, file or (open_file(path) if path else None)
        self.reads: list[tuple[int, int]] = []
        self.at, self.window = 0, b""

    def read(self, at: int, n: int) -> bytes:
        self.reads.append((at, n))
        if self.file:
            if not (self.at <= at and at + n <= self.at + len(self.window)):
                self.file.seek(max(0, at))
                self.at, self.window = at, self.file.read(max(n, WINDOW))
            out = self.window[at - self.at : at - self.at + n] if at >= 0 else b""
        else:
            out = self.data[at : at + n] if at >= 0 else b""
        if len(out) < n:
            raise RasterDataError(f"{n} bytes at {at} are past the end")
        return bytes(out)

    def close(self) -> None:
        if self.file:
            self.file.close()


@dataclass
class Page:
    index: int
    tags: dict
    exif: dict = field(default_factory=dict)
    gps: dict = field(default_factory=dict)
    big_endian: bool = False

    def one(self, tag: int, default=None):
        v = self.tags.get(tag)
        return default if v is None or not len(v) else v[0]

    @property
    def width(self) -> int:
        return int(self.tags[WIDTH][0])

    @property
    def height(self) -> int:
        return int(self.tags[HEIGHT][0])

    @property
    def spp(self) -> int:
        return int(self.one(SPP, 1))

    @property
    def bits(self) -> int:
        b = set(self.tags.get(BITS, (1,)))
        if len(b) > 1:
            raise RasterDataError("channels of different depths")
        return int(b.pop())

    @property
    def tiled(self) -> bool:
        return STRIP_OFFSETS not in self.tags and TILE_OFFSETS in self.tags

    def chunks(self) -> list[tuple[int, int, int, int, int, int, int, int]]:
        """(x, y, width, height, valid width, valid height, offset, bytes) of each strip or tile; 0 bytes: sparse."""
        if self.one(PLANAR, 1) == 2:
            raise RasterDataError("planar samples")
        w, h = self.width, self.height
        if self.tiled:
            tw, th = int(self.tags[TILE_WIDTH][0]), int(self.tags[TILE_HEIGHT][0])
            off, n = self.tags[TILE_OFFSETS], self.tags[TILE_COUNTS]
            across, down = -(-w // tw), -(-h // th)
            if len(off) != across * down or len(n) != len(off):
                raise RasterDataError("tile count")
            return [(tx * tw, ty * th, tw, th, min(tw, w - tx * tw), min(th, h - ty * th), int(off[ty * across + tx]), int(n[ty * across + tx])) for ty in range(down) for tx in range(across)]
        if STRIP_OFFSETS not in self.tags:
            raise RasterDataError("neither strips nor tiles")
        rps = int(self.one(ROWS_PER_STRIP, h)) or h
        rps = h if rps <= 0 else min(rps, h)
        off, n = self.tags[STRIP_OFFSETS], self.tags[STRIP_COUNTS]
        if len(off) != len(n) or len(off) * rps < h:
            raise RasterDataError("strip count")
        return [(0, y, w, min(rps, h - y), w, min(rps, h - y), int(off[k]), int(n[k])) for k, y in enumerate(range(0, h, rps))]

    def decode_chunk(self, data: bytes, width: int, height: int) -> np.ndarray:
        """Samples (height, width, spp) of a chunk; no bytes are zeros."""
        count = width * height * self.spp
        if not data:
            return np.zeros((height, width, self.spp), codecs.dtype_for(self.bits))
        code, predictor, per_row = int(self.one(COMPRESSION, 1)), int(self.one(PREDICTOR, 1)), -(-width * self.spp * self.bits // 8)
        if code == codecs.JPEG:
            return self._jpeg(jpeg_parts.whole([data], self._tables()) if self._tables() else data, width, height)
        if code in (codecs.CCITT_RLE, codecs.CCITT_G3, codecs.CCITT_G4):
            if self.bits != 1 or self.spp != 1:
                raise RasterDataError("fax schemes hold one sample of one bit")
            raw = fax.decode(code, data, width, height, int(self.one(T4_OPTIONS, 0)), int(self.one(T6_OPTIONS, 0)))
        else:
            raw = codecs.decode(code, data)
        if len(raw) < per_row * height:
            raise RasterDataError("a chunk is too short")
        raw = raw[: per_row * height]
        if predictor == 2:
            raw = codecs.difference(raw, width, self.spp, self.bits, self.big_endian, undo=True)
        elif predictor != 1:
            raise RasterDataError(f"predictor {predictor}")
        if self.bits % 8 == 0:
            return codecs.unpack_samples(raw, count, self.bits, self.big_endian).reshape(height, width, self.spp)
        rows = [codecs.unpack_samples(raw[k * per_row : (k + 1) * per_row], width * self.spp, self.bits) for k in range(height)]
        return np.stack(rows).reshape(height, width, self.spp)

    def _tables(self) -> bytes | None:
        t = self.tags.get(JPEG_TABLES)
        return bytes(t) if t else None

    def _jpeg(self, data: bytes, width: int, height: int) -> np.ndarray:
        if codecs.JPEG_HOOK:
            out = np.asarray(codecs.JPEG_HOOK[-1](data, width, height, self.spp))
        else:
            out = jpeg.decode(jpeg_parts.whole([data], rgb=self.one(PHOTOMETRIC) == 2), width, height, self.spp)
        if out.size != width * height * self.spp:
            raise RasterDataError(f"the JPEG decoder gave {out.size} samples for {width}x{height}")
        return out.reshape(height, width, self.spp)

    def stitched(self, parts: list[bytes]) -> np.ndarray:
        """Samples of the whole page from one stream that is cut over its chunks."""
        return self._jpeg(jpeg_parts.whole(parts, self._tables()), self.width, self.height)

    def tile_jpeg(self, src: Bytes, tx: int, ty: int) -> bytes | None:
        """A tile as a stream of its own, for a decoder outside; None for a sparse tile."""
        if not self.tiled or int(self.one(COMPRESSION, 1)) != codecs.JPEG:
            raise RasterDataError("no JPEG tiles")
        across = -(-self.width // int(self.tags[TILE_WIDTH][0]))
        chunks = self.chunks()
        if not (0 <= tx < across and 0 <= ty < len(chunks) // across):
            raise IndexError(f"tile {tx}, {ty}")
        at, n = chunks[ty * across + tx][6:]
        if not n:
            return None
        data = src.read(at, n)
        if not jpeg_parts.self_contained(data):
            raise RasterDataError("the tile is part of a longer stream")
        return jpeg_parts.whole([data], self._tables(), rgb=self.one(PHOTOMETRIC) == 2)

    def decode(self, src: Bytes, region: tuple[int, int, int, int] | None = None) -> np.ndarray:
        """Samples of a region (x, y, width, height); chunks that don't touch it are not read."""
        x, y, w, h = region or (0, 0, self.width, self.height)
        if x < 0 or y < 0 or w <= 0 or h <= 0 or x + w > self.width or y + h > self.height:
            raise RasterDataError("region outside the page")
        out = np.zeros((h, w, self.spp), codecs.dtype_for(self.bits))
        chunks = self.chunks()
        jpeg = int(self.one(COMPRESSION, 1)) == codecs.JPEG
        for cx, cy, cw, ch, vw, vh, off, n in chunks:
            x0, y0, x1, y1 = max(x, cx), max(y, cy), min(x + w, cx + vw), min(y + h, cy + vh)
            if x0 < x1 and y0 < y1 and n:
                data = src.read(off, n)
                if jpeg and not jpeg_parts.self_contained(data):  # one stream cut over the chunks
                    return self.stitched([src.read(c[6], c[7]) for c in chunks if c[7]])[y : y + h, x : x + w]
                part = self.decode_chunk(data, cw, ch)
                out[y0 - y : y1 - y, x0 - x : x1 - x] = part[y0 - cy : y1 - cy, x0 - cx : x1 - cx]
        return out

    def geo(self) -> dict | None:
        """scale, tiepoints (of six), transform and keys (number, list or text), or None without any of them."""
        t = self.tags
        if not any(k in t for k in (GEO_SCALE, GEO_TIEPOINTS, GEO_TRANSFORM, GEO_KEYS)):
            return None
        keys, d = {}, list(t.get(GEO_KEYS, ()))
        for k in range(int(d[3]) if len(d) > 3 else 0):
            e = d[4 + 4 * k : 8 + 4 * k]
            if len(e) < 4:
                break
            key, where, n, value = (int(v) for v in e)
            if where == 0:
                keys[key] = value
            elif where == GEO_DOUBLES and value < len(t.get(GEO_DOUBLES, ())):
                keys[key] = float(t[GEO_DOUBLES][value])
            elif where == GEO_ASCII and GEO_ASCII in t:
                keys[key] = t[GEO_ASCII][value : value + n].removesuffix("|")
        tie = list(t.get(GEO_TIEPOINTS, ()))
        return {"scale": list(t.get(GEO_SCALE, ())), "tiepoints": [tie[k : k + 6] for k in range(0, len(tie) - 5, 6)], "transform": list(t.get(GEO_TRANSFORM, ())), "keys": keys}


def read_pages(src: Bytes) -> list[Page]:
    """All directories of the chain; a directory that comes again is an error (it would never end)."""
    head = src.read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise RasterDataError("no byte order mark")
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic == 42:
        big, at = False, struct.unpack(order + "I", head[4:8])[0]
    elif magic == 43:
        size, zero, at = struct.unpack(order + "HHQ", src.read(4, 12))
        if size != 8 or zero:
            raise RasterDataError("offset size")
        big = True
    else:
        raise RasterDataError(f"magic {magic}")
    pages, seen = [], set()
    while at:
        if at in seen:
            raise RasterDataError("directories form a cycle")
        seen.add(at)
        tags, at = read_directory(src, at, order, big)
        page = Page(len(pages), tags, big_endian=order == ">")
        for tag, kind in ((EXIF, "exif"), (GPS, "gps")):
            if tag in tags:
                setattr(page, kind, read_directory(src, int(tags[tag][0]), order, big)[0])
        if WIDTH not in tags or HEIGHT not in tags:
            raise RasterDataError("width or height is missing")
        pages.append(page)
    if not pages:
        raise RasterDataError("no directory")
    return pages


def read_directory(src: Bytes, at: int, order: str, big: bool) -> tuple[dict, int]:
    """Tags (the last of equal ids) and the next directory's offset."""
    n = struct.unpack(order + ("Q" if big else "H"), src.read(at, 8 if big else 2))[0]
    at += 8 if big else 2
    step, inline = (20, 8) if big else (12, 4)
    raw, tags = src.read(at, n * step), {}
    for k in range(n):
        e = raw[k * step : (k + 1) * step]
        tag, kind = struct.unpack(order + "HH", e[:4])
        count = struct.unpack(order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
        if kind not in TYPES:
            raise RasterDataError(f"type {kind} of tag {tag}")
        size, code = TYPES[kind]
        field_ = e[-inline:]
        data = field_[: size * count] if size * count <= inline else src.read(struct.unpack(order + ("Q" if big else "I"), field_)[0], size * count)
        if kind == 2:
            tags[tag] = data.split(b"\0")[0].decode("latin-1")
        elif kind in (5, 10):
            v = struct.unpack(f"{order}{2 * count}{code[0]}", data)
            tags[tag] = tuple(zip(v[::2], v[1::2], strict=True))
        else:
            tags[tag] = struct.unpack(f"{order}{count}{code}", data)
    nxt = src.read(at + n * step, 8 if big else 4)
    return tags, struct.unpack(order + ("Q" if big else "I"), nxt)[0]


def rational(v: tuple[int, int]) -> float:
    return v[0] / v[1] if v[1] else 0.0


# ---------------------------------------------------------------- writing


@dataclass
class Spec:
    """A page to write: samples (height, width, spp); strips of rows_per_strip, or tiles."""

    samples: np.ndarray
    bits: int = 8
    photometric: int = 1
    compression: int = 1
    predictor: int = 1
    color_map: list[int] | None = None
    rows_per_strip: int | None = None
    tile: tuple[int, int] | None = None
    #: More tags (id, type, values); a text as bytes with its end mark.
    extra: tuple = ()

    def __post_init__(self):
        if self.samples.ndim != 3 or not self.samples.size:
            raise ValueError("samples must be height x width x channels")
        if not 1 <= self.bits <= 32:
            raise ValueError("bits from 1 to 32")
        if self.tile and self.rows_per_strip:
            raise ValueError("strips or tiles, not both")
        if self.rows_per_strip is not None and self.rows_per_strip <= 0:
            raise ValueError("rows per strip must be positive")
        if self.tile and min(self.tile) <= 0:
            raise ValueError("tiles must have a size")
        if self.predictor == 2 and self.bits not in (8, 16):
            raise ValueError("differencing is of 8 or 16 bits a sample")

    def chunks(self, big_endian: bool) -> list[bytes]:
        h, w, _ = self.samples.shape
        if self.tile:
            tw, th = self.tile
            boxes = [(x, y, tw, th) for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            rps = min(self.rows_per_strip or h, h)
            boxes = [(0, y, w, min(rps, h - y)) for y in range(0, h, rps)]
        return [self._encode(x, y, cw, ch, big_endian) for x, y, cw, ch in boxes]

    def _encode(self, x: int, y: int, w: int, h: int, big_endian: bool) -> bytes:
        block = np.zeros((h, w, self.samples.shape[2]), self.samples.dtype)
        part = self.samples[y : y + h, x : x + w]
        block[: part.shape[0], : part.shape[1]] = part
        if self.bits % 8:
            raw = b"".join(codecs.pack_samples(r.ravel(), self.bits) for r in block)
        else:
            raw = codecs.pack_samples(block.ravel(), self.bits, big_endian)
        if self.predictor == 2:
            raw = codecs.difference(raw, w, block.shape[2], self.bits, big_endian)
        return codecs.encode(self.compression, raw)


def use_big(data_bytes: int, force: bool | None = None) -> bool:
    return force if force is not None else data_bytes > 0xFFFFFFFF - (16 << 20)


def write_file(specs: list[Spec], big: bool | None = None, big_endian: bool = False) -> bytes:
    """A file of these pages: header, directories with their values, then the chunks one after another."""
    if not specs:
        raise ValueError("no page")
    order = ">" if big_endian else "<"
    encoded = [s.chunks(big_endian) for s in specs]
    total = sum(len(c) for e in encoded for c in e)
    wide = use_big(total, big)
    if not wide and total > 0xFFFFFFFF:
        raise RasterDataError("too large for 32-bit offsets")
    word, long_type, step = ("Q", 16, 20) if wide else ("I", 4, 12)
    at, layout = (16 if wide else 8), []
    for s, chunks in zip(specs, encoded, strict=True):
        h, w, spp = s.samples.shape
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [s.bits] * spp), (COMPRESSION, 3, [s.compression]), (PHOTOMETRIC, 3, [s.photometric]), (SPP, 3, [spp]), (PLANAR, 3, [1])]
        if s.predictor != 1:
            tags.append((PREDICTOR, 3, [s.predictor]))
        if s.color_map is not None:
            tags.append((COLOR_MAP, 3, s.color_map))
        tags += s.extra
        sizes = [len(c) for c in chunks]
        if s.tile:
            tags += [(TILE_WIDTH, 4, [s.tile[0]]), (TILE_HEIGHT, 4, [s.tile[1]]), (TILE_OFFSETS, long_type, None), (TILE_COUNTS, long_type, sizes)]
        else:
            tags += [(ROWS_PER_STRIP, 4, [min(s.rows_per_strip or h, h)]), (STRIP_OFFSETS, long_type, None), (STRIP_COUNTS, long_type, sizes)]
        tags.sort(key=lambda t: t[0])
        begin = at
        at += (8 if wide else 2) + step * len(tags) + (8 if wide else 4)
        places = {}
        for tag, kind, values in tags:
            n = TYPES[kind][0] * (len(chunks) if values is None else len(values))
            if n > (8 if wide else 4):
                places[tag] = at
                at += n + (n & 1)
        layout.append((begin, tags, places))
    out, data_at = bytearray(at), at
    out[: 16 if wide else 8] = (b"MM" if big_endian else b"II") + (struct.pack(order + "HHHQ", 43, 8, 0, layout[0][0]) if wide else struct.pack(order + "HI", 42, layout[0][0]))
    for k, ((begin, tags, places), chunks) in enumerate(zip(layout, encoded, strict=True)):
        offsets = []
        for c in chunks:
            offsets.append(data_at)
            data_at += len(c)
        p = begin
        p += struct.pack_into(order + ("Q" if wide else "H"), out, p, len(tags)) or (8 if wide else 2)
        for tag, kind, values in tags:
            v = offsets if values is None else values
            raw = bytes(v) if kind == 2 else struct.pack(f"{order}{len(v)}{TYPES[kind][1]}", *v)
            struct.pack_into(f"{order}HH{word}", out, p, tag, kind, len(v))
            if tag in places:
                struct.pack_into(order + word, out, p + step - (8 if wide else 4), places[tag])
                out[places[tag] : places[tag] + len(raw)] = raw
            else:
                out[p + step - (8 if wide else 4) : p + step - (8 if wide else 4) + len(raw)] = raw
            p += step
        struct.pack_into(order + word, out, p, layout[k + 1][0] if k + 1 < len(layout) else 0)
    return bytes(out) + b"".join(c for e in encoded for c in e)
