"""Sequential Huffman JPEG streams of 8 bits a sample to samples: 1, 3 or 4 components, any subsampling, restart intervals."""

from __future__ import annotations

import numpy as np

from ..errors import RasterDataError

# fixed values: the zigzag order of a block, marker codes
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
SOI, EOI, SOS, DQT, DHT, DRI, APP14 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xEE

_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.5**1.5) for x in range(8)] for u in range(8)])


def _u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big")


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: length of the code << 8 | symbol; 0 for none."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - length)
            if lo >= 1 << 16:
                raise RasterDataError("JPEG: a Huffman table has too many codes")
            out[lo : lo + (1 << (16 - length))] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out.tolist()


class _Part:
    """A component: id, sampling, quantisation table, and its coefficients by block."""

    def __init__(self, ident: int, h: int, v: int, q: int):
        self.ident, self.h, self.v, self.q, self.dc, self.ac = ident, h, v, q, 0, 0


def _scan(data: bytes, parts: list[_Part], dc: dict, ac: dict, mcus: int, interval: int, blocks: list[np.ndarray], place) -> None:
    """Fills the blocks of a scan from its entropy-coded bytes; place: the block of a component's k-th unit."""
    pieces, at = [], 0
    while True:  # cut at the restart marks, without stuffed bytes
        end = data.find(b"\xff", at)
        while 0 <= end < len(data) - 1 and data[end + 1] == 0:
            end = data.find(b"\xff", end + 2)
        end = len(data) if end < 0 else end
        pieces.append(data[at:end].replace(b"\xff\x00", b"\xff"))
        if end + 1 < len(data) and 0xD0 <= data[end + 1] <= 0xD7:
            at = end + 2
            continue
        break
    zig = ZIGZAG.tolist()
    done = 0
    for piece in pieces:
        raw = np.frombuffer(piece + b"\xff" * 8, np.uint8).astype(np.int64)
        word = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()
        p, bits = 0, 8 * len(piece) + 16  # a decoder may look a little beyond the end
        last = [0] * len(parts)
        for mcu in range(done, min(mcus, done + interval) if interval else mcus):
            for c, part in enumerate(parts):
                d, a = dc[part.dc], ac[part.ac]
                for unit in range(1 if len(parts) == 1 else part.h * part.v):
                    if p > bits:
                        raise RasterDataError("JPEG: the scan ends too early")
                    row = blocks[c][place(c, mcu, unit)]
                    hit = d[word[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                    if not hit:
                        raise RasterDataError("JPEG: no such Huffman code")
                    p += hit >> 8
                    if s := hit & 255:
                        v = word[p >> 3] >> (32 - (p & 7) - s) & ((1 << s) - 1)
                        p += s
                        last[c] += v if v >> (s - 1) else v - (1 << s) + 1
                    row[0] = last[c]
                    k = 1
                    while k < 64:
                        if p > bits:
                            raise RasterDataError("JPEG: the scan ends too early")
                        hit = a[word[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                        if not hit:
                            raise RasterDataError("JPEG: no such Huffman code")
                        p += hit >> 8
                        run, s = hit >> 4 & 15, hit & 15
                        if not s:
                            if run < 15:
                                break
                            k += 16
                            continue
                        k += run
                        if k > 63:
                            raise RasterDataError("JPEG: a block is too long")
                        v = word[p >> 3] >> (32 - (p & 7) - s) & ((1 << s) - 1)
                        p += s
                        row[zig[k]] = v if v >> (s - 1) else v - (1 << s) + 1
                        k += 1
        done += interval or mcus
    if done < mcus:
        raise RasterDataError("JPEG: restart intervals are missing")


def decode(data: bytes, width: int, height: int, spp: int) -> np.ndarray:
    """Samples (height, width, spp): grey, RGB (from YCbCr, but where the stream says that it isn't) or four components as they are.
    Another size or number of components than asked for, and progressive streams, are errors."""
    if spp not in (1, 3, 4):
        raise RasterDataError(f"JPEG of {spp} samples a pixel")
    if data[:2] != bytes((0xFF, SOI)):
        raise RasterDataError("JPEG: no stream begins here")
    quant, dc, ac, parts, at = {}, {}, {}, [], 2
    interval, transform, blocks, w, h = 0, None, [], 0, 0
    try:
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == EOI:
                break
            if kind == 0 or kind == 1 or 0xD0 <= kind <= SOI:
                at += 2
                continue
            n = _u16(data, at + 2)
            seg, after = data[at + 4 : at + 2 + n], at + 2 + n
            if kind == DQT:
                k = 0
                while k < len(seg):
                    wide, no = seg[k] >> 4, seg[k] & 15
                    size = 128 if wide else 64
                    quant[no] = np.frombuffer(seg[k + 1 : k + 1 + size], ">u2" if wide else np.uint8).astype(np.float64)
                    k += 1 + size
            elif kind == DHT:
                k = 0
                while k < len(seg):
                    counts = seg[k + 1 : k + 17]
                    (ac if seg[k] >> 4 else dc)[seg[k] & 15] = _lookup(counts, seg[k + 17 : k + 17 + sum(counts)])
                    k += 17 + sum(counts)
            elif kind == DRI:
                interval = _u16(seg, 0)
            elif kind == APP14 and seg[:5] == b"Adobe":
                transform = seg[11]
            elif kind in (0xC0, 0xC1):
                if seg[0] != 8:
                    raise RasterDataError(f"JPEG of {seg[0]} bits a sample")
                h, w = _u16(seg, 1), _u16(seg, 3)
                if (w, h) != (width, height):
                    raise RasterDataError(f"the JPEG stream is {w}x{h}, not {width}x{height}")
                if seg[5] != spp:
                    raise RasterDataError(f"the JPEG stream has {seg[5]} components, not {spp}")
                parts = [_Part(seg[6 + 3 * k], seg[7 + 3 * k] >> 4, seg[7 + 3 * k] & 15, seg[8 + 3 * k]) for k in range(spp)]
                hm, vm = max(x.h for x in parts), max(x.v for x in parts)
                across, down = -(-w // (8 * hm)), -(-h // (8 * vm))
                blocks = [np.zeros((across * x.h * down * x.v, 64), np.int64) for x in parts]
            elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
                raise RasterDataError("a JPEG stream that isn't sequential")
            elif kind == SOS:
                if not parts:
                    raise RasterDataError("JPEG: a scan before its frame")
                chosen = []
                for k in range(seg[0]):
                    c = next(i for i, x in enumerate(parts) if x.ident == seg[1 + 2 * k])
                    parts[c].dc, parts[c].ac = seg[2 + 2 * k] >> 4, seg[2 + 2 * k] & 15
                    chosen.append(c)
                some = [parts[c] for c in chosen]
                if len(some) == 1:  # units of the component itself, row by row
                    x = some[0]
                    own = -(-(-(-w * x.h // hm)) // 8)
                    units = own * -(-(-(-h * x.v // vm)) // 8)

                    def place(c, mcu, unit, own=own, wide=across * x.h):
                        return mcu // own * wide + mcu % own
                else:
                    units = across * down

                    def place(c, mcu, unit, some=some):
                        x = some[c]
                        return (mcu // across * x.v + unit // x.h) * across * x.h + mcu % across * x.h + unit % x.h
                lists = [blocks[c].tolist() for c in chosen]
                _scan(data[after:], some, dc, ac, units, interval, lists, place)
                for c, rows in zip(chosen, lists, strict=True):
                    blocks[c] = np.array(rows, np.int64).reshape(-1, 64)
                while after < len(data) and not (data[after] == 0xFF and after + 1 < len(data) and data[after + 1] not in (0, *range(0xD0, 0xD8))):
                    after = data.find(b"\xff", after + 1)
                    if after < 0:
                        after = len(data)
            at = after
    except (IndexError, KeyError, StopIteration, ValueError) as e:
        raise RasterDataError(f"JPEG: {e!r}") from None
    if not parts:
        raise RasterDataError("JPEG: no frame")
    planes = []
    for x, b in zip(parts, blocks, strict=True):
        if x.q not in quant:
            raise RasterDataError("JPEG: a quantisation table is missing")
        table = np.zeros(64)
        table[ZIGZAG] = quant[x.q]
        px = np.einsum("uy,nuv,vx->nyx", _COS, (b * table).reshape(-1, 8, 8), _COS) + 128
        wide = across * x.h
        plane = np.clip(np.rint(px), 0, 255).reshape(-1, wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, wide * 8)
        planes.append(np.repeat(np.repeat(plane, vm // x.v, 0), hm // x.h, 1)[:h, :w])
    out = np.stack(planes, 2)
    rgb = transform == 0 or [x.ident for x in parts] == list(b"RGB")
    if spp == 3 and not rgb:
        y, cb, cr = out[..., 0], out[..., 1] - 128, out[..., 2] - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
