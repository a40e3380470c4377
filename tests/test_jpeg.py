import numpy as np
import pytest

from gridloom.errors import RasterDataError
from gridloom.functions import codecs, jpeg
from gridloom.sources import raster_file as rf

COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.5**1.5) for x in range(8)] for u in range(8)])


def segment(kind, data):
    return bytes((0xFF, kind)) + (len(data) + 2).to_bytes(2, "big") + data


def codes():
    """All symbols with codes of 8 and 9 bits: no real table, but a right one."""
    symbols = bytes(range(256))
    counts = bytes([0] * 7 + [200, 56] + [0] * 7)
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = format(code, f"0{length}b")
            code, k = code + 1, k + 1
        code <<= 1
    return counts + symbols, out


def amplitude(v):
    s = abs(v).bit_length()
    return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""


def encode(planes, sampling, restart=0, separate=False, adobe=None, q=1):
    """A stream by the book, with one quantisation step for all: planes are component rasters at full size."""
    h, w = planes[0].shape
    hm, vm = max(a for a, _ in sampling), max(b for _, b in sampling)
    across, down = -(-w // (8 * hm)), -(-h // (8 * vm))
    table, code = codes()
    blocks = []
    for p, (a, b) in zip(planes, sampling, strict=True):
        full = np.pad(p, ((0, down * 8 * vm - h), (0, across * 8 * hm - w)), "edge").astype(float)
        fy, fx = vm // b, hm // a
        small = full.reshape(full.shape[0] // fy, fy, full.shape[1] // fx, fx).mean((1, 3)) - 128
        grid = small.reshape(small.shape[0] // 8, 8, small.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        blocks.append(np.rint(np.einsum("uy,abyx,vx->abuv", COS, grid, COS) / q).astype(int))

    def unit(block, before):
        z = block.reshape(64)[jpeg.ZIGZAG].tolist()
        s, bits = amplitude(z[0] - before)
        out, run = code[s] + bits, 0
        for k, v in enumerate(z[1:], 1):
            if not v:
                run += 1
                continue
            while run > 15:
                out, run = out + code[0xF0], run - 16
            s, bits = amplitude(v)
            out, run = out + code[run << 4 | s] + bits, 0
        return out + (code[0] if run else ""), z[0]

    def scan(which):
        units = []
        if len(which) == 1:
            a, b = sampling[which[0]]
            rows, cols = -(-(-(-h * b // vm)) // 8), -(-(-(-w * a // hm)) // 8)
            units = [[(which[0], y, x)] for y in range(rows) for x in range(cols)]
        else:
            units = [[(c, my * sampling[c][1] + v, mx * sampling[c][0] + u) for c in which for v in range(sampling[c][1]) for u in range(sampling[c][0])] for my in range(down) for mx in range(across)]
        out, step = b"", restart or len(units)
        for lo in range(0, len(units), step):
            bits, last = "", dict.fromkeys(which, 0)
            for mcu in units[lo : lo + step]:
                for c, y, x in mcu:
                    some, last[c] = unit(blocks[c][y, x], last[c])
                    bits += some
            bits += "1" * (-len(bits) % 8)
            out += int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\x00")
            if lo + step < len(units):
                out += bytes((0xFF, 0xD0 + lo // step % 8))
        return segment(0xDA, bytes([len(which), *(v for c in which for v in (c + 1, 0)), 0, 63, 0])) + out

    n = len(planes)
    head = b"\xff\xd8" + (segment(0xEE, b"Adobe\0\x64\0\0\0\0" + bytes([adobe])) if adobe is not None else b"")
    head += segment(0xDB, b"\0" + bytes([q] * 64)) + segment(0xC4, b"\0" + table) + segment(0xC4, b"\x10" + table) + (segment(0xDD, restart.to_bytes(2, "big")) if restart else b"")
    head += segment(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([n, *(v for c, (a, b) in enumerate(sampling) for v in (c + 1, a << 4 | b, 0))]))
    return head + (b"".join(scan([c]) for c in range(n)) if separate else scan(list(range(n)))) + b"\xff\xd9"


def smooth(seed, h, w):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 90 * np.sin(x / (5 + seed) + seed) * np.cos(y / 7) + r.integers(-3, 4, (h, w)), 0, 255)


@pytest.mark.parametrize("h,w", [(8, 8), (17, 33), (40, 21)])
@pytest.mark.parametrize("restart", [0, 2])
def test_grey(h, w, restart):
    a = smooth(1, h, w)
    got = jpeg.decode(encode([a], [(1, 1)], restart), w, h, 1)
    assert got.shape == (h, w, 1) and np.abs(got[..., 0] - a).max() <= 2


@pytest.mark.parametrize("separate", [False, True])
@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]])
def test_colour(sampling, separate):
    h, w = 35, 50
    flat = [np.repeat(np.repeat(smooth(k, -(-h // 2), -(-w // 2)), 2, 0), 2, 1)[:h, :w] for k in range(3)]
    y, cb, cr = flat[0], flat[1] - 128, flat[2] - 128
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)
    got = jpeg.decode(encode(flat, sampling, 3, separate), w, h, 3)
    assert np.abs(got - want).max() <= 6
    plain = jpeg.decode(encode(flat, sampling, 0, separate, adobe=0), w, h, 3)
    assert np.abs(plain - np.stack(flat, 2)).max() <= 3


def test_four_components_and_quantisation():
    parts = [smooth(k, 24, 24) for k in range(4)]
    assert np.abs(jpeg.decode(encode(parts, [(1, 1)] * 4), 24, 24, 4) - np.stack(parts, 2)).max() <= 2
    assert np.abs(jpeg.decode(encode(parts[:1], [(1, 1)], q=8), 24, 24, 1)[..., 0] - parts[0]).max() <= 24


def test_errors():
    good = encode([smooth(1, 16, 16)], [(1, 1)])
    for data, w, h, spp in ((good, 8, 16, 1), (good, 16, 16, 3), (good, 16, 16, 2), (b"", 1, 1, 1), (good[:40], 16, 16, 1), (good[:-60], 16, 16, 1), (good.replace(b"\xff\xc0", b"\xff\xc2"), 16, 16, 1)):
        with pytest.raises(RasterDataError):
            jpeg.decode(data, w, h, spp)


def test_pages_decode_without_a_hook():
    assert not codecs.JPEG_HOOK
    a = smooth(2, 20, 30)
    data = encode([a], [(1, 1)])
    page = rf.Page.__new__(rf.Page)
    page.tags = {rf.WIDTH: (30,), rf.HEIGHT: (20,), rf.SPP: (1,), rf.BITS: (8,), rf.COMPRESSION: (7,)}
    assert np.abs(page.decode_chunk(data, 30, 20)[..., 0] - a).max() <= 2
