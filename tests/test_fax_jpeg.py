import random
import struct

import numpy as np
import pytest

from gridloom.errors import RasterDataError
from gridloom.functions import codecs, fax, jpeg_parts
from gridloom.sources import raster_file as rf

WORD = [{n: w for w, n in t.items()} for t in fax.RUNS]
MODE = {m: w for w, m in fax.MODES.items()}
V0, VR1, H, EOL = MODE[0], MODE[1], MODE["horizontal"], "0" * 11 + "1"


def pack(digits):
    return bytes(int(digits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(digits), 8))


def word(n, colour):
    out = ""
    while n >= 2560:
        out, n = out + WORD[colour][2560], n - 2560
    if n >= 64:
        out, n = out + WORD[colour][n // 64 * 64], n % 64
    return out + WORD[colour][n]


def w(n):
    return word(n, 0)


def b(n):
    return word(n, 1)


def test_code_words_are_prefix_free():
    for table in (*fax.RUNS, fax.MODES):
        words = sorted([*table, EOL] if table is not fax.MODES else table)
        assert all(not y.startswith(x) for x, y in zip(words, words[1:], strict=False))
    assert [len(t) for t in fax.RUNS] == [104, 104]


@pytest.mark.parametrize("code,digits,columns,rows,t4,want", [
    (4, V0, 8, 1, 0, "00"), (4, H + w(0) + b(8), 8, 1, 0, "FF"), (4, H + w(3) + b(5), 8, 1, 0, "1F"), (4, H + w(3) + b(5) + V0 + V0, 8, 2, 0, "1F1F"),
    (4, H + w(3) + b(5) + VR1 + V0, 8, 2, 0, "1F0F"), (2, w(3) + b(5), 8, 1, 0, "1F"), (2, w(10) + b(6), 16, 1, 0, "003F"), (3, EOL + "1" + w(3) + b(5), 8, 1, 1, "1F")])
def test_examples(code, digits, columns, rows, t4, want):
    assert fax.decode(code, pack(digits), columns, rows, t4).hex().upper() == want


def test_errors():
    for args in ((4, pack(V0), 8, 5), (3, b"\x80", 8, 1, 2), (4, b"\x80", 8, 1, 0, 2), (5, b"\x80", 8, 1), (4, b"", 8, 1)):
        with pytest.raises(RasterDataError):
            fax.decode(*args)


def changes(row):
    return [x for x in range(len(row)) if row[x] != (row[x - 1] if x else 0)]


def encode_plain(row):
    out, at, colour = "", 0, 0
    while at < len(row):
        end = next((x for x in range(at, len(row)) if row[x] != colour), len(row))
        out += word(end - at, colour)
        at, colour = end, 1 - colour
    return out


def encode_coded(row, above):
    """A row against the one above, by the textbook."""
    n, out, a0, colour = len(row), "", -1, 0
    while a0 < n:
        a1 = next((x for x in range(max(a0, 0), n) if row[x] != colour and x >= a0), n)
        b1 = next((x for x in changes(above) if x > a0 and above[x] != colour), n)
        b2 = next((x for x in changes(above) if x > b1), n)
        if b2 < a1:
            out, a0 = out + MODE["pass"], b2
        elif abs(a1 - b1) <= 3:
            out, a0, colour = out + MODE[a1 - b1], a1, 1 - colour
        else:
            a2 = next((x for x in range(a1, n) if row[x] == colour), n)
            out, a0 = out + H + word(a1 - max(a0, 0), colour) + word(a2 - a1, 1 - colour), a2
    return out


@pytest.mark.parametrize("columns", [1, 7, 8, 33, 200, 5300])
def test_random_pages(columns):
    r = random.Random(columns)
    page = []
    for _ in range(12):
        if page and r.random() < 0.6:
            row = page[-1][:]
            for _ in range(r.randint(0, 3)):
                row[r.randrange(columns)] ^= 1
        else:
            row, c = [], r.randint(0, 1)
            while len(row) < columns:
                row += [c] * r.choice([1, 2, 3, 9, 70, 3000])
                c = 1 - c
            row = row[:columns]
        page.append(row)
    want = b"".join(np.packbits(np.array(row, np.uint8)).tobytes() for row in page)
    blank = [0] * columns
    t6 = "".join(encode_coded(row, above) for row, above in zip(page, [blank, *page], strict=False))
    assert fax.decode(4, pack(t6 + EOL + EOL), columns, 12) == want
    assert fax.decode(3, pack("".join(EOL + encode_plain(row) for row in page)), columns, 12) == want
    mixed = "".join(EOL + ("1" + encode_plain(row) if k % 4 == 0 else "0" + encode_coded(row, page[k - 1])) for k, row in enumerate(page))
    assert fax.decode(3, pack(mixed), columns, 12, t4=1) == want
    assert fax.decode(2, b"".join(pack(encode_plain(row)) for row in page), columns, 12) == want


def raw_file(width, height, tags, chunks, offsets_tag):
    """A little-endian file of one page with ready chunks."""
    tags = {256: (4, [width]), 257: (4, [height]), **tags}
    tags[offsets_tag] = (4, [0] * len(chunks))
    tags[{273: 279, 324: 325}[offsets_tag]] = (4, [len(c) for c in chunks])
    head = 8 + 2 + 12 * len(tags) + 4
    def build(offsets):
        tags[offsets_tag] = (4, offsets)
        fields, extra = b"", b""
        for t in sorted(tags):
            kind, v = tags[t]
            data = struct.pack(f"<{len(v)}{ {1: 'B', 3: 'H', 4: 'I', 7: 'B'}[kind] }", *v)
            if len(data) > 4:
                place, extra = struct.pack("<I", head + len(extra)), extra + data
            else:
                place = data.ljust(4, b"\0")
            fields += struct.pack("<HHI", t, kind, len(v)) + place
        return b"II*\0\x08\0\0\0" + struct.pack("<H", len(tags)) + fields + b"\0" * 4 + extra
    at, offsets = len(build([0] * len(chunks))), []
    for c in chunks:
        offsets.append(at if c else 0)
        at += len(c)
    return rf.Bytes(build(offsets) + b"".join(chunks))


def test_fax_page():
    one = pack(H + w(3) + b(5) + V0 + V0)
    src = raw_file(8, 4, {258: (3, [1]), 259: (3, [4]), 262: (3, [0]), 277: (3, [1]), 278: (4, [2])}, [one, one], 273)
    (p,) = rf.read_pages(src)
    assert p.decode(src)[:, :, 0].tolist() == [[0, 0, 0, 1, 1, 1, 1, 1]] * 4
    src = raw_file(8, 2, {258: (3, [8]), 259: (3, [4]), 277: (3, [1]), 278: (4, [2])}, [one], 273)
    with pytest.raises(RasterDataError):
        rf.read_pages(src)[0].decode(src)


def fake_jpeg(payload, frame=True):
    return b"\xff\xd8" + (b"\xff\xc0\0\x03\x01" if frame else b"") + b"\xff\xda" + payload + b"\xff\xd9"


@pytest.fixture
def hook():
    seen = []
    codecs.JPEG_HOOK.append(lambda data, w, h, spp: (seen.append(data), np.full(w * h * spp, len(seen) * 10))[1])
    yield seen
    codecs.JPEG_HOOK.pop()


def test_jpeg_parts():
    assert jpeg_parts.self_contained(fake_jpeg(b"abc"))
    for bad in (b"", fake_jpeg(b"abc", frame=False), fake_jpeg(b"abc")[:-2], b"\xff\xd8\xff\xd9"):
        assert not jpeg_parts.self_contained(bad)
    assert jpeg_parts.self_contained(b"\xff\xd8\xff\xe0\0\x04\xff\xc0" + fake_jpeg(b"x")[2:])
    assert not jpeg_parts.self_contained(b"\xff\xd8\xff\xe0\0\x04\xff\xc0\xff\xda\xff\xd9")  # a frame's mark inside another segment
    assert jpeg_parts.whole([fake_jpeg(b"a"), b"bc"], b"\xff\xd8TT\xff\xd9") == b"\xff\xd8TT" + fake_jpeg(b"a")[2:-2] + b"bc\xff\xd9"


def test_jpeg_pages(hook):
    tags = {258: (3, [8, 8, 8]), 259: (3, [7]), 262: (3, [2]), 277: (3, [3]), 322: (4, [8]), 323: (4, [8]), 347: (7, list(b"\xff\xd8TT\xff\xd9"))}
    src = raw_file(24, 8, tags, [fake_jpeg(b"a"), b"", fake_jpeg(b"c")], 324)
    (p,) = rf.read_pages(src)
    assert p.decode(src)[0, ::8, 0].tolist() == [10, 0, 20] and b"TT" in hook[0]
    tile = p.tile_jpeg(src, 0, 0)
    assert tile[2:4] == b"\xff\xee" and len(jpeg_parts.ADOBE_RGB) == 16 and p.tile_jpeg(src, 1, 0) is None
    with pytest.raises(IndexError):
        p.tile_jpeg(src, 3, 0)
    whole = fake_jpeg(b"0123456789")
    strips = raw_file(16, 8, {258: (3, [8, 8, 8]), 259: (3, [7]), 262: (3, [2]), 277: (3, [3]), 278: (4, [4])}, [whole[:12], whole[12:]], 273)
    hook.clear()
    (p,) = rf.read_pages(strips)
    assert p.decode(strips, (4, 2, 3, 5)).shape == (5, 3, 3) and hook == [whole]


def test_jpeg_without_decoder_or_of_wrong_size():
    src = raw_file(8, 8, {258: (3, [8]), 259: (3, [7]), 277: (3, [1]), 278: (4, [8])}, [fake_jpeg(b"a")], 273)
    with pytest.raises(RasterDataError):
        rf.read_pages(src)[0].decode(src)
    codecs.JPEG_HOOK.append(lambda *a: np.zeros(16))
    with pytest.raises(RasterDataError):
        rf.read_pages(src)[0].decode(src)
    codecs.JPEG_HOOK.pop()
