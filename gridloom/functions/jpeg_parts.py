"""Segments of JPEG streams inside raster chunks: whole or abbreviated, merged tables, streams cut over chunks. No decoding of pixels."""

from __future__ import annotations

# fixed values: marker codes
SOI, EOI, SOS = 0xD8, 0xD9, 0xDA
#: Start-of-frame markers: C0 to CF but the tables' C4, C8 and CC.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
# fixed value: an Adobe segment that says "no colour transform"
ADOBE_RGB = bytes.fromhex("FFEE000E41646F626500640000000000")


def self_contained(data: bytes) -> bool:
    """Does it end the image, with a frame before its scan?"""
    if len(data) < 4 or data[-2:] != bytes((0xFF, EOI)):
        return False
    at = 2 if data[:2] == bytes((0xFF, SOI)) else 0
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind in FRAMES:
            return True
        if kind in (SOS, EOI):
            return False
        if kind == 0xFF:  # fill
            at += 1
        elif kind == 1 or 0xD0 <= kind <= SOI:  # without a length
            at += 2
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return False


def body(data: bytes) -> bytes:
    """Without the marks of begin and end."""
    return data.removeprefix(bytes((0xFF, SOI))).removesuffix(bytes((0xFF, EOI)))


def whole(chunks: list[bytes], tables: bytes | None = None, rgb: bool = False) -> bytes:
    """One stream of chunks: their bodies one after another, behind shared tables; rgb: marked as not YCbCr."""
    return b"".join((bytes((0xFF, SOI)), ADOBE_RGB if rgb else b"", body(tables or b""), *map(body, chunks), bytes((0xFF, EOI))))
