"""Byte codecs of raster chunks: pure functions on bytes, and the same as Arrow functions on binary columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import RasterDataError

# ---------------------------------------------------------------- PackBits


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            if i + n + 1 > len(data):
                raise RasterDataError("PackBits: literal run past the end")
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            if i >= len(data):
                raise RasterDataError("PackBits: repeat without a byte")
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of two or more equal bytes (128 at most) become repeats, all else literals (128 at most)."""
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    cut = np.flatnonzero(np.diff(a)) + 1
    starts, ends = np.concatenate([[0], cut]), np.append(cut, len(a))
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        while e - s >= 2:
            flush()
            n = min(128, e - s)
            out += bytes((257 - n, data[s]))
            s += n
        if e > s:
            literal.append(data[s])
    flush()
    return bytes(out)


# ---------------------------------------------------------------- LZW

CLEAR, END, LIMIT = 256, 257, 4096


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widths one code early."""
    if not data:
        return b""
    out, table, known, width, prefix = bytearray(), {}, END + 1, 9, data[0]
    acc, bits, get = CLEAR, 9, table.get
    for byte in memoryview(data)[1:]:
        key = prefix << 8 | byte
        longer = get(key)
        if longer is not None:
            prefix = longer
            continue
        acc, bits = acc << width | prefix, bits + width
        table[key] = known
        known += 1
        if known in (512, 1024, 2048):
            width += 1
        if known >= LIMIT - 2:
            acc, bits = acc << width | CLEAR, bits + width
            table.clear()
            known, width = END + 1, 9
        if bits > 1024:  # whole bytes go out many at a time
            rest = bits & 7
            out += (acc >> rest).to_bytes(bits >> 3, "big")
            acc, bits = acc & (1 << rest) - 1, rest
        prefix = byte
    acc, bits = acc << width | prefix, bits + width
    width += known + 1 in (512, 1024, 2048)
    acc, bits = acc << width | END, bits + width
    rest = -bits & 7
    return bytes(out + (acc << rest).to_bytes(bits + rest >> 3, "big"))


def lzw_decode(data: bytes) -> bytes:
    """Both bit orders: streams that begin with 0 and an odd byte are old-style (least significant bit first, no early width)."""
    old = len(data) > 1 and data[0] == 0 and data[1] & 1 == 1
    out, table, width, prev = bytearray(), [], 9, None
    acc = bits = 0
    early = 0 if old else 1

    def reset() -> list[bytes]:
        return [bytes((i,)) for i in range(256)] + [b"", b""]

    table = reset()
    for byte in data:
        acc = acc | byte << bits if old else acc << 8 | byte
        bits += 8
        while bits >= width:
            if old:
                code = acc & (1 << width) - 1
                acc >>= width
            else:
                code = acc >> (bits - width)
                acc &= (1 << (bits - width)) - 1
            bits -= width
            if code == END:
                return bytes(out)
            if code == CLEAR:
                table, width, prev = reset(), 9, None
                continue
            if prev is None:
                if code > 255:
                    raise RasterDataError(f"LZW: code {code} after a clear code")
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                if len(table) < LIMIT:
                    table.append(prev + entry[:1])
            elif code == len(table) and len(table) < LIMIT:
                entry = prev + prev[:1]
                table.append(entry)
            else:
                raise RasterDataError(f"LZW: code {code} beyond the table")
            out += entry
            prev = entry
            if width < 12 and len(table) + early >= 1 << width:
                width += 1
    return bytes(out)


def deflate_encode(data: bytes) -> bytes:
    return zlib.compress(data)


def deflate_decode(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error as e:
        raise RasterDataError(f"Deflate: {e}") from None


# ---------------------------------------------------------------- registry

# fixed values: compression codes
NONE, CCITT_RLE, CCITT_G3, CCITT_G4, LZW, JPEG, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 2, 3, 4, 5, 7, 8, 32773, 32946
_DECODERS: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: lzw_decode, DEFLATE: deflate_decode, OLD_DEFLATE: deflate_decode, PACKBITS: packbits_decode}
_ENCODERS: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: lzw_encode, DEFLATE: deflate_encode, OLD_DEFLATE: deflate_encode, PACKBITS: packbits_encode}
#: (bytes, width, rows, samples per pixel) -> samples: decoders that go before jpeg.decode, in this process only.
JPEG_HOOK: list[Callable] = []


def decode(code: int, data: bytes) -> bytes:
    if code not in _DECODERS:
        raise RasterDataError(f"compression {code} can't be decoded here")
    return _DECODERS[code](data)


def encode(code: int, data: bytes) -> bytes:
    if code in (CCITT_RLE, CCITT_G3, CCITT_G4):
        raise RasterDataError(f"compression {code} is decode only")
    if code not in _ENCODERS:
        raise RasterDataError(f"compression {code} can't be encoded here")
    return _ENCODERS[code](data)


# ---------------------------------------------------------------- bits, samples, differencing


def dtype_for(bits: int):
    """The narrowest unsigned type that holds a sample."""
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32


def unpack_samples(data: bytes, count: int, bits: int, big_endian: bool = False) -> np.ndarray:
    """count samples of 1 to 32 bits; whole-byte depths follow the byte order, others come most significant bit first."""
    if not 1 <= bits <= 32:
        raise RasterDataError(f"{bits} bits a sample")
    if len(data) * 8 < count * bits:
        raise RasterDataError("fewer bytes than samples")
    if bits in (8, 16, 32):
        return np.frombuffer(data, np.dtype(dtype_for(bits)).newbyteorder(">" if big_endian else "<"), count).astype(dtype_for(bits))
    if bits == 24:
        b = np.frombuffer(data, np.uint8, 3 * count).reshape(-1, 3).astype(np.uint32)
        b = b if big_endian else b[:, ::-1]
        return b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2]
    x = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits).astype(np.uint64)
    return (x << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(1).astype(dtype_for(bits))


def pack_samples(samples: np.ndarray, bits: int, big_endian: bool = False) -> bytes:
    s = np.asarray(samples)
    if bits in (8, 16, 32):
        return s.astype(np.dtype(dtype_for(bits)).newbyteorder(">" if big_endian else "<")).tobytes()
    if bits == 24:
        x = s.astype(np.uint32)
        b = np.stack([x >> 16, x >> 8 & 255, x & 255], 1).astype(np.uint8)
        return (b if big_endian else b[:, ::-1]).tobytes()
    x = (s.astype(np.uint64)[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(x.astype(np.uint8).ravel()).tobytes()


def difference(data: bytes, width: int, spp: int, bits: int, big_endian: bool = False, undo: bool = False) -> bytes:
    """Horizontal differencing of rows of width * spp samples, modulo 2**8 or 2**16; a new buffer, so doing it twice is safe."""
    if bits not in (8, 16):
        raise RasterDataError(f"differencing of {bits} bits a sample")
    kind = np.dtype(dtype_for(bits)).newbyteorder(">" if big_endian else "<")
    rows = np.frombuffer(data, kind).astype(dtype_for(bits)).reshape(-1, width, spp)
    out = np.cumsum(rows, axis=1, dtype=rows.dtype) if undo else np.diff(rows, axis=1, prepend=np.zeros((rows.shape[0], 1, spp), rows.dtype))
    return out.astype(kind).tobytes()


# ---------------------------------------------------------------- on columns


#: Bytes of one batch that comes out, about: what is held of a column besides the batch that came in.
OUT_BYTES = 1 << 20


def _map(batches: Iterator[pa.RecordBatch], f: Callable, at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done, size, first = [], 0, 0
        for i in range(b.num_rows):
            x = b.column(at)[i].as_py()
            done.append(None if x is None else f(x))
            size += len(done[-1] or b"") + len(x or b"")
            if size >= OUT_BYTES or i == b.num_rows - 1:
                cols = [c.slice(first, len(done)) for c in b.columns]
                cols[at] = pa.array(done, pa.binary())
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
                done, size, first = [], 0, i + 1


def map_bytes(df: DataFrame, column: str, f: Callable[[bytes], bytes]) -> DataFrame:
    """df with f applied to a binary column, batch by batch; nulls stay."""
    return df.mapInArrow(partial(_map, f=f, at=df.columns.index(column)), df.schema)


def round_trip(data: bytes, code: int) -> bytes:
    return decode(code, encode(code, data))
