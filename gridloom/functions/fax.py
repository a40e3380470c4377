"""Bilevel fax streams (T.4 one- and two-dimensional, T.6) to packed rows; 1 is black. Decode only.

A stream is looked at as a string of binary digits; a row is painted as runs, and the row above is known by the places
where its colour changes.
"""

from __future__ import annotations

from bisect import bisect_right

from ..errors import RasterDataError

# fixed values: code words of T.4, white runs of 0 to 63
_WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"""
# fixed values: white runs of 64 to 1728 by 64
_WHITE_LONG = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"""
# fixed values: black runs of 0 to 63
_BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"""
# fixed values: black runs of 64 to 1728 by 64
_BLACK_LONG = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010
0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"""
# fixed values: runs of either colour of 1792 to 2560 by 64
_LONGEST = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
# fixed values: modes of two-dimensional rows; numbers are the distance from the changing place above
MODES: dict[str, int | str] = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "0001": "pass", "001": "horizontal"}


def _runs(short: str, long: str) -> dict[str, int]:
    return dict(zip(short.split(), range(64), strict=True)) | dict(zip((long + " " + _LONGEST).split(), range(64, 2561, 64), strict=True))


#: Code word -> run length, of white and of black.
RUNS = (_runs(_WHITE, _WHITE_LONG), _runs(_BLACK, _BLACK_LONG))
_EOL_ZEROS = 11


class _Stream:
    def __init__(self, data: bytes):
        self.digits = "".join(f"{b:08b}" for b in data)
        self.at = 0

    @property
    def ended(self) -> bool:
        return self.at >= len(self.digits)

    def word(self, table: dict, longest: int):
        """The value of the code word here, which is passed; None if there is none."""
        for n in range(1, longest + 1):
            found = table.get(self.digits[self.at : self.at + n])
            if found is not None:
                self.at += n
                return found
        return None

    def run(self, colour: int) -> int:
        """A run: words of 64 and more go on until one under 64. What is no word counts as one pixel and passes one bit."""
        total = 0
        while True:
            n = self.word(RUNS[colour], 13)
            if n is None:
                self.at += 1
                return total + 1
            total += n
            if n < 64:
                return total

    def skip_eol(self) -> None:
        """Passes fill and an end-of-line word; nothing but zeros left is the end."""
        one = self.digits.find("1", self.at)
        if one < 0:
            self.at = len(self.digits)
        elif one - self.at >= _EOL_ZEROS:
            self.at = one + 1

    def tag(self) -> bool:
        """The bit before a row of a mixed stream: is it two-dimensional?"""
        self.at += 1
        return self.digits[self.at - 1 : self.at] == "0"

    def align(self) -> None:
        self.at += -self.at % 8


def _plain_row(s: _Stream, columns: int) -> list[tuple[int, int]]:
    """Black spans (begin, end) of a row of alternating runs, white first."""
    spans, at, colour = [], 0, 0
    while at < columns:
        end = min(columns, at + s.run(colour))
        if colour and end > at:
            spans.append((at, end))
        at, colour = end, 1 - colour
    return spans


def _coded_row(s: _Stream, columns: int, above: list[int]) -> list[tuple[int, int]]:
    """Black spans of a row described by the changes of the row above; the rest of a row whose mode is unknown is white."""
    spans, at, colour = [], -1, 0

    def paint(end: int, black: int) -> None:
        nonlocal at
        begin, end = max(at, 0), min(columns, max(end, at, 0))
        if black and end > begin:
            spans.append((begin, end))
        at = end

    while at < columns:
        mode = s.word(MODES, 7)
        if mode is None:
            break
        if mode == "horizontal":
            paint(max(at, 0) + s.run(colour), colour)
            paint(at + s.run(1 - colour), 1 - colour)
            continue
        # the first change above, right of here, to the other colour: even ones lead to black
        k = bisect_right(above, at)
        k += (k ^ colour) & 1
        if mode == "pass":
            paint(above[k + 1] if k + 1 < len(above) else columns, colour)
        else:
            paint((above[k] if k < len(above) else columns) + mode, colour)
            colour = 1 - colour
    return spans


def _changes(spans: list[tuple[int, int]]) -> list[int]:
    """Places of changes, spans that touch taken as one."""
    out: list[int] = []
    for b, e in spans:
        if out and out[-1] == b:
            out[-1] = e
        else:
            out += [b, e]
    return out


def decode(code: int, data: bytes, columns: int, rows: int, t4: int = 0, t6: int = 0) -> bytes:
    """Rows of a strip or tile, each padded to a byte. code: 2 (runs; rows begin at bytes), 3 (T.4; options 1 two-dimensional,
    4 rows end at bytes), 4 (T.6). A stream that ends before the last row is an error, uncompressed mode too."""
    if code not in (2, 3, 4):
        raise RasterDataError(f"compression {code} is no fax scheme")
    if (code == 3 and t4 & 2) or (code == 4 and t6 & 2):
        raise RasterDataError("fax: uncompressed mode")
    mixed, aligned = code == 3 and bool(t4 & 1), code == 2 or (code == 3 and bool(t4 & 4))
    s, out, above, width = _Stream(data), bytearray(), [], -(-columns // 8)
    s.skip_eol()
    coded = s.tag() if mixed else code == 4
    for row in range(rows):
        if s.ended:
            raise RasterDataError(f"fax: the stream ends before row {row} of {rows}")
        spans = _coded_row(s, columns, above) if coded else _plain_row(s, columns)
        above = _changes(spans)
        line = 0
        for b, e in spans:
            line |= ((1 << (e - b)) - 1) << (width * 8 - e)
        out += line.to_bytes(width, "big")
        if aligned:
            s.align()
        s.skip_eol()
        if mixed and not s.ended:
            coded = s.tag()
    return bytes(out)
