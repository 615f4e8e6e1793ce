"""Decoding of fax-coded bitmaps (ITU-T T.4 one-dimensional, T.6) and an encoder for tests."""

from __future__ import annotations

import numpy as np

# Run-length codes of T.4, in the order of their runs.
# Runs 0 to 63 of white pixels
WHITE = """
00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
""".split()
# Runs 64 to 1728 of white pixels, in steps of 64
WHITE_LONG = """
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101
011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011
""".split()
# Runs 0 to 63 of black pixels
BLACK = """
0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
""".split()
# Runs 64 to 1728 of black pixels, in steps of 64
BLACK_LONG = """
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100
0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101
""".split()
# Runs 1792 to 2560 of either colour, in steps of 64
LONGER = """
00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111
""".split()
# Modes of a two-dimensionally coded line: vertical by their offset, pass, horizontal
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
PASS, HORIZONTAL = "0001", "001"
END_OF_LINE = "000000000001"


def _codes(short: list[str], long: list[str]) -> dict[str, int]:
    runs = {c: i for i, c in enumerate(short)} | {c: 64 * (i + 1) for i, c in enumerate(long)}
    return runs | {c: 1792 + 64 * i for i, c in enumerate(LONGER)}


RUNS = (_codes(WHITE, WHITE_LONG), _codes(BLACK, BLACK_LONG))
MODES = {c: ("v", d) for d, c in VERTICAL.items()} | {PASS: ("p", 0), HORIZONTAL: ("h", 0)}


class FaxError(ValueError):
    """A code that is none, a line of another length or data that end too early."""


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tobytes().translate(bytes.maketrans(b"\x00\x01", b"01")).decode()
        self.at = 0

    def code(self, table: dict, longest: int = 13):  # noqa: ANN201
        for n in range(1, longest + 1):
            found = table.get(self.bits[self.at : self.at + n])
            if found is not None and self.at + n <= len(self.bits):
                self.at += n
                return found
        raise FaxError(f"no code at bit {self.at}")

    def run(self, color: int) -> int:
        total, n = 0, 64
        while n >= 64:
            n = self.code(RUNS[color])
            total += n
        return total

    def skip(self, code: str) -> bool:
        if self.bits.startswith(code, self.at):
            self.at += len(code)
            return True
        return False

    def skip_end_of_line(self) -> bool:
        """Fill bits and an end-of-line code, if they come next."""
        one = self.bits.find("1", self.at)
        if one - self.at >= 11:
            self.at = one + 1
            return True
        return False


def _paint(changes: list[int], width: int) -> np.ndarray:
    row = np.zeros(width, np.uint8)
    for a, b in zip(changes[::2], [*changes[1::2], width], strict=False):
        row[a:b] = 1
    return row


def decode_t4(data: bytes, width: int, height: int) -> np.ndarray:
    """One-dimensional lines, with or without end-of-line codes; 1 is black. Missing lines are an error."""
    bits, out = _Bits(data), np.zeros((height, width), np.uint8)
    for y in range(height):
        bits.skip_end_of_line()
        at, color, changes = 0, 0, []
        while at < width:
            at += bits.run(color)
            if at > width:
                raise FaxError("a line is too long")
            changes.append(at)
            color = 1 - color
        out[y] = _paint([c for c in changes if c < width], width) if changes else 0
        # changes begin with the end of a white run: black from there on
    return out


def decode_t6(data: bytes, width: int, height: int) -> np.ndarray:
    """Two-dimensional lines; 1 is black. After an end-of-block code the rest is white."""
    bits, out = _Bits(data), np.zeros((height, width), np.uint8)
    reference: list[int] = []
    for y in range(height):
        if bits.skip(END_OF_LINE + END_OF_LINE):
            break
        changes: list[int] = []
        a0, color = -1, 0
        while a0 < width:
            # b1: the first change of the line above right of a0 and to the colour opposite to this one
            i = 0
            while i < len(reference) and (reference[i] <= a0 or i % 2 != color):
                i += 1
            b1 = reference[i] if i < len(reference) else width
            b2 = reference[i + 1] if i + 1 < len(reference) else width
            mode, shift = bits.code(MODES, 7)
            if mode == "p":
                a0 = b2
            elif mode == "h":
                start = max(a0, 0)
                first = start + bits.run(color)
                second = first + bits.run(1 - color)
                if second > width:
                    raise FaxError("a line is too long")
                changes += [first, second]
                a0 = second
            else:
                a1 = b1 + shift
                if a1 < max(a0, 0) or a1 > width:
                    raise FaxError("a change lies outside of its line")
                changes.append(a1)
                a0, color = a1, 1 - color
        reference = _tidy(changes, width)
        out[y] = _paint(reference, width)
    return out


def _tidy(changes: list[int], width: int) -> list[int]:
    """Changes of colour without runs of no pixels and without those at the end."""
    out: list[int] = []
    for c in changes:
        if out and out[-1] == c:
            out.pop()
        else:
            out.append(c)
    return [c for c in out if c < width]


def _changes(row: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8)]))).tolist()


def _run_code(n: int, color: int) -> str:
    out = ""
    while n > 2560:
        out += LONGER[-1]
        n -= 2560
    if n >= 64:
        out += LONGER[(n - 1792) // 64] if n >= 1792 else (WHITE_LONG, BLACK_LONG)[color][n // 64 - 1]
        n %= 64
    return out + (WHITE, BLACK)[color][n]


def _pack(bits: str) -> bytes:
    return np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()


def encode_t4(bitmap: np.ndarray, end_of_line: bool = False) -> bytes:
    out = []
    for row in bitmap:
        ends = [*_changes(row), len(row)]
        runs = [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        out.append((END_OF_LINE if end_of_line else "") + "".join(_run_code(n, i % 2) for i, n in enumerate(runs)))
    return _pack("".join(out))


def encode_t6(bitmap: np.ndarray) -> bytes:
    width, reference, out = bitmap.shape[1], [], []
    for row in bitmap:
        changes, a0, color = _changes(row), -1, 0
        while a0 < width:
            a1 = next((c for c in changes if c > a0 and changes.index(c) % 2 == color), width) if a0 >= 0 else (changes[0] if changes else width)
            i = next((k for k, c in enumerate(reference) if c > a0 and k % 2 == color), len(reference))
            b1, b2 = ([*reference[i : i + 2], width, width])[:2]
            if b2 < a1:
                out.append(PASS)
                a0 = b2
            elif abs(a1 - b1) <= 3:
                out.append(VERTICAL[a1 - b1])
                a0, color = a1, 1 - color
            else:
                a2 = next((c for c in changes if c > a1), width)
                out.append(HORIZONTAL + _run_code(a1 - max(a0, 0), color) + _run_code(a2 - a1, 1 - color))
                a0 = a2
        reference = changes
    return _pack("".join(out) + END_OF_LINE * 2)
