"""Group 4 (T.6) coding of bilevel rows: the coder of masks, and a decoder.

A row is coded against the row above it by the places where colours change. Rows start
white; 1 is black.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the standard: code words of run lengths 0 .. 63, then of 64, 128, .. 1728, for each colour, then of 1792, 1856, .. 2560 for both.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 "
    "101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 "
    "00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 "
    "00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 "
    "011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 "
    "0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 "
    "000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 "
    "000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 "
    "0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
PASS, HORIZONTAL = "0001", "001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
END = "000000000001" * 2


def run_code(n: int, black: int) -> str:
    """The code words of a run: as many of the longest as fit, one of whole 64s, and one of the rest."""
    words = BLACK if black else WHITE
    out = ""
    while n >= 2560:
        out, n = out + LONG[-1], n - 2560
    if n >= 1792:
        out += LONG[n // 64 - 28]
    elif n >= 64:
        out += words[63 + n // 64]
    return out + words[n % 64]


def _changes(row: np.ndarray) -> list[int]:
    """Places where the colour differs from the one before, white being before the first."""
    return np.flatnonzero(np.diff(row, prepend=0)).tolist()


def encode(mask: np.ndarray) -> bytes:
    """The T.6 stream of a mask (rows of 0 and 1), with the end mark, padded to bytes."""
    h, w = mask.shape
    bits: list[str] = []
    above: list[int] = []
    for y in range(h):
        here = _changes(mask[y].astype(np.int8))
        a0, colour, i, j = -1, 0, 0, 0
        while a0 < w:
            while i < len(here) and (here[i] <= a0 if a0 >= 0 else False):
                i += 1
            if i < len(here) and i % 2 != colour:  # the next change away from the present colour
                i += 1
            a1 = here[i] if i < len(here) else w
            # b1: the first change of the row above, right of a0, to the opposite of the present colour
            j = max(j - 2, 0)
            while j < len(above) and (above[j] <= a0 or j % 2 != colour):
                j += 1
            b1 = above[j] if j < len(above) else w
            b2 = above[j + 1] if j + 1 < len(above) else w
            if b2 < a1:
                bits.append(PASS)
                a0 = b2
            elif abs(a1 - b1) <= 3:
                bits.append(VERTICAL[a1 - b1])
                a0, colour = a1, 1 - colour
            else:
                a2 = here[i + 1] if i + 1 < len(here) else w
                bits += [HORIZONTAL, run_code(a1 - max(a0, 0), colour), run_code(a2 - a1, 1 - colour)]
                a0 = a2
        above = here
    stream = "".join(bits) + END
    stream += "0" * (-len(stream) % 8)
    return int(stream, 2).to_bytes(len(stream) // 8, "big")


_RUNS = [{c: n if n < 64 else (n - 63) * 64 for n, c in enumerate(words)} | {c: 1792 + 64 * n for n, c in enumerate(LONG)} for words in (WHITE, BLACK)]
_MODES = {PASS: "pass", HORIZONTAL: "horizontal"} | {c: d for d, c in VERTICAL.items()}


def decode(data: bytes, h: int, w: int) -> np.ndarray:
    """The mask of a stream that encode() has made."""
    bits = bin(int.from_bytes(b"\x01" + data, "big"))[3:]
    at = 0

    def word(table: dict):
        nonlocal at
        for n in range(1, 14):
            if (got := table.get(bits[at : at + n])) is not None:
                at += n
                return got
        raise ValueError(f"no code word at bit {at}")

    def run(colour: int) -> int:
        total = 0
        while True:
            n = word(_RUNS[colour])
            total += n
            if n < 64:
                return total

    out = np.zeros((h, w), np.uint8)
    above: list[int] = []
    for y in range(h):
        a0, colour = -1, 0
        while a0 < w:
            j = next((k for k in range(len(above)) if above[k] > a0 and k % 2 == colour), len(above))
            b1 = above[j] if j < len(above) else w
            b2 = above[j + 1] if j + 1 < len(above) else w
            mode = word(_MODES)
            start = max(a0, 0)
            if mode == "pass":
                out[y, start:b2] = colour
                a0 = b2
            elif mode == "horizontal":
                one = start + run(colour)
                two = one + run(1 - colour)
                out[y, start:one], out[y, one:two] = colour, 1 - colour
                a0 = two
            else:
                out[y, start : b1 + mode] = colour
                a0, colour = b1 + mode, 1 - colour
        above = _changes(out[y].astype(np.int8))
    return out
