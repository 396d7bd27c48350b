"""Where byte-level BPE pieces end in any context, and a bounded cache of encoded pieces.

The splitting pattern of the tokenizers looks ahead but never back, and none of its alternatives has white space after
another character. So a position where a character that isn't white space is followed by a space or newline is a border
of pieces in every text: what stands on one side changes nothing on the other. Special strings have no space inside.

Texts of common characters, whose classes no Unicode version changes, are split into pieces by an equivalent pattern of
Python's re, and each distinct piece is encoded once by the library; other texts go to the library whole.
"""

from __future__ import annotations

import re

BORDER = re.compile(r"\S(?=[ \n])")
CACHE_ENTRIES = 400_000
#: Longer pieces are not kept.
CACHE_CHARS = 48

LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
MARK = r"!-/:-@\[-`{-~¡¿«»‐-‟…"
BLANK = r"\t\n\r "
COMMON = re.compile(f"[{LETTER}0-9{MARK}{BLANK}]*")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[{MARK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


class PieceCache(dict):
    """Piece -> encode(piece), for the pieces met last."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str):
        value = self.encode(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = value
        return value


def left_border(text: str, low: int, middle: int) -> int:
    """The last border in (low, middle), found in a growing window; low if there is none."""
    width = 64
    while True:
        start, last = max(low, middle - width), None
        for last in BORDER.finditer(text, start, middle):
            pass
        if last is not None and low < last.end() < middle:
            return last.end()
        if start == low:
            return low
        width *= 2


def right_border(text: str, middle: int, high: int) -> int:
    """The first border after `middle`, or high."""
    found = BORDER.search(text, middle, high)
    return found.end() if found and found.end() < high else high
