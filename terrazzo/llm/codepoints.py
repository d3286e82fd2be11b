"""Texts as code-point arrays, with letters folded to lower case and classed by script."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

# Fixed: Unicode blocks of scripts, as (first, last) code points; letters elsewhere are "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
SCRIPT_NAMES = ("none", *SCRIPTS, "other")


@cache
def _categories() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its lower-case form and its category: 0 neither, 1 letter, 2 digit, 3 mark."""
    fold, kind = np.arange(sys.maxunicode + 1, dtype=np.uint32), np.zeros(sys.maxunicode + 1, np.uint8)
    for c in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0xE0100, 0xE01F0)):
        ch = chr(c)
        major = unicodedata.category(ch)[0]
        if major in "LM":
            kind[c] = 1 if major == "L" else 3
            low = ch.lower()
            if len(low) == 1:
                fold[c] = ord(low)
        elif major == "N":
            kind[c] = 2
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x32400)):  # ideographs and syllables
        kind[a:b] = 1
    return fold, kind


@cache
def letter_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters and marks (0 for all else), script numbers (0 for all else), and whether it is a mark."""
    fold, kind = _categories()
    some = np.isin(kind, (1, 3))
    script = np.where(some, len(SCRIPT_NAMES) - 1, 0).astype(np.uint8)
    for n, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1][some[a : b + 1]] = n
    return np.where(some, fold, 0).astype(np.uint32), script, kind == 3


@cache
def word_table() -> np.ndarray:
    """Lower-case letters and digits of code points; 0 for all else."""
    fold, kind = _categories()
    return np.where(kind > 0, fold, 0).astype(np.uint32)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a line feed after each, and the texts' starts (one more at the end)."""
    joined = "\n".join(texts) + "\n"
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum(sizes)))
