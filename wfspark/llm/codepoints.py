"""Texts as code points, and what Unicode says of each."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from wfspark.llm.columns import Texts

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: Code points with the property White_Space.
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def points(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all documents in a row, and the byte position of each."""
    if not len(t.data):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    return np.frombuffer(t.data.tobytes().decode().encode("utf-32-le"), np.uint32), np.flatnonzero((t.data & 0xC0) != 0x80)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[_BLANKS] = BLANK
    return table


@lru_cache(1)
def lower_letters() -> np.ndarray:
    """Lower-case form of every letter (itself where that isn't one code point), 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(classes() == LETTER).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table
