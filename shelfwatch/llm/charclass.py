"""Character classes of code points, and the word boundaries of byte-level tokenizers found on whole arrays of them."""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

from shelfwatch.llm.common import worker_store

BLANK, LETTER, DIGIT, SIGN = range(4)
#: The characters with the property White_Space.
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Where version 16 of Unicode added letters and digits.
ADDED_IN_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113E2),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF),
    (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def class_table() -> np.ndarray:
    """The class of every code point; what is no blank, letter or digit is a sign.

    Letters and digits are those of Unicode 16, as in the tokenizers' library: Python's own tables, and for what that version
    added the `regex` module's, which know still later characters.
    """
    store = worker_store()
    if "classes" not in store:
        major = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
        made = np.full(0x110000, SIGN, np.uint8)
        made[major == "L"], made[major == "N"], made[list(BLANKS)] = LETTER, DIGIT, BLANK
        for first, last in ADDED_IN_16:
            for c in range(first, last + 1):
                made[c] = LETTER if regex.match(r"\p{L}", chr(c)) else DIGIT if regex.match(r"\p{N}", chr(c)) else made[c]
        store["classes"] = made
    return store["classes"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def contraction_lengths(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For apostrophes at the given places: the length of the contraction that begins there, or 0."""
    padded = np.r_[points, np.zeros(2, points.dtype)]
    second, third = padded[at + 1], padded[at + 2]
    found = np.zeros(len(at), np.int64)
    for tail in CONTRACTIONS:
        same = second == ord(tail[0])
        if len(tail) == 2:
            same &= third == ord(tail[1])
        found[same & (found == 0)] = len(tail) + 1
    return found


def byte_level_starts(text: str) -> np.ndarray:
    """Where the words of a byte-level tokenizer start: runs of letters, digits or signs with a space before them, the
    contractions after an apostrophe, and what is left of runs of blanks.
    """
    points = code_points(text)
    if not len(points):
        return np.empty(0, np.int64)
    kind = class_table()[points]
    blank = kind == BLANK
    start = np.ones(len(points), bool)
    same = kind[1:] == kind[:-1]
    space_before = (points[:-1] == 0x20) & ~blank[1:]
    start[1:] = ~same & ~space_before
    start[:-1] |= blank[:-1] & ~blank[1:]  # the last blank of a run is apart from the others, or the next word's own
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        before = np.where(quotes > 0, quotes - 1, 0)
        free = (quotes == 0) | ((kind[before] != SIGN) & (points[before] != 0x20))
        at = quotes[free]
        length = contraction_lengths(points, at)
        at, length = at[length > 0], length[length > 0]
        start[at + 1] = False
        start[at[length == 3] + 2] = False
        after = at + length
        start[after[after < len(points)]] = True
    return np.flatnonzero(start)
