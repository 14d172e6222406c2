"""Splits whole texts into pre-tokens, a slice of texts at a time, without a regular
expression: the pattern of the rank files only tells runs of letters, digits, other
characters and white space apart, which are boundaries in an array of code points.

The pattern is
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
and `tests/llm` hold the result against it.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def token_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where in `points` a pre-token starts.  doc_starts: where the non-empty texts start."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 3, bool)  # a text starts here
    first[doc_starts] = True
    first[n:] = True
    run = first.copy()  # a run of one class starts here
    run[1:n] |= kind[1:] != kind[:-1]
    white = np.zeros(n + 3, bool)
    white[:n] = kind == SPACE
    blank = np.zeros(n + 1, bool)  # the character before is the blank that the next run takes
    blank[1:] = points == 0x20
    start = np.zeros(n + 3, bool)
    start[:n] = run[:n] & (white[:n] | ~blank[:n] | first[:n])
    # the last character of white space before something else in the same text stands alone or goes with it
    start[:n] |= white[:n] & ~white[1 : n + 1] & ~first[1 : n + 1]
    # contractions: a lone apostrophe that starts a pre-token, then lower-case letters
    letter = np.zeros(n + 3, bool)
    letter[:n] = kind == LETTER
    at = np.flatnonzero((points == 0x27) & start[:n] & run[:n] & run[1 : n + 1] & letter[1 : n + 1] & ~first[1 : n + 1])
    if len(at):
        after = np.zeros(n + 3, np.uint32)
        after[:n] = points
        a, b, same = after[at + 1], after[at + 2], ~first[at + 2]
        for size, hit in ((1, np.isin(a, [ord(c) for c in "stmd"])), (2, same & ((b == ord("e")) & np.isin(a, [ord("r"), ord("v")]) | (a == ord("l")) & (b == ord("l"))))):
            here = at[hit]
            start[here + 1] = False
            rest = here + 1 + size
            start[rest[letter[rest] & ~first[rest]]] = True
    return np.flatnonzero(start[:n])


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts as one array of bytes, and how many each text has."""
    whole = "".join(texts)
    if not whole:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    points = code_points(whole)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    starts = token_starts(points, (ends - lengths)[lengths > 0])
    data = whole.encode()
    # where each code point starts among the bytes: wherever no continuation byte is
    place = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    offsets = np.append(place[starts], len(data))
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    return tokens, counts
