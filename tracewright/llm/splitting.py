"""Where the words of many texts begin and end, found with array operations.

Two splits are offered, those of the public tokenizer files: `word` (contractions,
runs of letters, single digits, runs of other characters; white space goes) and
`byte` (the same with a leading blank kept, runs of digits, and white-space
tokens).  Texts with characters from U+0250 on, or with one that changes its
length in lower case, aren't simple: for those the caller asks the tokenizers
library for the pieces.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

LIMIT = 0x250
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_WHITE = {*range(9, 14), 32, 0x85, 0xA0}


def _kind(c: int) -> int:
    cat = unicodedata.category(chr(c))
    return SPACE if c in _WHITE else LETTER if cat[0] == "L" else DIGIT if cat[0] == "N" else OTHER


KINDS = np.array([_kind(c) for c in range(LIMIT)], np.uint8)
_COMPLEX = re.compile("[^\x00-įı-ɏ]")


def simple(text: str) -> bool:
    return text.isascii() or _COMPLEX.search(text) is None


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _contractions(codes: np.ndarray, kinds: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of 's 't 'm 'd 're 've 'll; free: where a token may begin with an apostrophe."""
    at = np.flatnonzero((codes == 39) & free)
    if not len(at):
        return at, at
    padded = np.append(codes, np.zeros(2, codes.dtype))
    a, b = padded[at + 1], padded[at + 2]
    one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
    two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
    size = np.where(one, 2, np.where(two, 3, 0))
    return at[size > 0], size[size > 0]


def word_split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of simple text in lower case, blanks between texts."""
    kinds = KINDS[codes]
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.empty(n + 1, bool)
    begins[0] = begins[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:n])
    begins[:n] |= kinds == DIGIT
    before = np.append(np.uint8(SPACE), kinds[:-1])
    at, size = _contractions(codes, kinds, before != OTHER)
    begins[at + 1] = False
    begins[at[size == 3] + 2] = False
    begins[at + size] = True
    edges = np.flatnonzero(begins)
    start, end = edges[:-1], edges[1:]
    words = kinds[start] != SPACE
    return start[words], end[words]


def byte_split(codes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the tokens of simple texts that stand without gaps; texts: where each begins."""
    kinds = KINDS[codes]
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[texts[texts < n]] = True
    first[n] = True
    begins = np.empty(n + 1, bool)
    begins[0] = begins[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:n])
    begins |= first
    white = kinds == SPACE
    # the last character of a white run goes to what follows it, or stands alone
    last = np.flatnonzero(white & ~np.append(white[1:], False) & ~first[1:])
    begins[last] = True
    joined = last[codes[last] == 32]
    begins[joined + 1] = False
    # an apostrophe can begin a token unless another sign or a joined blank stands before it
    free = np.append(np.uint8(SPACE), kinds[:-1]) != OTHER
    free[joined + 1] = False
    free |= first[:n]
    at, size = _contractions(codes, kinds, free)
    inside = ~(first[at + 1] | ((size == 3) & first[np.minimum(at + 2, n)]))
    at, size = at[inside], size[inside]
    begins[at + 1] = False
    begins[at[size == 3] + 2] = False
    begins[at + size] = True
    edges = np.flatnonzero(begins)
    return edges[:-1], edges[1:]
