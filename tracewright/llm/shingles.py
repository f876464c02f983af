"""Word shingles of many texts with array operations."""

from __future__ import annotations

import numpy as np
import xxhash

from .encoding import _hashes
from .splitting import code_points

_SPACES = np.zeros(0x3002, bool)
_SPACES[[c for c in range(0x3002) if chr(c).isspace()]] = True
_LONG = 64
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """The sorted different 64-bit hashes of each text's runs of `words` words.

    Words are what white space divides.  A text with fewer words is one shingle of
    all its words; one without words, like a null, has none.
    """
    held = [t or "" for t in texts]
    joined = "\n".join(held) + "\n"
    codes = code_points(joined)
    sizes = np.fromiter(map(len, held), np.int64, len(held)) + 1
    begins = np.cumsum(sizes) - sizes
    inside = ~_SPACES[np.minimum(codes, 0x3001)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    h = _hashes(codes, start, np.minimum(end, start + _LONG))
    for i in np.flatnonzero(end - start > _LONG).tolist():
        h[i] = np.uint64(xxhash.xxh64_intdigest(joined[start[i] : end[i]].encode("utf-8", "surrogatepass")))
    h = mixed(h)
    owner = np.searchsorted(begins, start, "right") - 1
    count = np.bincount(owner, minlength=len(held))
    first = np.cumsum(count) - count
    n = len(h)
    run = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        run += h[k : n - words + 1 + k] * _MULTIPLIERS[k % 7] ** np.uint64(1 + k // 7) if n >= words else run
    run = mixed(run)
    out = []
    for a, c in zip(first.tolist(), count.tolist(), strict=True):
        if c >= words:
            out.append(np.unique(run[a : a + c - words + 1]))
        elif c:
            short = np.uint64(c)
            for k in range(c):
                short = np.uint64((int(short) * 0x100000001B3 ^ int(h[a + k])) & 0xFFFFFFFFFFFFFFFF)
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of `left` shares with each of `right`."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.float32).reshape(len(left), len(right))
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    shared = np.intersect1d(a, b)
    pa, pb = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ka, kb = (pa < len(shared)), (pb < len(shared))
    ka[ka] = shared[pa[ka]] == a[ka]
    kb[kb] = shared[pb[kb]] == b[kb]
    ra, pa, rb, pb = ra[ka], pa[ka], rb[kb], pb[kb]
    oa, ob = np.argsort(pa, kind="stable"), np.argsort(pb, kind="stable")
    ra, pa, rb, pb = ra[oa], pa[oa], rb[ob], pb[ob]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(shared), 8192):
        i, j = np.searchsorted(pa, [low, low + 8192]), np.searchsorted(pb, [low, low + 8192])
        width = min(8192, len(shared) - low)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[ra[i[0] : i[1]], pa[i[0] : i[1]] - low] = 1
        y[rb[j[0] : j[1]], pb[j[0] : j[1]] - low] = 1
        out += x @ y.T
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs have at least that Jaccard similarity; sets without shingles are like none."""
    both = overlaps(left, right).astype(np.float64)
    a, b = np.array([len(x) for x in left], np.float64), np.array([len(y) for y in right], np.float64)
    union = a[:, None] + b[None, :] - both
    return (both > 0) & (both >= least * union - 1e-9)
