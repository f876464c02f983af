"""Exact products of integer matrices from float64 BLAS, and leading eigenvectors of such matrices.

An integer is cut into limbs of 20 bits, the top one with the sign.  A product of
two matrices of limbs sums at most 4,096 products of under 2^40, so every number
that BLAS meets on the way is under 2^53 and exact.  The limbs' products are put
together as big integers.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

BITS, ROWS = 20, 4096
MASK = (1 << BITS) - 1


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """The limbs of an array of int64 or Python integers, low ones first, as float64."""
    top = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    out = []
    for _ in range(max(-(-top.bit_length() // BITS), 1) - 1):
        out.append((x & MASK).astype(np.float64))
        x = x >> BITS
    return [*out, x.astype(np.float64)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b exactly, as Python integers."""
    total = np.zeros((a.shape[0], b.shape[1]), object)
    for at in range(0, a.shape[1], ROWS):
        left, right = limbs(a[:, at : at + ROWS]), limbs(b[at : at + ROWS])
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                total += (p @ q).astype(np.int64).astype(object) << (BITS * (i + j))
    return total


class Gram:
    """The sum of the outer products of rows (1, x) of int64: their number, sums and products."""

    def __init__(self, width: int):
        self.total = np.zeros((width + 1, width + 1), object)
        self.open: dict[tuple[int, int], np.ndarray] = {}
        self.blocks = 0

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), ROWS):
            part = np.concatenate([np.ones((len(x[at : at + ROWS]), 1), np.int64), x[at : at + ROWS]], axis=1)
            cut = limbs(part)
            for i, p in enumerate(cut):
                for j, q in enumerate(cut[i:], i):
                    made = (p.T @ q).astype(np.int64)
                    if (i, j) in self.open:
                        self.open[i, j] += made
                    else:
                        self.open[i, j] = made
            self.blocks += 1
            if self.blocks == 1024:  # 2^10 sums of under 2^52 fit in 63 bits
                self.settle()

    def settle(self) -> np.ndarray:
        for (i, j), s in self.open.items():
            both = s.astype(object) if i == j else s.astype(object) + s.T.astype(object)
            self.total += both << (BITS * (i + j))
        self.open, self.blocks = {}, 0
        return self.total


def _fixed(x: np.ndarray, bits: int) -> np.ndarray:
    """Floats up to 1 as multiples of 2^-bits."""
    return np.frompyfunc(lambda v: int(v * 2.0**60) << (bits - 60), 1, 1)(x)


def _floats(x: np.ndarray) -> np.ndarray:
    top = max(int(np.abs(x).max()).bit_length() - 60, 0)
    return (x >> top).astype(np.float64)


def leading(m: np.ndarray, k: int) -> tuple[list[int], np.ndarray, int]:
    """The k largest eigenvalues of a positive semidefinite matrix of integers, and their vectors.

    Returns (values, vectors as columns, bits), all as multiples of 2^-bits;
    values under 2^-32 are 0.  A float64 decomposition finds what is within a
    factor of 2^26 of the largest eigenvalue that is left; Newton steps in big
    integers then part these vectors from the rest, far beyond double precision,
    and the rest is decomposed in its turn, so that small eigenvalues beside huge
    ones come out right too.  Eigenvalues equal to within 2^-36 count as one of
    several dimensions: any basis of it will do.
    """
    d = len(m)
    bits = int(np.abs(m).max()).bit_length() + 80
    one = 1 << bits
    q = np.zeros((d, d), object)
    np.fill_diagonal(q, one)
    b, start = m << bits, 0
    while True:
        w, u = np.linalg.eigh(_floats(b[start:, start:]))
        w, u = w[::-1], u[:, ::-1]
        if w[0] <= 0 or int(b[start:, start:].max()) < one >> 32:
            break
        q[:, start:] = product(q[:, start:], _fixed(u, bits)) >> bits
        end = start + int((w >= w[0] * 2.0**-26).sum())
        rest = np.arange(d) >= end
        for _ in range(12):
            b = product(q.T, product(m, q)) >> bits
            r = -(product(q.T, q) >> bits)
            np.fill_diagonal(r, r.diagonal() + one)
            values = b.diagonal()
            gap = values[None, :] - values[:, None]
            near = (np.abs(gap) <= (np.abs(values)[None, :] >> 36)) | (gap == 0) | (rest[:, None] & rest[None, :])
            # what has gone already is not parted again from what comes later
            step = np.where(near, r >> 1, (b * one + values[None, :] * r) // np.where(near, 1, gap))
            q = q + (product(q, step) >> bits)
            if int(np.abs(step).max()) < 1 << 40:
                break
        b = product(q.T, product(m, q)) >> bits
        start = end
        if start >= min(k, d):
            break
    values = [int(b[i, i]) if i < d and int(b[i, i]) >= one >> 32 else 0 for i in range(min(k, d))]
    order = sorted(range(len(values)), key=lambda i: -values[i])
    vectors = q[:, order]
    for i in range(vectors.shape[1]):
        if vectors[int(np.argmax(np.abs(vectors[:, i]).astype(float))), i] < 0:
            vectors[:, i] = -vectors[:, i]
    return [values[i] for i in order], vectors, bits


def ratio(a: int, b: int) -> float:
    """a / b rounded once."""
    return float(Fraction(a, b))
