"""Byte-pair merges of many words at once, exactly as merge by merge, lowest rank first."""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(2**31 - 1)
_LONG = 48


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


class Merges:
    """The merges of a tokenizer file; suffix: what the last symbol of a word carries."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.lower = model["normalizer"] is not None
        model = model["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.vocab = vocab | self.special
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right = np.array([vocab[a] for a, _ in pairs], np.uint64), np.array([vocab[b] for _, b in pairs], np.uint64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # open addressing: a pair's rank by its key
        bits = 19
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        key = ((left << np.uint64(20)) | right).astype(np.int64)
        for rank, (k, slot) in enumerate(zip(key.tolist(), self._slot(key).tolist(), strict=True)):
            while self.keys[slot] not in (-1, k):
                slot = (slot + 1) & int(self.mask)
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = k, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; a symbol below 0 merges with nothing."""
        key = (a.astype(np.int64) << 20) | b
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], _NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, count of each); words aren't empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return np.zeros(0, np.int32), sizes
        counts, parts = np.zeros(len(words), np.int64), {}
        # words of like length together, so that short ones don't pay for long ones
        for low, high in ((0, 8), (8, 16), (16, _LONG)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(rows), 1 << 16):
                some = rows[at : at + (1 << 16)]
                ids, n = self._together([words[i] for i in some.tolist()], sizes[some])
                counts[some] = n
                parts[len(parts)] = (some, ids, n)
        for i in np.flatnonzero(sizes > _LONG).tolist():
            ids = self._alone(words[i])
            counts[i] = len(ids)
            parts[len(parts)] = (np.array([i]), ids, counts[i : i + 1])
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for rows, ids, n in parts.values():
            out[np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts

    def _together(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), int(sizes.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(n), sizes)
        col = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
        wide = width + 2  # a spare column on each side
        sym = np.full((n, wide), -1, np.int32)
        sym[row, col + 1] = self.inner[flat]
        sym[np.arange(n), sizes] = self.final[flat[ends - 1]]
        follow = np.tile(np.arange(1, wide + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), (n, 1))
        ranks = np.full((n, wide), _NONE, np.int32)
        ranks[:, 1:-1] = self.rank(sym[:, 1:-1].ravel(), sym[:, 2:].ravel()).reshape(n, width)
        live = np.arange(n)
        while len(live):
            seen = ranks[live]
            j = seen.argmin(1)
            best = seen[np.arange(len(live)), j]
            going = best < _NONE
            live, j, best = live[going], j[going], best[going]
            if not len(live):
                break
            k = follow[live, j]
            after, prior = follow[live, k], before[live, j]
            new = self.result[best]
            sym[live, j], sym[live, k], ranks[live, k] = new, -1, _NONE
            follow[live, j], before[live, np.minimum(after, wide - 1)] = after, j
            ranks[live, j] = self.rank(new, sym[live, np.minimum(after, wide - 1)])
            ranks[live, prior] = self.rank(sym[live, prior], new)
        kept = sym >= 0
        return sym[kept], kept.sum(1)

    def _alone(self, word: bytes) -> np.ndarray:
        """One long word, with a heap: n log n whatever its length."""
        import heapq

        raw = np.frombuffer(word, np.uint8)
        start = self.inner[raw]
        start[-1] = self.final[raw[-1]]
        ranks = self.rank(start[:-1], start[1:])
        sym, n = start.tolist(), len(start)
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(ranks.tolist()) if r < _NONE]
        heapq.heapify(heap)
        one = lambda a, b: int(self.rank(np.array([a], np.int32), np.array([b], np.int32))[0])
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = follow[i]
            if sym[i] != a or k >= n or sym[k] != b:
                continue
            sym[i], sym[k] = int(self.result[r]), -1
            follow[i] = follow[k]
            if follow[i] < n:
                before[follow[i]] = i
                if (q := one(sym[i], sym[follow[i]])) < _NONE:
                    heapq.heappush(heap, (q, i, sym[i], sym[follow[i]]))
            if before[i] >= 0 and (q := one(sym[before[i]], sym[i])) < _NONE:
                heapq.heappush(heap, (q, before[i], sym[before[i]], sym[i]))
        return np.array([x for x in sym if x >= 0], np.int32)
