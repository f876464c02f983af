"""A minimal acyclic transducer: words in, their numbers out, suffixes shared.

The automaton is a trie whose equal subtrees are one state.  The output of an
edge is the count of words that sort before those behind it, so the outputs on a
path sum to the word's place in sorted order: a perfect hash.  States and edges
are dense arrays in one file that workers map into memory; a batch of words is
walked one character at a time, all words at once.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

_HEAD = 8


def build(words: list[str], limit: int) -> bytes:
    """The file of a transducer over `words` (non-empty, of characters below `limit`)."""
    words = sorted(set(words))
    letters = sorted({c for w in words for c in w})
    code = {c: i + 1 for i, c in enumerate(letters)}
    # state: (accepting, ((letter, state), ...)); registered by what it holds
    registry: dict[tuple, int] = {}
    states: list[tuple] = [(False, ())]
    counts = [0]

    def register(accepting: bool, edges: list) -> int:
        key = (accepting, tuple(edges))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
            counts.append(int(accepting) + sum(counts[s] for _, s in edges))
        return registry[key]

    path: list[list] = [[False, []]]  # of the word before: nodes not yet registered
    before = ""
    for w in [*words, ""]:
        same = 0
        while same < min(len(w), len(before)) and w[same] == before[same]:
            same += 1
        while len(path) - 1 > same:
            done = path.pop()
            path[-1][1].append((code[before[len(path) - 1]], register(*done)))
        path.extend([False, []] for _ in w[same:])
        if w:
            path[-1][0] = True
        before = w
    root = register(*path[0])
    width = len(letters) + 1
    follow, out = np.zeros((len(states), width), np.int32), np.zeros((len(states), width), np.int32)
    accept = np.zeros(len(states), np.uint8)
    for s, (accepting, edges) in enumerate(states):
        accept[s], passed = accepting, int(accepting)
        for c, t in edges:
            follow[s, c], out[s, c] = t, passed
            passed += counts[t]
    classes = np.zeros(limit, np.uint8 if width < 256 else np.uint16)
    for c, i in code.items():
        classes[ord(c)] = i
    head = np.array([len(states), width, root, len(words), max(map(len, words), default=0), limit, classes.itemsize, 0], np.int64)
    return b"".join(x.tobytes() for x in (head, follow, out, classes, accept))


class Transducer:
    def __init__(self, data: bytes):
        """Map the file; its name goes at once, so nothing stays behind."""
        handle, path = tempfile.mkstemp()
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            with open(path, "rb") as f:
                held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(path)
        n, width, self.root, self.words, self.longest, limit, item, _ = map(int, np.frombuffer(held, np.int64, _HEAD))
        at = 8 * _HEAD
        self.follow = np.frombuffer(held, np.int32, n * width, at)
        self.out = np.frombuffer(held, np.int32, n * width, at + 4 * n * width)
        self.classes = np.frombuffer(held, np.uint8 if item == 1 else np.uint16, limit, at + 8 * n * width)
        self.accept = np.frombuffer(held, np.uint8, n, at + 8 * n * width + limit * item)
        self.width = width

    def numbers(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word codes[start:end], or -1 for a word that isn't held."""
        size = (end - start).astype(np.uint32)
        known = np.flatnonzero(size <= self.longest)
        length = size[known].astype(np.uint16)
        order = known[np.argsort(length, kind="stable")[::-1]]
        left = np.cumsum(np.bincount(length, minlength=self.longest + 1)[::-1])[::-1]  # words of at least that length
        at = start[order]
        state = np.full(len(order), self.root, np.int32)
        total = np.zeros(len(order), np.int32)
        classes = self.classes[codes]
        for k in range(self.longest):
            m = int(left[k + 1]) if k + 1 < len(left) else 0
            if not m:
                break
            slot = state[:m] * np.int32(self.width) + classes[at[:m] + k]
            total[:m] += self.out[slot]
            state[:m] = self.follow[slot]
        found = np.full(len(start), -1, np.int32)
        found[order] = np.where(self.accept[state] == 1, total, -1)
        return found
