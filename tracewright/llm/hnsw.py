"""A hierarchical navigable small-world graph over one shard, in flat arrays.

Nodes are unit vectors.  Every node is on level 0 and, with a chance that falls
by 1/M a level, on higher ones.  Nodes are inserted in batches, those of high
levels first.  A new node goes greedily down the levels above its own, and on
each of its own widens to `ef` nodes of the graph so far; these, and the nodes of
its batch, are its candidates.  Of them it keeps links to nodes that are nearer to
it than to a node already linked.  Links go both ways; a node with too many is
pruned by the same rule.  Level l's links are one array of nodes by places, -1
where there are fewer.

A search goes greedily down the levels, then widens on level 0 to `ef` nodes; it
walks for all queries at once.
"""

from __future__ import annotations

import numpy as np

M, EF_BUILD, EF = 16, 48, 64
_BLOCK = 1024
#: So many nodes are inserted at once, and never more than there are already.
BATCH = 256


def _chosen(x: np.ndarray, own: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates `near` (nearest first, -1: none) the diverse ones, at most `most`, then the nearest others."""
    n, c = near.shape
    out = np.full((n, most), -1, np.int32)
    for a in range(0, n, _BLOCK):
        some, sim = near[a : a + _BLOCK], sims[a : a + _BLOCK]
        rows = len(some)
        v = x[np.maximum(some, 0)]
        between = np.einsum("rid,rjd->rij", v, v, optimize=True)
        kept, count = np.zeros((rows, c), bool), np.zeros(rows, np.int64)
        for j in range(c):
            shaded = ((between[:, j] >= sim[:, j, None]) & kept).any(1)
            take = (some[:, j] >= 0) & ~shaded & (count < most)
            kept[:, j] = take
            count += take
        # the free places go to the nearest of those left
        order = np.argsort(~kept + 2 * (some < 0), axis=1, kind="stable")[:, :most]
        picked = np.take_along_axis(some, order, 1)
        out[a : a + rows, : picked.shape[1]] = picked
    return out


def _moved(x: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray, best: np.ndarray) -> None:
    """Move each query's place to its best neighbour while that is nearer; `at` and `best` change in place."""
    moving = np.arange(len(q))
    while len(moving):
        near = links[at[moving]]
        s = np.where(near >= 0, np.einsum("qd,qkd->qk", q[moving], x[np.maximum(near, 0)]), -2)
        j = s.argmax(1)
        top = s[np.arange(len(moving)), j]
        better = top > best[moving]
        moving, j, near, top = moving[better], j[better], near[better], top[better]
        at[moving], best[moving] = near[np.arange(len(moving)), j], top


def _widened(x: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray, best: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities): the `ef` nearest that a walk from each query's place finds, nearest first, -1 where there are fewer."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(links)), bool)
    seen[rows, at] = True
    nodes, sims, open_ = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), -2, np.float32), np.zeros((len(q), ef), bool)
    nodes[:, 0], sims[:, 0], open_[:, 0] = at, best, True
    live = rows
    while len(live):
        # the best open node of each query; a walk ends when none of its list is open
        score = np.where(open_[live], sims[live], -3)
        j = score.argmax(1)
        going = score[np.arange(len(live)), j] > -3
        live, j = live[going], j[going]
        if not len(live):
            break
        open_[live, j] = False
        near = links[nodes[live, j]]
        valid = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        seen[np.repeat(live, valid.sum(1)), near[valid]] = True
        s = np.where(valid, np.einsum("qd,qkd->qk", q[live], x[np.maximum(near, 0)]), -2)
        all_s = np.concatenate([sims[live], s], 1)
        all_n = np.concatenate([nodes[live], np.where(valid, near, -1)], 1)
        all_o = np.concatenate([open_[live], valid], 1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        sims[live], nodes[live], open_[live] = (np.take_along_axis(v, top, 1) for v in (all_s, all_n, all_o))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def _linked(x: np.ndarray, links: np.ndarray, first: int, near: np.ndarray, sims: np.ndarray) -> None:
    """Link the nodes from `first` on with the best of their candidates, both ways, within the width of `links`."""
    most = links.shape[1]
    new = np.arange(first, first + len(near))
    chosen = _chosen(x, new, near, sims, max(1, most // 2))
    links[new, : chosen.shape[1]] = chosen
    src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    if not len(dst):
        return
    # what comes in at each node, the nearest first and no more than it could hold
    s = np.einsum("ed,ed->e", x[src], x[dst])
    order = np.lexsort((-s, dst))
    src, dst = src[order], dst[order]
    nodes, count = np.unique(dst, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(np.cumsum(count) - count, count)
    coming = np.full((len(nodes), min(most, int(count.max()))), -1, np.int32)
    fit = place < coming.shape[1]
    coming[np.searchsorted(nodes, dst[fit]), place[fit]] = src[fit]
    # a node of the batch may be both a choice and a comer
    held = links[nodes]
    coming[(coming[:, :, None] == held[:, None, :]).any(2)] = -1
    both = np.concatenate([held, coming], 1)
    sim = np.where(both >= 0, np.einsum("nd,nkd->nk", x[nodes], x[np.maximum(both, 0)]), -2).astype(np.float32)
    order = np.argsort(-sim, axis=1, kind="stable")
    both, sim = np.take_along_axis(both, order, 1), np.take_along_axis(sim, order, 1)
    full = (both >= 0).sum(1) > most
    links[nodes[~full]] = both[~full, :most] if both.shape[1] >= most else np.pad(both[~full], ((0, 0), (0, most - both.shape[1])), constant_values=-1)
    if full.any():
        links[nodes[full]] = _chosen(x, nodes[full], both[full], sim[full], most)


class Graph:
    def __init__(self, x: np.ndarray, levels: list[np.ndarray], links: list[np.ndarray]):
        """x: unit vectors (float32); levels[l]: the nodes on it; links[l]: their neighbours, rows as in levels[l]."""
        self.x, self.levels, self.links = x, levels, links

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 3, m: int = M, ef: int = EF_BUILD) -> Graph:
        n = len(vectors)
        height = np.floor(-np.log(np.random.default_rng(seed).random(n).clip(1e-12)) / np.log(m)).astype(np.int64)
        order = np.argsort(-height, kind="stable")
        x, height = vectors[order].astype(np.float32), height[order]
        sizes = [int((height >= level).sum()) for level in range(int(height.max(initial=0)) + 1)]  # level l has the first nodes in order
        links = [np.full((size, 2 * m if level == 0 else m), -1, np.int32) for level, size in enumerate(sizes)]
        done = min(n, 1)
        while done < n:
            end = min(n, done + min(BATCH, done))
            q = x[done:end]
            within = q @ q.T
            np.fill_diagonal(within, -2)
            at = np.zeros(len(q), np.int32)
            best = q @ x[0]
            for level in range(len(sizes) - 1, -1, -1):
                own = max(0, min(sizes[level], end) - done)  # the first of the batch are on this level
                # before the batch is linked here: its nodes lead nowhere yet on the levels below
                if own < len(q) and min(done, sizes[level]):
                    rest_at, rest_best = at[own:].copy(), best[own:].copy()
                    _moved(x, links[level], q[own:], rest_at, rest_best)
                    at[own:], best[own:] = rest_at, rest_best
                if done <= sizes[level] and own:
                    near, sims = _widened(x, links[level], q[:own], at[:own], best[:own], ef)
                    at[:own], best[:own] = near[:, 0], sims[:, 0]
                    mates = np.broadcast_to(np.arange(done, done + own, dtype=np.int32), (own, own))
                    all_n, all_s = np.concatenate([near, mates], 1), np.concatenate([sims, within[:own, :own].astype(np.float32)], 1)
                    top = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
                    near, sims = np.take_along_axis(all_n, top, 1), np.take_along_axis(all_s, top, 1)
                    near[sims <= -2] = -1
                    _linked(x, links[level], done, near, sims)
            done = end
        # names as the caller's
        levels = [order[:size].astype(np.int32) for size in sizes]
        named = [np.where(t >= 0, order[np.maximum(t, 0)], -1).astype(np.int32) if n else t for t in links]
        return cls(vectors.astype(np.float32), levels, named)

    def to_bytes(self) -> bytes:
        head = np.array([*self.x.shape, len(self.levels), *[v for a, b in zip(self.levels, self.links, strict=True) for v in (len(a), b.shape[1])]], np.int64)
        return b"".join([np.int64(len(head)).tobytes(), head.tobytes(), self.x.tobytes(), *[y.tobytes() for a, b in zip(self.levels, self.links, strict=True) for y in (a, b)]])

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        size = int(np.frombuffer(data, np.int64, 1)[0])
        head = np.frombuffer(data, np.int64, size, 8).tolist()
        at = 8 + 8 * size
        x = np.frombuffer(data, np.float32, head[0] * head[1], at).reshape(head[0], head[1])
        at += x.nbytes
        levels, links = [], []
        for i in range(head[2]):
            n, w = head[3 + 2 * i : 5 + 2 * i]
            levels.append(np.frombuffer(data, np.int32, n, at))
            at += 4 * n
            links.append(np.frombuffer(data, np.int32, n * w, at).reshape(n, w))
            at += 4 * n * w
        return cls(x, levels, links)

    def search(self, queries: np.ndarray, k: int, ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities): the k nearest found of each query, nearest first, -1 where there are fewer."""
        found, sims = np.full((len(queries), k), -1, np.int32), np.full((len(queries), k), -2, np.float32)
        if not len(self.x):
            return found, sims
        for a in range(0, len(queries), 256):
            f, s = self._together(queries[a : a + 256].astype(np.float32), max(ef, k))
            found[a : a + len(f)], sims[a : a + len(f)] = f[:, :k], s[:, :k]
        return found, sims

    def _together(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        at = np.full(len(q), self.levels[-1][0], np.int32)
        best = np.einsum("qd,qd->q", q, self.x[at])
        for members, links in zip(self.levels[:0:-1], self.links[:0:-1], strict=True):
            by_node = np.full((n, links.shape[1]), -1, np.int32)
            by_node[members] = links
            _moved(self.x, by_node, q, at, best)
        base = np.empty_like(self.links[0])
        base[self.levels[0]] = self.links[0]
        return _widened(self.x, base, q, at, best, ef)
