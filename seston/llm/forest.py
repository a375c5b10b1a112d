"""A forest of random-projection trees over the points of one task, searched by all queries at the same time.

Every tree halves its nodes at the median of a projection on a random direction until leaves are small, so equal points are split like others.
A query descends every tree; the sides that it did not take wait in one queue for all trees, by how far the query is from them at least. The
nearest waiting side is searched next. A query is done when in one of the trees no waiting side is nearer than its k-th neighbour so far,
as that tree then holds nothing nearer, or after a number of rounds.
"""

from __future__ import annotations

import numpy as np

LEAF, TREES, ROUNDS = 32, 2, 32


class Tree:
    """A complete binary tree of ``depth`` levels; node k of a level has the children 2 k and 2 k + 1 in the next."""

    def __init__(self, points: np.ndarray, rng: np.random.Generator, leaf: int = LEAF):
        n, dims = points.shape
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        order = np.arange(n)
        bounds = np.array([0, n])
        self.way: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        for level in range(self.depth):
            w = rng.normal(size=(2**level, dims))
            w /= np.linalg.norm(w, axis=1, keepdims=True)
            node = np.repeat(np.arange(2**level), np.diff(bounds))
            value = (points[order] * w[node]).sum(1)
            inner = np.lexsort((value, node))
            order, value = order[inner], value[inner]
            middle = (bounds[:-1] + bounds[1:]) // 2
            left, right = np.clip(middle - 1, bounds[:-1], None), np.clip(middle, None, np.maximum(bounds[1:] - 1, 0))
            self.way.append(w)
            self.cut.append((value[np.minimum(left, n - 1)] + value[np.minimum(right, n - 1)]) / 2)
            bounds = np.insert(bounds[1:], np.arange(2**level), middle)
            bounds = np.r_[0, bounds]
        size = int(np.diff(bounds).max()) if n else 0
        at = bounds[:-1, None] + np.arange(size)[None, :]
        self.members = np.where(at < bounds[1:, None], order[np.minimum(at, max(n - 1, 0))], -1)


class Search:
    """The nearest ``k`` of ``points`` to each of ``queries``; ``own`` are the queries' own places among the points (-1 for none), which don't count.

    ``within`` are squared distances beyond which nothing is asked for. ``dist`` and ``near`` are the squared distances and places, nearest first; -1 where there
    are fewer.
    """

    def __init__(self, points: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, *, real: int, slack: float, within: np.ndarray | None = None, seed: int = 0, trees: int = TREES, rounds: int = ROUNDS):
        self.points, self.queries, self.own, self.real = points, queries, own, real
        q = len(queries)
        self.dist, self.near = np.full((q, k), np.inf), np.full((q, k), -1)
        self.limit = np.full(q, np.inf) if within is None else within.astype(float)
        self.slack = slack
        if not q or not len(points):
            return
        rng = np.random.default_rng(seed)
        self.trees = [Tree(points, rng) for _ in range(trees)]
        depth = self.trees[0].depth
        self.alive = np.arange(q)
        everyone = np.arange(q)
        room = trees * depth + rounds * depth
        self.wait = np.full((q, max(room, 1)), np.inf)  # distance of a waiting side at least
        self.where = np.zeros((q, max(room, 1)), np.int64)  # (tree, level, node) of it
        self.used = np.zeros(q, np.int64)
        for t in range(trees):
            self.descend(everyone, t, np.zeros(q, np.int64), np.zeros(q, np.int64), np.zeros(q))
        for _ in range(rounds if depth else 0):
            open_ = self.unfinished()
            if not len(open_):
                break
            at = self.wait[open_, : int(self.used[open_].max())].argmin(1)
            bound, code = self.wait[open_, at], self.where[open_, at]
            self.wait[open_, at] = np.inf
            tree, level, node = code >> 48, (code >> 40) & 255, code & (2**40 - 1)
            for t in range(trees):
                mine = tree == t
                if mine.any():
                    self.descend(open_[mine], t, level[mine], node[mine], bound[mine])
        self.dist, self.near = np.where(np.isfinite(self.dist), self.dist, np.inf), np.where(np.isfinite(self.dist), self.near, -1)

    def unfinished(self) -> np.ndarray:
        """The queries that aren't done; one that is done stays so."""
        who = self.alive
        far = self.dist[who, -1]
        reach = np.sqrt(np.minimum(far, self.limit[who])) + self.slack
        used = int(self.used[who].max(initial=0))
        wait, tree = self.wait[who, :used], self.where[who, :used] >> 48
        done = far == 0  # nothing is nearer
        for t in range(len(self.trees)):
            done |= ~((tree == t) & (wait < reach[:, None])).any(1)
        self.alive = who[~done]
        return self.alive

    def descend(self, who: np.ndarray, t: int, level: np.ndarray, node: np.ndarray, bound: np.ndarray) -> None:
        """From a node down to a leaf, noting the other sides; then the leaf's points are looked at."""
        tree = self.trees[t]
        node = node.copy()
        for step in range(tree.depth):
            go = level <= step
            if not go.any():
                continue
            w, mine = who[go], node[go]
            off = (self.queries[w] * tree.way[step][mine]).sum(1) - tree.cut[step][mine]
            right = off > 0
            at = self.used[w]
            self.wait[w, at] = np.maximum(bound[go], np.abs(off))
            self.where[w, at] = (t << 48) | ((step + 1) << 40) | (2 * mine + ~right)
            self.used[w] += 1
            node[go] = 2 * mine + right
        for i in range(0, len(who), 4096):
            self.look(who[i : i + 4096], tree.members[node[i : i + 4096]])

    def look(self, who: np.ndarray, among: np.ndarray) -> None:
        k = self.near.shape[1]
        d = sum((self.points[among, c] - self.queries[who, c][:, None]) ** 2 for c in range(self.real))
        d[(among < 0) | (among == self.own[who][:, None]) | (among[:, :, None] == self.near[who][:, None, :]).any(2)] = np.inf
        d, among = np.concatenate([self.dist[who], d], 1), np.concatenate([self.near[who], among], 1)
        best = np.argpartition(d, k - 1, 1)[:, :k]
        d, among = np.take_along_axis(d, best, 1), np.take_along_axis(among, best, 1)
        order = np.argsort(d, 1, kind="stable")
        self.dist[who], self.near[who] = np.take_along_axis(d, order, 1), np.take_along_axis(among, order, 1)
