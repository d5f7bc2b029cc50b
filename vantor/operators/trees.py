"""Minimum spanning trees of mutual reachability, in memory that follows the number of points and not of pairs.

Rows of distances serve few points, blocks of near points many points of few dimensions, and trees of pairs of blocks, which tasks
find side by side, the rest. Trees differ where weights are equal; what is connected up to a weight is the same in all.
"""

from __future__ import annotations

import numpy as np

from .neighbors import DECIMALS, _paired, distances

#: Points of a block of near points, and blocks that are met at once.
LEAF, GROUP = 128, 8
#: Up to so many points, or from so many dimensions on, rows of distances are the faster way.
FEW, WIDE = 1024, 16
#: Distances are rounded; a block is passed over only if it is farther by more than that.
SLACK = 1e-8


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after the edges (a, b) of points have been added."""
    root = np.arange(int(label.max(initial=-1)) + 1)
    s, t = label[a], label[b]
    while True:
        low = root.copy()
        np.minimum.at(low, root[s], root[t])
        np.minimum.at(low, root[t], root[s])
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low, root):
            return np.unique(root[label], return_inverse=True)[1]
        root = low[root]


def in_order(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges by (weight, smaller place, larger place), each once."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[fresh], b[fresh], w[fresh]


def sparse_tree(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Edges (a, b, weight) of the spanning tree of a connected graph, in order."""
    a, b, w = in_order(a, b, w)
    label, kept = np.arange(n), []
    ra, rb, at = a, b, np.arange(len(a))
    while len(at):
        first = np.full(int(label.max()) + 1, len(a))
        np.minimum.at(first, label[ra], at)
        np.minimum.at(first, label[rb], at)
        picked = np.unique(first[first < len(a)])
        kept.append(picked)
        label = joined(label, a[picked], b[picked])
        alive = label[ra] != label[rb]
        ra, rb, at = ra[alive], rb[alive], at[alive]
    kept = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
    return np.stack([a[kept], b[kept], w[kept]], 1)


def tree_by_rows(x: np.ndarray, core: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Edges (a, b, weight) as the tree grows from the first point, one row of distances at a time; of equal edges, the one met first."""
    n = len(x)
    fast = metric == "euclidean" and x.shape[1] >= WIDE
    left, best, link, alive = np.arange(n), np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    y, c, square, here = x, core, (x * x).sum(1), 0
    out = np.empty((max(0, n - 1), 3))
    for k in range(n - 1):
        at = int(left[here])
        alive[here] = False
        best[here] = np.inf
        if fast:
            # By products; where these cancel, in full.
            norm = square + square[here]
            d2 = norm - 2 * (y @ x[at])
            d = np.sqrt(np.maximum(d2, 0))
            close = np.flatnonzero(d2 < 1e-6 * norm)
            d[close] = np.sqrt(((y[close] - x[at]) ** 2).sum(1))
            d = np.round(d, DECIMALS)
        else:
            d = distances(x[at : at + 1], y, metric)[0]
        d = np.maximum(np.maximum(d, c), core[at])
        closer = alive & (d < best)
        best[closer], link[closer] = d[closer], at
        here = int(best.argmin())
        here = here if alive[here] else int(alive.argmax())  # what is infinitely far is left to the end
        out[k] = link[here], left[here], best[here]
        if k % 256 == 255:  # what is left is packed, so that rows shrink
            here = int(np.count_nonzero(alive[:here]))
            left, best, link, y, c, square = (v[alive] for v in (left, best, link, y, c, square))
            alive = np.ones(len(left), bool)
    if fast:
        a, b = out[:, 0].astype(np.int64), out[:, 1].astype(np.int64)
        out[:, 2] = np.maximum(np.maximum(_paired(x[a], x[b], metric), core[a]), core[b])
    return out


class Space:
    """Points in blocks of near ones, with the blocks' bounds."""

    def __init__(self, x: np.ndarray, metric: str = "euclidean"):
        self.x, self.metric, self.parts = x, metric, []
        stack = [np.arange(len(x))] if len(x) else []
        while stack:
            at = stack.pop()
            if len(at) <= LEAF:
                self.parts.append(np.sort(at))
                continue
            p = x[at]
            half = len(at) // 2
            cut = np.argpartition(p[:, np.ptp(p, axis=0).argmax()], half)
            stack += [at[cut[half:]], at[cut[:half]]]
        self.low = np.array([x[p].min(0) for p in self.parts])
        self.high = np.array([x[p].max(0) for p in self.parts])
        self.starts = np.cumsum([0, *map(len, self.parts)])[:-1]
        self.order = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)

    def gaps(self, b: int) -> np.ndarray:
        """The least distance that a point of each block can have from one of block b; 0 for metrics that bounds say nothing of."""
        side = np.maximum(0, np.maximum(self.low - self.high[b], self.low[b] - self.high))
        if self.metric == "euclidean":
            gap = np.sqrt((side * side).sum(1))
        else:
            gap = side.sum(1) if self.metric == "manhattan" else side.max(1) if self.metric == "chebyshev" else np.zeros(len(side))
        return gap * (1 - 1e-12) - SLACK

    def core(self, k: int) -> np.ndarray:
        """The k-th smallest distance of each point, itself counted as the 0-th."""
        out = np.empty(len(self.x))
        for b, own in enumerate(self.parts):
            gap = self.gaps(b)
            near, best = np.argsort(gap, kind="stable"), np.empty((len(own), 0))
            for s in range(0, len(near), GROUP):
                limit = best[:, k].max() if best.shape[1] > k else np.inf
                take = near[s : s + GROUP]
                take = take[gap[take] <= limit]
                if not len(take) or limit <= 0:
                    break
                best = np.hstack([best, distances(self.x[own], self.x[np.concatenate([self.parts[t] for t in take])], self.metric)])
                best = np.partition(best, k, axis=1)[:, : k + 1] if best.shape[1] > k else best
            out[own] = best[:, k]
        return out

    def ways_out(self, core: np.ndarray, label: np.ndarray, known: list[np.ndarray] | None = None, skip: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, weight): the first edge in order from each component to another, but for the component `skip`.

        known: weight, partner (-1: none) and least weight of each point, from earlier calls with smaller components; updated.
        """
        n = len(self.x)
        w, to, least = known if known is not None else (np.full(n, np.inf), np.full(n, -1), np.zeros(n))
        lost = (to >= 0) & (label[to] == label)
        least[lost] = np.maximum(least[lost], w[lost])
        w[lost], to[lost] = np.inf, -1
        best = np.full(int(label.max()) + 1, np.inf)
        np.minimum.at(best, label, w)
        # Blocks of one component have its label, others -1; their least core distances bound weights too.
        laid = label[self.order]
        low, high = np.minimum.reduceat(laid, self.starts), np.maximum.reduceat(laid, self.starts)
        whole = np.where(low == high, low, -1)
        least_core = np.minimum.reduceat(core[self.order], self.starts)
        asking = (to < 0) & (label != skip)
        floor = np.maximum(least, core)
        for b in np.argsort(np.minimum.reduceat(np.where(asking, floor, np.inf)[self.order], self.starts), kind="stable"):
            own = self.parts[b]
            own = own[asking[own] & (floor[own] <= best[label[own]])]
            if not len(own):
                continue
            gap = np.maximum(self.gaps(b), least_core)
            if (label[own] == label[own[0]]).all():
                gap[whole == label[own[0]]] = np.inf
            near = np.argsort(gap, kind="stable")
            cw, cj = np.full(len(own), np.inf), np.full(len(own), n)
            seen = np.inf
            for s in range(0, len(near), GROUP):
                limit = np.minimum(cw, best[label[own]]).max()
                take = near[s : s + GROUP]
                fits = gap[take] <= limit
                if not fits.all():
                    seen = gap[take[~fits][0]]
                    take = take[fits]
                if not len(take) or not np.isfinite(gap[take[0]]):
                    break
                j = np.concatenate([self.parts[t] for t in take[np.isfinite(gap[take])]])
                m = np.maximum(np.maximum(distances(self.x[own], self.x[j], self.metric), core[j]), core[own, None])
                m[label[own][:, None] == label[j]] = np.inf
                top = m.min(1)
                some = np.isfinite(top) & (top <= cw)
                if some.any():
                    first = np.where(m[some] == top[some, None], j, n).min(1)
                    better = (top[some] < cw[some]) | (first < cj[some])
                    rows = np.flatnonzero(some)[better]
                    cw[rows], cj[rows] = top[rows], first[better]
                    np.minimum.at(best, label[own], cw)
                if not fits.all():
                    break
            # All blocks nearer than `seen` were met: what was found below it is a point's first edge, else the weight is that large at least.
            sure = cw < seen
            w[own[sure]], to[own[sure]] = cw[sure], cj[sure]
            least[own[~sure]] = np.maximum(least[own[~sure]], seen)
        has = np.flatnonzero((to >= 0) & (label != skip))
        a, b = np.minimum(has, to[has]), np.maximum(has, to[has])
        order = np.lexsort((b, a, w[has], label[has]))
        has, a, b = has[order], a[order], b[order]
        head = np.r_[True, label[has][1:] != label[has][:-1]] if len(has) else np.zeros(0, bool)
        return a[head], b[head], w[has[head]]


def tree_by_blocks(x: np.ndarray, core: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Edges (a, b, weight) in order: each component but the largest is joined by its first edge to another, round by round."""
    n, space = len(x), Space(x, metric)
    label, known, found = np.arange(n), [np.full(n, np.inf), np.full(n, -1), np.zeros(n)], []
    while int(label.max(initial=0)) > 0:
        sizes = np.bincount(label)
        a, b, w = space.ways_out(core, label, known, int(sizes.argmax()) if sizes.max() > 1 else -1)
        found.append((a, b, w))
        label = joined(label, a, b)
    return np.stack(in_order(*(np.concatenate(c) for c in zip(*found))), 1) if found else np.zeros((0, 3))


def spanning_tree(x: np.ndarray, core: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Edges (a, b, weight) of a minimum spanning tree of mutual reachability."""
    by_rows = len(x) <= FEW or x.shape[1] >= WIDE or metric not in ("euclidean", "manhattan", "chebyshev")
    return (tree_by_rows if by_rows else tree_by_blocks)(x, core, metric)
