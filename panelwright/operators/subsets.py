"""Best subsets of each size from one cross-product, by branch and bound.

A subset's residual sum is never less than that of a set around it. The tree starts from all
predictors; a child drops one of its parent's free predictors and may later drop only those behind it,
the others stay. Free predictors are ordered by what dropping them alone costs, the dearest first, so
that the widest subtrees have the greatest sums and are cut off soonest: a subtree goes when its own sum
is no better than the best known of the least size in it. Bounds to start with come from elimination,
selection and exchange. The subtrees below the root are independent, so that tasks can share them out.

Dropping a predictor is one sweep of the inverse, done for many nodes at once.
"""

from __future__ import annotations

import numpy as np

_NODES = 64                 # expanded at once; bounds the memory of a search
_LEAST_EIGENVALUE = 1e-10   # of the correlations; below it a ridge keeps the sweeps defined
_RIDGE = 1e-9
_BETTER = 1 - 1e-12


def swept(m: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Matrices (node, row, column), each swept at its own pivot."""
    at = np.arange(len(m))
    d, column, row = m[at, pivot, pivot], m[at, :, pivot], m[at, pivot, :]
    out = m - column[:, :, None] * row[:, None, :] / d[:, None, None]
    out[at, :, pivot] = column / d[:, None]
    out[at, pivot, :] = row / d[:, None]
    out[at, pivot, pivot] = -1 / d
    return out


def _one(m: np.ndarray, pivot: int) -> np.ndarray:
    return swept(m[None], np.array([pivot]))[0]


def coefficients(gram: np.ndarray, subset: tuple[int, ...]) -> tuple[np.ndarray, float]:
    """Least-squares coefficients and residual sum of a subset; of least norm if it is singular."""
    at, p = list(subset), len(gram) - 1
    inner, target, total = gram[np.ix_(at, at)], gram[at, p], gram[p, p]
    scale = np.sqrt(np.maximum(np.diag(inner), 0))
    scale[scale == 0] = 1.0
    beta = np.linalg.pinv(inner / np.outer(scale, scale), rcond=1e-12, hermitian=True) \
        @ (target / scale) / scale
    return beta, float(max(total - beta @ target, 0.0))


class SubsetTree:
    """The search over one centred cross-product, response last."""

    def __init__(self, gram: np.ndarray):
        self.p = len(gram) - 1
        scale = np.sqrt(np.maximum(np.diag(gram), 0))
        scale[scale == 0] = 1.0
        self.scaled = gram / np.outer(scale, scale)
        inner = self.scaled[:-1, :-1]
        if self.p and np.linalg.eigvalsh(inner)[0] < _LEAST_EIGENVALUE:
            inner[np.diag_indices(self.p)] += _RIDGE
        self.unit = float(gram[-1, -1]) / max(float(self.scaled[-1, -1]), 1e-300)
        self.least = np.full(self.p + 1, np.inf)
        self.subset: list[tuple[int, ...]] = [()] * (self.p + 1)
        self.nodes = 0
        self._bounds()

    def _offer(self, members, rss: float) -> None:
        size = len(members)
        if rss < self.least[size] * _BETTER or not np.isfinite(self.least[size]):
            self.least[size], self.subset[size] = rss, tuple(sorted(int(j) for j in members))

    def _bounds(self) -> None:
        p = self.p
        everything = list(range(p))
        m = self.scaled
        self._offer([], m[p, p])
        chosen: list[int] = []
        while len(chosen) < p:                                   # selection
            rest = [j for j in everything if j not in chosen]
            gain = [m[j, p] ** 2 / m[j, j] for j in rest]
            chosen.append(rest[int(np.argmax(gain))])
            m = _one(m, chosen[-1])
            self._offer(chosen, m[p, p])
        self.full = m                                            # all predictors swept in
        kept = list(everything)
        while kept:                                              # elimination
            cost = [m[j, p] ** 2 / -m[j, j] for j in kept]
            m = _one(m, kept.pop(int(np.argmin(cost))))
            self._offer(kept, m[p, p])
        for size in range(1, p):                                 # exchange
            self._exchange(list(self.subset[size]))

    def _exchange(self, members: list[int]) -> None:
        p, m = self.p, self.scaled
        for j in members:
            m = _one(m, j)
        changed = True
        while changed:
            changed = False
            for out in list(members):
                without = _one(m, out)
                rest = [j for j in range(p) if j not in members]
                sums = [without[p, p] - without[j, p] ** 2 / without[j, j] for j in rest]
                at = int(np.argmin(sums))
                if sums[at] < m[p, p] * _BETTER:
                    members[members.index(out)] = rest[at]
                    m, changed = _one(without, rest[at]), True
        self._offer(members, m[p, p])

    def search(self, branches: set[int] | None = None) -> None:
        """Look below the root, in all or some of its ``p`` branches."""
        if self.p:
            self._expand(self.full[None], np.arange(self.p)[None], np.zeros((1, self.p), bool),
                         np.array([self.p]), branches)

    def _expand(self, m: np.ndarray, free: np.ndarray, dropped: np.ndarray, n_free: np.ndarray,
                branches: set[int] | None = None) -> None:
        """``m`` per node; the first ``n_free`` of ``free`` may be dropped."""
        p, nodes = self.p, np.arange(len(m))
        self.nodes += len(m)
        open_ = np.arange(p) < n_free[:, None]
        at = np.where(open_, free, 0)
        sums = m[:, p, p][:, None] + m[nodes[:, None], at, p] ** 2 / -m[nodes[:, None], at, at]
        size = p - dropped.sum(axis=1)
        cheapest = np.where(open_, sums, np.inf).argmin(axis=1)
        for i in np.flatnonzero(sums[nodes, cheapest] < self.least[size - 1] * _BETTER):
            members = np.flatnonzero(~dropped[i])
            self._offer(members[members != free[i, cheapest[i]]], sums[i, cheapest[i]])
        order = np.argsort(np.where(open_, -sums, np.inf), axis=1, kind="stable")
        sums, free = np.take_along_axis(sums, order, 1), np.take_along_axis(free, order, 1)
        # The child at place c keeps the free ones before it; its subtree has sizes from least to size - 2.
        least = (size - n_free)[:, None] + np.arange(p)

        def alive(node, place):
            low = least[node, place]
            return (low <= size[node] - 2) & (sums[node, place] < self.least[np.minimum(low, p)] * _BETTER)

        node, place = np.nonzero(open_)
        if branches is not None:
            mine = np.isin(place, list(branches))
            node, place = node[mine], place[mine]
        by_sum = np.argsort(sums[node, place], kind="stable")
        node, place = node[by_sum], place[by_sum]
        for first in range(0, len(node), _NODES):
            n, c = node[first:first + _NODES], place[first:first + _NODES]
            still = alive(n, c)
            n, c = n[still], c[still]
            if len(n):
                gone = dropped[n]
                gone[np.arange(len(n)), free[n, c]] = True
                behind = (np.arange(p) + c[:, None] + 1) % p
                self._expand(swept(m[n], free[n, c]), np.take_along_axis(free[n], behind, 1), gone,
                             n_free[n] - c - 1)

    def found(self) -> list[tuple[int, float, tuple[int, ...]]]:
        """(size, residual sum, subset), the sums as the search saw them."""
        return [(k, float(self.least[k]) * self.unit, self.subset[k]) for k in range(self.p + 1)]


def best_of_each_size(gram: np.ndarray) -> list[tuple[tuple[int, ...], np.ndarray, float]]:
    """Best predictor set of each size 0..p from a centred cross-product, response last."""
    tree = SubsetTree(gram)
    tree.search()
    return [(subset, *coefficients(gram, subset)) for subset in tree.subset]
