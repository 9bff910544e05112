"""Ball trees over sparse vectors for exact inner-product search.

A node holds the mean of its vectors and the largest distance to it, so that no vector of the node has an inner product
with a query above <query, mean> + |query| * radius. Where the coordinates are cut into blocks the same holds in each, and the
blocks' bounds add up; as a query is sparse, that is far less than the bound over all coordinates, to which the dimensions
that the query doesn't have add their distance. The bounds are rounded up; scores are exact integers. A tree is searched best
first: the node with the highest bound is opened next, and what is bounded below the k-th best score is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

#: Doubles lose a part of at most 1e-16 in each step of a sum. Bounds are raised by far more than a sum of a million terms loses.
SLACK = 1e-9


class Sparse:
    """Rows of (index, value) pairs; ``starts`` has one entry more than there are rows."""

    def __init__(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray, width: int):
        self.starts, self.index, self.value, self.width = starts, index, value, width

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        n = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.starts[:-1][rows] - starts[:-1], n) + np.arange(starts[-1])
        return Sparse(starts, self.index[at], self.value[at], self.width)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of values given for every entry, by row."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def row_sums(self, values: np.ndarray) -> np.ndarray:
        """As ``sums``, adding up each row on its own."""
        out = np.zeros(len(self), values.dtype)
        full = np.flatnonzero(np.diff(self.starts))
        if len(full):
            out[full] = np.add.reduceat(values, self.starts[:-1][full])
        return out

    def mean(self) -> np.ndarray:
        return np.bincount(self.index, weights=self.value, minlength=self.width) / max(1, len(self))

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return self.row_sums(self.value * dense[self.index])

    def radii(self, mean: np.ndarray, block: int) -> np.ndarray:
        """The largest distance of a row to the mean in each block of ``block`` coordinates, rounded up. Indices rise in a row."""
        blocks = -(-self.width // block)
        own = np.add.reduceat(mean * mean, np.arange(0, self.width, block)) if self.width else np.zeros(0)
        out, rows = np.zeros(blocks), np.zeros(blocks, np.int64)
        if len(self.index):
            at = self.index // block
            new = np.concatenate([[True], at[1:] != at[:-1]])
            new[self.starts[:-1][np.diff(self.starts) > 0]] = True
            first = np.flatnonzero(new)
            squares = self.value * self.value
            far = np.add.reduceat(squares - 2 * self.value * mean[self.index], first) + own[at[first]]
            far += SLACK * (np.add.reduceat(squares, first) + own[at[first]])
            np.maximum.at(out, at[first], far)
            rows = np.bincount(at[first], minlength=blocks)
        absent = rows < len(self)  # a row with nothing in the block is as far as the mean is long
        out[absent] = np.maximum(out[absent], own[absent] * (1 + SLACK))
        return np.sqrt(out)

    def dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        own = slice(self.starts[row], self.starts[row + 1])
        out[self.index[own]] = self.value[own]
        return out


class BallTree:
    """``order``: the rows in the order of the leaves. Node i covers ``order[first[i]:last[i]]``; its children are ``left[i]``
    and ``left[i] + 1``, or it is a leaf if ``left[i]`` is 0. ``visit(mean, radii)`` gives what is kept of a node."""

    def __init__(self, rows: Sparse, leaf: int, block: int, visit: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.first, self.last, self.left, self.kept = [0], [len(rows)], [0], []
        self.order = np.arange(len(rows))
        held = [rows]
        i = 0
        while i < len(self.first):
            own, held[i] = held[i], None
            mean = own.mean()
            norms = own.row_sums(own.value * own.value)
            far = norms - 2 * own.dot(mean) + mean @ mean
            top = float(norms.max(initial=0.0))
            self.kept.append(visit(mean, own.radii(mean, block)))
            if len(own) > leaf and float(far.max()) > SLACK * top:
                side = self._side(own, norms, far)
                at = self.first[i] + int(np.count_nonzero(~side))
                place = np.concatenate([np.flatnonzero(~side), np.flatnonzero(side)])
                self.order[self.first[i] : self.last[i]] = self.order[self.first[i] : self.last[i]][place]
                self.left[i] = len(self.first)
                for first, last, rows_of in ((self.first[i], at, ~side), (at, self.last[i], side)):
                    self.first.append(first)
                    self.last.append(last)
                    self.left.append(0)
                    held.append(own.take(np.flatnonzero(rows_of)))
            i += 1

    @staticmethod
    def _side(rows: Sparse, norms: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which rows are nearer to the one farthest from the mean than to the one farthest from that; if that
        leaves a side with under a sixteenth of the rows, the half that is nearest to it."""
        one = int(far.argmax())
        to_one = rows.dot(rows.dense(one))
        two = int((norms - 2 * to_one).argmax())
        lean = to_one - rows.dot(rows.dense(two)) - (norms[one] - norms[two]) / 2
        side = lean > 0
        n = int(np.count_nonzero(side))
        if min(n, len(rows) - n) * 16 < len(rows):
            side = np.zeros(len(rows), bool)
            side[np.argsort(lean, kind="stable")[len(rows) // 2 :]] = True
        return side


def search(tree: BallTree, bounds: np.ndarray, least: Callable[[], float], score: Callable[[int, int], None]) -> int:
    """Best first: ``score(first, last)`` is called for the leaves whose bound reaches ``least()``, highest bounds first. Returns
    the number of leaves scored."""
    heap = [(-bounds[0], 0)] if len(tree.order) else []
    leaves = 0
    while heap:
        bound, i = heapq.heappop(heap)
        if -bound < least():
            break
        child = tree.left[i]
        if child:
            for c in (child, child + 1):
                own = min(-bound, bounds[c])  # a child's rows are its parent's too
                if own >= least():
                    heapq.heappush(heap, (-own, c))
        else:
            leaves += 1
            score(tree.first[i], tree.last[i])
    return leaves
