"""Products of sparse rows, made in tasks, with sparse columns that every task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Columns that are multiplied at once, cells of a chunk of rows, and the share of a block's columns (one in so many) from which a term's weights are a dense row.
BLOCK, CELLS, DENSE = 1_024, 2_000_000, 16


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ..., counts[i] of them, one run after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def pieces(costs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that cost about `most` together; a single row may cost more."""
    part = np.cumsum(costs) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(costs)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) / 1e6 + 0.0


class Columns:
    """Columns of (term, column, weight), each pair given once.

    A block of BLOCK columns has frequent terms as dense rows, for a matrix
    product, and the others as lists.  With more than one block a dense part
    is made when it is used, so that one at a time is held.
    """

    def __init__(self, term: np.ndarray, column: np.ndarray, weight: np.ndarray, terms: int, columns: int):
        self.terms, self.lists, self.made = terms, [], None
        for first in range(0, columns, BLOCK):
            mine = np.flatnonzero((column >= first) & (column < first + BLOCK))
            mine = mine[np.argsort(term[mine], kind="stable")]
            self.lists.append((first, min(BLOCK, columns - first), term[mine], column[mine] - first, weight[mine]))

    def _parts(self, n: int):
        if self.made is None or self.made[0] != n:
            _, width, term, column, weight = self.lists[n]
            count = np.bincount(term, minlength=self.terms)
            often = count * DENSE >= width
            place, own = np.cumsum(often) - 1, often[term]
            dense = np.zeros((int(often.sum()), width))
            dense[place[term[own]], column[own]] = weight[own]
            self.made = n, (np.cumsum(count) - count, np.where(often, 0, count), often, place, dense)
        return self.made[1]

    def products(self, counts: np.ndarray, term: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, products) in chunks; counts are the entries (term, value) of each row, in the rows' order, each term of a row once."""
        if not len(counts):
            return
        ends, all_rows = np.cumsum(counts), np.repeat(np.arange(len(counts)), counts)
        for n, (first, width, _, column, weight) in enumerate(self.lists):
            start, count, often, place, dense = self._parts(n)
            costs = np.bincount(all_rows, count[term], len(counts)).astype(np.int64) + max(width, len(dense))
            for a, b in pieces(costs, CELLS):
                entries = slice(ends[a] - counts[a], ends[b - 1])
                row, t, v = all_rows[entries] - a, term[entries], value[entries]
                own, many = often[t], count[t]
                mine = np.zeros((b - a, len(dense)))
                mine[row[own], place[t[own]]] = v[own]
                at = runs(start[t], many)
                listed = np.bincount(np.repeat(row * width, many) + column[at], np.repeat(v, many) * weight[at], (b - a) * width)
                yield a, first, mine @ dense + listed.reshape(b - a, width)
