"""Interpolated modified Kneser-Ney estimates over packed character grams.

A gram of ORDER characters is one integer, BITS a character, the last one
lowest.  Numpy only: `logs` is what a task does with its shard of the counts;
quality.py deals the shards out.

For a gram abcde every context that its probability falls back on (abcd, bcd,
cd, d) and every shorter gram (bcde, cde, de) has the same d before the e.
So one shard by (language, d) holds all that orders 5 to 2 need; order 1 is a table of at most ALPHABET rows a language.
"""

from __future__ import annotations

import numpy as np

ORDER, BITS = 5, 12
ALPHABET = 1 << BITS
#: Code points below this have a code of their own.
PLAIN = ALPHABET - 128


def codes(text: str) -> np.ndarray:
    """Character codes 1 to ALPHABET - 2 of text, white space runs as one space.

    Code points from PLAIN on take two codes, a lead one and one of their low
    bits, so that scripts of any size keep their characters apart; only code
    points over half a million, in planes without assigned characters, fold.
    """
    points = np.frombuffer(" ".join(text.split()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    far = points >= PLAIN
    if not far.any():
        return points + 1
    at = np.arange(len(points)) + np.cumsum(far) - far
    out = np.empty(len(points) + int(far.sum()), np.int64)
    rest = points[far] - PLAIN
    out[at[~far]] = points[~far] + 1
    out[at[far]] = PLAIN + 1 + rest // (PLAIN - 1) % 126
    out[at[far] + 1] = 1 + rest % (PLAIN - 1)
    return out


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each character of all texts, number of characters of each text)."""
    parts = [codes(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    pad = np.zeros(order - 1, np.int64)
    line = np.concatenate([x for p in parts for x in (pad, p)] or [pad])
    n = len(line) - order + 1
    packed = np.zeros(max(0, n), np.int64)
    for k in range(order):
        packed = packed << BITS | line[k : k + n]
    # a text's grams end in its own characters, not in the pad of the next text
    own = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)) * (order - 1), sizes)
    return packed[own], sizes


def levels(g: np.ndarray, n: np.ndarray, lowest: int, order: int = ORDER) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Order -> (seen grams, ascending; their counts): of the highest order as given, below it how many characters come before them."""
    seen = n > 0
    at = np.argsort(g[seen], kind="stable")
    out = {order: (g[seen][at], n[seen][at])}
    for k in range(order - 1, lowest - 1, -1):
        out[k] = np.unique(out[k + 1][0] & ((1 << BITS * k) - 1), return_counts=True)
    return out


def counts_of_counts(n: np.ndarray) -> np.ndarray:
    """How many grams were counted 1, 2, 3 and 4 times."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


def discounts(of: np.ndarray) -> np.ndarray:
    """The discounts of grams counted 0, 1, 2, and 3 or more times, from counts of counts."""
    n1, n2, n3, n4 = (float(x) for x in of)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    out = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(max(k - (k + 1) * y * b / a if a else k / 2, 0.1), float(k)))
    return np.array(out)


def interpolated(g: np.ndarray, lower: np.ndarray, level: tuple[np.ndarray, np.ndarray], d: np.ndarray) -> np.ndarray:
    """Probabilities of grams g of one order, from those of their shorter grams, the seen grams of the order and its discounts."""
    seen, n = level
    if not len(seen):
        return lower
    off = d[np.minimum(n, 3)]
    context = seen >> BITS
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    total, free, context = np.add.reduceat(n, first).astype(np.float64), np.add.reduceat(off, first), context[first]
    at = np.minimum(np.searchsorted(seen, g), len(seen) - 1)
    mass = np.where(seen[at] == g, (n - off)[at], 0.0)
    of = np.minimum(np.searchsorted(context, g >> BITS), len(context) - 1)
    known = context[of] == g >> BITS
    return np.where(known, mass / total[of] + free[of] / total[of] * lower, lower)


def logs(g: np.ndarray, seen: np.ndarray, n: np.ndarray, singles: tuple[np.ndarray, np.ndarray], d: dict[int, np.ndarray], order: int = ORDER) -> np.ndarray:
    """Log probabilities of grams g of one shard, from its seen grams and their counts, the language's single characters and its discounts by order."""
    level = levels(seen, n, 2, order) | {1: singles}
    p = np.full(len(g), 1.0 / ALPHABET)
    for k in range(1, order + 1):
        p = interpolated(g & ((1 << BITS * k) - 1), p, level[k], d[k])
    return np.log(p)
