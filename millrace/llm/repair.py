"""Re-Pair grammar compression of token ids.

A shard holds the ids of consecutive documents.  Neighbouring pairs that occur
often become nonterminals, round after round, until no pair occurs as often as
a rule costs; a pair never crosses documents.  The shard stores the rules, each
rule's expansion length and each document's symbol count, so that any document,
or any run of its ids, is decoded without the others.

Layout, little-endian: header of 7 uint32 (magic, first nonterminal, rules,
documents, symbols, bits of a symbol over 16, bytes of an expansion length), then
the rules' sides, their expansion lengths, symbol counts uint32 [documents], and
the symbols.  Sides and symbols are uint16, followed by a bit plane for each
bit over 16.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

MAGIC = 0x52503031
#: A rule takes the room of three symbols and each replacement saves one: from four occurrences on it surely pays.
LEAST = 4
#: Occurrences that a pair must have in the first passes, so that the most frequent pairs are replaced first.
STEPS = (256, 32)
BUCKETS = 1 << 21


def _frequent(left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that occur `least` times or more: (pairs, counts, places of their occurrences, pair of each).

    A first count by hash buckets leaves out most rare pairs before the exact one.
    """
    mixed = (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(11)
    heavy = np.flatnonzero((np.bincount(mixed, minlength=BUCKETS) >= least)[mixed])
    code, pairs = pd.factorize(left[heavy].astype(np.int64) << 32 | right[heavy])
    counts = np.bincount(code, minlength=len(pairs))
    often = counts[code] >= least
    return pairs, counts, heavy[often], code[often]


def _chosen(place: np.ndarray, code: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Which occurrences, in ascending places, to replace, so that none overlap and every pair chosen has `least`.

    Of overlapping ones the more frequent pair goes first, equal ones in a
    mixed order, so that long repeats shrink everywhere at once; in a run of
    one pair every second is taken.  Where overlaps leave no pair enough, the
    most frequent of those that have enough by themselves goes alone.
    """
    if not len(place):
        return np.empty(0, bool)
    touch, nth = np.diff(place) == 1, np.arange(len(place))
    same = np.concatenate(([False], touch & (code[1:] == code[:-1])))
    single = (nth - np.maximum.accumulate(np.where(same, 0, nth))) % 2 == 0
    strength = counts[code].astype(np.int64) << 32 | (code.astype(np.int64) * 0x9E3779B1 & 0xFFFFFFFF)
    take = single.copy()
    take[1:] &= ~touch | (strength[1:] >= strength[:-1])
    take[:-1] &= ~touch | (strength[:-1] >= strength[1:])
    take &= (np.bincount(code[take], minlength=len(counts)) >= least)[code]
    if not take.any():
        alone = np.bincount(code[single], minlength=len(counts))
        if alone.max() >= least:
            take = single & (code == np.argmax(alone))
    return take


def compress(ids: np.ndarray, lengths: np.ndarray, first: int, least: int = LEAST, steps: tuple[int, ...] = STEPS) -> bytes:
    """A shard of the documents whose ids stand one after the other in `ids`; all are below `first`."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules = np.empty((0, 2), np.uint32)
    for often in (*(s for s in steps if s > least), least):
        # a pair of two old symbols that isn't frequent never gets so: later rounds look around new symbols only
        fresh = np.ones(len(symbols), bool)
        while True:
            open_ = np.flatnonzero(fresh[:-1] & ~last[:-1])
            pairs, counts, place, code = _frequent(symbols[open_], symbols[open_ + 1], often)
            place = open_[place]
            take = _chosen(place, code, counts, least)
            if not take.any():
                break
            used = np.bincount(code[take], minlength=len(pairs)) > 0
            own = np.flatnonzero(used)
            number = np.cumsum(used) - 1
            at = place[take]
            symbols[at] = first + len(rules) + number[code[take]]
            last[at] = last[at + 1]
            rules = np.concatenate((rules, np.stack((pairs[own] >> 32, pairs[own] & 0xFFFFFFFF), axis=1).astype(np.uint32)))
            fresh = np.zeros(len(symbols), bool)
            fresh[at] = fresh[np.maximum(at - 1, 0)] = fresh[np.maximum(at - 2, 0)] = True
            fresh[place[~take]] = True
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, last, fresh = symbols[keep], last[keep], fresh[keep]
    sizes = _sizes(rules, first)
    counts = np.zeros(len(lengths), np.uint32)
    counts[lengths > 0] = np.diff(np.concatenate(([-1], np.flatnonzero(last))))
    over = max(0, int(first + len(rules)).bit_length() - 16)
    wide = 2 if sizes.max(initial=0) < 1 << 16 else 4
    header = np.array([MAGIC, first, len(rules), len(lengths), len(symbols), over, wide], "<u4")
    return b"".join((header.tobytes(), _planes(rules.ravel(), over), sizes.astype(f"<u{wide}").tobytes(), counts.astype("<u4").tobytes(), _planes(symbols, over)))


def _planes(values: np.ndarray, over: int) -> bytes:
    """The low 16 bits of values, then each of `over` higher bits as a plane."""
    return b"".join([values.astype("<u2").tobytes(), *(np.packbits((values >> (16 + k) & 1).astype(np.uint8)).tobytes() for k in range(over))])


def _values(data: bytes, at: int, n: int, over: int) -> tuple[np.ndarray, int]:
    """(n values of _planes(), the place behind them)."""
    out = np.frombuffer(data, "<u2", n, at).astype(np.uint32)
    at += 2 * n
    for k in range(over):
        size = -(-n // 8)
        out |= np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(np.uint32) << np.uint32(16 + k)
        at += size
    return out, at


def _rounds(rules: np.ndarray, first: int):
    """Runs [start, end) of rules that refer only to rules before start."""
    start = 0
    while start < len(rules):
        refers = (rules[start:].max(axis=1) >= first + start).nonzero()[0]
        end = start + (int(refers[0]) if len(refers) else len(rules) - start)
        yield start, end
        start = end


def _sizes(rules: np.ndarray, first: int) -> np.ndarray:
    sizes = np.ones(len(rules), np.int64)
    for start, end in _rounds(rules, first):
        part = rules[start:end].astype(np.int64) - first
        sizes[start:end] = sum(np.where(p >= 0, sizes[np.maximum(p, 0)], 1) for p in part.T)
    return sizes


class Shard:
    """Random-access reader of compress()'s bytes."""

    def __init__(self, data: bytes):
        magic, self.first, n_rules, n_docs, n_symbols, over, wide = np.frombuffer(data, "<u4", 7).tolist()
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        rules, at = _values(data, 28, 2 * n_rules, over)
        rules = rules.reshape(-1, 2)
        self.sizes = np.frombuffer(data, f"<u{wide}", n_rules, at).astype(np.int64)
        at += wide * n_rules
        self.counts = np.frombuffer(data, "<u4", n_docs, at).astype(np.int64)
        self.symbols, _ = _values(data, at + 4 * n_docs, n_symbols, over)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.flat = np.empty(int(self.offsets[-1]), np.uint32)
        for a, b in _rounds(rules, self.first):
            self.flat[self.offsets[a] : self.offsets[b]] = self.expand(rules[a:b].ravel())[0]

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each symbol) of a run of symbols."""
        own = symbols.astype(np.int64) - self.first
        rule = own >= 0
        sizes = np.ones(len(own), np.int64)
        sizes[rule] = self.sizes[own[rule]]
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        out[(ends - sizes)[~rule]] = symbols[~rule]
        size, begin, source = sizes[rule], (ends - sizes)[rule], self.offsets[own[rule]]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + step] = self.flat[np.repeat(source, size) + step]
        return out, sizes

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[i] : self.starts[i + 1]])[0]

    def documents(self) -> list[np.ndarray]:
        ids, sizes = self.expand(self.symbols)
        ends = np.concatenate(([0], np.cumsum(sizes)))[self.starts]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
