"""Public tokenizers inside tasks, with a cache of words.

The tokenizers split a text before they merge: no token crosses from one
space-led word into the next.  So the texts of a batch are cut at spaces and
line ends and dictionary-encoded as one column; each distinct piece goes
through the library once, and the ids of the texts are gathered from those of
their pieces.  Texts in which white space itself could form tokens (two or
more in a row) go to the library whole.
"""

from __future__ import annotations

import threading
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

#: Pieces that a worker remembers, and characters of the longest one.
CACHE, LONGEST = 500_000, 48
#: Characters that are cut at a time.
RUN = 1_000_000
#: Seconds without use after which a worker lets go of its encoders.
IDLE = 4.0
#: Marks that the tokenizers keep apart from an ASCII letter before them.
MARKS = ".,"


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file is; looked up in the process that uses it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs [start, start + size) of flat, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Words:
    """Ids of pieces: a dictionary from piece to number, and ids and counts by number."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.hits = (np.empty(0, t) for t in (np.uint32, np.int64, np.int64, np.int32))

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.starts)
        self.number.update(zip(pieces, range(n, n + len(pieces))))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.flat, self.sizes = np.concatenate((self.flat, ids)), np.concatenate((self.sizes, sizes))
        self.hits = np.concatenate((self.hits, np.zeros(len(pieces), np.int32)))

    def keep(self, which: np.ndarray) -> None:
        """Forget all pieces but those of the mask."""
        new = np.cumsum(which) - 1
        self.number = {p: int(new[i]) for p, i in self.number.items() if which[i]}
        kept = np.flatnonzero(which)
        self.flat = gather(self.flat, self.starts[kept], self.sizes[kept])
        self.sizes, self.hits = self.sizes[kept], self.hits[kept] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes


class Encoder:
    """encode(texts) gives uint32 ids; add_special_tokens is False throughout."""

    def __init__(self, name: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.keeps_space = keeps_space
        self.words = Words()
        self.used = time.monotonic()
        marks = {m: self.library.encode(m, add_special_tokens=False).ids for m in MARKS}
        self.marks = {m: ids[0] for m, ids in marks.items() if len(ids) == 1}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece), from one text in which a mark that the tokenizer keeps apart stands between the pieces.

        One call for thousands of words takes a fraction of the time of as many calls.
        """
        mark = "\n" if self.keeps_space else " \x01 "
        own = self.library.encode(mark, add_special_tokens=False).ids
        ids = self._whole([mark.join(pieces)])[0]
        cuts = np.flatnonzero(ids == own[0]) if len(own) == 1 else ()
        if len(cuts) != len(pieces) - 1:  # the mark isn't kept apart
            parts = self._whole(pieces)
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return np.delete(ids, cuts), np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1

    def _learn(self, pieces: list[str]) -> None:
        """Add pieces that aren't known yet.

        A full stop or comma after an ASCII letter is a token of its own, so
        such a piece is its stem, known perhaps, and the mark.
        """
        known, mark = self.words.number, "\n" if self.keeps_space else "\x01"
        stems = {p: p[:-1] for p in pieces if p[-1:] in self.marks and p[-2:-1].isalpha() and p[-2].isascii()}
        new = [p for p in dict.fromkeys(stems.get(p, p) for p in pieces) if p not in known]
        plain = [p for p in new if mark not in p]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            self.words.add(part, *self._many(part))
        if rest := [p for p in new if mark in p]:
            parts = self._whole(rest)
            self.words.add(rest, np.concatenate(parts), np.array([len(x) for x in parts], np.int64))
        if stems:
            own = np.fromiter((known[s] for s in stems.values()), np.int64, len(stems))
            sizes = self.words.sizes[own] + 1
            ends = np.cumsum(sizes)
            ids = np.empty(int(ends[-1]), np.uint32)
            ids[ends - 1] = [self.marks[p[-1]] for p in stems]
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = gather(self.words.flat, self.words.starts[own], sizes - 1)
            self.words.add(list(stems), ids, sizes)

    def _cut(self, texts: pa.Array) -> pa.Array:
        if not self.keeps_space:  # white space only separates
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n"), "\0")

    def safe(self, text: str) -> bool:
        """Whether the tokenizer surely never joins the pieces of text."""
        return not self.keeps_space or not ("\0" in text or any(run in text for run in ("  ", "\n\n", " \n", "\n ")))

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each)."""
        upto = np.cumsum([len(t) for t in texts])
        cuts = np.flatnonzero(np.diff(upto // RUN)) + 1
        parts = [self._flat(texts[a:b]) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)])]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.used = time.monotonic()
        if not all(map(self.safe, texts)):
            parts = [self._flat([t]) if self.safe(t) else ((ids := self._whole([t])[0]), np.array([len(ids)])) for t in texts]
            return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts]).astype(np.int64)
        cut = self._cut(pa.array(texts, pa.large_string()))
        coded = cut.values.dictionary_encode()
        pieces, words = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.words
        found = list(map(words.number.get, pieces))
        if None in found:
            self._learn([p for p, i in zip(pieces, found) if i is None])
            found = [words.number[p] if i is None else i for p, i in zip(pieces, found)]
        own = np.array(found, np.int64)
        words.hits[own] += 1
        of = own[coded.indices.to_numpy()]
        sizes = words.sizes[of]
        ids = gather(words.flat, words.starts[of], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        counts = np.diff(ends[cut.offsets.to_numpy()])
        if len(words.number) > CACHE:  # what several batches use stays
            long = np.zeros(len(words.starts), bool)
            long[[i for p, i in words.number.items() if len(p) > LONGEST]] = True
            words.keep((words.hits > 1) & ~long)
            if len(words.number) > CACHE // 2:
                words.keep(words.hits >= np.median(words.hits))
                if len(words.number) > CACHE * 3 // 4:
                    self.words = Words()
        return ids, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.flat(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []


_held: dict[tuple[str, bool], Encoder] = {}
_guard = threading.Lock()


def _let_go(idle: float) -> None:
    """Wait until no encoder was used for `idle` seconds, and give their memory back."""
    while True:
        time.sleep(idle / 4)
        with _guard:
            if all(time.monotonic() - e.used > idle for e in _held.values()):
                _held.clear()
                break
    give_back()


def encoder(name: str, keeps_space: bool) -> Encoder:
    """One encoder a worker process; its cache serves every batch of the worker.

    Workers outlive the stages that encode: what is not used for IDLE seconds goes.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with _guard:
        if not _held:
            threading.Thread(target=_let_go, args=(IDLE,), daemon=True).start()
        if (name, keeps_space) not in _held:
            _held[name, keeps_space] = Encoder(name, keeps_space)
        found = _held[name, keeps_space]
        found.used = time.monotonic()
        return found
