"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: in every run of consecutive ANCHOR-word grams that
fits into a window of `window` words the gram with the smallest hash is kept,
so any two equal windows share an anchor at the same place.  Texts are joined
on anchors; only anchors that two different texts hold count.  Each shared
anchor is extended both ways to every window that contains it, and windows
meet on their 128-bit content hash, which gives the smallest document of each
without forming pairs of documents.  Neighbouring matched windows unite to the
maximal repeats; their words go.

A group of copies, or a passage in a third of all documents, is a key with
many rows only in aggregates with partial sums and in joins that Spark may
split.  Equal texts are handled once: all but the smallest document are
repeats from end to end.

Edge cases: null, empty and short texts have no window and keep all words;
repeated rows of a doc_id don't count against each other; rows without doc_id
are later than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, stash, utf8

WINDOW = 50
ANCHOR = 16
#: An odd base for each of the two rolling hashes, and its inverse mod 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Stands for a missing doc_id.
LAST = (1 << 63) - 1
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return factors.cumprod(dtype=np.uint64)


def words_of(text) -> list[bytes]:
    return utf8(text).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def gram_hashes(hashes: np.ndarray, size: int, column: int) -> np.ndarray:
    """Hash of every run of `size` words, by prefix sums of a polynomial mod 2**64, mixed."""
    n, base = len(hashes), BASES[column]
    if n < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[:, column] * _powers(base, n), dtype=np.uint64)))
        out = (total[size:] - total[:-size]) * _powers(pow(base, -1, 1 << 64), n - size + 1)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            out ^= out >> np.uint64(shift)
            out *= np.uint64(factor)
        return out ^ (out >> np.uint64(33))


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over every run of `width` values, in log(width) steps."""
    done = 1
    while 2 * done <= width:
        values, done = of(values[:-done], values[done:]), 2 * done
    rest = width - done
    return of(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(lengths: np.ndarray, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the concatenation, hashes) of the winnowed grams of texts of `lengths` words."""
    grams = gram_hashes(hashes, anchor, 0)
    run = window - anchor + 1
    if len(grams) < run:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.minimum(grams, NONE - np.uint64(1))
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    whole = text[: len(grams)] == text[anchor - 1 :]  # the gram lies in one text
    lows = _sliding(np.where(whole, grams, NONE), run, np.minimum)
    starts = text[: len(lows)] == text[window - 1 :]  # the run belongs to one window
    lows = np.where(starts, lows, np.uint64(0))
    pad = np.zeros(run - 1, np.uint64)
    kept = np.flatnonzero(whole & (grams == _sliding(np.concatenate((pad, lows, pad)), run, np.maximum)))
    assert not len(kept) or kept[-1] < ends[-1]
    return kept, grams[kept]


def _anchor_rows(frames, window: int, anchor: int):
    for frame in blocks(frames, "text"):
        texts = [words_of(t) for t in frame["text"]]
        keep = [i for i, t in enumerate(texts) if len(t) >= window]
        lengths = np.array([len(texts[i]) for i in keep], np.int64)
        if not len(keep):
            continue
        place, value = anchors(lengths, word_hashes([w for i in keep for w in texts[i]]), window, anchor)
        ends = np.cumsum(lengths)
        text = np.searchsorted(ends, place, side="right")
        yield pd.DataFrame({"anchor": value.view(np.int64), "body": frame["body"].to_numpy()[keep][text], "at": (place - (ends - lengths)[text]).astype(np.int32)})


def _window_rows(frames, window: int, anchor: int):
    for frame in blocks(frames, "text"):
        out = []
        for doc, body, text, seeds in zip(frame["doc_id"], frame["body"], frame["text"], frame["seeds"]):
            hashes = word_hashes(words_of(text))
            n = len(hashes) - window + 1
            if n < 1:
                continue
            marks = np.zeros(n + 1, np.int64)
            np.add.at(marks, np.clip(seeds + anchor - window, 0, n), 1)
            np.add.at(marks, np.minimum(seeds + 1, n), -1)
            at = np.flatnonzero(np.cumsum(marks)[:n] > 0)
            out.append(pd.DataFrame({"a": gram_hashes(hashes, window, 0)[at].view(np.int64), "b": gram_hashes(hashes, window, 1)[at].view(np.int64), "doc_id": doc, "body": body, "at": at.astype(np.int32)}))
        if out:
            yield pd.concat(out, ignore_index=True)


def kept_words(words: list[bytes], starts, whole: bool, window: int) -> list[bytes]:
    """words without those of the windows at `starts`, or of any window if whole."""
    if whole:
        return [] if len(words) >= window else words
    if starts is None or not len(starts):
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(starts)
    marks[starts] += 1
    np.add.at(marks, starts + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(marks)[:-1] == 0)]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs (doc_id, text).

    Goes every word that a window of `window` words covers whose word sequence
    also starts in a document with a smaller doc_id.  kept: the other words,
    joined by a space.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    # 64 bits name a text: two of n different texts share a name with a chance of n^2 / 2^65
    named = docs.withColumn("body", F.xxhash64("text", F.length("text")))
    rows = stash(named.select("text", "body").mapInPandas(lambda f: _anchor_rows(f, window, anchor), "anchor long, body long, at int"), "anchors")
    shared = rows.groupBy("anchor").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).filter("lo < hi").select("anchor")
    shared = stash(shared, "shared")  # as a scan it leaves the join free to split a hot anchor
    seeds = rows.join(shared, "anchor").groupBy("body").agg(F.collect_list("at").alias("seeds"))
    firsts = named.groupBy("body").agg(F.min("doc_id").alias("first"))
    seeds = stash(firsts.join(seeds, "body", "left"), "seeds")
    leaders = seeds.filter("seeds is not null").select(F.col("first").alias("doc_id"), "body", "seeds")
    windows = named.join(leaders, ["doc_id", "body"]).mapInPandas(lambda f: _window_rows(f, window, anchor), "a long, b long, doc_id long, body long, at int")
    windows = stash(windows, "windows")
    least = windows.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("a", "b", "lo")
    least = stash(least, "least")
    gone = windows.join(least, ["a", "b"]).filter("doc_id > lo").groupBy("doc_id", "body").agg(F.collect_list("at").alias("starts"))
    # what is known of each row beside its text: whether it repeats an earlier row's whole text, else its matched windows
    status = docs_status(named, firsts).join(gone, ["doc_id", "body"], "left")
    whole = named.join(status, ["doc_id", "body"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "starts")

    def finish(frames):
        for frame in blocks(frames, "text"):
            out = []
            for text, copy, starts in zip(frame["text"], frame["whole"], frame["starts"]):
                words = words_of(text)
                kept = kept_words(words, starts, bool(copy), window)
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            n, removed, kept = zip(*out)
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n_words": np.array(n, np.int64), "n_removed": np.array(removed, np.int64), "kept": list(kept)})

    done = whole.mapInPandas(finish, "doc_id long, n_words long, n_removed long, kept string")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))


def docs_status(named: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc_id, body, whole): rows whose text an earlier document has, or windows were found in; distinct."""
    rows = named.select("doc_id", "body").distinct()
    return rows.join(firsts, "body").select("doc_id", "body", (F.col("doc_id") > F.col("first")).alias("whole"))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
