"""Exact and near-duplicate removal."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .shared import checkpointed


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with is_first: whether the row is the smallest by `order` of its key; null keys are all first.

    Rows that tie by `order` are told apart by a hash of all their columns, and
    of equal rows one is first.  Equal rows are counted first and the smallest
    found by partial minima and a join, so a hot key never meets in one task.
    """
    of = lambda name: F.col(f"row.`{name}`")
    # rows travel nested, so that no name of theirs clashes
    nested = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    counted = nested.groupBy("row").agg(F.count(F.lit(1)).alias("copies")).select("row", "copies", F.struct(*map(of, order), F.xxhash64("row")).alias("place"))
    firsts = counted.filter(of(key).isNotNull()).groupBy(of(key).alias("key")).agg(F.min("place").alias("first"))
    joined = counted.join(firsts, of(key) == F.col("key"), "left")
    flags = F.transform(F.sequence(F.lit(1).cast("long"), "copies"), lambda i: F.col("first").isNull() | ((F.col("first") == F.col("place")) & (i == 1)))
    return joined.select("row", F.explode(flags).alias("is_first")).select(*[of(c) for c in rows.columns if c != "is_first"], "is_first")


def priority_exact_dedup(rows: DataFrame, key: str, priority: str, order: str) -> DataFrame:
    """rows that are first by (priority, order) of their key."""
    return first_of(rows, key, [priority, order]).filter("is_first").drop("is_first")


def _spans(words: list[str], size: int = 4, step: int = 2) -> list[str]:
    """Every `step`-th run of `size` words; the words themselves where there is no run."""
    return [" ".join(words[at : at + size]) for at in range(0, len(words) - size + 1, step)] or words


def _majority(digests: np.ndarray) -> str:
    """16 hex digits of the bits that at least half of the 8-byte digests [n, 8] have; all ones of none."""
    share = 2 * np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(share >= len(digests)).tobytes().hex()


@F.pandas_udf(T.StringType())
def simhash64(texts: pd.Series) -> pd.Series:
    """64-bit SimHash over blake2b of word 4-grams at every second word; null like an empty text."""
    words = texts.fillna("").str.casefold().str.findall("[a-z0-9]+")
    hashed = (b"".join(hashlib.blake2b(span.encode(), digest_size=8).digest() for span in _spans(own)) for own in words)
    return pd.Series([_majority(np.frombuffer(data, np.uint8).reshape(-1, 8)) for data in hashed], dtype=object)


def simhash_md5(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bits): 64 bits as a string of 0 and 1, over distinct words hashed by MD5; all built-in functions.

    The words' bits are summed map-side, one row a document is shuffled.
    """
    words = F.array_distinct(X.terms(F.col(text)))
    flat = rows.select(key, F.explode(words).alias("word"))
    half = lambda start: F.conv(F.substring("h", start, 8), 16, 10).cast("long")
    halves = flat.select(key, F.md5("word").alias("h")).select(key, half(1).alias("h0"), half(9).alias("h1"))
    ones = [F.sum(F.shiftright(f"h{b // 32}", 31 - b % 32).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    votes = halves.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *ones)
    return votes.select(key, F.concat(*[F.when(2 * F.col(f"b{b}") >= F.col("n"), "1").otherwise("0") for b in range(64)]).alias("bits"))


def distance(a: Column, b: Column) -> Column:
    """Differing places of two 64-digit strings of 0 and 1."""
    parts = [F.bit_count(F.conv(F.substring(a, s, 32), 2, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, s, 32), 2, 10).cast("long"))) for s in (1, 33)]
    return parts[0] + parts[1]


def bands_for(n: int, most: int = 3) -> int:
    """Blocks that 64 bits are cut into, so that a key of all but `most` of them has more values than there are fingerprints, where 7 blocks at most allow it."""
    blocks = most + 1
    while blocks < most + 4 and 64 * (blocks - most) / blocks < n.bit_length() - 4:
        blocks += 1
    return blocks


def banded_pairs(marked: DataFrame, key: str, most: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b, distance) of fingerprints that differ in at most `most` bits, a < b.

    Of the blocks that a fingerprint is cut into, `most` differ at worst, so
    two such fingerprints agree on some choice of the others: each choice is a
    join key.  More fingerprints are cut into more blocks, whose keys are
    longer, so buckets stay small at any size; the result is the same.  Equal
    fingerprints meet once, as classes: a and b are the smallest keys of
    theirs, so copies don't multiply.
    """
    classes = checkpointed(marked.groupBy("bits").agg(F.min(key).alias(key)))
    blocks = blocks or bands_for(classes.count(), most)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.substring("bits", a + 1, b - a) for a, b in zip(cuts, cuts[1:])]
    choices = itertools.combinations(range(blocks), blocks - most)
    keyed = classes.select(key, "bits", F.explode(F.array(*[F.concat(F.lit(f"{n}:"), *[parts[i] for i in chosen]) for n, chosen in enumerate(choices)])).alias("band"))
    other = keyed.select(F.col(key).alias("b"), F.col("bits").alias("bits_b"), "band")
    pairs = keyed.withColumnRenamed(key, "a").join(other, "band").filter("a < b")
    return pairs.select("a", "b", distance(F.col("bits"), F.col("bits_b")).alias("distance")).filter(F.col("distance") <= most).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex of the connected component of every vertex of edges (a, b).

    Alternating large-star and small-star steps; each round is checkpointed.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        wide = both.join(roots, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        close = wide.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(close.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            found = edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
            return found.unionAll(found.select(F.col("root").alias("v"), "root").distinct())
        before = now


def greedy_kept(vertices: DataFrame, edges: DataFrame, rounds: int = 8, group: int = 200_000) -> DataFrame:
    """(v, kept): the vertices that a pass in ascending order keeps, each unless a kept smaller neighbour exists.

    vertices (v), edges (a, b) with a < b.  Each round keeps the vertices whose
    smaller neighbours are all out and drops those with a kept one; the
    smallest open vertex is always decided.  Long chains decide few vertices a
    round: after each `rounds` rounds the open components of at most `group`
    edges are passed through in one go, a task a component; larger ones go on
    by rounds until none is open.
    """

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        kept: dict = {}
        below = frame.groupby("b")["a"].apply(list).to_dict()
        for v in sorted({*frame["a"], *frame["b"]}):
            kept[v] = not any(kept[a] for a in below.get(v, ()))
        return pd.DataFrame({"v": list(kept), "k": list(kept.values())})

    state = checkpointed(vertices.select("v").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    edges = checkpointed(edges.select("a", "b").distinct())
    kind = state.schema["v"].dataType.simpleString()
    while True:
        for _ in range(rounds):
            below = edges.join(state.select(F.col("v").alias("a"), F.col("kept").alias("k")), "a").groupBy(F.col("b").alias("v"))
            below = below.agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("has_kept"), F.bool_or(F.col("k").isNull()).alias("has_open"))
            decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("has_kept", F.lit(False)), False).when(~F.coalesce("has_open", F.lit(False)), True)
            state = checkpointed(state.join(below, "v", "left").select("v", decided.alias("kept")))
            if not state.filter("kept is null").take(1):
                return state
        # an open vertex has no kept smaller neighbour, so its fate hangs on open ones alone
        unsettled = state.filter("kept is null").select("v")
        inner = edges.join(unsettled.select(F.col("v").alias("a")), "a").join(unsettled.select(F.col("v").alias("b")), "b").select("a", "b")
        rooted = checkpointed(inner.join(_stars(inner).select(F.col("v").alias("a"), "root"), "a"))
        small = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= group).select("root")
        done = rooted.join(small, "root").select("root", "a", "b").groupBy("root").applyInPandas(settle, f"v {kind}, k boolean")
        state = checkpointed(state.join(done, "v", "left").select("v", F.coalesce("kept", "k").alias("kept")))
        if not state.filter("kept is null").take(1):
            return state
