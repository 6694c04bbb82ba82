"""Hard-negative mining by Strassen products of anchor and candidate tiles.

Candidates are dealt to tiles and anchors to batches by hash of their id.  A
task holds one tile and one batch; it multiplies blocks of both with
Strassen's recursion over int64, padded with zeros to even sides, and keeps a
heap of bounded size an anchor (or an anchor and positive) of what the block
offers.  Heaps of one tile's blocks merge in the task, those of all tiles in a
ranked window.  Two passes: positives of an anchor's own label first, then
negatives of other labels in the window that each positive's score opens.  All
anchors, one stated query set, meet all tiles; a hot label has no group of its
own, as tiles ignore labels.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part (see usable()); rows meet vectors of their own length
only, and never rows with their own id; repeated rows count once, and rows of
one id with different labels or vectors are rows of their own; an anchor
without positives, a positive without negatives and an empty table give no
rows; other columns aren't read.  Sums and products are taken modulo 2^64, so
a score is exact if it fits a long; where it might not, mining fails.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash
from .topk import valid

#: Candidates of a tile, anchors of a batch, and rows and columns multiplied at once.
TILE, BATCH, ROWS, COLS = 8_192, 16_384, 256, 2_048
#: Side at which the recursion ends.
LEAF = 32
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices by seven products of halves; exact modulo 2^64."""
    (n, m), p = a.shape, b.shape[1]
    if min(n, m, p) <= leaf:
        return a @ b
    if n % 2 or m % 2 or p % 2:
        a, b = np.pad(a, ((0, n % 2), (0, m % 2))), np.pad(b, ((0, m % 2), (0, p % 2)))
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * k), np.int64)
    out[:i, :k] = m1 + m4 - m5 + m7
    out[:i, k:] = m3 + m5
    out[i:, :k] = m2 + m4
    out[i:, k:] = m1 - m2 + m3 + m6
    return out[:n, :p]


def heads(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: by row, falling score, rising id."""
    order = np.lexsort((ids, ~score, row))
    first = np.concatenate(([True], np.diff(row[order]) != 0)) if len(row) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[rank < k]


def block_heads(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best allowed scores of each row of a block."""
    if scores.shape[1] > k:
        held = np.where(allowed, scores, LEAST)
        allowed = allowed & (scores >= np.partition(held, -k, axis=1)[:, -k][:, None])
    row, col = np.nonzero(allowed)
    score, ids = scores[row, col], ids[col]
    top = heads(row, score, ids, k)
    return row[top], ids[top], score[top]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, ids, score = (np.concatenate(x) for x in zip(*parts))
    top = heads(row, score, ids, k)
    return row[top], ids[top], score[top]


def _unpacked(frame: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of a tile or batch, by rising id."""
    return frame[name].to_numpy(np.int64), frame["label"].to_numpy(np.int64), np.stack(frame["v"].to_numpy()).astype(np.int64)


def _check(a: np.ndarray, b: np.ndarray) -> None:
    if a.size and b.size and a.shape[1] * int(max(a.max(), -int(a.min()))) * int(max(b.max(), -int(b.min()))) >= 2**55:
        raise OverflowError("scores could exceed a long")


def positives_of(anchors: pd.DataFrame, tile: pd.DataFrame, k: int) -> pd.DataFrame:
    """(anchor_id, anchor, vec_id, score) of each anchor's k best rows of its own label in the tile."""
    own, label, v = _unpacked(anchors, "anchor_id")
    ids, labels, rows = _unpacked(tile, "vec_id")
    _check(v, rows)
    out = []
    for kind in np.intersect1d(label, labels):
        mine, theirs = np.flatnonzero(label == kind), np.flatnonzero(labels == kind)
        for at in range(0, len(mine), ROWS):
            part = mine[at : at + ROWS]
            found = []
            for start in range(0, len(theirs), COLS):
                cols = theirs[start : start + COLS]
                scores = strassen(v[part], np.ascontiguousarray(rows[cols]).T)
                found.append(block_heads(scores, own[part][:, None] != ids[cols][None, :], ids[cols], k))
            row, found_ids, score = _merged(found, k)
            out.append(pd.DataFrame({"anchor_id": own[part][row], "anchor": anchors["anchor"].to_numpy()[part][row], "vec_id": found_ids, "score": score}))
    return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "anchor": [], "vec_id": [], "score": []})


def negatives_of(anchors: pd.DataFrame, tile: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """(anchor_id, anchor, place, vec_id, score): for each anchor and each of its positives the k best rows of other labels in the tile with low * positive <= 100 * score <= high * positive."""
    own, label, v = _unpacked(anchors, "anchor_id")
    ids, labels, rows = _unpacked(tile, "vec_id")
    _check(v, rows)
    most = max((len(x) for x in anchors["scores"]), default=0)
    bars = np.zeros((len(anchors), most), np.int64)
    there = np.zeros((len(anchors), most), bool)
    for i, x in enumerate(anchors["scores"]):
        bars[i, : len(x)], there[i, : len(x)] = x, True
    # 100 * score lies between them just where score does, so products stay small
    floor, roof = -(-low * bars // 100), high * bars // 100
    out = []
    for at in range(0, len(own), ROWS):
        part = slice(at, at + ROWS)
        found: list[list] = [[] for _ in range(most)]
        for start in range(0, len(ids), COLS):
            cols = slice(start, start + COLS)
            scores = strassen(v[part], rows[cols].T)
            other = (label[part][:, None] != labels[cols][None, :]) & (own[part][:, None] != ids[cols][None, :])
            for j in range(most):
                allowed = other & there[part, j][:, None] & (scores >= floor[part, j][:, None]) & (scores <= roof[part, j][:, None])
                found[j].append(block_heads(scores, allowed, ids[cols], k))
        for j in range(most):
            row, found_ids, score = _merged(found[j], k)
            out.append(pd.DataFrame({"anchor_id": own[part][row], "anchor": anchors["anchor"].to_numpy()[part][row], "place": j, "vec_id": found_ids, "score": score}))
    return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "anchor": [], "place": [], "vec_id": [], "score": []})


def usable(rows: DataFrame) -> DataFrame:
    """Rows of (vec_id, label, embedding) that take part."""
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(F.col("embedding")))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, tile: int = TILE, batch: int = BATCH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, v array<long>).

    For every row that is_anchor marks and each of its `positives` best rows of the same label, the
    `negatives` best rows of other labels whose score lies between low and high percent of the positive's.
    """
    of = lambda name, parts, salt: F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(parts)).cast("int")
    rows = rows.filter("vec_id is not null and label is not null and v is not null").select("vec_id", F.col("label").cast("long").alias("label"), F.size("v").alias("dim"), "v", is_anchor.alias("asked"))
    rows = stash(rows, "vectors")
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    tiles, batches = max(1, -(-n // tile)), max(1, -(-m // batch))
    data = rows.select(of("vec_id", tiles, 1).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "dim", "vec_id", "label", "v")
    anchors = rows.filter("asked").select("dim", F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("anchor"), "label", "v").distinct()
    keys = ["tile", "batch", "dim"]

    def met(asked: DataFrame, work, schema: str) -> DataFrame:
        """work(batch, tile) of every batch of the anchors and every tile, rows of a tile once each."""
        asked = asked.withColumn("batch", of("anchor_id", batches, 2)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        asked = asked.select([F.expr(c).alias(c) for c in asked.columns])  # columns apart from data's

        def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            names = [c.split()[0] for c in schema.split(", ")]
            if not len(left) or not len(right):
                return pd.DataFrame({c: [] for c in names})
            right = right.sort_values("vec_id", kind="stable")
            right = right[~pd.DataFrame({"id": right["vec_id"], "label": right["label"], "v": [x.tobytes() for x in right["v"]]}).duplicated()]
            return work(left, right)[names]

        return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(both, schema)

    near = met(anchors, lambda a, t: positives_of(a, t, positives), "anchor_id long, anchor long, vec_id long, score long")
    best = W.partitionBy("anchor_id", "anchor").orderBy(F.desc("score"), "vec_id")
    near = stash(near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives), "positives")
    # an anchor's list holds at most `positives` rows
    bars = near.groupBy("anchor_id", "anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("p"))
    asked = anchors.join(bars, ["anchor_id", "anchor"]).select("dim", "anchor_id", "anchor", "label", "v", F.col("p.score").alias("scores"))
    hard = met(asked, lambda a, t: negatives_of(a, t, negatives, low, high), "anchor_id long, anchor long, place int, vec_id long, score long")
    best = W.partitionBy("anchor_id", "anchor", "place").orderBy(F.desc("score"), "vec_id")
    hard = hard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    found = hard.join(near.select("anchor_id", "anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "anchor", "place"])
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
