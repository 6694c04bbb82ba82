"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are integers.  Rows are dealt to tiles of alike ones (cells of sampled
pivots, cut where they are too full); a tile orders its rows so that
alike ones lie together and cuts them into ranges, blocks of BLOCK rows, each with its
forward index (the rows' values) and the largest and smallest value of every
term (dimension).  The bound of a block for a query is the sum over terms of
the larger of weight * largest and weight * smallest.  Each query visits the
blocks of a tile by falling bound and stops when the next bound is below its
k-th score so far; equal bounds are still visited, since ties go to the
smaller id.

A query is searched in its home tile first.  The k-th score found there is
its floor elsewhere: tiles have bounds like blocks, and a query goes only to
tiles whose bound isn't below its floor, which drop every block below it at
once.  Queries go to tiles in batches, so that a task holds one tile and one
batch; Spark merges the tiles' results.

Edge cases: vectors that are null or hold null or non-finite components take
no part, nor do rows without id; a query meets vectors of its own length only,
and never rows with its own id; equal rows are one query; fewer than k
candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash

K, BLOCK, TILE, BATCH, PIVOTS = 5, 64, 16_384, 16_384, 128
#: Cells that rows are dealt to at most, and tiles whose bounds a task holds.
CELLS, BOUNDS = 1_024, 4_096
#: Queries of a batch that are searched together; bounds their matrix of bounds.
TOGETHER = 1_024


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


class Tile:
    """Rows of a tile in blocks, with forward index and term bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK, pivots: int = PIVOTS):
        chosen = rows[np.linspace(0, len(rows) - 1, min(pivots, len(rows))).astype(int)].astype(np.float32)
        norm = np.maximum(np.linalg.norm(chosen, axis=1, keepdims=True), 1)
        order = np.lexsort((ids, np.argmax(rows.astype(np.float32) @ (chosen / norm).T, axis=1)))
        ids, rows = ids[order], rows[order]
        n = -(-len(rows) // block)
        filler = n * block - len(rows)
        self.ids = np.concatenate((ids, np.zeros(filler, np.int64))).reshape(n, block)
        self.real = (np.arange(n * block) < len(rows)).reshape(n, block)
        self.rows = np.concatenate((rows, np.repeat(rows[-1:], filler, axis=0))).reshape(n, block, rows.shape[1])
        self.most, self.least = self.rows.max(axis=1), self.rows.min(axis=1)


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of a and b are exact in float64."""
    return a.size == 0 or b.size == 0 or a.shape[-1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**52


def search(tile: Tile, ids: np.ndarray, queries: np.ndarray, k: int = K, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, vec_id, score) of the k best of the tile for each query, and the number of blocks scored.

    With floors, rows that score below a query's floor needn't be found.
    """
    kind = np.float64 if _exact(queries, tile.rows) else np.int64
    q, rows = queries.astype(kind), tile.rows.astype(kind)
    bound = np.maximum(q, 0) @ tile.most.astype(kind).T + np.minimum(q, 0) @ tile.least.astype(kind).T
    order = np.argsort(-bound, axis=1, kind="stable")
    floor = np.iinfo(np.int64).min
    best_score = np.full((len(q), k), floor)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    active, scored = np.arange(len(q)), 0
    floors = np.full(len(q), floor) if floors is None else floors
    for step in range(order.shape[1]):
        block = order[active, step]
        # a query whose next bound is below its k-th score is done
        go = bound[active, block] >= np.maximum(best_score[active, -1], floors[active])
        active, block = active[go], block[go]
        if not len(active):
            break
        scored += len(active)
        scores = np.empty((len(active), rows.shape[1]), np.int64)
        by_block = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[by_block])) + 1
        for part in np.split(by_block, cuts):
            scores[part] = (q[active[part]] @ rows[block[part[0]]].T).astype(np.int64)
        found = tile.ids[block]
        scores[~tile.real[block] | (found == ids[active][:, None])] = floor
        better = scores.max(axis=1) >= best_score[active, -1]
        a = active[better]
        every_score = np.concatenate((best_score[a], scores[better]), axis=1)
        every_id = np.concatenate((best_id[a], np.where(scores[better] == floor, np.iinfo(np.int64).max, found[better])), axis=1)
        top = np.lexsort((every_id, -every_score.astype(np.float64) if kind is np.float64 else ~every_score), axis=1)[:, :k]
        best_score[a] = np.take_along_axis(every_score, top, axis=1)
        best_id[a] = np.take_along_axis(every_id, top, axis=1)
    row, place = np.nonzero(best_id != np.iinfo(np.int64).max)
    return row, best_id[row, place], best_score[row, place], scored


def dealt(rows: DataFrame, tile: int, batch: int, most: int = CELLS) -> tuple[DataFrame, int, int]:
    """(rows (tile, dim, vec_id, v, q), number of tiles, number of batches): alike rows lie in one tile of about `tile` rows.

    Rows go to the cell of the pivot whose direction is nearest; pivots are the
    `most` rows of smallest hash at most, one a tile.  A cell that is too full
    is cut into tiles by hash.
    """
    rows = stash(rows.select(F.size("v").alias("dim"), "vec_id", "v", "q"), "vectors")
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    cells = min(most, max(1, -(-n // tile)))
    pivots: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").select("dim", "v").limit(cells).collect():  # at most CELLS vectors
        pivots.setdefault(r.dim, []).append(r.v)
    units = {d: np.array(v, np.float64) / np.maximum(np.linalg.norm(np.array(v, np.float64), axis=1, keepdims=True), 1) for d, v in pivots.items() if d}

    @F.pandas_udf(T.IntegerType())
    def cell(v: pd.Series) -> pd.Series:
        sizes = v.map(len).to_numpy()
        out = np.zeros(len(v), np.int32)
        for d in np.unique(sizes):
            if d in units:
                at = np.flatnonzero(sizes == d)
                out[at] = np.argmax(np.stack(v.iloc[at].to_numpy()).astype(np.float64) @ units[d].T, axis=1)
        return pd.Series(out)

    if cells > 1:
        rows = stash(rows.withColumn("cell", cell("v")), "cells")
    else:
        rows = rows.withColumn("cell", F.lit(0))
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CELLS rows
    cuts = {c: -(-k // tile) for c, k in counts.items()}
    first = dict(zip(cuts, np.cumsum([0, *cuts.values()]).tolist()))
    table = [(c, first[c], cuts[c]) for c in cuts] or [(0, 0, 1)]
    lookup = lambda i: F.element_at(F.create_map(*[F.lit(x) for r in table for x in (r[0], r[i])]), F.col("cell"))
    rows = rows.withColumn("tile", (lookup(1) + F.pmod(F.xxhash64("vec_id", F.lit(1)), lookup(2))).cast("int"))
    return rows.select("tile", "dim", "vec_id", "v", "q"), max(1, sum(cuts.values())), max(1, -(-m // batch))


def tile_bounds(data: DataFrame) -> DataFrame:
    """(tile, dim, most array<long>, least array<long>): the largest and smallest value of every term among a tile's rows of a length."""

    def partial(frames):
        for frame in frames:
            out = []
            for (tile, dim), part in frame.groupby(["tile", "dim"]):
                v = np.stack(part["v"].to_numpy()).astype(np.int64)
                out.append(pd.DataFrame({"tile": tile, "dim": dim, "term": np.arange(dim), "most": v.max(axis=0), "least": v.min(axis=0)}))
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("tile", "dim", "term", "most", "least")})

    terms = data.select("tile", "dim", "v").mapInPandas(partial, "tile int, dim int, term int, most long, least long")
    terms = terms.groupBy("tile", "dim", "term").agg(F.max("most").alias("most"), F.min("least").alias("least"))
    ordered = F.array_sort(F.collect_list(F.struct("term", "most", "least")))
    found = terms.groupBy("tile", "dim").agg(ordered.alias("t")).select("tile", "dim", F.col("t.most").alias("most"), F.col("t.least").alias("least"))
    none = F.array().cast("array<long>")
    # rows without terms have bounds without terms
    return data.select("tile", "dim").distinct().join(found, ["tile", "dim"], "left").select(*[F.expr(c).alias(c) for c in ("tile", "dim")], F.coalesce("most", none).alias("most"), F.coalesce("least", none).alias("least"))


def visits(asked: DataFrame, bounds: DataFrame, tiles: int, group: int = BOUNDS) -> DataFrame:
    """asked (dim, query_id, query, v, home, floor) once for each other tile whose bound isn't below the query's floor.

    Bounds meet queries in groups of `group` tiles, so a task holds so many of them.
    """
    groups = -(-tiles // group)
    sides = (asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("group", "dim", "query_id", "query", "v", "home", "floor"), bounds.withColumn("group", F.floor(F.col("tile") / group).cast("int")))

    def reached(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "query": [], "tile": []})
        most, least = (np.stack(right[c].to_numpy()).astype(np.float64) for c in ("most", "least"))
        names, parts = right["tile"].to_numpy(), []
        for start in range(0, len(left), TOGETHER):
            part = left.iloc[start : start + TOGETHER]
            q = np.stack(part["v"].to_numpy()).astype(np.float64)
            bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
            slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(most), np.abs(least)).T)  # sums of large values are rounded
            row, col = np.nonzero((bound + slack >= part["floor"].to_numpy(np.float64)[:, None]) & (part["home"].to_numpy()[:, None] != names[None, :]))
            parts.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "query": part["query"].to_numpy()[row], "tile": names[col]}))
        return pd.concat(parts)

    pairs = sides[0].groupBy("group", "dim").cogroup(sides[1].groupBy("group", "dim")).applyInPandas(reached, "query_id long, query long, tile int")
    return pairs.join(asked.select("query_id", "query", "dim", "v", "floor"), ["query_id", "query"])


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, tile: int = TILE, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of vectors (vec_id, v array<long>) for every row that is_query marks."""
    rows, tiles, batches = dealt(vectors.filter("vec_id is not null and v is not null").withColumn("q", is_query), tile, batch)
    of = lambda name, parts, salt: F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(parts)).cast("int")
    asked = rows.filter("q").select("tile", "dim", F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query"), "v").distinct()
    data = rows.select("tile", "dim", "vec_id", "v")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []})
        left = left.sort_values("vec_id", kind="stable")
        made = Tile(left["vec_id"].to_numpy(np.int64), np.stack(left["v"].to_numpy()).astype(np.int64), block)
        parts = []
        for start in range(0, len(right), TOGETHER):
            part = right.iloc[start : start + TOGETHER]
            ids = part["query_id"].to_numpy(np.int64)
            floors = part["floor"].to_numpy(np.int64)
            row, found, score, _ = search(made, ids, np.stack(part["v"].to_numpy()).astype(np.int64), k, floors)
            parts.append(pd.DataFrame({"query_id": ids[row], "query": part["query"].to_numpy()[row], "vec_id": found, "score": score}))
        return pd.concat(parts)

    def searched(data: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
        asked = asked.select([F.expr(c).alias(c) for c in ("tile", "batch", "dim", "query_id", "query", "v", "floor")])  # columns apart from data's
        return data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(work, "query_id long, query long, vec_id long, score long")

    least = F.lit(-(2**63)).cast("long")
    at_home = searched(data, asked.withColumns({"batch": F.lit(0), "floor": least}), ["tile", "dim"])
    found = at_home
    if tiles > 1:
        # the query set meets the bounds of all other tiles, and those tiles that can hold something better, batch by batch
        at_home = stash(at_home, "home")
        kth = at_home.groupBy("query_id", "query").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        floored = asked.join(kth, ["query_id", "query"], "left").withColumn("floor", F.coalesce("kth", least)).withColumnRenamed("tile", "home")
        away = visits(floored, tile_bounds(data), tiles).withColumn("batch", of("query_id", batches, 2))
        if batches > 1:
            data = data.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        else:
            data = data.withColumn("batch", F.lit(0))
        found = at_home.unionByName(searched(data, away, ["tile", "batch", "dim"]))
    best = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
