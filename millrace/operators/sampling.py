"""Hash-ordered sampling, splits and budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .shared import checkpointed


def stratified_split(docs: DataFrame, percent: float = 1.0) -> DataFrame:
    """docs (doc_key, pool) with split: of each pool the first max(1, round half even of percent) documents by hash are valid."""
    distinct = docs.select("pool", "doc_key").distinct()
    keyed = distinct.withColumn("k", X.stable_key(F.concat_ws(":", F.lit("validation"), "pool", "doc_key")))
    valid = places(keyed, "pool", ["k", "doc_key"]).filter(F.col("place") <= F.greatest(F.lit(1), F.bround(F.col("size") * percent / 100.0, 0)))
    return docs.join(valid.select("pool", "doc_key", F.lit("valid").alias("split")), ["pool", "doc_key"], "left").withColumn("split", F.coalesce("split", F.lit("train")))


def places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place, from 1, in their group by order, and the group's size; columns of these two names give way.

    Rows are dealt to ranges of (group, order); a place is a prefix count of
    the ranges before and the rank within the range, so a group of any size
    spreads over tasks.  The ranges are checkpointed: both sides of the join
    must see the same ones.
    """
    return _totalled(rows, group, order, {"place": (F.lit(1), True), "size": (F.lit(1), False)})


def _totalled(rows: DataFrame, group: str, order: list[str], sums: dict[str, tuple[Column, bool]]) -> DataFrame:
    """rows with sums over their group, each of (value, running): up to the row by order, or whole; rows travel nested, so their names can't clash."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.col(f"`{c}`") for c in rows.columns if c not in sums]
    by = [f"o{i}" for i in range(len(order))]
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{group}`").alias("g"), *[F.col(f"`{o}`").alias(b) for o, b in zip(order, by)], *[v.alias(f"s{i}") for i, (v, _) in enumerate(sums.values())])
    ranged = checkpointed(keyed.repartitionByRange(parts, "g", *by).withColumn("part", F.spark_partition_id()))
    n = range(len(sums))
    counts = ranged.groupBy("part", "g").agg(*[F.sum(f"s{i}").alias(f"n{i}") for i in n])
    whole = W.partitionBy("group")
    earlier = whole.orderBy("of").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("part").alias("of"), F.col("g").alias("group"), *[f"n{i}" for i in n])
    counts = counts.select("of", "group", *[(F.coalesce(F.sum(f"n{i}").over(earlier), F.lit(0)) if running else F.sum(f"n{i}").over(whole)).alias(f"b{i}") for i, (_, running) in enumerate(sums.values())])
    upto = W.partitionBy("part", "g").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    met = ranged.select("row", "part", "g", *[F.sum(f"s{i}").over(upto).alias(f"r{i}") for i in n]).join(counts, (F.col("part") == F.col("of")) & F.col("g").eqNullSafe(F.col("group")))
    found = [(F.col(f"b{i}") + F.col(f"r{i}") if running else F.col(f"b{i}")).alias(name) for i, (name, (_, running)) in enumerate(sums.items())]
    return met.select(*[F.col(f"row.`{c}`") for c in rows.columns if c not in sums], *found) if own else met.select(*found)


def balanced(rows: DataFrame, value: list[str], label: str, attempt: str, quotas: dict[str, int], most: int | None = None) -> DataFrame:
    """The rows that a sampler with quotas takes when attempts come in order, with place in their label.

    Of equal values the first attempt counts; a label takes rows in order of
    attempt until its quota is full; attempts after `most` are never made.
    Labels without a quota, and null labels (rejected draws), take none.
    """
    made = rows if most is None else rows.filter(F.col(attempt) <= most)
    # partial minima and a join: a frequent value never meets in one task
    firsts = made.groupBy(*[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(value)]).agg(F.min(attempt).alias("first"))
    cells = [F.col(f"row.`{v}`").eqNullSafe(F.col(f"v{i}")) for i, v in enumerate(value)]
    nested = made.select(F.struct(*[F.col(f"`{c}`") for c in made.columns]).alias("row"))
    kept = nested.join(firsts, [F.col(f"row.`{attempt}`") == F.col("first"), *cells]).select("row.*").filter(F.col(label).cast("string").isin(*map(str, quotas)))
    quota = F.coalesce(*[F.when(F.col(label).cast("string") == str(k), F.lit(n)) for k, n in quotas.items()])
    return places(kept, label, [attempt, *value]).filter(F.col("place") <= quota).drop("size")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: the first 52 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / 2.0**52


def weighted_without(rows: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn without replacement, each draw by weight among those left: the n smallest exponential keys -ln(u) / weight.

    u is a hash of seed and key, so reruns agree; rows without positive weight
    are never drawn; fewer than n give all.
    """
    drawn = rows.filter(F.col(weight) > 0).withColumn("exponential", -F.ln(1 - uniform(F.lit(str(seed)), F.col(key).cast("string"))) / F.col(weight)).withColumn("all", F.lit(1))
    return places(drawn, "all", ["exponential", key]).filter(F.col("place") <= n).drop("all", "size", "exponential")


def weighted_with(rows: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn with replacement by weight, with draw from 0: the row whose stretch of the summed weights holds draw's point.

    Sums go over ranges of keys; stretches and points meet in equal slices of
    the whole, so no task holds more than its slices.  Weights are taken in
    millionths, in integers, so that slices meet exactly.
    """
    spark = rows.sparkSession
    scaled = rows.filter(F.col(weight) > 0).withColumn("millionths", F.ceil(F.col(weight) * 1_000_000).cast("decimal(38,0)")).withColumn("all", F.lit(1))
    summed = _totalled(scaled, "all", [key], {"upto": (F.col("millionths"), True), "total": (F.col("millionths"), False)})
    whole = summed.agg(F.max("total")).first()[0]
    slices = max(1, n // 1_000)
    at = lambda x: F.least(F.floor(x.cast("double") / float(whole or 1) * slices), F.lit(slices - 1)).cast("long")
    held = summed.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), (F.col("upto") - F.col("millionths")).alias("low"), F.col("upto").alias("high"), F.explode(F.sequence(at(F.col("upto") - F.col("millionths")), at(F.col("upto")))).alias("slice"))
    points = spark.range(n if whole else 0).select(F.col("id").alias("draw"), F.floor(uniform(F.lit(f"{seed}:draw"), F.col("id").cast("string")) * float(whole or 0)).cast("decimal(38,0)").alias("point"))
    points = points.withColumn("slice", at(F.col("point")))
    met = held.join(points, "slice").filter((F.col("low") <= F.col("point")) & (F.col("point") < F.col("high")))
    return met.select("draw", "row.*")


def top_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def cap_fill(rows: DataFrame, pool: str, key: str, tokens: str, cap: int) -> DataFrame:
    """(pool, key, tokens) that a greedy pass in key order takes: rows that would overflow the cap are skipped
    (never the first), and the pass ends once the cap is reached.

    The pass reads tokens only.  While the running sum fits, a prefix sum over
    ranges of keys decides; what comes after the first overflow can be taken
    only while it is smaller than the room left, so a pool's remaining
    candidates are few rows of distinct sizes, walked in order by one task.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k", kind="stable").reset_index(drop=True)
        sizes, used, taken, at = frame["n"].to_numpy(), 0, [], 0
        while at < len(sizes) and used < cap:
            total = used + np.cumsum(sizes[at:])
            fit = int(np.searchsorted(total, cap, side="right"))
            if not taken and not fit:
                fit = 1
            if fit:
                taken += range(at, at + fit)
                used = int(total[fit - 1])
                at += fit
            else:  # on to the next row that fits
                smaller = np.flatnonzero(sizes[at:] <= cap - used)
                if not len(smaller):
                    break
                at += int(smaller[0])
        return frame.iloc[taken][["p", "k", "n"]]

    flat = rows.select(F.col(pool).cast("string").alias("p"), F.col(key).alias("k"), F.col(tokens).cast("long").alias("n"))
    sizes = flat.groupBy("p", F.substring("k", 1, 3).alias("r")).agg(F.sum("n").alias("m"))
    sums = sizes.withColumn("before", F.sum("m").over(W.partitionBy("p").orderBy("r")) - F.col("m"))
    # ranges of keys that start beyond the cap matter only for rows smaller than what can be left over
    near = flat.withColumn("r", F.substring("k", 1, 3)).join(sums.select("p", "r", "before"), ["p", "r"])
    smallest = W.partitionBy("p", "n").orderBy("k")
    late = near.filter(F.col("before") > cap).withColumn("i", F.row_number().over(smallest)).filter(F.col("i") <= F.greatest(F.lit(1), F.floor(cap / F.greatest("n", F.lit(1))))).drop("i")
    early = near.filter(F.col("before") <= cap)
    out = early.unionByName(late).select("p", "k", "n").groupBy("p").applyInPandas(walk, "p string, k string, n long")
    return out.select(F.col("p").alias(pool), F.col("k").alias(key), F.col("n").alias(tokens))


def newest_within(turns: DataFrame, conversation: str, order: str, tokens: str, role: str, budget: int) -> DataFrame:
    """The newest turns of each conversation that fit the budget (the newest always does), from the first user turn on."""
    nested = turns.select(F.struct(*[F.col(f"`{c}`") for c in turns.columns]).alias("row"))
    of = lambda name: F.col(f"row.`{name}`")
    newest = W.partitionBy(of(conversation)).orderBy(of(order).desc())
    rows = nested.select("row", F.sum(of(tokens)).over(newest).alias("used"), F.row_number().over(newest).alias("i")).filter((F.col("i") == 1) | (F.col("used") <= budget))
    oldest = W.partitionBy(of(conversation)).orderBy(of(order))
    rows = rows.select("row", F.max(F.when(of(role) == "user", 1).otherwise(0)).over(oldest).alias("user"))
    return rows.filter("user = 1").select("row.*")
