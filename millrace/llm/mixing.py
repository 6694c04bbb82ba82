"""Mixing sources to target weights.

Documents get hash-random keys; within each source they are ordered by key,
running word counts are prefix sums over ranges of keys, and each source is
cut at its exact budget after as many whole epochs as the budget holds.

Everything is built-in expressions.  Keys are uniform, so a source is split
into ranges of near-equal row counts however large it is; a window never
spans more than one range, or the list of ranges of one source.

Edge cases: a null text has size 0 and takes 0; a null source is a source of
its own and comes last; an empty table gives an empty result; repeated rows
each count; extra columns are carried along, whatever their names, but that
mix() gives its own four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import nested, word_count

#: Documents in a range of keys, about.
RANGE_ROWS = 5_000
#: Hex digits of the key that a range may use.
RANGE_DIGITS = 7


def mix_key(id_col: Column, text: Column, seed: int) -> Column:
    """32 hex digits, uniform and the same in every run; equal for rows of equal id and text only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, share: float = 1.0) -> DataFrame:
    """Targets by source: (source, source_size, n_docs, target).

    Sources in code point order, null last, weigh `weights`, repeating.  The
    targets sum up to `share` of all words as long as the caps (`epochs` times
    the size) allow; what a capped source leaves is shared by weight among the
    others.  With r = cap/weight, the uncapped level L solves
    sum(min(weight * L, cap)) = total: in order of r it is the first r at
    which the remainder by remaining weight is not above r.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # one row a source from here on
    order = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % F.lit(len(weights))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")))
    by = by.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = rising.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    by = by.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    by = by.withColumn("level", F.max(F.when(F.col("left") <= F.col("ratio") * F.col("open"), F.col("left") / F.col("open"))).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def _mixed(docs: DataFrame, weights: tuple[float, ...], epochs: int, share: float, seed: int, whole_documents: bool) -> DataFrame:
    """(row, size, source_size, target, taken): every row of docs as a struct, and what the mix takes of it."""
    rows = nested(docs).select("row", F.col("row.source").alias("of"), word_count(F.col("row.text")).alias("size"), mix_key(F.col("row.doc_id"), F.col("row.text"), seed).alias("key"))
    targets = source_targets(rows.select(F.col("of").alias("source"), "size"), weights, epochs, share)
    # few rows against all documents: AQE broadcasts it while it is small and splits skewed sources otherwise
    rows = rows.join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / RANGE_ROWS))
    drawn = F.conv(F.substring("key", 1, RANGE_DIGITS), 16, 10).cast("long")
    rows = rows.withColumn("range", F.floor(drawn * ranges / F.lit(16**RANGE_DIGITS)).cast("int"))
    totals = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    starts = totals.select(
        F.col("source").alias("s"),
        F.col("range").alias("r"),
        (F.sum("words").over(W.partitionBy("source").orderBy("range")) - F.col("words")).alias("start"),
    )
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    within = W.partitionBy("source", "range").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.col("start") + F.sum("size").over(within) - F.col("size"))
    budget = F.floor(F.col("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - passes * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("first")))
    if whole_documents:
        part = F.when(2 * part > F.col("size"), F.col("size")).otherwise(F.lit(0))
    taken = (passes * F.col("size") + part).cast("long")
    return rows.select("row", "size", "source_size", F.col("target").cast("double"), taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, share: float = 1.0, seed: int = 17, whole_documents: bool = False) -> DataFrame:
    """docs with size, source_size, target and taken; columns of docs with these four names give way.

    taken is the words that the mix takes of the row, repeats counted: each
    source's sum is its target, rounded down.  The row that crosses the cut
    gives the words before it; with whole_documents it counts whole if more
    than half of it lies before the cut, so that taken is a multiple of size.
    """
    made = ("size", "source_size", "target", "taken")
    return _mixed(docs, weights, epochs, share, seed, whole_documents).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in made], *made)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The rows of the mix, with all columns of docs as they are: every document as often as the mix takes it whole.

    A document without words takes no room and stays once.
    """
    rows = _mixed(docs, weights, epochs, share, seed, True)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")
