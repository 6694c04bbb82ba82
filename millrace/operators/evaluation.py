"""Scores of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def concept_score(answer: Column, concepts: Column) -> Column:
    """struct(score, found, total): a concept counts if at least half, and one, of its words over three letters are in the answer."""

    def found_in(low: Column) -> Column:
        def has(concept: Column) -> Column:
            words = F.filter(F.regexp_extract_all(F.lower(concept), F.lit(r"([\p{L}\p{N}_]+)")), lambda w: F.length(w) > 3)
            hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
            return (F.size(words) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(words) / 2)))

        return F.size(F.filter(concepts, has))

    found, total = X.bind(F.lower(F.coalesce(answer, F.lit(""))), found_in), F.size(concepts)
    return F.struct(F.when(total > 0, F.bround(found / total * 100.0, 1)).otherwise(100.0).alias("score"), found.alias("found"), total.alias("total"))


def refusal_score(answer: Column) -> Column:
    cues = F.array(*map(F.lit, V.REFUSAL_CUES))
    refuses = X.bind(F.lower(F.coalesce(answer, F.lit(""))), lambda low: F.exists(cues, lambda c: F.contains(low, c)))
    return F.when(refuses, 100.0).otherwise(0.0)


def length_score(answer: Column) -> Column:
    return F.when(X.word_count(answer) < 50, 30.0).otherwise(80.0)


def numeric_score(answer: Column, target: Column, succeeded: Column, expected: Column) -> Column:
    """100 if the target tool succeeded, or the expected value shows with two decimals; else 50 if the tool was called, else 0.

    succeeded: map of tool name to whether a call succeeded.
    """
    called, good = F.map_contains_key(succeeded, target), F.coalesce(F.try_element_at(succeeded, target), F.lit(False))
    shown = F.coalesce(F.contains(answer, F.format_string("%.2f", expected)), F.lit(False))
    return F.when(good | shown, 100.0).when(F.coalesce(called, F.lit(False)), 50.0).otherwise(0.0)


def keyword_ratio_score(answer: Column, keywords: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(F.size(keywords) > 0, F.bround(F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k)))) / F.size(keywords) * 100.0, 1)).otherwise(100.0)


def with_responses(items: DataFrame, responses: DataFrame) -> DataFrame:
    """items left-joined with the last response of their id; an id stands under id or benchmark_id; none is an empty response."""
    keyed = responses.select(F.coalesce("id", "benchmark_id").alias("id"), "ord", "response")
    last = keyed.groupBy("id").agg(F.max_by("response", "ord").alias("response"))
    return items.join(last, "id", "left").withColumn("response", F.coalesce("response", F.lit("")))


def pillar_report(scored: DataFrame) -> DataFrame:
    """(pillar, items, score) by pillar, and OVERALL weighted by items."""
    rows = scored.groupBy("pillar").agg(F.count(F.lit(1)).alias("items"), F.bround(F.avg("score"), 1).alias("score"))
    return rows.unionByName(scored.groupBy(F.lit("OVERALL").alias("pillar")).agg(F.count(F.lit(1)).alias("items"), F.bround(F.avg("score"), 1).alias("score")))
