"""Checks and choices over whole record sets: requests by id, required classes, stored totals, code and answer rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Misspelt calls, and the pattern of a made-up design value.
BANNED_CALLS = ("newSystem(", "addblock(", "addline(", "setmdl(", "dimpoles(", "systems(")
MADE_UP_VALUE = r"(?i)\b(?:k_?p|k_?i|k_?d|controller coefficients?|kalman gain)\s*(?:=|:)\s*[-+]?\d"
# Marks of the front matter of a book in an address.
FRONT_MATTER = ("frontmatter", "/bfm", "bfm%3a")


def has_class_left(classes: Column, excluded: list[str]) -> Column:
    """Whether an array holds a class that isn't excluded; null arrays hold none."""
    gone = F.array(*map(F.lit, excluded)).cast("array<string>")
    return F.coalesce(F.size(F.array_except(classes, gone)) > 0, F.lit(False))


def requested(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """rows of the wanted keys with their place in the request, which may repeat keys; an unknown key is an error.

    The request is the caller's own list, so it is the small side.
    """
    spark = rows.sparkSession
    asked = spark.createDataFrame([(k, i) for i, k in enumerate(wanted)], f"{key} {rows.schema[key].dataType.simpleString()}, place int")
    unknown = [r[0] for r in asked.join(rows.select(key).distinct(), key, "left_anti").select(key).distinct().sort(key).collect()]
    if unknown:
        raise ValueError(f"unknown {key}: {unknown}")
    return rows.join(asked, key)


def is_front_matter(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    tests = [F.contains(low, F.lit(mark)) for mark in FRONT_MATTER]
    return tests[0] | tests[1] | tests[2]


def without_rejected(rows: DataFrame, candidates: str = "candidates", status: str = "status") -> DataFrame:
    """rows whose candidate addresses are all front matter lose them, and are metadata only if they were candidates."""
    rejected = F.coalesce((F.size(candidates) > 0) & F.forall(candidates, is_front_matter), F.lit(False))
    none = F.array().cast(rows.schema[candidates].dataType.simpleString())
    return rows.withColumns(
        {
            candidates: F.when(rejected, none).otherwise(F.col(candidates)),
            status: F.when(rejected & (F.col(status) == "oa_candidate"), F.lit("metadata_only")).otherwise(F.col(status)),
        }
    )


def mentions(needle: str, *columns: str) -> Column:
    """Whether the columns, joined by blanks, hold the needle, whatever its case."""
    return F.contains(X.folded(F.concat_ws(" ", *columns)), F.lit(needle.casefold()))


def class_report(rows: DataFrame, column: str, required: list[str], forbidden: list[str] = (), least: dict[str, float] | None = None) -> DataFrame:
    """(class, n, share, rule, passed) for every required, forbidden or least-share class, absent ones included."""
    rules = [(c, "required", 0.0) for c in required] + [(c, "forbidden", 0.0) for c in forbidden] + [(c, "least", float(s)) for c, s in (least or {}).items()]
    asked = rows.sparkSession.createDataFrame(rules, "class string, rule string, least double")
    counts = rows.groupBy(F.col(column).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = asked.join(counts, "class", "left").join(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0)
    passed = F.when(F.col("rule") == "required", F.col("n") > 0).when(F.col("rule") == "forbidden", F.col("n") == 0).otherwise(F.col("share") >= F.col("least"))
    return out.withColumn("share", share).withColumn("passed", passed).select("class", "n", "share", "rule", "passed")


def totals_agree(rows: DataFrame, group: str, stored: Column, found: Column) -> DataFrame:
    """(group, stored, found, agrees): a stored measure and its recomputation, summed by group."""
    sums = rows.groupBy(group).agg(F.coalesce(F.sum(stored), F.lit(0)).alias("stored"), F.coalesce(F.sum(found), F.lit(0)).alias("found"))
    return sums.withColumn("agrees", F.col("stored") == F.col("found"))


def rubric_errors(points: Column, max_words: Column) -> Column:
    """Array of what is wrong with a rubric: points must be positive and sum to 10, answers be allowed 50 words at least."""
    total = F.aggregate(points, F.lit(0).cast("long"), lambda a, p: a + p)
    tests = [
        F.when(F.coalesce(F.exists(points, lambda p: p <= 0), F.lit(True)), "points_not_positive"),
        F.when(F.coalesce(total != 10, F.lit(True)), "points_not_10"),
        F.when(F.coalesce(max_words < 50, F.lit(False)), "max_words_below_50"),
    ]
    return F.array_compact(F.array(*tests))


def answer_errors(answer: Column, terms: list[str], no_values: bool = True) -> Column:
    """Array of required terms that an answer to an underspecified question omits, and of a made-up design value."""
    low = F.regexp_replace(X.folded(answer), r"\s+", " ")
    tests = [F.when(~F.contains(low, F.lit(t.casefold())), F.lit(f"omits {t}")) for t in terms]
    made_up = [F.when(answer.rlike(MADE_UP_VALUE), F.lit("made-up value"))] if no_values else []
    return F.array_compact(F.array(*tests, *made_up))


def code_errors(code: Column, required: list[str] = ()) -> Column:
    """Array of missing calls, misspelt calls and unbalanced brackets, without running anything."""
    low = F.lower(code)
    count = lambda mark: F.length(code) - F.length(F.replace(code, F.lit(mark), F.lit("")))
    tests = [F.when(~F.contains(low, F.lit(r.lower())), F.lit(f"missing {r}")) for r in required]
    tests += [F.when(F.contains(low, F.lit(b.lower())), F.lit(f"banned {b}")) for b in BANNED_CALLS]
    tests += [F.when(count("(") != count(")"), "unbalanced parentheses"), F.when(count("[") != count("]"), "unbalanced brackets")]
    return F.array_compact(F.array(*tests))


def ordered_units(rows: DataFrame, group: str, page: str, unit: str) -> DataFrame:
    """rows with their place in the group, by page and unit; units without page come last."""
    order = W.partitionBy(group).orderBy(F.col(page).asc_nulls_last(), F.col(unit))
    return rows.withColumn("place", F.row_number().over(order))


def every_nth(rows: DataFrame, group: str, order: list[str], step: int = 10) -> DataFrame:
    """The first row of each group in order, and each step-th after it."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).filter((F.col("place") - 1) % step == 0)
