"""Fuzzy entity resolution and topic-stratified selection."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .shared import checkpointed


@F.pandas_udf(T.StringType())
def ascii_title(texts: pd.Series) -> pd.Series:
    """Accents stripped, lower case, runs of anything but letters and digits as one blank."""
    plain = texts.fillna("").map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower())
    return plain.str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def surnames(authors: Column) -> Column:
    """Distinct last words of normalised names."""
    last = F.transform(authors, lambda a: F.element_at(F.split(F.trim(F.regexp_replace(F.lower(a), "[^a-z0-9]+", " ")), " "), -1))
    return F.array_distinct(F.filter(last, lambda x: x != ""))


#: Characters of a gram of titles.
GRAM = 3


def _grams(text: Column) -> Column:
    """array<struct<g, n>> of a title's runs of GRAM characters, repeats numbered; the title itself where it is shorter."""
    runs = F.when(F.length(text) < GRAM, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM))))
    sorted_ = F.array_sort(runs)
    return F.transform(sorted_, lambda g, i: F.struct(g.alias("g"), (i - F.array_position(sorted_, g) + 1).cast("int").alias("n")))


def _rare_prefix(rows: DataFrame, key: str, counts: DataFrame, sure: float) -> DataFrame:
    """(key, g, n) of the rarest grams of each title: so many that two titles of ratio `sure` or more share one of them.

    Of two titles of lengths a and b with the ratio, at most (1 - sure)(a + b)
    <= (1 - sure) 2a / sure characters aren't matched, and each spoils at most
    GRAM grams; the others are shared, and the rarest shared one is among the
    first GRAM * that + 1 of both.
    """
    flat = rows.select(key, F.length("t").alias("size"), F.explode(_grams(F.col("t"))).alias("x")).select(key, "size", "x.g", "x.n").join(counts, ["g", "n"])
    spoilt = F.floor(F.col("size") * (2 * (1 - sure) / sure) + 1e-9)
    order = W.partitionBy(key).orderBy("c", "g", "n")
    return flat.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= GRAM * spoilt + 1).select(key, "g", "n")


def fuzzy_join(targets: DataFrame, works: DataFrame, sure: float = 0.94, likely: float = 0.82) -> DataFrame:
    """The best work (work_id, title, authors, cited) of each target (target_id, title, authors): (target_id, work_id, similarity, overlap).

    score = similarity + 0.12 * min(common surnames, 2); accepted at `sure`, or
    at `likely` with a common surname; best by score, then citations.  No
    acceptable pair is missed: those at `likely` share a surname, those at
    `sure` one of their rarest grams, and these two are the join keys; lengths
    that rule the ratio out are dropped before it is computed.
    """
    of = lambda df, key: df.select(key, ascii_title("title").alias("t"), surnames(F.col("authors")).alias("s"), *(["cited"] if "cited" in df.columns else []))
    left, right = checkpointed(of(targets, "target_id")), checkpointed(of(works, "work_id"))
    by_name = left.select("target_id", F.explode("s").alias("name")).join(right.select("work_id", F.explode("s").alias("name")), "name").select("target_id", "work_id")
    grams = lambda df: df.select(F.explode(_grams(F.col("t"))).alias("x")).select("x.*")
    # only grams that targets have matter; a gram's order is its count among works
    asked = grams(left).distinct()
    counts = asked.join(grams(right).groupBy("g", "n").agg(F.count(F.lit(1)).alias("c")), ["g", "n"], "left").select("g", "n", F.coalesce("c", F.lit(0)).alias("c"))
    # grams of works that no target has can't be shared: they come first in the order and take up the prefix, so they count, too
    every = grams(right).groupBy("g", "n").agg(F.count(F.lit(1)).alias("c")).unionByName(counts.filter("c = 0"))
    by_gram = _rare_prefix(left, "target_id", counts, sure).join(_rare_prefix(right, "work_id", every, sure), ["g", "n"]).select("target_id", "work_id")
    pairs = by_name.unionAll(by_gram).distinct().join(left, "target_id").join(right.withColumnsRenamed({"t": "u", "s": "z"}), "work_id")
    pairs = pairs.filter(2 * F.least(F.length("t"), F.length("u")) >= (likely - 1e-9) * (F.length("t") + F.length("u")))
    scored = pairs.withColumn("similarity", title_ratio("t", "u")).withColumn("overlap", F.size(F.array_intersect("s", "z")))
    good = scored.filter((F.col("similarity") >= sure) | ((F.col("similarity") >= likely) & (F.col("overlap") >= 1)))
    order = W.partitionBy("target_id").orderBy(F.desc(F.col("similarity") + 0.12 * F.least("overlap", F.lit(2))), F.desc("cited"), "work_id")
    return good.withColumn("i", F.row_number().over(order)).filter("i = 1").select("target_id", "work_id", "similarity", "overlap")


def first_local(targets: DataFrame, books: DataFrame) -> DataFrame:
    """(target_id, ordinal) of the first book (ordinal, title, authors) whose normalised title is the target's, and that shares a surname or has none, or whose target has none.

    Books are summed up by title, by title and surname, and by title without
    surnames before they meet targets, so a title that many books share costs
    a row a surname.
    """
    left = checkpointed(targets.select("target_id", ascii_title("title").alias("t"), surnames(F.coalesce("authors", F.array().cast("array<string>"))).alias("s")))
    right = books.select("ordinal", ascii_title("title").alias("t"), F.explode_outer(surnames(F.coalesce("authors", F.array().cast("array<string>")))).alias("name"))
    firsts = checkpointed(right.groupBy("t", "name").agg(F.min("ordinal").alias("ordinal")))
    whole = firsts.groupBy("t").agg(F.min("ordinal").alias("any"), F.min(F.when(F.col("name").isNull(), F.col("ordinal"))).alias("nameless"))
    named = left.select("target_id", "t", F.explode("s").alias("name")).join(firsts, ["t", "name"]).groupBy("target_id").agg(F.min("ordinal").alias("shared"))
    met = left.join(whole, "t").join(named, "target_id", "left")
    found = F.when(F.size("s") == 0, F.col("any")).otherwise(F.least("shared", "nameless"))
    return met.select("target_id", found.alias("ordinal")).filter("ordinal is not null")


def pilot(chunks: DataFrame, topics: dict[str, tuple[str, ...]], each: int, distractors: int) -> DataFrame:
    """(chunk_id, topic): for each topic in turn the `each` best chunks not taken yet by (keyword score, tokens, id), scores above 0 only; then `distractors` of the rest by id.

    chunks: chunk_id, text, tokens.  Texts are read once, for their scores; all choices are made on these.
    """
    ready = X.for_matching(F.col("text"))
    scored = chunks.select("chunk_id", "tokens", *[sum((X.occurrences(ready, p) for p in phrases), F.lit(0)).alias(name) for name, phrases in topics.items()])
    scored, taken = checkpointed(scored), None
    for name in topics:
        left = scored if taken is None else scored.join(taken.select("chunk_id"), "chunk_id", "left_anti")
        best = left.filter(F.col(name) > 0).orderBy(F.desc(name), F.desc("tokens"), F.desc("chunk_id")).limit(each).select("chunk_id", F.lit(name).alias("topic"))
        taken = best if taken is None else taken.unionAll(best)
    rest = scored.join(taken.select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id").limit(distractors)
    return taken.unionAll(rest.select("chunk_id", F.lit("distractor").alias("topic")))
