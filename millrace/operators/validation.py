"""Checks of records: shape, required fields, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def missing_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of every required field that is null or an empty string."""
    tests = [F.struct(F.lit(f).alias("field"), (F.col(f).isNull() | (F.col(f).cast("string") == "")).alias("gone")) for f in fields]
    return rows.select(key, F.explode(F.array(*tests)).alias("t")).filter("t.gone").select(key, F.col("t.field").alias("field"))


def conversation_errors(turns: DataFrame) -> DataFrame:
    """(conv_id, error) of conversations (conv_id, turn, role, text) that aren't system, user, assistant with non-blank text.

    One aggregation by conversation; a conversation's turns are bounded by the record.
    """
    folded = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", (F.coalesce(X.trimmed(F.col("text")), F.lit("")) == "").alias("blank")))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    tests = F.array_compact(
        F.array(
            F.when(roles != F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "roles"),
            F.when(F.exists("t", lambda x: x["blank"]), "blank_content"),
            F.when(F.get(roles, F.lit(0)) == "assistant", "starts_with_assistant"),
        )
    )
    return folded.select("conv_id", F.explode(tests).alias("error"))


def ngrams(text: Column, n: int) -> Column:
    """Distinct runs of n folded terms, joined by blanks."""

    def grams(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return X.bind(X.terms(X.folded(text)), grams)


def ngram_leaks(docs: DataFrame, items: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, item_id, shared) of documents that share n-grams with benchmark items.

    Only hashes of the grams travel, 128 bits of each; the items' grams are the
    small side of the join, and AQE decides whether to broadcast them.
    """

    def marks(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(key, F.explode(ngrams(F.col("text"), n)).alias("g")).select(key, F.xxhash64("g").alias("h"), F.xxhash64("g", F.lit(n)).alias("i"))

    return marks(docs, "doc_id").join(marks(items, "item_id").distinct(), ["h", "i"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


def exact_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents whose folded text is an item's."""
    keyed = items.select("item_id", X.text_hash(F.col("text")).alias("k"))
    return docs.select("doc_id", X.text_hash(F.col("text")).alias("k")).join(keyed, "k").select("doc_id", "item_id")


def group_leaks(train: DataFrame, held: DataFrame, group: str) -> DataFrame:
    """Groups that stand on both sides of a split."""
    return train.select(group).distinct().join(held.select(group).distinct(), group, "left_semi")
