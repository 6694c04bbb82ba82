"""Phrases in the joined text of many units, without joining it.

What matters of a stretch of text is which phrases it holds, how it begins and
how it ends: two stretches make one, and the order of making doesn't matter.
Units are sorted into ranges of (document, ordinal); a task folds each
document's units of its range to one row, and only a document that spans
ranges has more than one row left to fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: (phrases found as bits, first characters, last characters, length).
Stretch = tuple[int, str, str, int]


def _found(text: str, phrases: tuple[str, ...]) -> int:
    return sum(1 << i for i, p in enumerate(phrases) if p in text)


def stretch(text: str, phrases: tuple[str, ...], reach: int) -> Stretch:
    return _found(text, phrases), text[:reach], text[-reach:] if reach else "", len(text)


def joined(a: Stretch, b: Stretch, phrases: tuple[str, ...], reach: int) -> Stretch:
    """Of a, a blank, and b; an empty stretch changes nothing."""
    if not a[3] or not b[3]:
        return a if a[3] else b
    border = _found(f"{a[2]} {b[1]}", phrases)
    head = a[1] if a[3] >= reach else f"{a[1]} {b[1]}"[:reach]
    tail = b[2] if b[3] >= reach else f"{a[2]} {b[2]}"[-reach:]
    return a[0] | b[0] | border, head, tail, a[3] + 1 + b[3]


def phrases_of(units: DataFrame, document: str, ordinal: str, text: str, phrases: tuple[str, ...]) -> DataFrame:
    """(document, found array<string>) of every document: the phrases, in their order, that its units hold when joined in order, after normalisation for matching.

    Null texts count as empty; a null document is one of its own; units of one
    ordinal follow each other by a hash of their text.
    """
    if len(phrases) > 62 or any(not p or p != " ".join(p.split()) for p in phrases):
        raise ValueError("at most 62 phrases, of words with single blanks")
    reach = max(map(len, phrases)) - 1
    schema = T.StructType([units.schema[document], *T.StructType.fromDDL("part int, found long, head string, tail string, length long")])
    ready = F.trim(X.for_matching(F.coalesce(F.col(text), F.lit(""))))
    rows = units.select(F.col(document).alias("d"), F.col(ordinal).alias("o"), ready.alias("t"), F.xxhash64(ready).alias("h"), F.xxhash64(F.col(document)).alias("key"))
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "key", "d", "o", "h").sortWithinPartitions("key", "d", "o", "h").withColumn("part", F.spark_partition_id())
    # documents travel as a number of their own in a task, so that ids of any type come back unchanged
    marked = ranged.select("part", F.col("d").cast("string").alias("d"), "t")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: tuple | None = None  # (part, document, stretch) that may go on in the next batch
        for frame in frames:
            done = []
            for part, doc, t in zip(frame["part"], frame["d"], frame["t"]):
                made = stretch(t, phrases, reach)
                if open_ is not None and open_[1] == doc:
                    open_ = (part, doc, joined(open_[2], made, phrases, reach))
                else:
                    if open_ is not None:
                        done.append(open_)
                    open_ = (part, doc, made)
            yield _frame(done)
        if open_ is not None:
            yield _frame([open_])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(d, p, *s) for p, d, s in rows], columns=["d", "part", "found", "head", "tail", "length"])

    @F.pandas_udf(T.LongType())
    def together(parts: pd.Series) -> pd.Series:
        out = []
        for row in parts:
            whole: Stretch = (0, "", "", 0)
            for s in sorted(row, key=lambda s: s["part"]):
                whole = joined(whole, (s["found"], s["head"], s["tail"], s["length"]), phrases, reach)
            out.append(whole[0])
        return pd.Series(out)

    folded = marked.mapInPandas(fold, "d string, part int, found long, head string, tail string, length long")
    # at most one row a range
    met = folded.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("found").alias("found"), F.collect_list(F.struct("part", "found", "head", "tail", "length")).alias("parts"))
    one = met.filter("n = 1").select("d", "found")
    more = met.filter("n > 1").select("d", together("parts").alias("found"))
    return one.unionAll(more).select(F.col("d").cast(schema[0].dataType).alias(document), named(F.col("found"), phrases).alias("found"))


def named(bits: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases whose bits are set."""
    return F.filter(F.transform(F.array(*map(F.lit, phrases)), lambda p, i: F.when(F.getbit(bits, i) == 1, p)), lambda p: p.isNotNull())
