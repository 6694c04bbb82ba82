"""A stored BM25 index in immutable segments, searched with upper bounds.

A segment is written once.  Its documents, in order of id, are cut into blocks
of BLOCK; a row of postings is a term in a block, with the documents that hold
it and, apart from them, the largest count and the shortest length.  These two
bound what the term adds to any document of the block, whatever later segments
do to the statistics.  A search reads the bounds first, scores the most
promising blocks of each query, and then only blocks whose bound reaches the
k-th score found: the result is that of scoring everything.

Layout: postings/segment=s (by term in each file), terms/segment=s (term, df), and
totals/segment=s, written last; a segment without totals isn't there yet.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType

from ..functions import text as X
from ..functions import vocabulary as V
from .shared import checkpointed

#: Documents of a block, and blocks of a query that are scored to find its floor.
BLOCK, FIRST = 128, 8
#: Ranges of ids a partition of a segment, and rows up to which terms and blocks of the queries are broadcast.
RANGES, FEW = 4, 500_000
#: Ranges of documents that a segment may have in a partition's numbering.
_RUN = 2**33


def _ranged(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) with the column `range`, dealt by it; ranges of ids lie between quantiles, ids that are no numbers go by hash."""
    n = parts * RANGES
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, NumericType) and not isinstance(kind, DecimalType):
        cuts = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
        place = F.aggregate(F.array(*map(F.lit, sorted(set(cuts)))), F.lit(0), lambda at, cut: at + (F.col("doc_id") >= cut).cast("int")) if cuts else F.lit(0)
        place = F.coalesce(place, F.lit(0))
    else:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(n))
    return docs.select("doc_id", "text", place.cast("int").alias("range")).repartition(parts, "range")


def append(docs: DataFrame, path: str, segment: int, block: int = BLOCK) -> None:
    """Write docs (doc_id, text) as a segment; written again, it replaces itself.

    Only texts are shuffled: all rows of a range lie in one partition, and with
    it all that its blocks are aggregated from.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = _ranged(docs, parts).sortWithinPartitions("range", "doc_id", F.xxhash64("text"))
    at = F.monotonically_increasing_id()
    # numbers are per partition and row of the sorted ranges, so a task done again gives the same
    rows = ranged.select("range", "doc_id", X.terms(F.col("text")).alias("terms"), (F.floor(at / _RUN) * (_RUN // block) + F.floor(at % _RUN / block)).cast("long").alias("block"))
    flat = rows.select("range", "doc_id", "block", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    counted = flat.groupBy("range", "term", "block", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))
    # at most `block` documents a row
    posts = counted.groupBy("range", "term", "block").agg(F.collect_list(F.struct("doc_id", "tf", "len")).alias("docs"), F.count(F.lit(1)).alias("n"), F.sum("tf").alias("sum_tf"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
    posts.drop("range").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings/segment={segment}")
    stored = spark.read.parquet(f"{path}/postings/segment={segment}")
    stored.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms/segment={segment}")
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    n.join(stored.agg(F.coalesce(F.sum("sum_tf"), F.lit(0)).alias("sum_len"))).write.mode("overwrite").parquet(f"{path}/totals/segment={segment}")


def _sent(few: DataFrame) -> DataFrame:
    """few, a checkpointed table, broadcast if it is small: postings then stay where they are."""
    return F.broadcast(few) if few.count() <= FEW else few


class Index:
    """The segments under a path that are complete when it is opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            totals = spark.read.parquet(f"{path}/totals").groupBy("segment").agg(F.sum("n_docs").alias("n"), F.sum("sum_len").alias("m")).collect()  # a row a segment
        except AnalysisException as e:
            warnings.warn(f"no index at {path}: {e.getCondition()}", stacklevel=2)
            totals = []
        self.segments = [r.segment for r in totals]
        self.n_docs = sum(r.n for r in totals)
        self.mean_length = sum(r.m for r in totals) / self.n_docs if self.n_docs else 0.0

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}").filter(F.col("segment").isin(self.segments))

    def weights(self) -> DataFrame:
        """(term, idf) over all segments; negative values become epsilon times the mean idf."""
        df = self._read("terms").groupBy("term").agg(F.sum("df").alias("df"))
        raw = df.select("term", (F.ln(self.n_docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw")).first()[0]
        return raw.select("term", F.when(F.col("raw") < 0, V.EPSILON * F.lit(mean)).otherwise(F.col("raw")).alias("idf"))

    def _part(self, tf: Column, length: Column) -> Column:
        return tf * (V.K1 + 1) / (tf + V.K1 * (1 - V.B + V.B * length / self.mean_length))

    def bounds(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query terms with weight; (query_id, segment, block, bound)): no document of a block scores above the bound."""
        asked = queries.select("query_id", F.explode(X.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
        asked = checkpointed(asked.join(self.weights(), "term").select("query_id", "term", (F.col("idf") * F.col("qf")).alias("w")))
        heads = self._read("postings").select("term", "segment", "block", "max_tf", "min_len").join(_sent(asked), "term")
        most = F.greatest("w", F.lit(0.0)) * self._part(F.col("max_tf"), F.col("min_len"))
        return asked, heads.groupBy("query_id", "segment", "block").agg(F.sum(most).alias("bound"))

    def _scored(self, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of the documents of each query's blocks."""
        rows = self._read("postings").select("term", "segment", "block", "docs").join(_sent(asked), "term").join(_sent(blocks.select("query_id", "segment", "block")), ["query_id", "segment", "block"])
        rows = rows.select("query_id", "w", F.explode("docs").alias("d")).select("query_id", "w", "d.*")
        scores = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * self._part(F.col("tf"), F.col("len"))), 6).alias("score"))
        return scores.filter("score > 0")

    def search(self, queries: DataFrame, k: int = 5, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """((query_id, rank, doc_id, score) of the k best, ties to the smaller doc_id; (query_id, blocks, read): how many blocks have a term of the query, and how many were scored)."""
        if not self.n_docs or not self.mean_length:
            empty = lambda schema: self.spark.createDataFrame([], schema)
            return empty("query_id long, rank int, doc_id long, score double"), empty("query_id long, blocks long, read long")
        asked, bounds = self.bounds(queries)
        by_bound = W.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        ranked = checkpointed(bounds.withColumn("i", F.row_number().over(by_bound)))
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        early = checkpointed(top(self._scored(asked, ranked.filter(F.col("i") <= first))))
        floors = early.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        # scores are rounded, so a bound may lie a little below its score
        late = ranked.filter(F.col("i") > first).join(floors, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") + 1e-6 >= F.col("floor")))
        late = checkpointed(late.select("query_id", "segment", "block"))
        found = top(early.select("query_id", "doc_id", "score").unionByName(self._scored(asked, late)))
        read = late.groupBy("query_id").agg(F.count(F.lit(1)).alias("late"))
        counts = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(read, "query_id", "left")
        return found.select("query_id", "rank", "doc_id", "score"), counts.select("query_id", "blocks", (F.least("blocks", F.lit(first)) + F.coalesce("late", F.lit(0))).alias("read"))
