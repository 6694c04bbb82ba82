"""Incremental forms: ingestion that drops what is known, an index that grows, and folds of event traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import retrieval, segments


def new_records(stream: DataFrame, key: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first record of each key; with a time column state is dropped once it is `late`."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def grow_index(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the postings and lengths of new documents (doc_id, text) under path; document frequencies are derived when searching."""

    def add(batch: DataFrame, number: int) -> None:
        # a batch that is done again replaces its own part, so postings never double
        retrieval.postings(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        retrieval.document_lengths(batch).write.mode("overwrite").parquet(f"{path}/lengths/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grow_segments(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of new documents (doc_id, text) under path as a segment of the stored index; a batch done again replaces its own."""
    return stream.writeStream.foreachBatch(lambda batch, number: segments.append(batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_trace(events: DataFrame) -> DataFrame:
    """(request_id, text, tools, errors, finished) of event rows (request_id, seq, type, content, tool).

    Tokens are joined in order unless a done event gives the whole answer.
    """
    ordered = events.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "content", "tool"))).alias("e"))
    of = lambda kind: F.filter("e", lambda x: x["type"] == kind)
    done = F.get(F.transform(of("done"), lambda x: x["content"]), F.size(of("done")) - 1)
    tokens = F.array_join(F.transform(of("token"), lambda x: F.coalesce(x["content"], F.lit(""))), "")
    return ordered.select("request_id", F.coalesce(done, tokens).alias("text"), F.transform(of("tool_end"), lambda x: x["tool"]).alias("tools"), F.size(of("error")).alias("errors"), (F.size(of("done")) > 0).alias("finished"))


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind and window of event time; batch or stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
