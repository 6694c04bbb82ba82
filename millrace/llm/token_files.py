"""Token-ID output: documents in ascending doc_id order, as Re-Pair shards.

Documents are range-partitioned by doc_id; each task encodes its documents and
compresses about 4 MB of text to a shard.  Shards are written through Spark's
Parquet writer, one row a shard with the document ids beside it, so a commit
is atomic, a lost task is done anew, and any store that Spark reaches can hold
the files.  Reading back decodes the shards; a document's place in the whole
is a prefix sum over partitions, shards and documents.

Edge cases: a null text is empty and gives the end id alone; null doc_ids come
first; rows of one doc_id are ordered by their text's hash, and repeated rows
each stand in the file; an empty table gives no shard; other columns than
doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, ids_as_text, map_batches, stash
from .repair import Shard, compress
from .tokens import encoder

END = 2
SHARDS = "part int, seq int, ids array<long>, n_tokens array<int>, shard binary"


def write_shards(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = END, first: int = 50_257, parts: int | None = None) -> DataFrame:
    """The shards of docs (doc_id, text), written and read again as a table of SHARDS.

    part and seq order the shards; ids and n_tokens are each document's.
    """
    session = docs.sparkSession
    parts = parts or max(int(session.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.md5("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)

    def work(frames):
        encode, seq = encoder(name, True).flat, 0
        for frame in blocks(frames, "text"):
            ids, sizes = encode(frame["text"].fillna("").tolist())
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), (sizes + 1).astype(np.int32)
            yield pd.DataFrame({"part": [int(frame["part"].iloc[0])], "seq": [seq], "ids": [frame["doc_id"].tolist()], "n_tokens": [sizes], "shard": [compress(ids, sizes, first)]})
            seq += 1

    return stash(map_batches(ordered.withColumn("part", F.spark_partition_id()), work, SHARDS, ("doc_id", "ids")), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary, uint32) of every document, decoded."""
    sized = shards.select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sized.groupBy("part").agg(F.sum("n").alias("n"))
    # one row a partition of the writer
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    starts = sized.join(parts, "part").select("part", "seq", (F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("seq")) - F.col("n")).alias("start"))

    def work(frames):
        for frame in frames:
            for start, docs, shard in zip(frame["start"], frame["docs"], frame["shard"]):
                ids = Shard(shard).documents()
                sizes = np.array([len(x) for x in ids], np.int64)
                yield pd.DataFrame({"doc_id": docs, "start": start + np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids": [x.astype("<u4").tobytes() for x in ids]})

    rows = ids_as_text(shards.select("part", "seq", "ids", "shard").join(starts, ["part", "seq"]).select("start", F.col("ids").alias("docs"), "shard"), ("docs",))
    return map_batches(rows, work, "doc_id long, start long, n_tokens long, ids binary")
