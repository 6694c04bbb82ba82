"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset on a single machine (master local) a temporary
    folder is made and registered; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return a scan of it.

    It cuts the lineage, so what two later branches need is made once, and
    the copy survives the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() with the shared folder made sure of; for small tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def nested(df: DataFrame) -> DataFrame:
    """df as one struct column `row`: columns that an operator adds beside it can't clash with df's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def _id_text(kind: T.DataType) -> T.DataType:
    return T.ArrayType(T.StringType()) if isinstance(kind, T.ArrayType) else T.StringType()


def ids_as_text(df: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df with the named ids, longs or arrays of them, as text.

    pandas turns a long column that holds a null into float64, which rounds
    ids beyond 2^53; text comes through unchanged.
    """
    return df.select(*[F.col(f"`{f.name}`").cast(_id_text(f.dataType)).alias(f.name) if f.name in ids else F.col(f"`{f.name}`") for f in df.schema])


def give_back() -> None:
    """Return freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(work: Callable) -> Callable:
    """work on batches, after which the worker gives freed memory back: Spark keeps workers for later tasks and stages, beside a heap that has grown meanwhile."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def map_batches(df: DataFrame, work: Callable, schema: str | T.StructType, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df.mapInPandas(work, schema) in which the named ids are text on both sides of work, and longs again outside."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    inner = T.StructType([T.StructField(f.name, _id_text(f.dataType)) if f.name in ids else f for f in fields])
    out = ids_as_text(df, ids).mapInPandas(tidy(work), inner)
    return out.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in ids else F.col(f"`{f.name}`") for f in fields])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text) -> bytes:
    """The UTF-8 bytes of a cell; none for null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def blocks(frames: Iterator[pd.DataFrame], column: str, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into runs of rows with about `most` characters, one row at least.

    A task then holds one run's working arrays at a time, whatever the row sizes.
    """
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield frame.iloc[start:i]
                start, held = i, 0
            held += n
        if len(frame) > start:
            yield frame.iloc[start:]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """blocks() of Arrow batches, without a copy, by bytes of the column."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
