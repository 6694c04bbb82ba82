"""Loading files and archive members: links, dispatch by extension, failures as rows, and metrics of the same pass."""

from __future__ import annotations

import io
import json
import posixpath
import stat
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .files import MOST_LINKS, html_text

# Extensions that a folder's walk takes, and those that are loaded singly.
WALKED = (".pdf", ".md", ".txt", ".rst", ".py", ".m", ".json")
SINGLE = (".pdf", ".md", ".txt")
#: What a large-file pointer begins with.
POINTER = "version https://git-lfs"


def member_bytes(archive: zipfile.ZipFile, name: str, most: int = MOST_LINKS) -> bytes:
    """A member's data, through at most `most` - 1 links inside the archive; a link that leaves it, leads nowhere, or goes on too long fails."""
    there, at = set(archive.namelist()), name
    for _ in range(most):
        info = archive.getinfo(at)
        if not stat.S_ISLNK(info.external_attr >> 16):
            return archive.read(info)
        target = archive.read(info).decode("utf-8").strip()
        # an absolute target leaves the archive like one that climbs out of it
        at = posixpath.normpath(posixpath.join(posixpath.dirname(at), target))
        if at.startswith(("/", "..")) or at not in there:
            raise ValueError(f"link leaves the archive or leads nowhere: {target}")
    raise ValueError(f"too many links: {name}")


def read_members(containers: DataFrame, wanted: DataFrame) -> DataFrame:
    """(container, member_path, content, error_type, error) of wanted (container, member_path) from containers (path, content): an archive's member, or a file that is its own."""

    def work(frames):
        for frame in frames:
            out = []
            for container, members, data in zip(frame["container"], frame["members"], frame["content"]):
                archive = None
                for name in sorted(members):
                    try:
                        if name in (container, posixpath.basename(container)):
                            found = data
                        else:
                            archive = archive or zipfile.ZipFile(io.BytesIO(data))
                            found = member_bytes(archive, name)
                        out.append((container, name, found, None, None))
                    except Exception as e:  # whatever is wrong with a member is its row
                        out.append((container, name, None, type(e).__name__, str(e)))
            yield pd.DataFrame(out, columns=["container", "member_path", "content", "error_type", "error"])

    asked = wanted.groupBy("container").agg(F.collect_set("member_path").alias("members"))
    rows = asked.join(containers.select(F.col("path").alias("container"), "content"), "container")
    return rows.mapInPandas(work, "container string, member_path string, content binary, error_type string, error string")


def notebook(data: bytes) -> str:
    """Markdown and code cells under a heading of kind and place among all cells."""
    text = data.decode("utf-8", "replace")
    if text.startswith(POINTER):
        return ""
    parts = []
    for i, cell in enumerate(json.loads(text).get("cells", []), 1):
        body = cell.get("source", "")
        body = "".join(body) if isinstance(body, list) else body
        if cell.get("cell_type") in ("markdown", "code") and body.strip():
            parts.append(f"## {cell['cell_type'].title()} cell {i}\n\n{body}")
    return "\n\n".join(parts)


UNITS = "document_id string, source_id string, member_path string, split_policy string, text string, characters long, words long, extraction_status string, error_type string, error string, outcome string"


def no_reader(data: bytes) -> str:
    raise NotImplementedError("no reader for this kind of file")


#: Extractors by extension; any other file is plain text.
READERS: dict[str, Callable[[bytes], str]] = {".ipynb": notebook, ".html": lambda d: html_text(d.decode("utf-8", "replace")), ".htm": lambda d: html_text(d.decode("utf-8", "replace")), ".pdf": no_reader}
RESULT = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "error_type", "error")])


@F.pandas_udf(RESULT)
def extracted(extension: pd.Series, content: pd.Series) -> pd.DataFrame:
    """struct<text, error_type, error> of files, by extension; a file that fails gives its error and no text."""
    out = []
    for ext, data in zip(extension, content):
        try:
            if data is None:
                raise ValueError("no content")
            out.append((READERS.get(ext, lambda d: d.decode("utf-8", "replace"))(bytes(data)), None, None))
        except Exception as e:  # the failure is the row's result
            out.append((None, type(e).__name__, str(e)))
    return pd.DataFrame(out, columns=RESULT.names)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def load_directory(spark: SparkSession, folder: str, extensions: tuple[str, ...] = WALKED) -> DataFrame:
    """(path, filename, extension, text, error_type, error) of the files under a folder, at any depth; names that begin with a dot, and what lies in folders of such names, are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    inside = F.substr("path", F.lit(len(root) + 1))
    rows = found.filter(extension_of(F.col("path")).isin(*extensions) & ~inside.rlike(r"/\.")).select("path", "content", extension_of(F.col("path")).alias("extension"))
    rows = rows.withColumn("r", extracted("extension", "content"))
    return rows.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "extension", "r.*")


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """The rows of load_directory() for one file of a narrower set of kinds; other kinds give no row."""
    found = spark.read.format("binaryFile").load(path).select("path", "content", extension_of(F.col("path")).alias("extension")).filter(F.col("extension").isin(*SINGLE))
    return found.withColumn("r", extracted("extension", "content")).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "extension", "r.*")


def units(files: DataFrame) -> DataFrame:
    """files (document_id, source_id, member_path, split_policy, extension, content) with text, counts and status, or error_type and error."""
    rows = files.withColumn("r", extracted("extension", "content"))
    text = F.col("r.text")
    words = F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")
    status = F.when(F.col("r.error_type").isNotNull(), "failed").when(X.trimmed(text) == "", "empty").otherwise("ok")
    return rows.select("document_id", "source_id", "member_path", "split_policy", text.alias("text"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("characters"), words.alias("words"), status.alias("extraction_status"), "r.error_type", "r.error")


def write_units(rows: DataFrame, path: str) -> dict:
    """Write units() under path, failures apart, and return the metrics of that one pass.

    Units and failures are two partitions of one write (outcome=units and
    outcome=failures); the metrics are observed while rows go by, so nothing is
    read twice.
    """
    seen = Observation("units")
    failed = F.col("extraction_status") == "failed"
    count = lambda condition: F.count_if(condition)
    # a policy is one of few fixed values, so their counts are a bounded map
    policies = ("knowledge_candidate", "quarantine_problem_or_solution", "tool_example_candidate")
    watched = rows.observe(
        seen, F.count(F.lit(1)).alias("attempted"), count(failed).alias("failed"), count(~failed).alias("units"), count(F.col("extraction_status") == "empty").alias("empty"),
        F.coalesce(F.sum("characters"), F.lit(0)).alias("characters"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), *[count(~failed & (F.col("split_policy") == p)).alias(p) for p in policies],
    )
    watched.withColumn("outcome", F.when(failed, "failures").otherwise("units")).write.mode("overwrite").partitionBy("outcome").parquet(path)
    got = dict(seen.get)
    return {k: v for k, v in got.items() if k not in policies} | {"by_split_policy": {p: got[p] for p in policies if got[p]}}


def read_units(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(units, failures) that write_units() wrote."""
    rows = spark.read.schema(UNITS).parquet(path)
    ok = rows.filter("outcome = 'units'").drop("outcome", "error_type", "error")
    return ok, rows.filter("outcome = 'failures'").select("document_id", "source_id", "member_path", "error_type", "error")


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """One JSON object, through Spark's writer, so that any store will do."""
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
