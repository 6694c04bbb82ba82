"""Scans and sinks."""

from __future__ import annotations

import io
import posixpath
import zipfile
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vocabulary as V

#: Links that a member of an archive may follow.
MOST_LINKS = 8


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; strict fails on a bad line, else bad lines come with their text in _corrupt_record and nulls elsewhere.  Blank lines are skipped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def union_chunks(spark: SparkSession, paths: list[str], kind: str = "json") -> DataFrame:
    """Rows with text of the chunk files that exist, with the file's name as chunk_file; columns that a file lacks are null."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = [p for p in paths if (path := hadoop.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)]
    if not there:
        raise FileNotFoundError(f"none of {paths} exists")
    parts = [spark.read.format(kind).load(p).filter("length(text) > 0").withColumn("chunk_file", F.lit(posixpath.basename(p))) for p in there]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_numbered(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): rows have _file, _line and record; errors name file:line of blank, malformed and non-object lines.

    Every file is numbered where it is read; files are the unit of work, so a
    long one takes one task but never the driver.
    """

    def number(frames):
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                lines = data.decode("utf-8", "replace").split("\n")
                lines = lines[:-1] if lines and not lines[-1] else lines
                yield pd.DataFrame({"_file": name, "_line": range(1, len(lines) + 1), "value": lines})

    lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(number, "_file string, _line int, value string")
    parsed = lines.withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("whole", F.try_parse_json("value"))
    bad = F.when(X.trimmed(F.col("value")) == "", "blank line").when(F.col("whole").isNull(), "malformed").when(~F.startswith(F.schema_of_variant("whole"), F.lit("OBJECT")), "not an object")
    parsed = parsed.withColumn("error", bad)
    errors = parsed.filter("error is not null").select(F.format_string("%s:%d", "_file", "_line").alias("place"), "error")
    return parsed.filter("error is null").select("_file", "_line", "record"), errors


def read_array(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """A JSON array of objects, the last of each key."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_ord", F.monotonically_increasing_id())
    last = rows.groupBy(key).agg(F.max("_ord").alias("_ord"))
    return rows.join(last, [key, "_ord"], "left_semi").drop("_ord")


def with_defaults(manifest: DataFrame, fields: list[str]) -> DataFrame:
    """One row a source of a manifest (schema_version, defaults, sources): the source's value, else the default."""
    rows = manifest.select("schema_version", "defaults", F.explode("sources").alias("s")).filter("schema_version = 1")
    return rows.select(*[F.coalesce(F.col(f"s.{f}"), F.col(f"defaults.{f}")).alias(f) for f in fields])


def document_id(source: Column, member: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit("\u0000"), member), 256), 1, 20)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """One row a useful file, or member of an archive, under a folder: sizes, checksum of members, role and the first exact copy.

    Copies are members of equal extension, size and checksum; files without a
    checksum are never copies.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)

    def members(frames):
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for info in archive.infolist():
                        ext = posixpath.splitext(info.filename)[1].lower()
                        if not info.is_dir() and ext in V.USEFUL_EXTENSIONS:
                            rows.append((path, info.filename, ext, info.file_size, info.compress_size, f"{info.CRC:08x}"))
            yield pd.DataFrame(rows, columns=["container", "member_path", "extension", "uncompressed_bytes", "compressed_bytes", "archive_crc32"])

    schema = "container string, member_path string, extension string, uncompressed_bytes long, compressed_bytes long, archive_crc32 string"
    zipped = found.filter(F.lower("path").endswith(".zip")).select("path", "content").mapInPandas(members, schema)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    plain = found.filter(~F.lower("path").endswith(".zip")).filter(ext.isin(*V.USEFUL_EXTENSIONS))
    plain = plain.select(F.col("path").alias("container"), F.regexp_extract("path", r"([^/]+)$", 1).alias("member_path"), ext.alias("extension"), F.col("length").alias("uncompressed_bytes"), F.lit(None).cast("long").alias("compressed_bytes"), F.lit(None).cast("string").alias("archive_crc32"))
    rows = zipped.unionByName(plain).withColumn("document_id", document_id(F.col("container"), F.col("member_path")))
    key = ["extension", "uncompressed_bytes", "archive_crc32"]
    firsts = rows.filter("archive_crc32 is not null").groupBy(*key).agg(F.min("document_id").alias("first"))
    rows = rows.join(firsts, key, "left")
    return rows.select("document_id", "container", "member_path", "extension", "uncompressed_bytes", "compressed_bytes", "archive_crc32", F.when(F.col("first") != F.col("document_id"), F.col("first")).alias("exact_duplicate_of"))


class _Text(HTMLParser):
    """Visible text by root: main, else article, else body, else all."""

    HIDDEN = frozenset(("script", "style", "template", "svg", "noscript"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.found = [], {"main": [], "article": [], "body": [], "": []}

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        if (line := data.strip()) and not self.HIDDEN.intersection(self.stack):
            for root, lines in self.found.items():
                if not root or root in self.stack:
                    lines.append(line)


def html_text(page: str | None) -> str:
    reader = _Text()
    reader.feed(page or "")
    reader.close()
    return "\n".join(next((lines for lines in reader.found.values() if lines), []))


@F.arrow_udf(T.StringType())
def extract_html(pages: pa.Array) -> pa.Array:
    return X.by_row(pages, html_text)


def notebook_text(content: Column) -> Column:
    """Markdown and code cells of a notebook's JSON under a heading with kind and position among all cells; a large-file pointer gives empty text."""
    schema = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"
    cells = F.from_json(content, schema)["cells"]
    numbered = F.transform(cells, lambda c, i: F.struct(c["cell_type"].alias("kind"), F.array_join(c["source"], "").alias("body"), (i + 1).alias("i")))
    kept = F.filter(numbered, lambda c: c["kind"].isin("markdown", "code") & (X.trimmed(c["body"]) != ""))
    parts = F.transform(kept, lambda c: F.concat(F.lit("## "), F.initcap(c["kind"]), F.lit(" cell "), c["i"].cast("string"), F.lit("\n\n"), c["body"]))
    return F.when(F.startswith(content, F.lit("version https://git-lfs")), "").otherwise(F.coalesce(F.array_join(parts, "\n\n"), F.lit("")))


def feed_entries(xml: Column) -> Column:
    """array<struct<id, title, published>> of a preprint feed; ids without version.

    The feed's parts are read as parallel lists; entries have one of each.
    """
    part = lambda what: F.xpath(xml, F.lit(f"//entry/{what}/text()"))
    ids = F.transform(part("id"), lambda x: F.regexp_replace(F.regexp_extract(x, "([^/]+)$", 1), r"v[0-9]+$", ""))
    return F.arrays_zip(ids.alias("id"), F.transform(part("title"), X.collapsed).alias("title"), part("published").alias("published"))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't in what an earlier run has written."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new rows in place of those of the same key; of several new ones the last."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines, one part file a partition; the order of rows within and across parts is that of rows."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def verify_checksums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status) of every line of a manifest (sha256, name) against files (name, content)."""
    real = files.select("name", F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed")
    return manifest.join(real, "name", "left").select("name", status.alias("status"))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8")
