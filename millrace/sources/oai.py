"""Harvested OAI pages: a streaming source with offsets of its own, and their records.

A folder holds one XML page a request; a page names the next by its
resumption token.  The source's offset is the token of the next page and how
many were read, so a stream that stops after any page goes on from there.  The
driver reads tokens only; pages are read in tasks.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import text as X
from ..operators import gates

PAGE = "page long, token string, next string, xml string"
#: The first page's name, and bytes at a page's end that hold its token.
START, TAIL = "start", 4_096
TOKEN = re.compile(rb"<(?:[\w.-]+:)?resumptionToken[^>]*>([^<]*)<")


class _Page(InputPartition):
    def __init__(self, page: int, token: str):
        self.page, self.token = page, token


class _Pages:
    """Pages by token: folder/<token>.xml, the first one folder/start.xml."""

    def __init__(self, folder: str):
        self.store, self.root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)

    def _path(self, token: str) -> str:
        return posixpath.join(self.root, f"{token}.xml")

    def has(self, token: str) -> bool:
        return self.store.get_file_info(self._path(token)).type == fs.FileType.File

    def next(self, token: str) -> str:
        """The token of the page after, empty at the end."""
        with self.store.open_input_file(self._path(token)) as file:
            file.seek(max(0, file.size() - TAIL))
            found = TOKEN.findall(file.read())
        return found[-1].decode().strip() if found else ""

    def text(self, token: str) -> str:
        with self.store.open_input_file(self._path(token)) as file:
            return file.read().decode("utf-8", "replace")


    def walk(self, page: int, token: str, most: int | None = None) -> Iterator[tuple[int, str, str]]:
        """(page, token, token after) from a page on; a token that has been seen, or whose page isn't stored yet, ends the walk."""
        seen: set[str] = set()
        while token and token not in seen and self.has(token) and (most is None or len(seen) < most):
            seen.add(token)
            after = self.next(token)
            yield page, token, after
            page, token = page + 1, after

    def row(self, page: _Page) -> tuple:
        return page.page, page.token, self.next(page.token), self.text(page.token)


class _Batch(DataSourceReader):
    """All stored pages."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_Page(page, token) for page, token, _ in _Pages(self.folder).walk(0, START)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield _Pages(self.folder).row(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, at_once: int):
        self.folder, self.at_once = folder, at_once
        self.latest: dict | None = None

    def initialOffset(self) -> dict:
        return {"page": 0, "token": START}

    def latestOffset(self) -> dict:
        # a stream asks before every batch; what it got last is where the next batch begins
        at = self.latest or self.initialOffset()
        for page, _, after in _Pages(self.folder).walk(at["page"], at["token"], self.at_once):
            at = {"page": page + 1, "token": after}
        self.latest = at
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.latest is None or self.latest["page"] < end["page"]:
            self.latest = end  # after a restart
        return [_Page(page, token) for page, token, _ in _Pages(self.folder).walk(start["page"], start["token"], end["page"] - start["page"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield _Pages(self.folder).row(partition)

    def commit(self, end: dict) -> None:
        pass


class OaiPages(DataSource):
    """format("oai_pages"), options path and pagesPerBatch: (page, token, next, xml) of the stored pages, in the order that their tokens give."""

    @classmethod
    def name(cls) -> str:
        return "oai_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("pagesPerBatch", "1000")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OaiPages)


_LISTS = ("title", "creator", "contributor", "subject", "description", "language", "resourceType", "identifier", "publisher", "rights")
RECORD = T.ArrayType(T.StructType([T.StructField("oai_identifier", T.StringType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in (*_LISTS, "licenseCondition")), T.StructField("issued", T.StringType())]))


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def page_records(xml: str | None) -> list[dict] | None:
    """Records of a page, element names without their namespace; null where the page isn't XML."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return None
    out = []
    for record in (e for e in root.iter() if _local(e.tag) == "record"):
        row: dict = {name: [] for name in (*_LISTS, "licenseCondition")} | {"oai_identifier": None, "issued": None}
        header = next((e for e in record if _local(e.tag) == "header"), None)
        for e in record.iter():
            name, text = _local(e.tag), " ".join("".join(e.itertext()).split())
            if name in _LISTS and text:
                row[name].append(text)
            if name == "licenseCondition" and e.get("uri"):
                row[name].append(e.get("uri"))
            if name == "date" and e.get("type") == "Issued" and row["issued"] is None:
                row["issued"] = e.text
        if header is not None:
            row["oai_identifier"] = next((e.text for e in header if _local(e.tag) == "identifier"), None)
        out.append(row)
    return out


_ARROW = pa.list_(pa.struct([("oai_identifier", pa.string()), *((n, pa.list_(pa.string())) for n in (*_LISTS, "licenseCondition")), ("issued", pa.string())]))


@F.arrow_udf(RECORD)
def records_of(pages: pa.Array) -> pa.Array:
    return X.by_row(pages, page_records, _ARROW, 16)


def _any_of(values: Column, known: tuple[str, ...]) -> Column:
    """Whether there are no values, or one of them is known."""
    return (F.size(values) == 0) | F.exists(values, lambda v: F.lower(F.trim(v)).isin(*known))


def candidates(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row a PDF address of each record of pages (xml) in English, of a book, scored at least `least`."""
    # Languages and types that a record may have where it has any.
    languages, kinds = ("en", "eng", "english"), ("book", "monograph", "textbook")
    rows = pages.select(F.explode(records_of("xml")).alias("r")).select("r.*")
    urls = F.filter("identifier", lambda x: F.startswith(x, F.lit("http")))
    pdf = F.array_distinct(F.filter(urls, lambda x: F.contains(F.lower(x), F.lit(".pdf"))))
    rows = rows.withColumns({"pdf_urls": pdf, "landing_urls": F.array_except(urls, pdf), "name": F.coalesce(F.get("title", F.lit(0)), F.lit("Untitled")), "text": F.array_join("description", "\n")})
    rows = rows.filter(_any_of(F.col("language"), languages) & _any_of(F.col("resourceType"), kinds) & (F.size("pdf_urls") > 0))
    rows = rows.withColumn("score", gates.record_score(F.col("name"), F.array_join("subject", " "), F.col("text"))).filter(F.col("score.score") >= least)
    return rows.select(
        "oai_identifier", F.col("name").alias("title"), F.col("creator").alias("creators"), F.col("contributor").alias("contributors"), F.col("subject").alias("subjects"), F.col("text").alias("description"),
        F.transform("language", lambda x: F.lower(F.trim(x))).alias("language"), F.col("resourceType").alias("resource_types"), F.col("publisher").alias("publishers"), "issued",
        F.array_distinct(F.concat("licenseCondition", "rights")).alias("licenses"), F.explode("pdf_urls").alias("pdf_url"), "landing_urls", F.col("score.score").alias("relevance_score"), F.col("score.matches").alias("matched_phrases"),
    )
