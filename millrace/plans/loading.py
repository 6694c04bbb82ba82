"""Queries of catalogue pages and of extraction with failures as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import shared
from ..sources import loaders, oai
from .book import Book, table

book = Book()
_PHRASES = "[" + ", ".join(f"{{'p': '{p}', 'w': {w}}}" for p, w in V.PHRASES.items()) + "]"


@book.query(f"""WITH p AS (SELECT *, p_size % 7 AS k FROM part WHERE p_size % 7 NOT IN (1, 2, 3)),
m AS (SELECT *, list_filter(list_transform({_PHRASES}, lambda x: {{'p': x.p, 'n': x.w * CASE WHEN contains(lower(p_name) || ' robotics', x.p) THEN 3 WHEN contains('kalman filter ' || lower(p_type), x.p) THEN 2 ELSE 0 END}}), lambda x: x.n > 0) AS f FROM p)
SELECT 'oai:' || p_partkey AS oai_identifier, p_name || ' Robotics' AS title, 'http://x/' || p_partkey || CASE copy WHEN 0 THEN '.pdf' ELSE '/b.PDF?download' END AS pdf_url,
  'http://x/' || p_partkey AS landing_url, CAST(list_sum(list_transform(f, lambda x: x.n)) AS INTEGER) AS relevance_score, array_to_string(list_sort(list_transform(f, lambda x: x.p)), '|') AS matches, CASE WHEN k = 0 THEN 'http://l' ELSE '' END AS licenses
FROM m, unnest(CASE WHEN k = 4 THEN [0, 1] ELSE [0] END) AS u(copy)""")
def oai_books(spark, sf_dir):
    """Books with PDF addresses in catalogue pages made from parts, a page for every brand."""
    k = F.col("p_size") % 7
    tag = lambda name, text: F.concat(F.lit(f"<dc:{name}>"), text, F.lit(f"</dc:{name}>"))
    record = F.concat(
        F.lit("<record><header><identifier>oai:"), "p_partkey", F.lit("</identifier></header><metadata><x:dc>"), tag("title", F.concat("p_name", F.lit(" Robotics"))), tag("subject", F.concat(F.lit("Kalman Filter "), "p_type")),
        F.when(k == 0, F.lit("<dc:licenseCondition uri=\"http://l\"/>")).otherwise(F.lit("")), F.when(k == 1, tag("language", F.lit("fr"))).when(k == 5, tag("language", F.lit(" ENG "))).otherwise(F.lit("")), F.when(k == 2, tag("resourceType", F.lit("article"))).when(k == 6, tag("resourceType", F.lit("Book"))).otherwise(F.lit("")),
        tag("identifier", F.concat(F.lit("http://x/"), "p_partkey")), F.when(k == 3, F.lit("")).otherwise(tag("identifier", F.concat(F.lit("http://x/"), "p_partkey", F.lit(".pdf")))),
        F.when(k == 4, tag("identifier", F.concat(F.lit("http://x/"), "p_partkey", F.lit("/b.PDF?download")))).otherwise(F.lit("")), F.lit("</x:dc></metadata></record>"),
    )
    # a page holds the records of 50 neighbouring keys
    pages = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("page"), record.alias("r")).groupBy("page").agg(F.array_join(F.collect_list("r"), "").alias("body"))
    xml = F.concat(F.lit("<o:OAI-PMH xmlns:o=\"http://o\" xmlns:dc=\"http://d\" xmlns:x=\"http://x\"><o:ListRecords>"), "body", F.lit("</o:ListRecords></o:OAI-PMH>"))
    rows = oai.candidates(pages.select(xml.alias("xml")), 1)
    return rows.select("oai_identifier", "title", "pdf_url", F.col("landing_urls")[0].alias("landing_url"), "relevance_score", F.array_join("matched_phrases", "|").alias("matches"), F.array_join("licenses", "|").alias("licenses"))


@book.query(r"""WITH f AS (SELECT page_id, page_id % 5 AS k, html FROM pages),
u AS (SELECT page_id, CASE k WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' WHEN 4 THEN 'empty' ELSE 'ok' END AS status, CASE k WHEN 2 THEN 'JSONDecodeError' WHEN 3 THEN 'NotImplementedError' END AS error_type,
  CASE WHEN k < 2 THEN length(html) ELSE 0 END AS characters FROM f)
SELECT status, error_type, count(*) AS files, CAST(sum(characters) AS BIGINT) AS characters FROM u GROUP BY ALL""")
def extraction_outcomes(spark, sf_dir):
    """Files made of pages, of four kinds, extracted and written once, units and failures apart; read back by outcome."""
    k = F.col("page_id") % 5
    ext = F.when(k == 2, ".ipynb").when(k == 3, ".pdf").otherwise(".txt")
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("document_id"), F.lit("pages").alias("source_id"), F.col("url").alias("member_path"), F.lit("knowledge_candidate").alias("split_policy"),
        ext.alias("extension"), F.encode(F.when(k == 4, F.lit(" ")).otherwise(F.col("html")), "UTF-8").alias("content"),
    )
    path = shared.new_folder(spark, "units")
    loaders.write_units(loaders.units(rows), path)
    ok, failures = loaders.read_units(spark, path)
    ok = ok.groupBy(F.col("extraction_status").alias("status"), F.lit(None).cast("string").alias("error_type")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("extraction_status") == "empty", 0).otherwise(F.col("characters"))).alias("characters"))
    return ok.unionByName(failures.groupBy(F.lit("failed").alias("status"), "error_type").agg(F.count(F.lit(1)).alias("files"), F.lit(0).cast("long").alias("characters")))
