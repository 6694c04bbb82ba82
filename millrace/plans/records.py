"""Queries over record sets: requests, required classes, stored totals, rubric, answer and code rules, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import records as R
from ..operators import sampling
from ..sources import files
from .book import Book, table

book = Book()
_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@book.query("""SELECT source, array_to_string(list_sort(langs), ',') AS languages FROM (SELECT source, list_distinct(list(lang)) AS langs FROM documents GROUP BY source)
WHERE len(list_filter(langs, lambda x: x NOT IN ('en', 'de'))) > 0""")
def sources_with_languages_left(spark, sf_dir):
    """Sources that hold a language besides two excluded ones, sorted by their languages, then name."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    return rows.filter(R.has_class_left(F.col("langs"), ["en", "de"])).orderBy("langs", "source").select("source", F.array_join("langs", ",").alias("languages"))


@book.query("SELECT n_nationkey, n_name, place FROM nation JOIN (VALUES (7, 0), (3, 1), (7, 2), (24, 3)) w(k, place) ON n_nationkey = k")
def requested_nations(spark, sf_dir):
    """Rows by a list of ids that fixes the order and repeats one."""
    return R.requested(table(spark, sf_dir, "nation"), "n_nationkey", [7, 3, 7, 24]).select("n_nationkey", "n_name", "place")


@book.query("""WITH c AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN [url || '/FrontMatter.pdf', url || '/bfm%3A1'] WHEN 1 THEN [url, url || '/bfm1'] ELSE CAST([] AS VARCHAR[]) END AS c FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE len(c) END AS n_candidates, CASE WHEN page_id % 3 = 0 THEN 'metadata_only' ELSE 'oa_candidate' END AS status FROM c""")
def page_candidates(spark, sf_dir):
    """Candidate addresses after those that are front matter throughout were rejected."""
    url, kind = F.col("url"), F.col("page_id") % 3
    made = F.when(kind == 0, F.array(F.concat(url, F.lit("/FrontMatter.pdf")), F.concat(url, F.lit("/bfm%3A1")))).when(kind == 1, F.array(url, F.concat(url, F.lit("/bfm1")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "pages").select("page_id", made.alias("candidates"), F.lit("oa_candidate").alias("status"))
    return R.without_rejected(rows).select("page_id", F.size("candidates").cast("long").alias("n_candidates"), "status")


@book.query("SELECT doc_id FROM documents WHERE contains(replace(lower(concat_ws(' ', lang, source, text)), 'ß', 'ss'), 'license')")
def documents_mentioning(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(R.mentions("License", "lang", "source", "text")).select("doc_id")


@book.query("""WITH r(class, rule, least) AS (VALUES ('en', 'required', 0.0), ('fr', 'required', 0.0), ('xx', 'required', 0.0), ('de', 'forbidden', 0.0), ('en', 'least', 0.05), ('xx', 'least', 0.05)),
c AS (SELECT lang AS class, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT count(*) AS total FROM documents)
SELECT class, coalesce(n, 0) AS n, coalesce(n, 0) / total AS share, rule,
  CASE rule WHEN 'required' THEN coalesce(n, 0) > 0 WHEN 'forbidden' THEN coalesce(n, 0) = 0 ELSE coalesce(n, 0) / total >= least END AS passed FROM r LEFT JOIN c USING (class), t""")
def language_coverage(spark, sf_dir):
    """Required, forbidden and least-share languages."""
    return R.class_report(table(spark, sf_dir, "documents"), "lang", ["en", "fr", "xx"], ["de"], {"en": 0.05, "xx": 0.05})


@book.query("""SELECT source, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS stored, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS found,
  coalesce(sum(n_chars), 0) = coalesce(sum(length(text)), 0) AS agrees FROM documents GROUP BY source""")
def stored_totals(spark, sf_dir):
    """The stored character counts against the texts, by source."""
    return R.totals_agree(table(spark, sf_dir, "documents"), "source", F.col("n_chars"), F.length("text").cast("long"))


@book.query("""WITH p AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) % 7) AS p, max(CAST(l_quantity AS BIGINT)) * 2 AS w FROM lineitem GROUP BY 1)
SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN list_min(p) <= 0 THEN 'points_not_positive' END, CASE WHEN list_sum(p) <> 10 THEN 'points_not_10' END,
  CASE WHEN w < 50 THEN 'max_words_below_50' END], lambda x: x IS NOT NULL)) AS error FROM p) GROUP BY 1""")
def rubric_error_counts(spark, sf_dir):
    """Rubric errors by kind; an order's quantities mod 7 serve as points."""
    quantity = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(quantity % 7).alias("points"), (F.max(quantity) * 2).alias("most"))
    return rows.select(F.explode(R.rubric_errors(F.col("points"), F.col("most"))).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@book.query(r"""WITH a AS (SELECT conv_id, turn, replace(lower(text), 'ß', 'ss') AS low, text || CASE WHEN conv_id % 5 = 0 THEN ' Kp = 2' ELSE '' END AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, unnest(list_filter([CASE WHEN NOT contains(low, 'the') THEN 'omits the' END, CASE WHEN NOT contains(low, 'and') THEN 'omits and' END,
  CASE WHEN regexp_matches(t, '(?i)\b(?:k_?p|k_?i|k_?d|controller coefficients?|kalman gain)\s*(?:=|:)\s*[-+]?\d') THEN 'made-up value' END], lambda x: x IS NOT NULL)) AS error FROM a""")
def answer_rule_errors(spark, sf_dir):
    """Terms that assistant turns omit and design values that they make up; every fifth conversation gets one."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    answer = F.concat("text", F.when(F.col("conv_id") % 5 == 0, " Kp = 2").otherwise(""))
    return rows.select("conv_id", "turn", F.explode(R.answer_errors(answer, ["the", "and"])).alias("error"))


@book.query(r"""WITH p AS (SELECT page_id, html || CASE WHEN page_id % 4 = 0 THEN ' addBlock([x)' ELSE '' END AS c FROM pages)
SELECT page_id, unnest(list_filter([CASE WHEN NOT contains(lower(c), 'article') THEN 'missing Article' END, CASE WHEN contains(lower(c), 'newsystem(') THEN 'banned newSystem(' END,
  CASE WHEN contains(lower(c), 'addblock(') THEN 'banned addblock(' END, CASE WHEN contains(lower(c), 'addline(') THEN 'banned addline(' END, CASE WHEN contains(lower(c), 'setmdl(') THEN 'banned setmdl(' END,
  CASE WHEN contains(lower(c), 'dimpoles(') THEN 'banned dimpoles(' END, CASE WHEN contains(lower(c), 'systems(') THEN 'banned systems(' END,
  CASE WHEN length(replace(c, '(', '')) <> length(replace(c, ')', '')) THEN 'unbalanced parentheses' END,
  CASE WHEN length(replace(c, '[', '')) <> length(replace(c, ']', '')) THEN 'unbalanced brackets' END], lambda x: x IS NOT NULL)) AS error FROM p""")
def code_rule_errors(spark, sf_dir):
    """Static code rules over page sources; every fourth page gets a bad call."""
    code = F.concat("html", F.when(F.col("page_id") % 4 == 0, " addBlock([x)").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(R.code_errors(code, ["Article"])).alias("error"))


@book.query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role <> 'system' THEN turn END NULLS LAST, turn) AS INTEGER) AS place FROM conversations")
def unit_places(spark, sf_dir):
    """Units by page, those without page last; system turns have no page here."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("turn")).alias("page"))
    return R.ordered_units(rows, "conv_id", "page", "turn").select("conv_id", "turn", "place")


@book.query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE (r - 1) % 10 = 0""")
def every_tenth_order(spark, sf_dir):
    return R.every_nth(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@book.query("""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY left(sha256('split:' || CAST(doc_id AS VARCHAR)), 16), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= floor(n * 85 / 100) THEN 'train' ELSE 'valid' END AS split FROM k""")
def percent_split(spark, sf_dir):
    """The first 85 % of all documents in hash order are train."""
    key = X.stable_key(F.concat(F.lit("split:"), F.col("doc_id").cast("string")))
    rows = sampling.places(table(spark, sf_dir, "documents").select(F.lit(0).alias("all"), "doc_id", key.alias("k")), "all", ["k", "doc_id"])
    return rows.select("doc_id", F.when(F.col("place") <= F.floor(F.col("size") * 85 / 100), "train").otherwise("valid").alias("split"))


@book.query(rf"""SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') || '.pdf' AS filename,
  regexp_replace(regexp_replace(url || ' \\zeta \\[2pt] \\[x \\|', '\\\\([a-zA-Z|{{}}()\]])', '\\\1', 'g'), '\\\\(\[\s*[^\d\s])', '\\\1', 'g') AS latex,
  {_TRIM.format(x="regexp_extract('Code:' || chr(10) || '```Python ' || chr(10) || url || chr(10) || '```' || html, '(?is)```python\\s*\\n(.*?)```', 1)")} AS code,
  'Instruct: find' || chr(10) || 'Query:' || url AS question,
  url || chr(10) || chr(10) || 'Response constraints:' || chr(10) || '- Language: English' || CASE WHEN page_id % 2 = 0 THEN chr(10) || '- Maximum length: ' || page_id || ' words' ELSE '' END AS prompt FROM pages""")
def page_strings(spark, sf_dir):
    """File names, mended LaTeX, fenced code, and prompts."""
    url = F.col("url")
    fenced = F.concat(F.lit("Code:\n```Python \n"), url, F.lit("\n```"), F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        X.safe_filename(url).alias("filename"),
        X.mended_latex(F.concat(url, F.lit(r" \\zeta \\[2pt] \\[x \\|"))).alias("latex"),
        X.fenced_code(fenced, "python").alias("code"),
        X.instructed(url, "find").alias("question"),
        X.user_prompt(url, F.lit(None).cast("string"), F.when(F.col("page_id") % 2 == 0, F.col("page_id"))).alias("prompt"),
    )


@book.query()
def title_keys(spark, sf_dir):
    """Titles as compatibility-normalised keys."""
    return table(spark, sf_dir, "documents").select("doc_id", X.compatible(F.col("text")).alias("key"))


@book.query("""SELECT 'documents.parquet' AS chunk_file, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL AND text <> ''
UNION ALL SELECT 'benchmark.parquet', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark WHERE text IS NOT NULL AND text <> ''""")
def chunk_union(spark, sf_dir):
    """Rows and characters of chunk files, of which one doesn't exist."""
    rows = files.union_chunks(spark, [f"{sf_dir}/{n}.parquet" for n in ("documents", "missing", "benchmark")], "parquet")
    return rows.groupBy("chunk_file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
