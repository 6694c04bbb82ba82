"""Names of sources, citations, and the report of a retrieval suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Published works by their file's name.
PUBLISHED = {
    "norman s. nise - control systems engineering": "Nise, *Control Systems Engineering*",
    "ogata modern control engineering 5th txtbk": "Ogata, *Modern Control Engineering* (5th ed.)",
}

# What course codes stand for.
COURSES = {
    "SAS": "Safety in Automation Systems",
    "AMC": "Advanced and Multivariable Control",
    "CIR": "Control of Industrial Robots",
    "PLMMR": "Perception, Localization and Mapping for Mobile Robots",
    "NC": "Networked Control",
    "CAM": "Computer-Aided Manufacturing",
    "PSC": "Production Systems Control",
    "MIDA": "Model Identification and Data Analysis",
    "MIDA1": "Model Identification and Data Analysis",
    "ACEHV": "Autonomous and Connected Electric/Hybrid Vehicles",
    "ACHEV": "Autonomous and Connected Electric/Hybrid Vehicles",
    "ACAV": "Autonomous and Connected Vehicles",
    "DDCSD": "Data-Driven Control System Design",
    "SACI": "Industrial Automation and Communication Systems",
    "ICT": "Information and Communication Technology",
}

# Endings, owners' prefixes, noise words, remainders that say nothing, and the label of nothing.
ENDINGS = r"(?i)(?:\.pdf|\.md|\.txt|\.json|\.jsonl)+$"
OWNERS = r"(?i)^(?:B&B|BBB|JD|LP|EC|AC|FG|RB|XX)[_\-\s]+"
NOISE = r"(?i)\b(?:txtbk|definitivo|margini\s+larghi|theory\s+notes|practice\s+notes|final)\b|\(.*?\)"
GENERIC = ("", "course notes", "lecture notes", "notes", "exercise sessions", "summary", "course notes part 1", "course notes part 2", "lectures")
UNNAMED = "local reference"
#: Characters of a passage that a citation shows, and the score from which an answer may rest on a passage.
EXCERPT, GROUNDED = 600, 2.5


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def source_label(name: Column) -> Column:
    """struct<label, published> of a file's name: a published work as cited, else a course's subject and what is left of the name."""
    def worded(stem: Column) -> Column:
        return F.array_remove(F.split(F.regexp_replace(F.regexp_replace(stem, OWNERS, ""), r"[_\s]+", " "), " "), "")

    def coded(words: Column) -> Column:
        """The subject of the first word, and the words that are left of the name."""
        first = F.get(words, F.lit(0))
        code = F.upper(F.regexp_replace(first, "^[:-]+|[:-]+$", ""))
        # an unknown code is dropped where words follow it
        unknown = (F.size(words) > 1) & code.rlike(r"^\p{L}{2,6}$") & first.rlike(r"\p{Lu}") & (first == F.upper(first))
        subject = F.coalesce(_lookup(COURSES, code), F.lit(""))
        return X.bind(subject, lambda s: F.struct(s.alias("subject"), F.when((s != "") | unknown, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words).alias("left")))

    def cleaned(x: Column) -> Column:
        rest = F.regexp_replace(X.collapsed(F.regexp_replace(F.array_join(x["left"], " "), NOISE, "")), "^[ \u2013\u2014-]+|[ \u2013\u2014-]+$", "")
        return F.struct(x["subject"].alias("subject"), rest.alias("rest"))

    def labelled(x: Column) -> Column:
        subject, rest = x["subject"], x["rest"]
        told = F.lower(rest).isin(*GENERIC) | F.contains(F.lower(subject), F.lower(rest))
        return F.when(subject == "", F.when(rest == "", UNNAMED).otherwise(rest)).when(told, subject).otherwise(F.concat(subject, F.lit(" - "), rest))

    def of_stem(stem: Column) -> Column:
        work = _lookup(PUBLISHED, F.lower(X.collapsed(stem)))
        course = X.bind(X.bind(X.bind(worded(stem), coded), cleaned), labelled)
        return X.bind(work, lambda w: F.struct(F.coalesce(w, F.concat(course, F.lit(" (course notes)"))).alias("label"), w.isNotNull().alias("published")))

    unnamed = F.struct(F.lit(UNNAMED).alias("label"), F.lit(False).alias("published"))
    return F.when(F.coalesce(name, F.lit("")) == "", unnamed).otherwise(X.bind(F.regexp_replace(name, ENDINGS, ""), of_stem))


def citation(label: Column, page: Column) -> Column:
    """[label, p. N], without a page where none, or page zero, is known."""
    return F.concat(F.lit("["), label, F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", p. "), page.cast("string"))).otherwise(F.lit("")), F.lit("]"))


def passages(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, rank, citation, source_path, relevance, content) of hits (query_id, rank, doc_id, score) over docs (doc_id, name, page, text)."""
    rows = hits.join(docs, "doc_id")
    return rows.select("query_id", "rank", citation(source_label(F.col("name"))["label"], F.col("page")).alias("citation"), F.col("name").alias("source_path"), F.col("score").alias("relevance"), F.substring("text", 1, EXCERPT).alias("content"))


def suite_report(cases: DataFrame, hits: DataFrame, docs: DataFrame, bar: float = GROUNDED) -> DataFrame:
    """(query_id, matched, best_score, grounds) of every case (query_id, keywords): whether any hit's text holds any keyword, and whether the best score is over the bar."""
    found = hits.join(docs.select("doc_id", F.lower("text").alias("text")), "doc_id").join(cases.select("query_id", "keywords"), "query_id")
    held = F.exists("keywords", lambda k: F.contains(F.col("text"), F.lower(k)))
    scored = found.groupBy("query_id").agg(F.coalesce(F.bool_or(held), F.lit(False)).alias("matched"), F.max("score").alias("best"))
    rows = cases.select("query_id").join(scored, "query_id", "left")
    best = F.coalesce("best", F.lit(0.0))
    return rows.select("query_id", F.coalesce("matched", F.lit(False)).alias("matched"), best.alias("best_score"), (best > bar).alias("grounds"))
