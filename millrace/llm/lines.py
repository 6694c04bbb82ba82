"""Line deduplication by a log-template tree of fixed depth.

A line goes down the tree by its token count and its first DEPTH tokens, in
which tokens with digits are variable.  Only leaves that LEAST lines reach go
on.  In a leaf, a token is part of the template if at least LEAST lines have
it at that place; other places, and tokens with digits, are variable fields.
A template with enough fixed tokens that LEAST different texts hold recurs:
its lines are dropped everywhere but in the smallest document that has them.

All steps are aggregates with partial sums and joins; the leaves that go on
are broadcast while they are few (LEAVES) and joined by shuffle beyond that.

Edge cases: lines of fewer than TOKENS tokens always stay; null texts stay
null, empty ones empty; exact copies of a text count once, so copies alone
don't make their lines recur; rows without doc_id count as holders and keep a
template only where no holder has an id (then the smallest text hash does);
repeated rows lose the same lines; an empty table gives an empty result; extra columns are carried along, whatever their names, but that
dedup_lines() gives its own n_lines and n_dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nested, stash

DEPTH, TOKENS, LEAST, SHARE = 3, 3, 6, 0.6
#: Leaves up to which the set of them is broadcast: 16 MB of keys.
LEAVES = 2_000_000
FIELD = "<*>"
#: A token that holds a digit, where blanks and line ends part tokens.
HAS_DIGIT = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"


def _lines(docs: DataFrame, tokens: int) -> DataFrame:
    """(doc_id, body, at, tokens, leaf) of every line with enough tokens, tokens with digits as FIELD.

    White space and digits are dealt with once a text, so that a line is split at single blanks.
    """
    body = F.xxhash64("text", F.length("text")).alias("body")
    plain = F.regexp_replace(F.translate("text", "\t\x0b\x0c\r", "    "), HAS_DIGIT, FIELD)
    rows = docs.select("doc_id", body, F.posexplode(F.split(plain, "\n")).alias("at", "line"))
    rows = rows.select("doc_id", "body", "at", F.array_remove(F.split("line", " "), "").alias("tokens")).filter(F.size("tokens") >= tokens)
    leading = [F.get("tokens", F.lit(i)) for i in range(DEPTH)]
    return rows.select("doc_id", "body", "at", "tokens", F.xxhash64(F.size("tokens"), *leading).alias("leaf"))


def recurring_lines(docs: DataFrame, tokens: int = TOKENS, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(doc_id, body, at, template, keeper): lines whose template recurs, and the document that keeps it: (none, doc_id, body), the smallest doc_id, or without any the smallest body."""
    lines = _lines(docs, tokens)
    leaves = stash(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("leaf"), "leaves")
    known = F.broadcast(leaves) if leaves.count() <= LEAVES else leaves
    lines = stash(lines.join(known, "leaf").select("doc_id", "body", "at", "leaf", "tokens", F.xxhash64("tokens").alias("key")), "lines")
    kinds = lines.groupBy("leaf", "key", "tokens").agg(F.count(F.lit(1)).alias("n"))
    places = stash(kinds.select("leaf", "key", "n", F.posexplode("tokens").alias("place", "token")), "places")
    fixed = places.filter(F.col("token") != FIELD).groupBy("leaf", "place", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    fixed = stash(fixed.select("leaf", "place", "token", F.lit(True).alias("fixed")), "fixed")
    marked = places.join(fixed, ["leaf", "place", "token"], "left")
    parts = F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(FIELD)).alias("token"))))
    templates = marked.groupBy("leaf", "key").agg(F.concat_ws(" ", F.transform(parts, lambda p: p["token"])).alias("template"), F.avg(F.when(F.col("fixed"), 1.0).otherwise(0.0)).alias("share"))
    templates = stash(templates.filter(F.col("share") >= share).select("leaf", "key", "template"), "templates")
    found = stash(lines.join(templates, ["leaf", "key"]).select("doc_id", "body", "at", "template"), "found")
    held = found.groupBy("template", "body").agg(F.min("doc_id").alias("doc_id")).groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("keeper"))
    held = stash(held.filter(F.col("texts") >= least).select("template", "keeper"), "held")
    return found.join(held, "template")


def _split(docs: DataFrame, tokens: int, least: int, share: float) -> DataFrame:
    """(row, text, n_lines, n_dropped): every row of docs as a struct, its text without dropped lines, and counts of its non-blank lines."""
    keeps = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("doc_id").isNotNull() | (F.col("body") == F.col("keeper.body")))
    gone = recurring_lines(docs, tokens, least, share).filter(~keeps)
    gone = gone.groupBy(F.col("doc_id").alias("id"), F.col("body").alias("own")).agg(F.collect_set("at").alias("gone"))
    rows = nested(docs).withColumn("body", F.xxhash64("row.text", F.length("row.text")))
    rows = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("body") == F.col("own")), "left")
    text = F.col("row.text")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n"))
    n_lines = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("long")
    n_gone = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return rows.select("row", kept.alias("text"), n_lines.alias("n_lines"), n_gone.alias("n_dropped"))


def dedup_lines(docs: DataFrame, tokens: int = TOKENS, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """docs with text without its dropped lines, and n_lines and n_dropped, both of non-blank lines; columns of docs with these two names give way."""
    own = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _split(docs, tokens, least, share).select(*own, "n_lines", "n_dropped")


def without_recurring_lines(docs: DataFrame, tokens: int = TOKENS, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """docs with all its own columns, text without its dropped lines."""
    return _split(docs, tokens, least, share).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
