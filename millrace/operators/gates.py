"""Predicates and ladders that decide where a row goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def _share(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")) / F.length(text)


def quality_reason(text: Column, tokens: Column | None = None) -> Column:
    """The first gate that a text fails, null if none: length, emptiness, printable and alphabetic share, repeats, words."""
    tokens = X.count_tokens(text) if tokens is None else tokens
    return (
        F.when(tokens < V.LEAST_TOKENS, "too_short")
        .when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
        .when(_share(text, r"[\p{C}\p{Z}&&[^\n\t ]]") < V.LEAST_PRINTABLE, "nonprintable_noise")
        .when(_share(text, r"[^\p{L}]") < V.LEAST_ALPHABETIC, "low_alphabetic_ratio")
        .when(text.rlike(r"(.)\1{%d,}" % (V.REPEATS - 1)), "repeated_character_noise")
        .when(F.regexp_count(text, F.lit("[A-Za-z]{2,}")) < V.LEAST_WORDS, "too_few_words")
    )


def signals_in(text: Column) -> Column:
    """The relevance phrases that a text holds, as substrings, in order."""
    return X.bind(X.for_matching(text), lambda ready: F.filter(F.array(*map(F.lit, V.SIGNALS)), lambda s: F.contains(ready, s)))


def classify_role(path: Column, extension: Column) -> Column:
    out = F.when(extension.isin(*V.CODE_EXTENSIONS), "code")
    for role, pattern in V.ROLE_PATTERNS:
        out = out.when(path.rlike(f"(?i){pattern}"), role)
    return out.when(extension.isin(".html", ".htm"), "course_page").when(extension == ".pdf", "document").otherwise("text")


def split_policy(role: Column) -> Column:
    return F.when(role.isin("assignment", "solution", "exam"), "quarantine_problem_or_solution").when(role == "code", "tool_example").otherwise("knowledge")


def route(units: DataFrame) -> DataFrame:
    """units (ord, unit_id, text, text_sha256, needs_ocr_review, split_policy, corpus_tier, content_role, score) with pool, reason and duplicate_unit_id.

    A text that an earlier unit of the input has is a duplicate of the first
    such unit, wherever that one went.  Hot texts are handled by one
    aggregation with partial minima; no window holds a group of copies.
    """
    firsts = units.filter("text_sha256 is not null").groupBy("text_sha256").agg(F.min(F.struct("ord", "unit_id")).alias("_first"))
    rows = units.join(firsts, "text_sha256", "left")
    later = F.coalesce(F.col("_first.ord") < F.col("ord"), F.lit(False))
    partial = F.col("corpus_tier").isin("metadata_only", "canonical_excerpt", "canonical_scan_pending_ocr")
    ladder = (
        (F.coalesce(F.length("text"), F.lit(0)) == 0, "review", "empty_text"),
        (F.coalesce("needs_ocr_review", F.lit(False)), "review", "possible_ocr_or_sparse_page"),
        (later, "review", "exact_text_duplicate"),
        (F.col("split_policy") == "quarantine_problem_or_solution", "quarantine", "problem_solution_or_exam"),
        (partial, "review", "partial_or_metadata_only_source"),
        (F.col("content_role") == "code", "knowledge", "code_candidate"),
        (F.col("corpus_tier") == "foundation", "knowledge", "foundation_knowledge_candidate"),
        (F.col("score") == 0, "review", "no_strong_control_signal"),
    )
    reason = pool = None
    for test, where, why in ladder:
        pool = F.when(test, where) if pool is None else pool.when(test, where)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    reason = reason.otherwise("control_knowledge_candidate")
    duplicate = F.when(reason == "exact_text_duplicate", F.col("_first.unit_id"))
    return rows.select(*units.columns, pool.otherwise("knowledge").alias("pool"), reason.alias("pool_reason"), duplicate.alias("duplicate_unit_id"))


def record_score(title: Column, subjects: Column, description: Column) -> Column:
    """struct(score, matches) of a catalogue record: each phrase counts by the best field that has it."""
    fields = F.struct(*[X.collapsed(X.for_matching(c)).alias(n) for n, c in (("title", title), ("subjects", subjects), ("description", description))])
    phrases = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("weight")) for p, w in V.PHRASES.items()])

    def scored(f: Column) -> Column:
        def points(p: Column) -> Column:
            factor = F.lit(0)
            for name, times in sorted(V.FIELD_FACTORS.items(), key=lambda x: x[1]):
                factor = F.when(F.contains(f[name], p["phrase"]), times).otherwise(factor)
            return F.struct(p["phrase"].alias("phrase"), (p["weight"] * factor).alias("points"))

        combined = F.concat_ws(" ", f["title"], f["subjects"], f["description"])
        against = F.size(F.filter(F.array(*map(F.lit, V.NEGATIVE)), lambda p: F.contains(combined, p)))

        def result(found: Column) -> Column:
            total = F.aggregate(found, F.lit(0), lambda a, p: a + p["points"]) - V.PENALTY * against
            return F.struct(F.greatest(total, F.lit(0)).alias("score"), F.array_sort(F.transform(found, lambda p: p["phrase"])).alias("matches"))

        return X.bind(F.filter(F.transform(phrases, points), lambda p: p["points"] > 0), result)

    return X.bind(fields, scored)


def needs_tools(prompt: Column) -> Column:
    return prompt.rlike(r"\p{N}") | F.lower(prompt).rlike("|".join(V.TOOL_WORDS))


def safe_url(url: Column, host: str, suffixes: tuple[str, ...]) -> Column:
    """https, the same host, and a path with an allowed suffix."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.endswith(path, F.lit(s))
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.try_parse_url(url, F.lit("HOST")) == host) & ends, F.lit(False))


def degenerate_array(values: Column, most: int = 25, run: int = 6) -> Column:
    """More than `most` elements, or `run` equal ones in a row."""
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        now = F.when(a["last"] == x, a["now"] + 1).otherwise(1)
        return F.struct(x.cast("double").alias("last"), now.alias("now"), F.greatest(a["best"], now).alias("best"))

    return (F.size(values) > most) | (F.aggregate(values, zero, step)["best"] >= run)


def lint(answer: Column, placeholder: str = "i could not generate") -> Column:
    """The defects of an answer's text, as an array."""
    words = X.word_count(answer)
    blank = F.coalesce(X.trimmed(answer), F.lit("")) == ""
    text = F.coalesce(answer, F.lit(""))
    length = F.when(blank, "EMPTY answer").when(F.contains(F.lower(text), F.lit(placeholder)), "PLACEHOLDER non-answer").when(words < 40, F.format_string("THIN answer (%d words)", words.cast("int")))
    return F.array_compact(
        F.array(
            length,
            F.when(text.rlike(r"\\\\(?=[a-zA-Z|{}()])"), "DOUBLED LaTeX backslash"),
            F.when(text.rlike("</?tool_call>"), "LEAKED tool_call tag"),
            F.when(text.rlike(r'\{\s*"name"\s*:'), "LEAKED raw JSON"),
            F.when(text.rlike(V.RAW_FILE_NAME), "RAW filename in citation"),
        )
    )
