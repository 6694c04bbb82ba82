"""Text scalars as Column functions; all run inside whole-stage code generation.

Word and letter classes are Unicode, white space is ASCII.  Case folding is lower-casing with a double s for the sharp one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The declared unit of token counts: a run of letters and digits, or any other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Retrieval tokens: words, or one mathematical sign.
TERM = r"[\p{L}\p{N}_]+|[+\-*/^]"


def bind(value: Column, f) -> Column:
    """f(value) with value computed once a row, however often f's lambdas use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for blank and null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def canonical_text(text: Column) -> Column:
    """Without soft hyphens and hyphenated line breaks; blanks and blank lines collapsed."""
    text = F.replace(text, F.lit("­"), F.lit(""))
    text = F.regexp_replace(text, r"(?<=[\p{L}\p{N}_])-\s*\n\s*(?=[\p{L}\p{N}_])", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalized_text(text: Column) -> Column:
    """As extracted pages are stored: unix line ends, no NUL, blanks collapsed and off the line ends."""
    text = F.replace(F.replace(F.replace(text, F.lit("\u0000"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" *\n *", "\n")
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def for_matching(text: Column) -> Column:
    """Lower case, hyphens as blanks, white space collapsed."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), r"\s+", " ")


def text_hash(text: Column) -> Column:
    """Null for empty text, else the SHA-256 of the folded text with white space collapsed."""
    return F.when(F.length(text) > 0, F.sha2(collapsed(folded(text)), 256))


def stable_key(value: Column) -> Column:
    """16 hex digits; their order is that of the hash as a fraction of 2**64."""
    return F.substring(F.sha2(value, 256), 1, 16)


def similarity_text(text: Column) -> Column:
    """Folded, with numbers as a placeholder."""
    return F.regexp_replace(folded(text), r"[-+]?[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?", " <NUM> ")


def slug(text: Column, most: int = 80) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    made = F.regexp_replace(F.substring(made, 1, most), "-+$", "")
    return F.when(F.coalesce(F.length(made), F.lit(0)) == 0, F.lit("untitled")).otherwise(made)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"))


def human_size(n: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB")) -> Column:
    """Bytes with a binary unit and one decimal, ties to the even one; null is unknown."""
    out = F.when(n.isNull(), F.lit("unknown")).when(n < 1024, F.format_string("%d B", n.cast("long")))
    # format_string rounds ties up
    shown = [F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**power, 1)) for power, unit in enumerate(units, 1)]
    for power, size in enumerate(shown[:-1], 1):
        out = out.when(n < 1024 ** (power + 1), size)
    return out.otherwise(shown[-1])


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase in a text made by for_matching()."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def round_half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def significant(x: Column, digits: int = 6) -> Column:
    """x to so many significant figures."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | x.isNull() | F.isnan(x), x).otherwise(F.rint(x * scale) / scale)


def safe_filename(name: Column, suffix: str = ".pdf") -> Column:
    return F.concat(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), F.lit(suffix))


def mended_latex(text: Column) -> Column:
    """With one backslash for two before a command or delimiter; row breaks with a spacing stay."""
    return F.regexp_replace(text, r"\\\\(?=[a-zA-Z|{}()\]]|\[\s*[^\d\s])", r"\\")


def fenced_code(text: Column, language: str) -> Column:
    """The first fenced block of a language, trimmed; empty if there is none."""
    return trimmed(F.regexp_extract(text, rf"(?is)```{language}\s*\n(.*?)```", 1))


def instructed(query: Column, instruction: str) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), query)


def user_prompt(prompt: Column, language: Column, max_words: Column) -> Column:
    """A prompt with its constraints; null language is English, null max_words no limit."""
    limit = F.coalesce(F.concat(F.lit("\n- Maximum length: "), max_words.cast("string"), F.lit(" words")), F.lit(""))
    return F.concat(prompt, F.lit("\n\nResponse constraints:\n- Language: "), F.coalesce(language, F.lit("English")), limit)


def by_row(column: pa.Array, f: Callable, kind: pa.DataType = pa.string(), together: int = 256) -> pa.Array:
    """f of every cell, as a kind; few rows at a time are Python objects, so a batch takes little beside its Arrow buffers."""
    parts = [pa.array([f(x) for x in column.slice(i, together).to_pylist()], kind) for i in range(0, len(column), together)]
    return pa.concat_arrays([pa.array([], kind), *parts])


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return by_row(text, lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compatible(text: Column) -> Column:
    """NFKC, lower case, hyphens as blanks, white space collapsed and trimmed."""
    return trimmed(for_matching(_nfkc(text)))
