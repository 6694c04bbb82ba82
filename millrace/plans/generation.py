"""Queries of record generators, their verification, quotas and weighted draws; keys come from the tables."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ground_truth as G
from ..operators import generation, sampling
from .book import Book, table

book = Book()
SEED = 7


def _hex(text: str, start: int, digits: int) -> str:
    """SQL for the number that hex digits of an MD5 make."""
    return f"CAST('0x' || substr(md5({text}), {start}, {digits}) AS BIGINT)"


_FAMILY = "[" + ", ".join(f"'{f}'" for f in generation.FAMILIES) + f"][1 + {_hex(f"'{SEED}:' || o_orderkey", 1, 8)} % {len(generation.FAMILIES)}]"


def _draw(i: int, low: float, high: float) -> str:
    """SQL for the i-th number of a record, between low and high to three places."""
    return f"round_even({low} + ({high} - ({low})) * ({_hex(f"'{SEED}:' || family || ':' || o_orderkey || ':{i // 4}'", 1 + 8 * (i % 4), 8)} / power(2, 32)), 3)"


#: Closed forms: what each family draws, in order, and SQL of its claims.
_CLOSED = {
    "first_order_step": ({"gain": (0.5, 10), "step": (0.5, 4), "tau": (0.1, 8)}, {"final": "gain * step", "at_tau": "gain * step * (1 - exp(-1))", "settling_2": "-tau * ln(0.02)"}),
    "first_order_frequency": ({"gain": (0.5, 10), "tau": (0.1, 5), "omega": (0.1, 20)}, {"magnitude": "gain / sqrt(1 + power(tau * omega, 2))", "phase_deg": "-degrees(atan(tau * omega))"}),
    "lead_parameters": ({"phi_deg": (10, 65), "omega_m": (0.5, 20)}, {"alpha": "(1 - sin(radians(phi_deg))) / (1 + sin(radians(phi_deg)))", "zero": "-omega_m * sqrt((1 - sin(radians(phi_deg))) / (1 + sin(radians(phi_deg))))"}),
    "crossover_margins": ({"magnitude_at_phase_crossover": (0.05, 1.5), "phase_at_gain_crossover_deg": (-200, -90)}, {"gain_margin_db": "-20 * log10(magnitude_at_phase_crossover)", "phase_margin_deg": "180 + phase_at_gain_crossover_deg"}),
    "scalar_kf_predict": ({"a": (0.5, 1.2), "x": (-5, 5), "b": (0.1, 2), "u": (-3, 3), "P": (0.1, 4), "Q": (0.01, 1)}, {"x_minus": "a * x + b * u", "P_minus": "a * a * P + Q"}),
    "iid_jump_mean_square": ({"p": (0.05, 0.95), "a1": (0.2, 1.6), "a2": (0.2, 1.6)}, {"factor": "p * a1 * a1 + (1 - p) * a2 * a2"}),
    "second_order": ({"a1": (0.2, 6), "a0": (0.5, 20)}, {"omega_n": "sqrt(a0)", "zeta": "a1 / (2 * sqrt(a0))"}),
    "small_gain": ({"g1": (0.1, 2.5), "g2": (0.1, 1.5)}, {"product": "g1 * g2"}),
    "fopdt_step": ({"delta_y": (0.5, 9), "delta_u": (0.5, 4), "t63": (4, 12), "delay": (0.1, 3)}, {"gain": "delta_y / delta_u", "tau": "t63 - delay"}),
    "scalar_stationary_covariance": ({"a": (-0.95, 0.95), "q": (0.1, 5)}, {"P": "q / (1 - a * a)"}),
}


def _closed_sql() -> str:
    parts = []
    for family, (drawn, claims) in _CLOSED.items():
        given = ", ".join(f"{_draw(i, *span)} AS {name}" for i, (name, span) in enumerate(drawn.items()))
        for claim, formula in claims.items():
            parts.append(f"SELECT o_orderkey, family, '{claim}' AS claim, round({formula}, 9) AS value FROM (SELECT o_orderkey, family, {given} FROM k WHERE family = '{family}')")
    return f"WITH k AS (SELECT o_orderkey, {_FAMILY} AS family FROM orders) " + " UNION ALL ".join(parts)


def _generated(spark, sf_dir, check=False):
    return generation.records(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SEED, check=check)


@book.query()
def generated_records(spark, sf_dir):
    """One record an order, of the family its key falls to: messages, digest, split by family, and its recomputation."""
    return _generated(spark, sf_dir, check=True).select(F.col("key").cast("long").alias("o_orderkey"), "family", "split", F.size("messages").alias("n_messages"), F.sha2(F.col("messages")[1]["content"], 256).alias("prompt_sha256"), "metadata.solution_sha256", "verified")


@book.query(_closed_sql())
def generated_closed_forms(spark, sf_dir):
    """Claims of the generated records of ten closed-form families."""
    rows = _generated(spark, sf_dir).select(F.col("key").cast("long").alias("o_orderkey"), "family", F.col("metadata.ground_truth").alias("record"))
    claims = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for f, (_, c) in _CLOSED.items() for x in (f, list(c))])
    rows = rows.filter(F.col("family").isin(*_CLOSED)).select("o_orderkey", "family", "record", F.explode(F.element_at(claims, F.col("family"))).alias("claim"))
    values = F.from_json("record", "map<string, string>")
    return rows.select("o_orderkey", "family", "claim", F.round(F.element_at(values, F.col("claim")).cast("double"), 9).alias("value"))


@F.pandas_udf(T.StringType())
def _spoilt(record: pd.Series, how: pd.Series) -> pd.Series:
    """Records with their last number claim off by a third and a bit (1), or without it (2)."""

    def off(x):
        return [off(v) if n == 0 else v for n, v in enumerate(x)] if isinstance(x, list) else (not x if isinstance(x, bool) else math.copysign(abs(x) * 4 / 3 + 1, x))

    out = []
    for text, n in zip(record, how):
        made = json.loads(text)
        claims = [c.partition(":")[0] for c in G.KINDS[made["kind"]].claims.split()]
        if n == 1:
            made[claims[-1]] = off(made[claims[-1]])
        if n == 2:
            del made[claims[0]]
        out.append(json.dumps(made))
    return pd.Series(out)


@book.query(f"""WITH k AS (SELECT {_FAMILY} AS family, o_orderkey % 3 AS how FROM orders)
SELECT family, count(*) FILTER (how = 0) AS verified, count(*) FILTER (how = 1) AS refuted, count(*) FILTER (how = 2) AS errors FROM k GROUP BY family""")
def ground_truth_audit(spark, sf_dir):
    """Records of every kind as made, with one claim off, and with one claim gone: what recomputation says of them."""
    how = (F.col("key").cast("long") % 3).cast("int")
    rows = _generated(spark, sf_dir).select("family", G.verify(_spoilt(F.col("metadata.ground_truth"), how)).alias("check"))
    return rows.groupBy("family").agg(F.count_if("check.verified").alias("verified"), F.count_if(~F.col("check.verified")).alias("refuted"), F.count_if(F.col("check.error").isNotNull()).alias("errors"))


_CELL = [f"{_hex(f"'{SEED}:matrix:' || o_orderkey", 1 + 8 * i, 8)} % 9 - 4" for i in range(4)]


@book.query(f"""WITH d AS (SELECT o_orderkey, {_CELL[0]} AS a, {_CELL[1]} AS b, {_CELL[2]} AS c, {_CELL[3]} AS d FROM orders),
e AS (SELECT *, (a + d) / 2 AS m, power((a - d) / 2, 2) + b * c AS disc FROM d),
r AS (SELECT *, m - CASE WHEN disc > 0 THEN sqrt(disc) ELSE 0 END AS low, m + CASE WHEN disc > 0 THEN sqrt(disc) ELSE 0 END AS high FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c, d ORDER BY o_orderkey) AS copy FROM r),
s AS (SELECT *, high < 0 AS stable, row_number() OVER (PARTITION BY high < 0 ORDER BY o_orderkey) AS place FROM f WHERE copy = 1 AND abs(low) >= 0.25 AND abs(high) >= 0.25)
SELECT o_orderkey, a, b, c, d, stable, place FROM s WHERE place <= 300""")
def balanced_matrices(spark, sf_dir):
    """Distinct integer matrices, 300 stable and 300 unstable, by attempt; those near the border are rejected."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{SEED}:matrix"), F.col("o_orderkey").cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % 9 - 4).alias(n) for i, n in enumerate("abcd")])
    a, b, c, d = (F.col(n) for n in "abcd")
    disc = F.pow((a - d) / 2, 2) + b * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    low, high = (a + d) / 2 - root, (a + d) / 2 + root
    label = F.when((F.abs(low) >= 0.25) & (F.abs(high) >= 0.25), high < 0)
    return sampling.balanced(rows.withColumn("stable", label), ["a", "b", "c", "d"], "stable", "o_orderkey", {"true": 300, "false": 300})


@book.query(f"""SELECT doc_id, row_number() OVER (ORDER BY -ln(1 - {_hex(f"'{SEED}:' || doc_id", 1, 13)} / power(2, 52)) / n_chars, doc_id) AS place FROM documents WHERE n_chars > 0
QUALIFY place <= 250""")
def weighted_documents(spark, sf_dir):
    """250 documents drawn by length without replacement, in the order of the draws."""
    return sampling.weighted_without(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 250, SEED).select("doc_id", "place")


@book.query(f"""WITH w AS (SELECT doc_id, n_chars * 1000000::HUGEINT AS w, sum(n_chars * 1000000::HUGEINT) OVER (ORDER BY doc_id) AS upto, sum(n_chars * 1000000::HUGEINT) OVER () AS total FROM documents WHERE n_chars > 0),
p AS (SELECT i AS draw, floor({_hex(f"'{SEED}:draw:' || i", 1, 13)} / power(2, 52) * CAST(total AS DOUBLE)) AS point FROM range(3000) AS r(i), (SELECT max(total) AS total FROM w))
SELECT draw, doc_id FROM p JOIN w ON point >= CAST(upto - w AS DOUBLE) AND point < CAST(upto AS DOUBLE)""")
def resampled_documents(spark, sf_dir):
    """3000 draws with replacement, by length."""
    return sampling.weighted_with(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 3000, SEED).select("draw", "doc_id")


_TOOLS = "[" + ", ".join(f"'{f}'" for f in sorted(generation.TOOLS)) + "]"
_MISSING = "[" + ", ".join(f"'{f}'" for f in sorted(generation.MISSING)) + "]"


@book.query(f"""WITH k AS (SELECT o_orderkey, {_hex(f"'{SEED}:refuse:' || o_orderkey", 1, 13)} / power(2, 52) < 1.0 / 7 AS refused, row_number() OVER (ORDER BY md5('{SEED}:split:' || o_orderkey), CAST(o_orderkey AS VARCHAR)) AS place, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN refused THEN {_MISSING}[1 + {_hex(f"'{SEED}:missing:' || o_orderkey", 1, 8)} % 6] ELSE {_TOOLS}[1 + {_hex(f"'{SEED}:' || o_orderkey", 1, 8)} % 3] END AS family,
  CASE WHEN place <= floor(n * 0.85) THEN 'train' ELSE 'valid' END AS split, CASE WHEN refused THEN 3 ELSE 5 END AS n_messages, true AS verified FROM k""")
def tool_trajectories(spark, sf_dir):
    """A tool call with its result, or a request that lacks data, for each order; recomputed."""
    rows = generation.trajectories(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SEED)
    return rows.select(F.col("key").cast("long").alias("o_orderkey"), "family", "split", F.size("messages").alias("n_messages"), G.verify(F.col("ground_truth"))["verified"].alias("verified"))


@book.query(f"""WITH d AS (SELECT o_orderkey, ['multiply', 'inverse', 'rank'][1 + o_orderkey % 3] AS family, {_CELL[0]} AS a, {_CELL[1]} AS b, {_CELL[2]} AS c, {_CELL[3]} AS d FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY o_orderkey) AS attempt FROM d),
v AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY attempt) AS place FROM t WHERE attempt <= 4 * CASE family WHEN 'multiply' THEN 220 WHEN 'inverse' THEN 200 ELSE 60 END
  AND CASE family WHEN 'inverse' THEN a * d <> b * c WHEN 'rank' THEN a * d = b * c ELSE true END)
SELECT o_orderkey, family, attempt, place FROM v WHERE place <= CASE family WHEN 'multiply' THEN 220 WHEN 'inverse' THEN 200 ELSE 60 END""")
def retried_tasks(spark, sf_dir):
    """Matrix tasks by quota: inverses of regular matrices, ranks of singular ones, any products; each family tries four times its quota at most."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{SEED}:matrix"), F.col("o_orderkey").cast("string")))
    family = F.element_at(F.array(F.lit("multiply"), F.lit("inverse"), F.lit("rank")), (1 + F.col("o_orderkey") % 3).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", family.alias("family"), *[(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % 9 - 4).alias(n) for i, n in enumerate("abcd")])
    regular = F.col("a") * F.col("d") != F.col("b") * F.col("c")
    valid = F.when(F.col("family") == "inverse", regular).when(F.col("family") == "rank", ~regular).otherwise(F.lit(True))
    return generation.first_successes(rows, "family", "o_orderkey", valid, {"multiply": 220, "inverse": 200, "rank": 60}).select("o_orderkey", "family", "attempt", "place")
