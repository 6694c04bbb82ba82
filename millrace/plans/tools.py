"""Queries of the numeric tools and of answer scoring, over columns of the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import calls, matrix, numeric, systems, verification
from ..functions import text as X
from ..operators import evaluation, gates
from .book import Book, table

book = Book()
c = F.col


def _line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@book.query("""SELECT l_orderkey, l_linenumber, round(kp, 6) AS kp, round(kp / ti, 6) AS ki, round(kp * td, 6) AS kd
FROM (SELECT *, 0.6 / ((1 + l_discount) * (1 + l_tax) / l_quantity) AS kp, l_quantity AS ti, 0.5 * (1 + l_tax) AS td FROM lineitem)""")
def pid_tune(spark, sf_dir):
    rows = _line(spark, sf_dir).select("l_orderkey", "l_linenumber", numeric.pid_tuning(1 + c("l_discount"), c("l_quantity"), 1 + c("l_tax")).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(f"r.{n}", 6).alias(n) for n in ("kp", "ki", "kd")])


@book.query("""SELECT l_orderkey, l_linenumber, round(greatest(wanted, bound), 6) + 0 AS u, wanted < bound AS active
FROM (SELECT *, -l_quantity / 10 AS wanted, -1.2 * (l_discount - l_tax) AS bound FROM lineitem)""")
def cbf_filter(spark, sf_dir):
    rows = _line(spark, sf_dir).select("l_orderkey", "l_linenumber", numeric.barrier_filter(c("l_discount"), -c("l_quantity") / 10, F.lit(1.2), c("l_tax")).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", F.round("r.u", 6).alias("u"), "r.active")


@book.query("""SELECT l_orderkey, l_linenumber, round((-2 * (l_quantity - 10) - l_discount * l_quantity) / (1 + l_tax), 6) + 0 AS u FROM lineitem""")
def dynamic_inversion(spark, sf_dir):
    rows = _line(spark, sf_dir).select("l_orderkey", "l_linenumber", numeric.dynamic_inversion(c("l_discount"), 1 + c("l_tax"), c("l_quantity"), F.lit(10.0), F.lit(2.0)).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", F.round("r.u", 6).alias("u"))


@book.query("""SELECT l_orderkey, l_linenumber, round((-l_quantity * l_discount - l_tax * l_quantity - 1) / 2, 6) AS u,
  round(-l_tax / 2 + sqrt(greatest(l_tax * l_tax - 4 * l_quantity, 0)) / 2, 6) AS re1, round(sqrt(greatest(4 * l_quantity - l_tax * l_tax, 0)) / 2, 6) AS im1,
  (-l_tax / 2 + sqrt(greatest(l_tax * l_tax - 4 * l_quantity, 0)) / 2) < 0 AS stable FROM lineitem""")
def feedback_linearization(spark, sf_dir):
    r = numeric.feedback_linearization(F.lit(1.0), F.lit(2.0), c("l_quantity"), c("l_tax"), c("l_discount"), c("l_quantity"))
    rows = _line(spark, sf_dir).select("l_orderkey", "l_linenumber", r.alias("r"))
    return rows.select("l_orderkey", "l_linenumber", F.round("r.u", 6).alias("u"), F.round("r.re1", 6).alias("re1"), F.round("r.im1", 6).alias("im1"), "r.stable")


@book.query("""SELECT l_orderkey, l_linenumber, round(p, 6) AS product, p < 1 AS certified, round(CASE WHEN p < 1 THEN 1 - p ELSE 0 END, 6) AS margin FROM (SELECT *, l_discount * l_quantity AS p FROM lineitem)""")
def small_gain(spark, sf_dir):
    rows = _line(spark, sf_dir).select("l_orderkey", "l_linenumber", numeric.small_gain(c("l_discount"), c("l_quantity")).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", F.round("r.product", 6).alias("product"), "r.certified", F.round("r.margin", 6).alias("margin"))


@book.query("""SELECT l_orderkey, l_linenumber, round(greatest(l_discount * l_quantity, l_tax * 3), 6) AS peak, greatest(l_discount * l_quantity, l_tax * 3) < 1 AS satisfied FROM lineitem""")
def peak_product(spark, sf_dir):
    r = numeric.peak_product(F.array("l_discount", "l_tax"), F.array(c("l_quantity"), F.lit(3.0)))
    return _line(spark, sf_dir).select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", F.round("r.peak", 6).alias("peak"), "r.satisfied")


@book.query("""SELECT l_orderkey, l_linenumber, round(14 / n * 1, 6) AS u1, round(14 / n * l_quantity, 6) AS u2, round(14 / sqrt(n), 6) AS norm FROM (SELECT *, 1 + l_quantity * l_quantity AS n FROM lineitem)""")
def allocation_norm(spark, sf_dir):
    rows = _line(spark, sf_dir).select("l_orderkey", "l_linenumber", numeric.allocation(F.array(F.lit(1.0), c("l_quantity")), F.lit(14.0)).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", F.round(c("r.u")[0], 6).alias("u1"), F.round(c("r.u")[1], 6).alias("u2"), F.round("r.norm", 6).alias("norm"))


@book.query("""SELECT l_orderkey, l_linenumber, round(res, 6) AS residual, abs(res) > 1e-4 AS detected, CASE WHEN abs(l_discount * 2) > 1e-9 THEN round(-res / (l_discount * 2), 6) END AS loss
FROM (SELECT *, l_quantity - (l_discount * 2 + l_tax * 3) AS res FROM lineitem)""")
def fault_isolation(spark, sf_dir):
    r = numeric.fault_isolation(F.array("l_discount", "l_tax"), F.array(F.lit(2.0), F.lit(3.0)), c("l_quantity"))
    rows = _line(spark, sf_dir).select("l_orderkey", "l_linenumber", r.alias("r"))
    return rows.select("l_orderkey", "l_linenumber", F.round("r.residual", 6).alias("residual"), "r.detected", F.round(c("r.losses")[0], 6).alias("loss"))


def _cubic(a, b, d, e):
    return f"({e} > 0 AND {a} > 0 AND {b} > 0 AND {d} > 0 AND {b} * {d} > {a} * {e})"


@book.query(f"""WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity AS a0, l_quantity + 1 AS a1, 2.0 AS b0, 2.4 AS b1, 1 + l_tax AS d0, 5 + l_tax AS d1, 1.0 AS e0, 1.2 AS e1 FROM lineitem)
SELECT l_orderkey, l_linenumber, {_cubic('a0', 'b0', 'd1', 'e1')} AND {_cubic('a1', 'b1', 'd0', 'e0')} AND {_cubic('a1', 'b0', 'd0', 'e1')} AND {_cubic('a0', 'b1', 'd1', 'e0')} AS robust FROM k""")
def interval_cubic(spark, sf_dir):
    low = F.array(c("l_quantity"), F.lit(2.0), 1 + c("l_tax"), F.lit(1.0))
    high = F.array(c("l_quantity") + 1, F.lit(2.4), 5 + c("l_tax"), F.lit(1.2))
    return _line(spark, sf_dir).select("l_orderkey", "l_linenumber", numeric.interval_cubic_is_hurwitz(low, high).alias("robust"))


@book.query("""WITH k AS (SELECT p_partkey AS id, 1 + p_partkey % 10 AS gain, p_size / 10 AS tau, p_size AS i FROM part)
SELECT id, gain, round(gain / sqrt(1 + tau * tau), 6) AS magnitude, round(-degrees(atan(tau)), 6) AS phase, round(1 - exp(-1), 6) AS at_tau, round(-ln(0.02) * tau, 6) AS settling, CAST(round(0.4 + 0.035 * i, 6) AS DOUBLE) AS parameter FROM k""")
def gen_families_native(spark, sf_dir):
    """Closed-form rows of first-order families, a part each."""
    tau, gain = c("p_size") / 10, 1 + c("p_partkey") % 10
    return table(spark, sf_dir, "part").select(
        c("p_partkey").alias("id"), gain.alias("gain"), F.round(gain / F.sqrt(1 + tau * tau), 6).alias("magnitude"), F.round(-F.degrees(F.atan(tau)), 6).alias("phase"),
        F.round(1 - F.exp(F.lit(-1.0)), 6).alias("at_tau"), F.round(-F.ln(F.lit(0.02)) * tau, 6).alias("settling"), F.round(0.4 + 0.035 * c("p_size"), 6).alias("parameter"),
    )


def _m(*rows):
    """A matrix column."""
    as_double = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.array(*[F.array(*map(as_double, r)) for r in rows])


@book.query("""WITH k AS (SELECT p_partkey AS id, p_size AS k, p_size % 4 AS d FROM part),
e AS (SELECT *, d * d / 4 - k AS disc FROM k), r AS (SELECT *, -k + sqrt(k * k + 10) AS k1 FROM e)
SELECT id, round(-d / 2 - CASE WHEN disc > 0 THEN sqrt(disc) ELSE 0 END, 6) AS slowest_re, round(CASE WHEN disc < 0 THEN -sqrt(-disc) ELSE 0 END, 6) AS slowest_im, d > 0 AS stable,
  CASE WHEN id % 2 = 0 OR k = 0 THEN 0 + CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END ELSE 2 END AS rank, round(k1, 6) AS k1, round(-d + sqrt(d * d + 2 * k1 + 1), 6) AS k2 FROM r""")
def matrix_tools(spark, sf_dir):
    """Oscillators made from parts: an eigenvalue, stability, observability rank (of no output at even keys), and the regulator's gains."""
    k, d = c("p_size"), c("p_size") % 4
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), _m((0, 1), (-k, -d)).alias("a"))
    rows = rows.select("id", matrix.eigen_analysis("a", F.lit(False)).alias("e"), matrix.observability("a", _m((0, c("id") % 2))).alias("o"), matrix.continuous_lqr("a", _m((0,), (1,)), _m((10, 0), (0, 1)), _m((1,))).alias("g"))
    value = c("e.values")[0]
    return rows.select("id", F.round(value[0], 6).alias("slowest_re"), (F.round(value[1], 6) + 0).alias("slowest_im"), "e.stable", c("o.rank").alias("rank"), F.round(c("g.k")[0][0], 6).alias("k1"), F.round(c("g.k")[0][1], 6).alias("k2"))


@book.query("""WITH k AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS q, CAST(p_partkey % 7 - 3 AS DOUBLE) AS r, CAST(p_size % 5 AS DOUBLE) AS z FROM part)
SELECT id, [1.0, -(1 + r) + 0, r - 2 * q] AS denominator, [z, z * -(1 + r) + 3 + 0, z * (r - 2 * q) - r + q + 4 - 2] AS numerator FROM k""")
def transfer_functions(spark, sf_dir):
    """Transfer functions of second-order systems made from parts."""
    q, r, z = c("p_size"), c("p_partkey") % 7 - 3, c("p_size") % 5
    made = systems.transfer_function(_m((1, q), (2, r)), _m((1,), (1,)), _m((1, 2)), _m((z,)))
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), made.alias("r"))
    six = lambda x: F.transform(x, lambda v: F.round(v, 6) + 0)
    return rows.select("id", six(c("r.denominator")).alias("denominator"), six(c("r.numerator")).alias("numerator"))


@book.query("""WITH k AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS p, CAST(p_partkey % 7 AS DOUBLE) AS q, CAST(p_partkey % 3 AS DOUBLE) AS r FROM part), d AS (SELECT *, p * r - q * 2 AS det FROM k)
SELECT id, round(det, 6) AS determinant, p + r AS trace, CASE WHEN det = 0 THEN (CASE WHEN p = 0 AND q = 0 AND r = 0 THEN 0 ELSE 1 END) ELSE 2 END::DOUBLE AS rank, CASE WHEN det <> 0 THEN round(r / det, 6) + 0 END AS inverse11,
  det = 0 AS singular, p * p + 2 * q AS square11, [p, 2] AS transposed1 FROM d""")
def matrix_arithmetic(spark, sf_dir):
    """Operations on matrices made from parts; singular ones have no inverse but a reason."""
    a = _m((c("p_size"), c("p_partkey") % 7), (2, c("p_partkey") % 3))
    none = F.lit(None).cast("array<array<double>>")
    op = lambda name, other=none: systems.arithmetic(F.lit(name), c("a"), other)
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), a.alias("a"))
    rows = rows.select("id", op("determinant").alias("d"), op("trace").alias("t"), op("rank").alias("k"), op("inverse").alias("i"), op("multiply", c("a")).alias("m"), op("transpose").alias("p"))
    return rows.select("id", (F.round("d.value", 6) + 0).alias("determinant"), c("t.value").alias("trace"), c("k.value").alias("rank"), (F.round(c("i.result")[0][0], 6) + 0).alias("inverse11"), (c("i.status") == "error").alias("singular"), c("m.result")[0][0].alias("square11"), c("p.result")[0].alias("transposed1"))


@book.query("""WITH w AS (SELECT i, power(10, -3 + 7 * i / 1999) AS w FROM range(2000) AS r(i)), k AS (SELECT DISTINCT p_size AS k FROM part),
g AS (SELECT k, i, w, k / (w * sqrt(1 + w * w) * sqrt(4 + w * w)) AS m, -90 - degrees(atan(w)) - degrees(atan(w / 2)) AS p FROM k, w),
x AS (SELECT k, arg_min(w, (abs(m - 1), i)) AS gain_crossover, 180 + arg_min(p, (abs(m - 1), i)) AS phase_margin, arg_min(w, (abs(p + 180), i)) AS phase_crossover, 1 / arg_min(m, (abs(p + 180), i)) AS gain_margin FROM g GROUP BY k)
SELECT p_partkey AS id, round(gain_crossover, 6) AS gain_crossover, round(phase_margin, 6) AS phase_margin, round(phase_crossover, 6) AS phase_crossover, round(gain_margin, 6) AS gain_margin, 1 AS gain_crossings,
  CASE WHEN p_size > 6 THEN 2 ELSE 0 END AS closed_poles, 0 AS open_poles, CASE WHEN p_size > 6 THEN 2 ELSE 0 END AS encirclements, 1 AS at_origin FROM part JOIN x ON k = p_size""")
def loop_margins(spark, sf_dir):
    """Margins on the grid, and encirclements from root counts, of k / (s (s + 1) (s + 2))."""
    num, den = F.array(c("p_size").cast("double")), F.array(*[F.lit(x) for x in (1.0, 3.0, 2.0, 0.0)])
    rows = table(spark, sf_dir, "part").filter("p_size is not null").select(c("p_partkey").alias("id"), systems.stability_margins(num, den).alias("m"), systems.nyquist(num, den).alias("n"))
    margins = [F.round(f"m.{x}", 6).alias(x) for x in ("gain_crossover", "phase_margin", "phase_crossover", "gain_margin")]
    return rows.select("id", *margins, "m.gain_crossings", "n.closed_poles", "n.open_poles", "n.encirclements", "n.at_origin")


_SCHEMA = '{"properties": {"A": {"type": "array", "items": {"type": "array", "items": {"type": "number"}}}, "n": {"type": "integer"}}, "required": ["A", "n", "b"]}'


@book.query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 3 THEN NULL ELSE '{"A":[[' || p_size || ',2],[3,' || CASE p_size % 4 WHEN 2 THEN '"x"' ELSE '4' END || ']],"n":' || CASE p_size % 4 WHEN 1 THEN '"7"' ELSE '7' END || ',"b":0}' END AS arguments,
  CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '.n: not a integer' WHEN 2 THEN '.A[1][1]: not a number' ELSE 'arguments: not an object' END AS errors FROM part""")
def coerced_arguments(spark, sf_dir):
    """Arguments made from parts whose matrices came as text, under a schema."""
    kind = c("p_size") % 4
    n = c("p_size").cast("string")
    text = F.when(kind == 0, F.concat(F.lit('{"A": "[['), n, F.lit(' 2] [3 4]]", "n": 7, "b": 0}'))).when(kind == 1, F.concat(F.lit('{"A": ["['), n, F.lit(', 2]", "[3, 4]"], "n": "7", "b": 0}')))
    text = text.when(kind == 2, F.concat(F.lit('{"A": "[['), n, F.lit(', 2], [3, \\"x\\"]]", "n": 7, "b": 0}'))).otherwise("[1, 2]")
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), calls.coerced(text, F.lit(_SCHEMA)).alias("r"))
    return rows.select("id", "r.arguments", F.array_join("r.errors", "|").alias("errors"))


@book.query("""WITH a AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(round_even((CASE WHEN contains(t, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'thed') OR contains(t, 'tion') THEN 1 ELSE 0 END) / 2 * 100.0, 1) AS DOUBLE) AS concepts,
  CASE WHEN regexp_matches(t, 'missing|cannot|specify|please provide|uncontrollable|unobservable|undefined|invalid|positive semi-definite|zero control authority|sampling period|not possible|cannot be inverted|violates|requires') THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS refusal,
  CASE WHEN len(regexp_extract_all(t, '\\S+')) < 50 THEN 30.0::DOUBLE ELSE 80.0::DOUBLE END AS length FROM a""".replace("contains(t, 'the') THEN 1", "contains(t, 'then') THEN 1").replace("\\\\S", r"\S"))
def answer_scores(spark, sf_dir):
    """Concept, refusal and length scores of assistant turns."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    concepts = F.array(F.lit("then"), F.lit("thed tion"))
    return rows.select("conv_id", "turn", evaluation.concept_score(c("text"), concepts)["score"].alias("concepts"), evaluation.refusal_score(c("text")).alias("refusal"), evaluation.length_score(c("text")).alias("length"))


@book.query("""WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations WHERE role = 'assistant'),
s AS (SELECT 'p' || (item_id % 5) AS pillar, CASE WHEN len(regexp_extract_all(coalesce(r.text, ''), '\\S+')) < 50 THEN 30.0 ELSE 80.0 END AS score FROM benchmark b LEFT JOIN r ON r.conv_id = b.item_id AND r.i = 1)
SELECT pillar, count(*) AS items, CAST(round_even(avg(score), 1) AS DOUBLE) AS score FROM s GROUP BY pillar UNION ALL SELECT 'OVERALL', count(*), CAST(round_even(avg(score), 1) AS DOUBLE) FROM s""".replace("\\\\S", r"\S"))
def pillar_scores(spark, sf_dir):
    """Items joined with the last response of their id, scored, by pillar and over all."""
    items = table(spark, sf_dir, "benchmark").select(c("item_id").cast("string").alias("id"), F.concat(F.lit("p"), (c("item_id") % 5).cast("string")).alias("pillar"))
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    responses = turns.select(F.lit(None).cast("string").alias("id"), c("conv_id").cast("string").alias("benchmark_id"), c("turn").alias("ord"), c("text").alias("response"))
    return evaluation.pillar_report(evaluation.with_responses(items, responses).withColumn("score", evaluation.length_score(c("response"))))


@book.query("""SELECT event_id, CAST(CASE WHEN value = 0 THEN 0 ELSE round_even(value * power(10, 5 - floor(log10(abs(value)))), 0) / power(10, 5 - floor(log10(abs(value)))) END AS DOUBLE) AS value FROM events""")
def significant_figures(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.significant(c("value"), 6).alias("value"))


@book.query("""SELECT user_id, len(v) > 25 AS degenerate, CAST(len(v) AS INTEGER) AS n FROM (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id)""")
def degenerate_arrays(spark, sf_dir):
    """Users whose values form an array too long to be an argument."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    counts = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    # users with more are degenerate by their number; only arrays of at most 25 values are made
    few = rows.join(counts.filter("n <= 25").select("user_id"), "user_id").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    judged = counts.join(few.select("user_id", gates.degenerate_array(c("v")).alias("run")), "user_id", "left")
    return judged.select("user_id", F.coalesce("run", F.lit(True)).alias("degenerate"), c("n").cast("int").alias("n"))


def _records(parts):
    """Records of six kinds over parts (id, n), those of every fourth n with one value off, those of every fifth without one."""
    i = c("n").cast("double")
    m = lambda **values: F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("double") for v in values.values()]))
    f = lambda x: F.lit(float(x))
    off = F.when(c("n") % 4 == 0, 0.5).otherwise(0.0)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<double>>"))
    kinds = {
        "scalar_cbf_filter": m(x=i / 10, x_min=f(1), alpha=f(2), u_nom=-i, h=i / 10 - 1, u=F.greatest(-i, -2 * (i / 10 - 1)) + off),
        "first_order_step": m(gain=i, tau=i / 7, final=i, at_tau=i * (1 - F.exp(f(-1))) + off, settling=-i / 7 * F.ln(f(0.02))),
        "scalar_stationary_covariance": m(a=i / 100, q=f(3), p=3 / (1 - i * i / 10_000) + off),
        "small_gain": m(g1=i / 20, g2=f(0.8), product=i / 20 * 0.8 + off, certified=(i / 20 * 0.8 < 1).cast("double")),
        "crossover_margins": m(magnitude=i / 40, phase_deg=-i, gain_margin=40 / i, gain_margin_db=-20 * F.log10(i / 40), phase_margin=180 - i + off),
        "zero_dynamics": m(a=i - 20, zero=20 - i + off, minimum_phase=(i > 20).cast("double")),
    }
    rows = None
    for kind, s in kinds.items():
        part = parts.select("id", F.lit(kind).alias("kind"), F.when(c("n") % 5 == 0, F.map_filter(s, lambda k, v: k != s_names(kind)[0])).otherwise(s).alias("s"), none.alias("v"))
        rows = part if rows is None else rows.unionAll(part)
    return rows


def s_names(kind: str) -> tuple[str, ...]:
    """The value that the incomplete records of a kind lack."""
    return {"scalar_cbf_filter": ("u",), "first_order_step": ("settling",), "scalar_stationary_covariance": ("p",), "small_gain": ("g1",), "crossover_margins": ("magnitude",), "zero_dynamics": ("zero",)}[kind]


@book.query("""SELECT k AS kind, p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 4 <> 0 END AS verified
FROM part, unnest(['scalar_cbf_filter', 'first_order_step', 'scalar_stationary_covariance', 'small_gain', 'crossover_margins', 'zero_dynamics']) AS u(k)""")
def ground_truth_checks(spark, sf_dir):
    """Recomputed ground truths: right, wrong, and incomplete ones."""
    parts = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_size").alias("n"))
    return _records(parts).select("kind", "id", verification.verified(c("kind"), c("s"), c("v")).alias("verified"))
