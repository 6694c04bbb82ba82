"""Ground truths, generators, quotas and weighted draws."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import ground_truth as G
from millrace.functions import stacked as S
from millrace.operators import dedup, generation, sampling


@pytest.fixture(scope="module")
def draw():
    return np.random.default_rng(11)


def stable(draw, n, k):
    a = draw.normal(size=(n, k, k))
    return a - (np.abs(np.linalg.eigvals(a)).max(axis=1) + 0.3)[:, None, None] * np.eye(k)


def test_stacked_algebra_meets_its_definitions(draw):
    a, b = stable(draw, 40, 3), draw.normal(size=(40, 3, 2))
    q = np.broadcast_to(np.eye(3), (40, 3, 3))
    r = np.broadcast_to(np.eye(2), (40, 2, 2))
    t = S.t
    x = S.lyapunov(a, q)
    assert np.allclose(a @ x + x @ t(a) + q, 0)
    f = a / (np.abs(np.linalg.eigvals(a)).max(axis=1) + 0.2)[:, None, None]
    x = S.stein(f, q)
    assert np.allclose(f @ x @ t(f) - x + q, 0)
    p, k = S.care(-a, b, q, r)
    assert np.allclose(-t(a) @ p - p @ a - p @ b @ t(b) @ p + q, 0, atol=1e-6) and (np.linalg.eigvals(-a - b @ k).real < 0).all()
    g = draw.normal(size=(40, 3, 3))
    p, k = S.dare(g, b, q, r)
    assert np.allclose(t(g) @ p @ (g - b @ k) + q, p) and (np.abs(np.linalg.eigvals(g - b @ k)) < 1).all()
    e, v = np.linalg.eig(a)
    assert np.allclose(S.exponential(a), v @ (np.exp(e)[:, :, None] * np.linalg.inv(v)))
    big = np.array([[[0.0, 1.0], [0.0, 0.0]], [[-300.0, 0], [0, -1]]])
    assert np.allclose(S.exponential(big), [[[1, 1], [0, 1]], [[0, 0], [0, np.exp(-1)]]])
    ad, bd = S.held(a, b, np.full(40, 0.3))
    assert np.allclose(ad, S.exponential(a * 0.3)) and np.allclose(bd, np.linalg.solve(a, (ad - np.eye(3)) @ b))
    c, adjugate = S.characteristic(g)
    assert np.allclose(c[:, -1], -np.linalg.det(g)) and np.allclose(c[0], np.poly(g[0]))
    s = 1.7
    assert np.allclose(sum(s ** (2 - i) * adjugate[:, i] for i in range(3)), np.polyval(c.T, s)[:, None, None] * np.linalg.inv(s * np.eye(3) - g))
    z = np.array([[-1.0, -2 + 1j, -2 - 1j]] * 40)
    assert S.same_roots(np.linalg.eigvals(a - b[:, :, :1] @ S.placed(a, b[:, :, :1], z)), z, 1e-4, 1e-4).all()
    assert S.roots(np.array([[0, 0, 2.0, -4.0], [1, 0, 0, -1.0]])).shape == (2, 3)


def test_roots_pair_up_under_tolerance():
    near = np.array([[1 + 1e-10 + 2j, 1 - 2j, 3]])
    assert S.same_roots(near, np.array([[1 + 2j, 1 - 2j, 3 + 0j]])).all()
    # the real parts differ by rounding, in the other order: sorting pairs them wrongly
    left, right = np.array([[1 + 1e-9 + 5j, 1 - 5j]]), np.array([[1 - 1e-9 + 5j, 1 - 5j]])
    assert S.same_roots(left, right).all() and S.same_roots(right, left).all()
    assert not S.same_roots(np.array([[1, 1, 2]]) + 0j, np.array([[1, 2, 2]]) + 0j).any()
    assert not S.same_roots(np.zeros((1, 2), complex), np.zeros((1, 3), complex)).any()


def spoilt(record, kind):
    claim, _, how = kind.claims.split()[-1].partition(":")

    def off(x):
        return [off(v) if i == 0 else v for i, v in enumerate(x)] if isinstance(x, list) else (not x if isinstance(x, bool) else x + 0.37)

    return record | {claim: off(record[claim])}


@pytest.mark.parametrize("name", sorted(G.KINDS))
def test_right_wrong_and_incomplete_records(name, draw):
    kind = G.KINDS[name]
    if kind.draw is None:
        records = [{"kind": name, "numerator": [1.0, 2.0 + i], "denominator": [1.0, 5.0, 6.0], "poles": [-3.0, -2.0], "zero": -2.0 - i, "dc_gain": (2.0 + i) / 6} for i in range(5)]
    else:
        records = G.make_records(name, draw.random((30, generation.SLOTS)))
    texts = [json.dumps(r) for r in records]
    assert len(set(texts)) > 3
    verified, errors = G.check_records(texts)
    assert all(verified), [t for t, v in zip(texts, verified) if not v][:1]
    assert not any(errors)
    verified, errors = G.check_records([json.dumps(spoilt(r, kind)) for r in records])
    assert not any(verified) and not any(errors)
    lack = [json.dumps({k: v for k, v in r.items() if k != kind.claims.split()[0].partition(":")[0]}) for r in records]
    verified, errors = G.check_records(lack)
    assert set(verified) == {None} and all("missing" in e for e in errors)


def test_independent_values_of_a_few_kinds():
    x, y = np.exp(-0.05), np.exp(-0.1)
    for record in (
        {"kind": "zoh_discretization", "A": [[0, 1], [-2, -3]], "B": [[0], [1]], "sample_time": 0.05, "Ad": [[2 * x - y, x - y], [2 * y - 2 * x, 2 * y - x]], "Bd": [[0.5 - x + y / 2], [x - y]]},
        {"kind": "mpc_box_qp", "x0": 4.0, "r": 1.0, "limit": 1.0, "U": [-1.0, -1.0], "X": [3.0, 2.0], "cost": 15.0},
        {"kind": "routh_quartic", "coefficients": [1, 2, 3, 4, 5], "first_column": [1, 2, 1, -6, 5], "poles": G.pairs(np.roots([1, 2, 3, 4, 5])).tolist(), "stable": False},
        {"kind": "underspecified_requirements", "can_compute_final_design": False, "forbid_numeric_controller_coefficients": True, "required_answer_terms": list("abcde")},
        {"kind": "continuous_lti_eigenvalue_stability", "A": [[-1, 2], [0, -3]], "asymptotically_stable": True},
    ):
        assert G.check_records([json.dumps(record)]) == ([True], [None]), record["kind"]
    assert G.required_terms({"can_compute_final_design": False, "forbid_numeric_controller_coefficients": True, "required_answer_terms": ["a", "b", "c", "d", "Sample  time"]}, "A b c d sample\n time") == "no Sample  time"


def test_bad_rows_do_not_spoil_their_stack():
    good = {"kind": "continuous_lyapunov", "A": [[-1, 0], [0, -2]], "Q": [[2, 0], [0, 4]], "P": [[1, 0], [0, 1]]}
    texts = [json.dumps(good), json.dumps(good | {"A": [[1, 0], [0, -1]]}), "no json", "[1]", "null", json.dumps({"kind": "nothing"}), json.dumps(good | {"Q": "x"}), json.dumps(good)]
    verified, errors = G.check_records(texts)
    assert verified == [True, None, None, None, None, None, None, True] and [e is None for e in errors] == [v is True for v in verified]


def test_records_depend_on_seed_family_and_key_alone(spark):
    keys = spark.range(400).withColumnRenamed("id", "k")
    one = {r.key: r for r in generation.records(keys, "k", 3).collect()}
    again = {r.key: r for r in generation.records(keys.filter("k % 7 = 2").repartition(5), "k", 3).collect()}
    assert all(one[k] == r for k, r in again.items()) and len(again) == 57
    other = generation.records(keys, "k", 4).collect()
    assert sum(one[r.key].metadata.ground_truth == r.metadata.ground_truth for r in other) == 0
    apart = {r.family for r in one.values() if r.split == "test"}
    assert apart and not apart & {r.family for r in one.values() if r.split == "train"}
    r = one["5"]
    assert [m.role for m in r.messages] == ["system", "user", "assistant"] and json.loads(r.metadata.ground_truth)["kind"] == r.family


def test_quotas_take_first_attempts(spark):
    draw = np.random.default_rng(2)
    rows = [(i, int(draw.integers(0, 60)), None if i % 11 == 0 else bool(draw.random() < 0.8), "x") for i in range(500)]
    rows = [(i, v, None if i % 11 == 0 else v < 45, p) for i, v, _, p in rows]
    seen, made, want = set(), {True: 0, False: 0}, []
    for i, v, label, _ in rows:
        if v in seen or i > 300:
            continue
        seen.add(v)
        if label is not None and made[label] < {True: 20, False: 5}[label]:
            made[label] += 1
            want.append((i, v, label, made[label]))
    df = spark.createDataFrame(rows, "n long, v int, ok boolean, place string").repartition(6)
    got = sampling.balanced(df, ["v"], "ok", "n", {"true": 20, "false": 5}, most=300).collect()
    assert sorted((r.n, r.v, r.ok, r.place) for r in got) == sorted(want)


def test_weighted_draws(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 10, 100.0).when(F.col("id") < 900, 1.0).otherwise(0.0).alias("w"), F.lit(1).alias("place"), F.lit(2).alias("slice"))
    first = sampling.weighted_without(rows, "w", "k", 50, 1).collect()
    assert len({r.k for r in first}) == 50 and sorted(r.place for r in first) == list(range(1, 51)) and all(r.w > 0 for r in first)
    assert sorted(map(repr, sampling.weighted_without(rows.repartition(7), "w", "k", 50, 1).collect())) == sorted(map(repr, first))
    assert np.mean([sum(r.k < 10 for r in sampling.weighted_without(rows, "w", "k", 12, s).collect()) for s in range(3)]) > 3
    assert sampling.weighted_without(rows, "w", "k", 5000, 1).count() == 900
    drawn = sampling.weighted_with(rows, "w", "k", 20_000, 5).collect()
    assert sorted(r.draw for r in drawn) == list(range(20_000))
    assert abs(sum(r.k < 10 for r in drawn) / 20_000 - 1000 / 1890) < 0.02 and max(r.k for r in drawn) < 900
    assert sampling.weighted_with(rows.limit(0), "w", "k", 10, 5).count() == 0


def test_names_of_rows_do_not_clash(spark):
    odd = spark.createDataFrame([(1, "a", 5, 1), (2, "a", 4, 1), (2, "b", 4, 2), (2, "b", 4, 2)], "key long, row string, first long, o0 int").withColumn("place", F.lit(9)).withColumn("_key", F.col("key")).withColumn("_part", F.lit(1))
    got = dedup.first_of(odd, "row", ["first", "key"]).collect()
    assert sorted((r.key, r.row, r.is_first) for r in got) == [(1, "a", False), (2, "a", True), (2, "b", False), (2, "b", True)]
    assert sorted((r.row, r["first"], r.place, r.size) for r in sampling.places(odd, "row", ["first", "key"]).collect()) == [("a", 4, 1, 2), ("a", 5, 2, 2), ("b", 4, 1, 2), ("b", 4, 2, 2)]
    turns = spark.createDataFrame([(1, 1, "user", 3), (1, 2, "assistant", 3), (1, 3, "user", 3)], "row long, used long, i string, user long")
    assert sampling.newest_within(turns, "row", "used", "user", "i", 7).count() == 1


def test_split_spreads_a_hot_pool(spark):
    docs = spark.range(5000).select(F.col("id").cast("string").alias("doc_key"), F.when(F.col("id") < 4000, "hot").when(F.col("id") < 4999, "cold").otherwise("one").alias("pool"))
    got = {r.pool: r.n for r in sampling.stratified_split(docs, 5.0).filter("split = 'valid'").groupBy("pool").agg(F.count("*").alias("n")).collect()}
    assert got == {"hot": 200, "cold": 50, "one": 1}


def test_trajectories_hold_their_calls(spark):
    keys = spark.range(300).withColumnRenamed("id", "k")
    rows = generation.trajectories(keys, "k", 5).collect()
    assert len(rows) == 300 and sum(r.split == "train" for r in rows) == 255
    lacking = [r for r in rows if r.family in generation.MISSING]
    assert 15 < len(lacking) < 90
    for r in rows:
        roles = [m.role for m in r.messages]
        truth = json.loads(r.ground_truth)
        if r.family in generation.MISSING:
            assert roles == ["system", "user", "assistant"] and G.required_terms(truth, r.messages[2].content) is None
        else:
            assert roles == ["system", "user", "assistant", "tool", "assistant"]
            call = json.loads(r.messages[2].content.removeprefix("<tool_call>").removesuffix("</tool_call>"))
            assert call["name"] == generation.TOOLS[r.family] and truth == {"kind": r.family} | call["arguments"] | json.loads(r.messages[3].content)
    assert {r.key: r for r in generation.trajectories(keys.filter("k % 5 = 1").repartition(3), "k", 5).collect()}["6"].messages == next(r for r in rows if r.key == "6").messages


def test_first_successes_lose_patience(spark):
    rows = spark.range(100).select(F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"))
    got = generation.first_successes(rows, "kind", "n", F.col("n") >= 10, {"a": 3, "b": 1}).collect()
    assert sorted((r.kind, r.n, r.attempt, r.place) for r in got) == [("a", 10, 6, 1), ("a", 12, 7, 2), ("a", 14, 8, 3)]


def test_a_spoilt_claim_is_never_the_claim(spark):
    """The last number claim of these records is -3, which a third and one more leave alone."""
    from millrace.plans.generation import _spoilt

    keys = spark.createDataFrame([(550621,), (487399,), (543883,)], "k long")
    rows = generation.records(keys, "k", 7).select(F.col("metadata.ground_truth").alias("g"))
    found = rows.select(G.verify(F.col("g")).alias("a"), G.verify(_spoilt(F.col("g"), F.lit(1))).alias("b")).select("a.verified", "b.verified").collect()
    assert [tuple(r) for r in found] == [(True, False)] * 3


def test_records_are_made_and_checked_by_one_worker_a_task(spark):
    keys = spark.range(300).withColumnRenamed("id", "k")
    found = generation.records(keys, "k", 7, check=True)
    plan = found.select("key", "verified", "metadata.solution_sha256")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
    plain = generation.records(keys, "k", 7)
    want = plain.select("*", G.verify(F.col("metadata.ground_truth"))["verified"].alias("verified"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
