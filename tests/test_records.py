"""Record checks and choices, and positions over ranges."""

import collections

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import records, sampling
from millrace.sources import files


def test_requests_repeat_and_refuse(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = records.requested(rows, "k", [2, 1, 2]).sort("place").collect()
    assert [r.v for r in got] == ["b", "a", "b"]
    with pytest.raises(ValueError, match="9"):
        records.requested(rows, "k", [9, 1])


def test_rejected_candidates(spark):
    rows = spark.createDataFrame(
        [(1, ["x/FrontMatter"], "oa_candidate"), (2, ["x/bfm"], "chosen"), (3, ["x", "x/bfm"], "oa_candidate"), (4, [], "oa_candidate"), (5, None, "oa_candidate")],
        "k int, candidates array<string>, status string",
    )
    got = {r.k: (r.candidates, r.status) for r in records.without_rejected(rows).collect()}
    assert got == {1: ([], "metadata_only"), 2: ([], "chosen"), 3: (["x", "x/bfm"], "oa_candidate"), 4: ([], "oa_candidate"), 5: (None, "oa_candidate")}


def test_classes_left(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, []), (4, None)], "k int, c array<string>")
    assert [r.k for r in rows.filter(records.has_class_left(F.col("c"), ["a"])).collect()] == [2]
    assert rows.filter(records.has_class_left(F.col("c"), [])).count() == 2


def test_class_report_of_nothing(spark):
    rows = spark.createDataFrame([], "c string")
    got = {(r["class"], r.rule): r.passed for r in records.class_report(rows, "c", ["a"], ["b"], {"a": 0.1}).collect()}
    assert got == {("a", "required"): False, ("b", "forbidden"): True, ("a", "least"): False}


def test_rules(spark):
    rows = spark.createDataFrame([([4, 6], 50), ([11, -1], 49), (None, None)], "p array<int>, w int")
    got = [r[0] for r in rows.select(records.rubric_errors(F.col("p"), F.col("w"))).collect()]
    assert got == [[], ["points_not_positive", "max_words_below_50"], ["points_not_positive", "points_not_10"]]
    rows = spark.createDataFrame([("ask for the\n Model; K_p: -3",), ("ask for the model",)], "t string")
    assert [r[0] for r in rows.select(records.answer_errors(F.col("t"), ["THE model", "rate"])).collect()] == [["omits rate", "made-up value"], ["omits rate"]]
    rows = spark.createDataFrame([("AddBlock(x", ), ("sim(a[1])",)], "t string")
    assert [r[0] for r in rows.select(records.code_errors(F.col("t"), ["SIM"])).collect()] == [["missing SIM", "banned addblock(", "unbalanced parentheses"], []]


def test_strings(spark):
    row = spark.createDataFrame([("ﬁne–A-B  x", r"\\zeta \\[2pt] \\[ y \\|", "```PYTHON\n 1 \n```\n```python\n2```", "a/b c")], "a string, b string, c string, d string")
    got = row.select(X.compatible(F.col("a")), X.mended_latex(F.col("b")), X.fenced_code(F.col("c"), "python"), X.safe_filename(F.col("d"))).first()
    assert tuple(got) == ("fine–a b x", r"\zeta \\[2pt] \[ y \|", "1", "a_b_c.pdf")


def test_places_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else None, i * 7919 % 1000, i) for i in range(600)]
    got = sampling.places(spark.createDataFrame(rows, "g string, k int, i int"), "g", ["k", "i"]).collect()
    sizes = collections.Counter(g for g, *_ in rows)
    want = {(g, k, i, n, sizes[g]) for g in sizes for n, (k, i) in enumerate(sorted((k, i) for h, k, i in rows if h == g), 1)}
    assert {(r.g, r.k, r.i, r.place, r["size"]) for r in got} == want


def test_chunk_union(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text": "x", "n": 1}\n{"text": ""}\n')
    (tmp_path / "b.json").write_text('{"text": "y"}\n{"other": 1}\n')
    got = files.union_chunks(spark, [f"{tmp_path}/{n}.json" for n in "abc"])
    assert sorted((r.text, r.n, r.chunk_file) for r in got.collect()) == [("x", 1, "a.json"), ("y", None, "b.json")]
    with pytest.raises(FileNotFoundError):
        files.union_chunks(spark, [f"{tmp_path}/c.json"])
