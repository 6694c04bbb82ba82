"""Joins that promise to miss nothing, and stacked system tools."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import calls, systems
from millrace.operators import dedup, matching, retrieval, sparse


def titles(draw, n):
    roots = ["optimisation of control", "linear algebra", "feedback systems an introduction", "a", "of", "the art of robust design", "modern control engineering fifth", "nonlinear", "xy"]
    out = []
    for _ in range(n):
        t = list(draw.choice(roots) + (" " + draw.choice(roots) if draw.random() < 0.3 else ""))
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(t) + 1)
            if draw.random() < 0.5:
                t.insert(at, draw.choice("abcxyz "))
            elif t:
                del t[min(at, len(t) - 1)]
        out.append("".join(t))
    return out


def test_fuzzy_join_misses_no_acceptable_pair(spark):
    draw = random.Random(4)
    name = lambda: [f"A. {draw.choice(['Smith', 'Smith', 'Lee', 'Roe'])}" for _ in range(draw.randint(0, 2))]
    targets = [(i, t, name()) for i, t in enumerate([*titles(draw, 60), "Optimisation", "", None])]
    works = [(i, t, name(), draw.randint(0, 5)) for i, t in enumerate([*titles(draw, 300), "optimization", "", None])]
    targets.append((90, "Optimisation", ["B. Smith"]))
    works.append((900, "Optimization", ["C Smith"], 1))
    clean = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split())
    last = lambda names: {n.lower().replace(".", " ").split()[-1] for n in names}
    want = {}
    for i, t, a in targets:
        found = []
        for j, u, b, cited in works:
            ratio, both = SequenceMatcher(None, clean(t), clean(u)).ratio(), len(last(a) & last(b))
            if ratio >= 0.94 or (ratio >= 0.82 and both):
                found.append((-(ratio + 0.12 * min(both, 2)), -cited, j, ratio, both))
        if found:
            want[i] = min(found)[2:]
    got = matching.fuzzy_join(spark.createDataFrame(targets, "target_id long, title string, authors array<string>"), spark.createDataFrame(works, "work_id long, title string, authors array<string>, cited int")).collect()
    assert {r.target_id: (r.work_id, r.similarity, r.overlap) for r in got} == want
    assert want[90][0] == 900 and len(want) > 40


def test_first_local_book(spark):
    draw = random.Random(8)
    name = lambda: None if draw.random() < 0.1 else [f"x {draw.choice('abcd')}" for _ in range(draw.randint(0, 2))]
    targets = [(i, draw.choice(["T one", "T-two", "t!three", "none"]), name()) for i in range(60)]
    books = [(i, draw.choice(["t One", "T two", "T THREE"]), name()) for i in range(40)]
    clean = lambda t: t.lower().replace("-", " ").replace("!", " ")
    want = {}
    for i, t, a in targets:
        fits = [j for j, u, b in books if clean(t) == clean(u) and (not a or not b or set(a) & set(b))]
        if fits:
            want[i] = min(fits)
    got = matching.first_local(spark.createDataFrame(targets, "target_id long, title string, authors array<string>"), spark.createDataFrame(books, "ordinal long, title string, authors array<string>"))
    assert {r.target_id: r.ordinal for r in got.collect()} == want


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.95])
def test_nearest_by_ngrams_is_that_of_all_pairs(spark, threshold):
    draw = random.Random(6)
    words = ["control", "controls", "kontrol", "state", "stated", "gain", "of", "the", "margin"]
    text = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(1, 8)))
    left, right = [(i, text()) for i in range(40)], [(str(i), text()) for i in range(60)]
    grams = lambda t: Counter(f" {w} "[i : i + n] for w in t.split() for n in (3, 4, 5) for i in range(len(w) + 3 - n))
    every = [grams(t) for _, t in left + right]
    df = Counter(g for x in every for g in x)
    idf = {g: math.log((1 + len(every)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(x):
        v = {g: n * idf[g] for g, n in x.items()}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {g: w / size for g, w in v.items()}

    vectors = [unit(x) for x in every]
    want = {}
    for (j, _), y in zip(right, vectors[len(left) :]):
        scored = [(-round(sum(w * y.get(g, 0) for g, w in x.items()), 6), i) for (i, _), x in zip(left, vectors)]
        best = min(scored)
        if -best[0] >= threshold:
            want[j] = (best[1], -best[0])
    got = retrieval.nearest_by_ngrams(spark.createDataFrame(left, "left_id long, text string"), spark.createDataFrame(right, "right_id string, text string"), threshold)
    assert {r.right_id: (r.left_id, r.cosine) for r in got.collect()} == want


@pytest.mark.parametrize("tile, batch, together", [(16_384, 4_096, 256), (17, 5, 2)])
def test_dense_top_k_leaves_unsound_vectors_out(spark, tile, batch, together):
    draw = np.random.default_rng(3)
    rows = [(i, draw.standard_normal(4).tolist()) for i in range(80)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(80, 100)]
    bad = [(100, None), (101, [None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 4), (103, [0.0] * 4), (104, []), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = retrieval.dense_top_k(df, df.filter("vec_id % 5 = 0 or vec_id > 99"), 5, tile, batch, together).collect()
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.round(v @ v.T, 6)
    want = {(i, r, d) for i in range(0, 100, 5) for r, d in enumerate(sorted(range(100), key=lambda d, i=i: (-scores[i, d], -d))[:5], 1)}
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == want and all(r.score is not None for r in got)


def test_system_tools(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=(k, k)).tolist(), draw.normal(size=(k, 1)).tolist(), draw.normal(size=(1, k)).tolist(), [[float(i % 2)]]) for i, k in enumerate([2, 3, 2, 4, 3, 2])]
    rows.append((6, [[1.0, 2.0]], [[1.0]], [[1.0, 0.0]], [[0.0]]))
    m = "array<array<double>>"
    df = spark.createDataFrame(rows, f"i int, a {m}, b {m}, c {m}, d {m}")
    found = {r.i: r.r for r in df.select("i", systems.transfer_function("a", "b", "c", "d").alias("r")).collect()}
    for i, a, b, c, d in rows[:-1]:
        s = 0.3 + 0.7j
        value = np.array(c) @ np.linalg.solve(s * np.eye(len(a)) - np.array(a), np.array(b)) + np.array(d)
        assert np.isclose(np.polyval(found[i].numerator, s) / np.polyval(found[i].denominator, s), value[0, 0])
        assert np.allclose(sorted(p[0] for p in found[i].poles), sorted(np.linalg.eigvals(np.array(a)).real))
    assert found[6].status == "error" and found[6].numerator is None

    cases = spark.createDataFrame([("inverse", [[1.0, 2.0], [2.0, 4.0]], None), ("inverse", [[2.0, 0.0], [0.0, 4.0]], None), ("inverse", [[1.0, 2.0]], None), ("add", [[1.0]], None), ("add", [[1.0]], [[2.0]]), ("multiply", [[1.0, 2.0]], [[1.0, 2.0]]), ("eigenvalues", [[0.0, 1.0], [-4.0, 0.0]], None), ("nothing", [[1.0]], None), ("trace", None, None), ("trace", [[1.0], [1.0, 2.0]], None)], f"op string, a {m}, b {m}")
    got = [r.r for r in cases.coalesce(1).select(systems.arithmetic("op", "a", "b").alias("r")).collect()]
    assert [r.status for r in got] == ["error", "success", "error", "error", "success", "error", "success", "error", "error", "error"]
    assert "singular" in got[0].error and got[1].result == [[0.5, 0], [0, 0.25]] and np.isclose(got[1].value, 8) and got[4].result == [[3.0]] and np.isclose(got[6].value, 2)

    loops = spark.createDataFrame([([1.0], [1.0, 1.0]), ([100.0], [1.0, 1.0]), ([30.0], [1.0, 3.0, 2.0, 0.0]), ([1.0], [1.0, -1.0]), ([2.0], [1.0, -1.0]), ([1.0, 0.0, 0.0], [1.0, 1.0])], "num array<double>, den array<double>")
    n = [r.n for r in loops.coalesce(1).select(systems.nyquist("num", "den").alias("n")).collect()]
    assert [(r.encirclements, r.open_poles, r.closed_poles, r.at_origin) for r in n] == [(0, 0, 0, 0), (0, 0, 0, 0), (2, 0, 2, 1), (-1, 1, 0, 0), (-1, 1, 0, 0), (0, 0, 0, 0)]
    margins = [r.m for r in loops.coalesce(1).select(systems.stability_margins("num", "den").alias("m")).collect()]
    # 100 / (s + 1): unit gain at sqrt(9999), where the phase is -atan(sqrt(9999))
    assert abs(margins[1].gain_crossover - 99.995) < 0.5 and abs(margins[1].phase_margin - (180 - math.degrees(math.atan(99.995)))) < 0.1
    assert abs(margins[2].phase_crossover - math.sqrt(2)) < 0.01 and abs(margins[2].gain_margin - 0.2) < 0.005 and not margins[2].stable and margins[2].phase_crossings == 1
    b = loops.limit(2).select(systems.bode("num", "den", F.lit(0.01), F.lit(100.0), F.lit(50)).alias("b")).collect()
    assert b[0].b.dc_gain == 1.0 and abs(b[0].b.peak_db) < 1e-3 and len(b[0].b.frequencies) == 5 and abs(b[1].b.dc_gain - 100) < 1e-9


def test_arguments_are_coerced_by_schema(spark):
    schema = '{"properties": {"A": {"type": "array", "items": {"type": "array", "items": {"type": "number"}}}, "o": {"type": "object", "properties": {"v": {"type": "array"}}}, "s": {"type": "string"}}, "required": ["A"]}'
    cases = {
        '{"A": "[[1 2]; [3 4]]", "s": "[1]"}': (None, None), '{"A": ["[1 2 3]", [4, 5.5, 6]], "s": "[1]"}': ('{"A":[[1,2,3],[4,5.5,6]],"s":"[1]"}', []), '{"A": "nothing"}': ('{"A":"nothing"}', [".A: not an array"]),
        '{"A": [[1, null], "x"], "other": "[1]"}': ('{"A":[[1,null],"x"],"other":"[1]"}', [".A[0][1]: not a number", ".A[1]: not an array"]), '{"o": {"v": "[1 2]"}}': ('{"o":{"v":[1,2]}}', [".A: missing"]), "7": (None, ["arguments: not an object"]), None: (None, ["arguments: not an object"]),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", calls.coerced("t", F.lit(schema)).alias("r"))
    got = {r.t: (r.r.arguments, list(r.r.errors)) for r in df.collect()}
    assert {k: v for k, v in got.items() if cases[k] != (None, None)} == {k: v for k, v in cases.items() if v != (None, None)}


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_pairs_of_fingerprints_for_any_number_of_blocks(spark, blocks):
    draw = random.Random(2)
    marks = [draw.getrandbits(64) for _ in range(40)]
    for base in marks[:20]:
        for flips in (0, 1, 2, 3, 4):
            near = base
            for at in draw.sample(range(64), flips):
                near ^= 1 << at
            marks.append(near)
    least = {}
    for i, m in enumerate(marks):
        least.setdefault(m, i)
    want = {(min(i, j), max(i, j)): (a ^ b).bit_count() for a, i in least.items() for b, j in least.items() if i < j and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(i, f"{m:064b}") for i, m in enumerate(marks)], "id long, bits string")
    assert {(r.a, r.b): r.distance for r in dedup.banded_pairs(df, "id", blocks=blocks).collect()} == want


def test_blocks_grow_with_the_number_of_fingerprints():
    assert [dedup.bands_for(n) for n in (0, 1000, 2**20, 2**26, 2**33, 2**60)] == [4, 4, 5, 5, 6, 7]


@pytest.mark.parametrize("few, grams", [(0, 500_000), (0, 0), (1_024, 0)])
def test_nearest_by_ngrams_by_either_way(spark, monkeypatch, few, grams):
    """Few left rows or many, idf broadcast or joined: the same rows, and those of few never pair prefixes."""
    draw = random.Random(8)
    words = ["control", "kontrol", "state", "stated", "gain", "of", "the", "margin"]
    make = lambda n: [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 8)))) for i in range(n)] + [(n, None)]
    left, right = spark.createDataFrame(make(30), "left_id long, text string"), spark.createDataFrame(make(50), "right_id long, text string")
    want = sorted(map(tuple, retrieval.nearest_by_ngrams(left, right, 0.4).collect()))
    monkeypatch.setattr(retrieval, "FEW", few)
    monkeypatch.setattr(retrieval, "GRAMS", grams)
    assert want and sorted(map(tuple, retrieval.nearest_by_ngrams(left, right, 0.4).collect())) == want


@pytest.mark.parametrize("block, cells", [(1_024, 2_000_000), (7, 30)])
def test_nearest_by_ngrams_shuffles_no_gram(spark, monkeypatch, block, cells):
    """Held left rows: no row is exploded into grams after the counts; rows of one key are one, in chunks and blocks as at once."""
    monkeypatch.setattr(sparse, "BLOCK", block)
    monkeypatch.setattr(sparse, "CELLS", cells)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    draw = random.Random(12)
    words = ["contról", "kontrol", "state", "stated", "gain", "of", "the", "x", "😀y"]
    make = lambda n: [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 9)))) for i in range(n)]
    left = spark.createDataFrame(make(25) + [(3, "gain of"), (None, "stated"), (70, None)], "left_id long, text string")
    right = spark.createDataFrame([(f"{i}", t) for i, t in make(40)] + [("5", "the state"), ("90", "zzzz"), ("91", None)], "right_id string, text string")
    got = retrieval.nearest_by_ngrams(left, right, 0.2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "FEW", 0)
    want = sorted(map(tuple, retrieval.nearest_by_ngrams(left, right, 0.2).collect()))
    assert len(want) > 30 and sorted(map(tuple, got.collect())) == want
    assert "Generate" not in plan and plan.count("Exchange") <= 1, plan


def test_equal_arguments_of_a_batch_are_computed_once(spark):
    """The value is the size of the stack that was computed: one where all rows are alike, also beside a missing argument."""
    sized = systems.stacked_tool(lambda a, b: {"value": np.full(len(a), float(len(a)))}, value="double")
    none = F.lit(None).cast("array<double>")
    rows = spark.range(300).coalesce(1).select("id", F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("a"), F.array(F.array(F.col("id") % 3 + 0.5)).alias("b"))
    assert [r.v for r in rows.select(sized("a", none)["value"].alias("v")).distinct().collect()] == [1.0]
    assert [r.v for r in rows.select(sized("b", none)["value"].alias("v")).distinct().collect()] == [3.0]
    made = systems._arithmetic("inverse", np.array([[[1.0, 2.0], [2.0, 4.0]], [[2.0, 0.0], [0.0, 4.0]]]), None)
    assert list(made["error"]) == [0] and made["result"][1].tolist() == [[0.5, 0], [0, 0.25]]


def test_pilot_reads_texts_once(spark):
    """What is left to run after the scores are stored no longer holds the texts' expressions."""
    rows = spark.createDataFrame([(i, "tion " * (i % 4) + "cion " * (i % 3), i % 7) for i in range(40)], "chunk_id long, text string, tokens long")
    got = matching.pilot(rows, {"first": ("tion",), "second": ("cion",)}, 3, 4)
    assert "regexp_replace" not in got._jdf.queryExecution().toString().lower()
    assert sorted((r.topic, r.chunk_id) for r in got.collect()) == [("distractor", i) for i in range(4)] + [("first", i) for i in (19, 27, 39)] + [("second", i) for i in (5, 20, 26)]


def test_cells_become_python_objects_few_at_a_time(spark):
    """Each text made from a cell sees at most the cells of its run alive."""
    import weakref

    import pyarrow as pa

    from millrace.functions import text as X
    from millrace.sources import files, oai

    class Made(str):
        pass

    alive: weakref.WeakSet = weakref.WeakSet()
    most = []

    def f(x):
        made = Made(x)
        alive.add(made)
        most.append(sum(1 for _ in alive.data))
        return made

    names = [f"x{i}" for i in range(100)]
    assert X.by_row(pa.array(names), f, together=8).to_pylist() == names and max(most) <= 16
    assert X.by_row(pa.array([], pa.string()), f).to_pylist() == []
    assert all(u.evalType == oai.records_of.evalType for u in (files.extract_html, X._nfkc))
    rows = spark.createDataFrame([("<record><title>a b</title></record>",), ("no xml",), (None,)], "xml string").coalesce(1)
    assert [r.r if r.r is None else r.r[0].title for r in rows.select(oai.records_of("xml").alias("r")).collect()] == [["a b"], None, None]
