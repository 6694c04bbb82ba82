"""Top-k search and source mixing against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import mixing, topk

from .helpers import awkward, empty


def brute(rows, query_ids, k):
    out = set()
    for q, v in rows:
        if q in query_ids:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), d) for d, w in rows if d != q and len(w) == len(v))
            out |= {(q, r, d, -s) for r, (s, d) in enumerate(scored[:k], 1)}
    return out


def vectors(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.standard_normal(8).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 340)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] + [0.0] * 7), (403, [float("inf")] + [0.0] * 7), (404, [1.0, 2.0]), (405, [3.0, 1.0]), (450, [])]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, query long, dim long"), rows


def test_top_k_is_exact(spark):
    df, rows = vectors(spark)
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ready = df.filter(topk.valid(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("v"), "query", "dim")
    assert {r.vec_id for r in ready.collect()} == {i for i, _ in good}
    want = brute(good, {i for i, _ in good if i % 50 == 0}, 5)
    for tile, batch, block in ((16_384, 1024, 64), (64, 3, 8)):
        got = topk.top_k(ready, F.col("vec_id") % 50 == 0, tile=tile, batch=batch, block=block)
        assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(ready.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert {tuple(r) for r in topk.top_k(ready.unionAll(ready.filter("vec_id = 50")), F.col("vec_id") == 0).filter("rank = 1").collect()} == {r for r in brute(good, {0}, 1)}


def test_bounds_spare_blocks():
    draw = np.random.default_rng(1)
    centres = draw.integers(-200, 200, (20, 16))
    rows = np.concatenate([c + draw.integers(-5, 6, (64, 16)) for c in centres])
    tile = topk.Tile(np.arange(len(rows)), rows, pivots=len(rows))
    *_, scored = topk.search(tile, np.arange(0, len(rows), 64), rows[::64])
    assert scored < 20 * len(tile.ids) / 2


def test_queries_visit_only_tiles_whose_bound_reaches_their_floor(spark):
    draw = np.random.default_rng(6)
    centres = draw.integers(-400, 400, (16, 12))
    rows = np.concatenate([c + draw.integers(-8, 9, (64, 12)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, v array<long>").withColumn("q", F.col("vec_id") % 20 == 0)
    dealt, tiles, _ = topk.dealt(df, 64, 1024)
    best = {i: sorted((rows @ rows[i]).tolist(), reverse=True)[6] for i in range(0, len(rows), 20)}
    floors = spark.createDataFrame([(i, int(s)) for i, s in best.items()], "query_id long, floor long")
    asked = dealt.filter("q").select(F.col("tile").alias("home"), "dim", F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query"), "v").join(floors, "query_id")
    pairs = topk.visits(asked, topk.tile_bounds(dealt), tiles, group=5)
    assert tiles >= 16 and pairs.count() < 0.4 * len(best) * (tiles - 1)
    got = {tuple(r) for r in topk.top_k(df.drop("q"), F.col("vec_id") % 20 == 0, tile=64).collect()}
    assert got == brute([(i, v.tolist()) for i, v in enumerate(rows)], set(best), 5)


def test_large_components_stay_exact():
    rows = np.array([[2**30, 3], [2**30 - 1, 5], [-(2**30), 7]], np.int64)
    row, ids, score, _ = topk.search(topk.Tile(np.arange(3), rows), np.array([0]), rows[:1], 2)
    assert list(zip(ids.tolist(), score.tolist())) == [(1, 2**30 * (2**30 - 1) + 15), (2, -(2**60) + 21)]


def check_mix(rows, epochs=3):
    by, targets, sizes = {}, {}, {}
    for r in rows:
        by[r.source] = by.get(r.source, 0) + r.taken
        targets[r.source], sizes[r.source] = r.target, r.source_size
        assert 0 <= r.taken <= epochs * r["size"]
    for s, t in targets.items():
        assert by[s] == math.floor(t) and t <= epochs * sizes[s] + 1e-9
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    return targets, sizes


def water_fill(sizes, epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def test_mix_meets_targets(spark):
    rows = mixing.mix(awkward(spark).drop("size")).collect()
    targets, sizes = check_mix(rows)
    want = water_fill(sizes)
    assert all(abs(targets[s] - want[s]) < 1e-6 for s in want)
    assert {r.doc_id for r in rows if r["size"] == 0} >= {3, 4, 5}
    assert mixing.mix(empty(spark).drop("size")).count() == 0
    again = mixing.mix(awkward(spark).drop("size").repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_small_sources_are_capped(spark):
    rows = [(i, "w " * 1000, "a") for i in range(50)] + [(100 + i, "v " * 7, "b") for i in range(3)] + [(200, "u " * 5000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    targets, sizes = check_mix(found)
    assert targets["b"] == 63 and abs(targets["c"] - 15000) < 1e-9
    whole = mixing.mix(docs, whole_documents=True).collect()
    assert all(r.taken % r["size"] == 0 for r in whole)
    assert mixing.mixed_documents(docs).filter("source = 'b'").count() == 9


def test_ranges_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 37), f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    one = sorted(map(repr, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    assert sorted(map(repr, mixing.mix(docs).collect())) == one
