"""Hard negatives and centroid clustering against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import clusters, negatives, topk

SCHEMA = "vec_id long, embedding array<double>, label int, tile long, distance long, anchor string"


def odd_vectors(spark, dim):
    draw = np.random.default_rng(3)
    rows = [(i, draw.standard_normal(dim).tolist(), int(draw.integers(0, 4)) if i % 3 else 1) for i in range(320)]
    rows += [(i, [0.5] * dim, i % 2) for i in range(320, 420)]  # ties
    rows += [rows[100], rows[100], rows[5]]  # repeated rows
    rows += [(1000, None, 1), (1001, [None] + [1.0] * (dim - 1), 1), (1002, [float("nan")] * dim, 1), (1003, [float("inf")] * dim, 1), (1004, [1.0, 2.0], 1), (1100, [2.0, 1.0], 1), (1105, [1.5, 1.0], 2), (1200, [], 1)]
    rows += [(1007, [0.25] * dim, None), (None, [0.1] * dim, 2)]
    return spark.createDataFrame([(*r, 9, 9, "clash") for r in rows], SCHEMA).repartition(3), rows


def whole(v):
    return None if v is None or any(x is None or not np.isfinite(x) for x in v) else tuple(int(np.floor(256 * x)) for x in v)


def brute_negatives(rows, step=20):
    good = sorted({(i, label, whole(v)) for i, v, label in rows if i is not None and label is not None and whole(v) is not None})
    out = set()
    for a, label, v in good:
        if a % step:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), d, kind) for d, kind, w in good if d != a and len(w) == len(v)), key=lambda s: s[:2])
        for p, d, _ in [s for s in scored if s[2] == label][:5]:
            found = [(-n, e) for n, e, kind in scored if kind != label and 80 * -p <= 100 * -n <= 100 * -p]
            out |= {(a, d, r, e, -p, n) for r, (n, e) in enumerate(found[:5], 1)}
    return out


def test_strassen_is_exact():
    draw = np.random.default_rng(1)
    for n, m, p, leaf in ((1, 1, 1, 1), (37, 71, 99, 8), (64, 64, 64, 4), (5, 200, 3, 2), (0, 4, 6, 2), (3, 0, 5, 2)):
        a, b = draw.integers(-(2**62), 2**62, (n, m)), draw.integers(-9, 9, (m, p))
        assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_heads_break_ties_by_id():
    scores = np.array([[5, 7, 7, 7, 1], [3, 3, 3, 3, 3]])
    row, ids, score = negatives.block_heads(scores, np.array([[True] * 5, [False, True, True, True, True]]), np.array([9, 4, 2, 8, 1]), 2)
    assert list(zip(row.tolist(), ids.tolist(), score.tolist())) == [(0, 2, 7), (0, 4, 7), (1, 1, 3), (1, 2, 3)]


@pytest.mark.parametrize("tile, batch", [(8192, 16384), (50, 7)])
def test_hard_negatives(spark, tile, batch):
    df, rows = odd_vectors(spark, 6)
    ready = negatives.usable(df).select("vec_id", "label", topk.quantised(F.col("embedding")).alias("v"), "tile")
    got = negatives.hard_negatives(ready, F.col("vec_id") % 20 == 0, tile=tile, batch=batch).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_negatives(rows)
    assert negatives.hard_negatives(ready.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_beyond_a_long_fail(spark):
    huge = spark.createDataFrame([(0, 1, [2**40, 1]), (1, 1, [2**40, 2])], "vec_id long, label int, v array<long>")
    with pytest.raises(Exception, match="exceed a long"):
        negatives.hard_negatives(huge, F.col("vec_id") == 0).collect()


def brute_clusters(rows, dim, k, rounds):
    kept = [(i, whole(v)) for i, v, _ in rows if v is not None and len(v) == dim and whole(v) is not None]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, held in groups.items():
            centroids[n] = [sum(x) // len(held) for x in zip(*held)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    return sorted(((i, c, d, sum(x[2] for x in last if x[1] == c), sum(x[2] for x in last), tuple(centroids[c])) for i, c, d in last), key=repr)


def test_clusters(spark):
    df, rows = odd_vectors(spark, 6)
    for k, rounds in ((12, 3), (1000, 1)):
        got = clusters.cluster(clusters.kept_vectors(df, 6), k, rounds, 6)
        found = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got.collect()), key=repr)
        assert found == brute_clusters(rows, 6, k, rounds)
        assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest() for r in got.limit(5).collect())
    assert clusters.cluster(clusters.kept_vectors(df.limit(0), 6), 12, 2, 6).count() == 0


def test_tree_prunes_and_keeps_ties():
    draw = np.random.default_rng(2)
    centres = draw.integers(-400, 400, (40, 16))
    centres[9] = centres[4]
    v = np.concatenate([c + draw.integers(-20, 20, (50, 16)) for c in centres] + [centres])
    tree = clusters.Tree(centres)
    number, distance, taken = tree.nearest(v)
    every = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert 9 not in number and taken < 0.8 * every.size
    equal = clusters.Tree(np.zeros((30, 4), np.int64))
    assert (equal.nearest(np.ones((3, 4), np.int64))[0] == 0).all()


def test_tree_ties_within_a_leaf():
    draw = np.random.default_rng(3)
    for low, high, dim in ((-2, 3, 3), (-1, 2, 6), (2**26 - 3, 2**26, 4)):
        centres, v = draw.integers(low, high, (40, dim)), draw.integers(low, high, (400, dim))
        number, distance, _ = clusters.Tree(centres).nearest(v)
        every = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_clusters_of_coarse_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) / 256 for x in draw.integers(-1, 2, 6)], 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = clusters.cluster(clusters.kept_vectors(df, 6), 40, 3, 6)
    found = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got.collect()), key=repr)
    assert found == brute_clusters(rows, 6, 40, 3)
