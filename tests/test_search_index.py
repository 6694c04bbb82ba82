"""The stored index against scoring everything; phrases over borders; names, citations and the suite."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from millrace.operators import citations, phrases, retrieval, segments, sparse
from millrace.plans import search
from millrace.streaming import streams


def corpus(spark, n, seed, first=0):
    """Documents whose topic changes with their id, so that blocks differ."""
    draw = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        topic = [f"t{(i // 20) % 9}x{j}" for j in range(12)]
        rows.append((i, " ".join(draw.choice(topic if draw.random() < 0.6 else ["a", "b", "c", "common", "word"]) for _ in range(draw.randint(0, 60)))))
    return spark.createDataFrame(rows, "doc_id long, text string")


def same(found, docs, queries, k=5):
    want = retrieval.bm25(docs, queries, k)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "t3x1 t3x2 common"), (2, "a b"), (3, "nowhere"), (4, "t0x0 t0x0 t8x3"), (5, ""), (6, None), (7, "t5x5")]
    return spark.createDataFrame(rows, "query_id long, text string")


def test_segments_give_the_same_top_k_and_skip_blocks(spark, queries, tmp_path):
    path = str(tmp_path / "index")
    one, two = corpus(spark, 400, 1), corpus(spark, 200, 2, first=400)
    segments.append(one, path, 0, block=10)
    found, counts = segments.Index(spark, path).search(queries, first=2)
    same(found, one, queries)
    read = {r.query_id: (r.blocks, r.read) for r in counts.collect()}
    assert all(r <= b for b, r in read.values()) and sum(r for _, r in read.values()) < 0.7 * sum(b for b, _ in read.values()), read
    # new documents are found after an append; older segments keep as they are
    segments.append(two, path, 1, block=10)
    both = one.unionAll(two)
    same(segments.Index(spark, path).search(queries, first=2)[0], both, queries)
    # a segment that is written again replaces itself
    segments.append(two, path, 1, block=10)
    same(segments.Index(spark, path).search(queries, k=3)[0], both, queries, 3)


def test_awkward_documents_and_a_missing_index(spark, queries, tmp_path):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a a a"), (4, "a a a"), (5, "common " * 3000)], "doc_id long, text string")
    segments.append(docs, str(tmp_path / "odd"), 0)
    same(segments.Index(spark, str(tmp_path / "odd")).search(queries)[0], docs, queries)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        none = segments.Index(spark, str(tmp_path / "nothing"))
    assert caught and none.search(queries)[0].count() == 0
    segments.append(docs.limit(0), str(tmp_path / "empty"), 0)
    assert segments.Index(spark, str(tmp_path / "empty")).search(queries)[0].count() == 0


def test_a_stream_grows_the_index(spark, queries, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    corpus(spark, 60, 3).write.parquet(source)
    for upto, extra in ((60, None), (90, corpus(spark, 30, 4, first=60))):
        if extra is not None:
            extra.write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        streams.grow_segments(stream, path, str(tmp_path / "log")).awaitTermination()
        docs = spark.read.parquet(source)
        assert docs.count() == upto
        same(segments.Index(spark, path).search(queries)[0], docs, queries)


WORDS = ("state feedback", "feedback", "a b c d e", "gain margin", "x")


def brute(units):
    docs = {}
    for doc, _, text in sorted(units, key=lambda u: (repr(u[0]), u[1])):
        docs.setdefault(doc, []).append(text or "")
    out = {}
    for doc, parts in docs.items():
        whole = " ".join("\n".join(parts).lower().replace("-", " ").split())
        out[doc] = [p for p in WORDS if p in whole]
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_phrases_cross_units(spark, parts):
    draw = random.Random(9)
    units = [("d1", 0, "State"), ("d1", 1, "feedback"), ("d2", 0, "state"), ("d2", 1, None), ("d2", 2, "  "), ("d2", 3, "Feed"), ("d2", 4, "back"), ("d3", 0, "gain-"), ("d3", 1, "margin"), (None, 0, "state feedback")]
    units += [("hot", i, draw.choice("abcdex") if i % 50 else "gain") for i in range(600)] + [("runs", i, w) for i, w in enumerate("abcde")]
    df = spark.createDataFrame(units, "doc string, n int, text string").repartition(4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.doc: r.found for r in phrases.phrases_of(df, "doc", "n", "text", WORDS).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute(units) and got["d1"] == ["state feedback", "feedback"] and got["d2"] == [] and got["runs"] == ["a b c d e"]
    assert phrases.phrases_of(df.limit(0), "doc", "n", "text", WORDS).count() == 0


def test_joining_stretches_is_associative():
    draw = random.Random(3)
    for _ in range(300):
        parts = ["".join(draw.choice("abx ") for _ in range(draw.randint(0, 6))).strip() for _ in range(5)]
        ps = ("a b", "ab x", "x", "b a b")
        made = [phrases.stretch(" ".join(p.split()), ps, 4) for p in parts]
        left = right = None
        for s in made:
            left = s if left is None else phrases.joined(left, s, ps, 4)
        for s in reversed(made):
            right = s if right is None else phrases.joined(s, right, ps, 4)
        whole = " ".join(" ".join(parts).split())
        assert left == right and left == phrases.stretch(whole, ps, 4)


def test_source_labels(spark):
    cases = {
        "": ("local reference", False), None: ("local reference", False), "Ogata Modern Control  Engineering 5th txtbk.pdf.pdf": ("Ogata, *Modern Control Engineering* (5th ed.)", True),
        "CAM Course Notes Part 2.pdf": ("Computer-Aided Manufacturing (course notes)", False), "JD_AMC exercise 3.md": ("Advanced and Multivariable Control - exercise 3 (course notes)", False),
        "QRS handbook of things.txt": ("handbook of things (course notes)", False), "QRS.txt": ("QRS (course notes)", False), "a.b.json": ("a.b (course notes)", False),
        "B&B_NC: networked.jsonl": ("Networked Control (course notes)", False), "Notes (scan) FINAL - .pdf": ("Notes (course notes)", False), ".pdf": ("local reference (course notes)", False),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "name string").select("name", citations.source_label(F.col("name")).alias("r")).collect()
    assert {r.name: (r.r.label, r.r.published) for r in rows} == cases


def test_citations_and_suite(spark):
    docs = spark.createDataFrame([(1, "CAM notes.pdf", 3, "x" * 700), (2, "Z.txt", None, "The Gain Margin"), (3, "Z.txt", 0, None)], "doc_id long, name string, page int, text string")
    hits = spark.createDataFrame([(7, 1, 1, 3.0), (7, 2, 2, 2.0), (8, 1, 3, 2.5)], "query_id long, rank int, doc_id long, score double")
    found = {(r.query_id, r.rank): r for r in citations.passages(hits, docs).collect()}
    assert found[7, 1].citation == "[Computer-Aided Manufacturing (course notes), p. 3]" and len(found[7, 1].content) == 600
    assert found[7, 2].citation == found[8, 1].citation == "[Z (course notes)]"
    cases = spark.createDataFrame([(7, ["nothing", "gain margin"]), (8, ["gain"]), (9, ["gain"])], "query_id long, keywords array<string>")
    report = {r.query_id: (r.matched, r.best_score, r.grounds) for r in citations.suite_report(cases, hits, docs).collect()}
    assert report == {7: (True, 3.0, True), 8: (False, 2.5, False), 9: (False, 0.0, False)}


def test_many_alike_names_are_scored_by_class(spark, monkeypatch):
    """As scoring everything; classes meet queries, not each of their documents."""
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choice(("www", "blog", "m")) + draw.choice((" a example", " b example", " b b example")) for _ in range(draw.randint(1, 2))) + f" {draw.randint(0, 150)}") for i in range(600)]
    names = spark.createDataFrame(rows, "doc_id long, text string")
    asked = names.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    made, whole = [], retrieval._by_classes
    monkeypatch.setattr(retrieval, "_by_classes", lambda *a: made.append(whole(*a)) or made[-1])
    for k in (3, 50):
        want = retrieval.bm25(names, asked, k)
        assert sorted(map(repr, retrieval.bm25(names, asked, k, alike=True).collect())) == sorted(map(repr, want.collect()))
    assert len(made) == 2 and made[0].count() < 0.5 * 600 * 30
    twice = names.unionAll(names.limit(5))
    same(retrieval.bm25(twice, asked, 5, alike=True), twice, asked)


def test_bm25_shuffles_no_posting_of_other_terms(spark, queries, monkeypatch):
    docs = corpus(spark, 60, 5)
    want = sorted(map(repr, retrieval.bm25(docs, queries).collect()))
    monkeypatch.setattr(retrieval, "postings", lambda docs: pytest.fail("all postings are made"))
    assert want and sorted(map(repr, retrieval.bm25(docs, queries).collect())) == want


def test_segments_shuffle_texts_only_and_searches_no_postings(spark, queries, tmp_path):
    """The first range of keys that a row of postings is aggregated by deals them, so no posting moves; terms of few queries are broadcast."""
    docs, path = corpus(spark, 200, 5), str(tmp_path / "index")
    plans, write = [], DataFrameWriter.parquet

    def kept(self, *args, **how):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **how)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", kept)
        segments.append(docs, path, 0, block=10)
    assert plans[0].count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plans[0], plans[0]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = segments.Index(spark, path)
        asked, bounds = index.bounds(queries)
        assert "SortMergeJoin" not in bounds._jdf.queryExecution().executedPlan().toString()
        same(index.search(queries)[0], docs, queries)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_segments_of_ids_that_are_no_numbers_or_null(spark, queries, tmp_path):
    named = corpus(spark, 120, 6).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    segments.append(named, str(tmp_path / "named"), 0, block=10)
    same(segments.Index(spark, str(tmp_path / "named")).search(queries)[0], named, queries)
    odd = spark.createDataFrame([(None, "a b"), (2, "a"), (2**60 + 1, "b b"), (2**60, "b b")], "doc_id long, text string")
    segments.append(odd, str(tmp_path / "odd"), 0)
    index = segments.Index(spark, str(tmp_path / "odd"))
    assert (index.n_docs, index.mean_length) == (4, 7 / 4)


def test_bm25_of_few_terms_reads_texts_once(spark, monkeypatch):
    """As the general path, with null texts and ids, terms in over half of the documents and repeated terms; lengths aren't read apart."""
    odd = spark.createDataFrame([(None, "t3x1 common"), (900, None), (901, ""), (902, "common " * 40)], "doc_id long, text string")
    docs = corpus(spark, 120, 8).unionAll(odd).coalesce(2)
    asked = [(1, "common t3x1"), (2, "t3x1 t3x1 t4x2"), (3, "nowhere"), (4, None)]
    rare, some = (spark.createDataFrame(rows, "query_id long, text string").coalesce(1) for rows in (asked[1:], asked))
    monkeypatch.setattr(retrieval, "PICKED", -1)
    want = [sorted(map(repr, retrieval.bm25(docs, q).collect())) for q in (rare, some)]
    monkeypatch.setattr(retrieval, "PICKED", 2_000)
    monkeypatch.setattr(retrieval, "document_lengths", lambda docs: pytest.fail("lengths are read apart"))
    assert want[1] and sorted(map(repr, retrieval.bm25(docs, some).collect())) == want[1]
    monkeypatch.setattr(retrieval, "frequencies", lambda docs: pytest.fail("no term needs the mean idf"))
    assert want[0] and sorted(map(repr, retrieval.bm25(docs, rare).collect())) == want[0]


def test_bm25_topk_asks_every_benchmark_item(spark, tmp_path):
    """Not only items whose id is divisible by 100."""
    docs, path = corpus(spark, 60, 8), str(tmp_path)
    asked = spark.createDataFrame([(i, f"t{i % 9}x1 common t{i % 7}x2") for i in range(1, 15)] + [(100, None), (101, "a b")], "item_id long, text string")
    docs.write.parquet(f"{path}/documents.parquet")
    asked.write.parquet(f"{path}/benchmark.parquet")
    got = search.bm25_topk(spark, path)
    same(got, docs, asked.withColumnRenamed("item_id", "query_id"))
    assert {r.query_id for r in got.collect()} >= {1, 2, 7, 101}


@pytest.mark.parametrize("block, cells, dense", [(1_024, 2_000_000, 32), (3, 40, 2), (5, 1, 1_000)])
def test_bm25_of_many_queries_in_blocks(spark, monkeypatch, block, cells, dense):
    """As the general path: many queries and equal documents, ids of either kind, a query without an id."""
    docs = corpus(spark, 90, 9).unionAll(corpus(spark, 20, 9, first=200)).unionAll(spark.createDataFrame([(None, "a b"), (300, None), (301, "a " * 50)], "doc_id long, text string"))
    asked = spark.createDataFrame([(i, f"t{i % 9}x{i % 12} t{i % 4}x3 common" + " a" * (i % 3)) for i in range(2**60, 2**60 + 30)] + [(None, "t1x1"), (5, "")], "query_id long, text string")
    monkeypatch.setattr(retrieval, "PICKED", -1)
    named = docs.withColumn("doc_id", F.concat(F.lit("é"), F.col("doc_id") % 17, F.lit("d"), "doc_id"))
    want = [sorted(map(repr, retrieval.bm25(d, asked, 3).collect())) for d in (docs, named)]
    monkeypatch.setattr(retrieval, "PICKED", 1_000)
    monkeypatch.setattr(retrieval, "document_lengths", lambda docs: pytest.fail("the general path was taken"))
    for name, value in (("BLOCK", block), ("CELLS", cells), ("DENSE", dense)):
        monkeypatch.setattr(sparse, name, value)
    for d, w in zip((docs, named), want):
        assert w and sorted(map(repr, retrieval.bm25(d, asked, 3).collect())) == w


@pytest.mark.parametrize("block, cells, dense", [(1_024, 2_000_000, 32), (3, 40, 2), (5, 1, 1_000), (4, 100, 10**9)])
def test_sparse_products(monkeypatch, block, cells, dense):
    for name, value in (("BLOCK", block), ("CELLS", cells), ("DENSE", dense)):
        monkeypatch.setattr(sparse, name, value)
    draw = np.random.default_rng(4)
    a, b = (np.where(draw.random(shape) < share, draw.random(shape), 0) for shape, share in (((17, 9), 0.4), ((9, 11), 0.3)))
    (row, term), (t, column) = np.nonzero(a), np.nonzero(b)
    got = np.full((17, 11), np.nan)
    for at, first, x in sparse.Columns(t, column, b[t, column], 9, 11).products(np.bincount(row, minlength=17), term, a[row, term]):
        assert np.isnan(got[at : at + len(x), first : first + x.shape[1]]).all()
        got[at : at + len(x), first : first + x.shape[1]] = x
    assert np.allclose(got, a @ b)
    assert not list(sparse.Columns(t, column, b[t, column], 9, 11).products(np.empty(0, int), term[:0], term[:0]))
