"""Operators of the library on small tables: awkward rows, brute force and known values."""

import hashlib
import itertools
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import matrix, numeric
from millrace.functions import text as X
from millrace.operators import chunking, dedup, evaluation, gates, retrieval, sampling, validation
from millrace.sources import files
from millrace.streaming import streams


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.select(expression.alias("x")).first().x


def test_text_scalars(spark):
    t = F.col("t")
    assert one(spark, X.canonical_text(t), t="  a­b  hyphen-\n  ated\t x\n\n\n\ny ") == "ab hyphenated x\n\ny"
    assert one(spark, X.normalized_text(t), t="a\r\nb \u0000 \rc\n\n\n\nd") == "a\nb\nc\n\nd"
    assert one(spark, X.text_hash(t), t="  Straße \n X ") == hashlib.sha256(b"strasse x").hexdigest()
    assert one(spark, X.text_hash(t), t="") is None
    assert one(spark, X.word_count(t), t="  ") == 0 and one(spark, X.count_tokens(t), t="é1, ü!") == 4
    assert one(spark, X.similarity_text(t), t="gain -1.5e3 and 2") == "gain  <NUM>  and  <NUM> "
    assert one(spark, X.slug(t), t="--") == "untitled" and one(spark, X.slug(t), t="A b/C.") == "a-b-c"
    assert [one(spark, X.human_size(F.col("n")), n=n) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.0 KiB", "3.0 MiB", "5.0 GiB"]
    assert one(spark, X.significant(F.col("v")), v=123456.789) == 123457.0 and one(spark, X.significant(F.col("v")), v=0.0) == 0.0
    assert one(spark, X.occurrences(X.for_matching(t), "closed loop"), t="Closed-loop closed  loop") == 2


@pytest.mark.parametrize(
    "text,reason",
    [("word " * 79, "too_short"), ("ab cd " * 60 + "\u0001" * 20, "nonprintable_noise"), ("1 2 3 4 " * 40 + "ab " * 5, "low_alphabetic_ratio"), ("word " * 90 + "x" * 13, "repeated_character_noise"), ("word " * 90 + "x" * 12, None), ("éé " * 100, "too_few_words")],
)
def test_quality_gate(spark, text, reason):
    assert one(spark, gates.quality_reason(F.col("t")), t=text) == reason


def test_routing_points_to_the_first_of_the_input(spark):
    rows = [(1, "a", "same", True, "knowledge", None, "document", 3), (2, "b", "same", False, "knowledge", None, "document", 3), (3, "c", "", False, "knowledge", None, "document", 1), (4, "d", "x", False, "quarantine_problem_or_solution", None, "exam", 1), (5, "e", "y", False, "knowledge", "metadata_only", "document", 1), (6, "f", "z", False, "tool_example", None, "code", 0), (7, "g", "w", False, "knowledge", "foundation", "document", 0), (8, "h", "v", False, "knowledge", None, "document", 0)]
    units = spark.createDataFrame(rows, "ord long, unit_id string, text string, needs_ocr_review boolean, split_policy string, corpus_tier string, content_role string, score int").withColumn("text_sha256", X.text_hash(F.col("text")))
    got = {r.unit_id: (r.pool_reason, r.duplicate_unit_id) for r in gates.route(units).collect()}
    assert got["a"][0] == "possible_ocr_or_sparse_page" and got["b"] == ("exact_text_duplicate", "a") and got["c"][0] == "empty_text"
    assert [got[k][0] for k in "defgh"] == ["problem_solution_or_exam", "partial_or_metadata_only_source", "code_candidate", "foundation_knowledge_candidate", "no_strong_control_signal"]


def test_record_scores_use_the_best_field(spark):
    r = one(spark, gates.record_score(F.col("a"), F.col("b"), F.col("c")), a="Robust Control", b="robust-control linear algebra", c="pest control robotics")
    assert r.score == 12 * 3 + 6 * 2 + 6 - 18 and r.matches == ["linear algebra", "robotics", "robust control"]


def greedy(n, edges):
    kept = set()
    for v in range(n):
        if not any(a in kept for a, b in edges if b == v):
            kept.add(v)
    return kept


def test_greedy_pass_is_not_components(spark):
    draw = random.Random(4)
    for edges in ([(0, 1), (1, 2)], [e for e in itertools.combinations(range(30), 2) if draw.random() < 0.1]):
        n = 3 if len(edges) == 2 else 30
        state = dedup.greedy_kept(spark.range(n).select(F.col("id").alias("v")), spark.createDataFrame(edges, "a long, b long"))
        assert {r.v for r in state.filter("kept").collect()} == greedy(n, edges)


def test_bands_find_every_close_pair(spark):
    draw = random.Random(1)
    base = "".join(draw.choice("01") for _ in range(64))
    flip = lambda s, places: "".join("10"[int(c)] if i in places else c for i, c in enumerate(s))
    marks = [base] + [flip(base, draw.sample(range(64), k)) for k in (1, 2, 3, 4, 9)] + [base]
    got = {(r.a, r.b): r.distance for r in dedup.banded_pairs(spark.createDataFrame(list(enumerate(marks)), "id long, bits string"), "id").collect()}
    want = {(i, j): d for i, j in itertools.combinations(range(6), 2) if (d := sum(x != y for x, y in zip(marks[i], marks[j]))) <= 3}
    assert got == want


def test_greedy_pass_ends_on_long_chains(spark):
    n = 500
    edges = [(i, i + 1) for i in range(n - 1)] + [(3, 400), (10, 12)]
    for group in (200_000, 0):  # by components, and by rounds alone on a shorter chain
        n = n if group else 30
        own = [e for e in edges if max(e) < n]
        state = dedup.greedy_kept(spark.range(n).select(F.col("id").alias("v")), spark.createDataFrame(own, "a long, b long"), group=group)
        assert {r.v for r in state.filter("kept").collect()} == greedy(n, own)


def test_one_of_equal_rows_is_first(spark):
    rows = spark.createDataFrame([(1, "k", "x"), (1, "k", "x"), (1, "k", "y"), (2, "k", "x"), (3, None, "x"), (3, None, "x")], "o long, k string, t string")
    found = dedup.first_of(rows, "k", ["o"]).collect()
    assert len(found) == 6 and sum(r.is_first for r in found if r.k) == 1 and sum(r.is_first for r in found if not r.k) == 2
    assert next(r.o for r in found if r.k and r.is_first) == 1


def test_blake_fingerprints(spark):
    texts = ["", None, "A b! c d e f", "a b c d e f", "one two three", "x " * 40]
    got = {r.i: r.h for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", dedup.simhash64("t").alias("h")).collect()}
    assert got[0] == got[1] == "f" * 16 and got[2] == got[3]
    for i in (2, 4, 5):
        w = "".join(c if c.isalnum() else " " for c in texts[i].lower()).split()
        spans = [" ".join(w[k : k + 4]) for k in range(0, len(w) - 3, 2)] or w
        hashes = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in spans]
        assert int(got[i], 16) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))


def test_priority_wins(spark):
    rows = spark.createDataFrame([(1, 2, "k"), (2, 1, "k"), (3, 1, "k"), (4, 9, None), (5, 9, None)], "o long, p int, k string")
    assert {r.o for r in dedup.priority_exact_dedup(rows, "k", "p", "o").collect()} == {2, 4, 5}


def fill(rows, cap):
    taken, used = [], 0
    for k, n in sorted(rows):
        if used + n > cap and taken:
            continue
        taken.append(k)
        used += n
        if used >= cap:
            break
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_cap_fill_skips_and_goes_on(spark, seed):
    draw = random.Random(seed)
    rows = [(f"{draw.randrange(16**6):06x}{i:04d}", draw.choice([1, 3, 5, 40, 90, 200, 500])) for i in range(300)]
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", "0" * 10, 10_000), ("b", "1" * 10, 1), (None, "2" * 10, 5)], "pool string, k string, n long")
    got = sampling.cap_fill(df, "pool", "k", "n", 1000).collect()
    assert sorted(r.k for r in got if r.pool == "a") == sorted(fill(rows, 1000))
    assert [r.k for r in got if r.pool == "b"] == ["0" * 10]


def test_a_pool_of_one_is_valid(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("b", "2")], "pool string, doc_key string")
    got = sampling.stratified_split(docs, 1.0).collect()
    assert sum(r.split == "valid" for r in got if r.pool == "a") == 1 and len({r.doc_key for r in got if r.pool == "b" and r.split == "valid"}) == 1
    assert len(got) == 4


def test_history(spark):
    rows = [(1, 0, "user", 50), (1, 1, "assistant", 60), (1, 2, "user", 30), (1, 3, "assistant", 20), (2, 0, "user", 999), (3, 0, "assistant", 1)]
    turns = spark.createDataFrame(rows, "c long, t long, role string, n long")
    assert {(r.c, r.t) for r in sampling.newest_within(turns, "c", "t", "n", "role", 115).collect()} == {(1, 2), (1, 3), (2, 0)}


def test_chunks():
    text = "\n\n".join(" ".join(f"w{p}_{i}" for i in range(n)) for p, n in enumerate((200, 149, 2, 500)))
    got = list(chunking.pack_paragraphs(text))
    assert [len(c) for c in got] == [349, 52, 550] and got[1][:50] == got[0][-50:] and list(chunking.pack_paragraphs(None)) == []
    assert chunking.paragraphs_of("12\n\nxiv\n\nreal") == ["real"] and chunking.paragraphs_of("12\n\n13") == ["12\n\n13"]
    assert chunking.block_chunks([("", 500), ("", 200), ("", 50)]) == [[0, 1, 2]]
    assert chunking.block_chunks([("", 700), ("", 790), ("", 50)]) == [[0], [1], [2]]
    assert chunking.block_chunks([("", 300), ("", 300), ("", 300), ("", 90), ("", 20)], 120, 600, 800)[-1] == [2, 3, 4]


def test_word_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(401)))), (2, ""), (3, None), (4, "a")], "doc_id long, text string")
    got = {(r.doc_id, r.chunk): (r.start, r.n_words) for r in chunking.word_windows(docs).collect()}
    assert got == {(1, 0): (0, 200), (1, 1): (150, 200), (1, 2): (300, 101), (4, 0): (0, 1)}


def test_bm25_ranks_and_ties(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma gamma"), (4, ""), (5, None), (6, "beta"), (7, "delta"), (8, "delta")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "alpha"), (1, "absent words"), (2, "")], "query_id long, text string")
    got = [(r.query_id, r["rank"], r.doc_id) for r in retrieval.bm25(docs, queries).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    common = spark.createDataFrame([(i, "all x" if i else "all y") for i in range(5)], "doc_id long, text string")
    weights = {r.term: r.idf for r in retrieval.idf(retrieval.postings(common), retrieval.document_lengths(common)).collect()}
    mean = sum(__import__("math").log((5 - n + 0.5) / (n + 0.5)) for n in (5, 4, 1)) / 3
    assert abs(weights["all"] - 0.25 * mean) < 1e-12


def test_nearest_by_ngrams(spark):
    left = spark.createDataFrame([(1, "find the closed loop poles of 12"), (2, "other words entirely")], "left_id long, text string")
    right = spark.createDataFrame([(7, "Find the closed loop poles of 99"), (8, "zzz")], "right_id long, text string")
    assert [(r.right_id, r.left_id, r.cosine) for r in retrieval.nearest_by_ngrams(left, right).collect()] == [(7, 1, 1.0)]


def test_checks(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", " "), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.error) for r in validation.conversation_errors(turns).collect()} == {(2, "roles"), (2, "blank_content"), (2, "starts_with_assistant")}
    rows = spark.createDataFrame([(1, "", 2), (2, "x", None)], "k long, a string, b int")
    assert {tuple(r) for r in validation.missing_fields(rows, "k", ["a", "b"]).collect()} == {(1, "a"), (2, "b")}


def test_evaluation(spark):
    r = one(spark, evaluation.concept_score(F.col("a"), F.array(F.lit("state feedback gain"), F.lit("of a"), F.lit("observer design"))), a="The feedback law")
    assert (r.score, r.found, r.total) == (33.3, 1, 3)
    assert one(spark, evaluation.refusal_score(F.col("a")), a="Please PROVIDE it") == 100.0 and one(spark, evaluation.refusal_score(F.col("a")), a="ok") == 0.0
    items = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "id string, pillar string")
    answers = spark.createDataFrame([("a", None, 1, "old"), (None, "a", 2, "new")], "id string, benchmark_id string, ord int, response string")
    assert {r.id: r.response for r in evaluation.with_responses(items, answers).collect()} == {"a": "new", "b": "", "c": ""}
    report = evaluation.pillar_report(items.withColumn("score", F.when(F.col("pillar") == "p", 100.0).otherwise(40.0)))
    assert {r.pillar: (r["items"], r.score) for r in report.collect()} == {"p": (2, 100.0), "q": (1, 40.0), "OVERALL": (3, 80.0)}


def test_closed_form_tools(spark):
    f = lambda x: F.lit(float(x))
    a = lambda *x: F.array(*map(f, x))
    r = one(spark, numeric.barrier_filter(f(-0.3), f(-2), f(1.2), f(-0.5)))
    assert abs(r.u + 0.24) < 1e-12 and r.active
    assert one(spark, numeric.interval_cubic_is_hurwitz(a(1, 2, 3, 1), a(1.3, 2.4, 3.5, 1.2)))
    assert not one(spark, numeric.interval_cubic_is_hurwitz(a(1, 2, 3, 1), a(9, 2.4, 3.5, 1.2)))
    assert one(spark, numeric.allocation(a(1, 2, 3), f(14))).u == [1.0, 2.0, 3.0]
    r = one(spark, numeric.pid_tuning(f(2), f(5), f(1)))
    assert r.kp > 0 and r.ki > 0 and r.kd > 0


def test_matrix_tools(spark):
    d = T.ArrayType(T.ArrayType(T.DoubleType()))
    v = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField(n, k) for n, k in (("a", d), ("b", d), ("q", d), ("r", d), ("x", v), ("p", d), ("h", d), ("m", d), ("z", v))])
    A, B = [[0.0, 1.0], [-2.0, -3.0]], [[0.0], [1.0]]
    row = (A, B, [[10.0, 0.0], [0.0, 1.0]], [[1.0]], [1.0, 0.5], [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]], [[0.1]], [1.2])
    df = spark.createDataFrame([row, (None, *row[1:])], schema)
    got = df.select(matrix.exact_zoh("a", "b", F.lit(0.05)).alias("z"), matrix.continuous_lqr("a", "b", "q", "r").alias("k"), matrix.discrete_lqr("a", "b", "q", "r").alias("dk"), matrix.kalman_update("x", "p", "h", "m", "z").alias("u"), matrix.solve_lyapunov("a", "q", F.lit(False)).alias("l"), matrix.place_poles("a", "b", F.array(F.array(F.lit(-4.0), F.lit(0.0)), F.array(F.lit(-5.0), F.lit(0.0)))).alias("p"), matrix.routh_hurwitz(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("rh")).collect()
    good = next(r for r in got if r.z.status == "success")
    bad = next(r for r in got if r.z.status != "success")
    assert abs(good.z.ad[0][0] - 0.997621) < 1e-4 and bad.z.status == "error" and bad.z.error
    assert good.k.stable and good.k.residual < 1e-10 and good.dk.residual < 1e-6 and good.l.residual < 1e-9
    assert len(good.u.x) == 2 and [round(p[0], 6) for p in good.p.poles] == [-5.0, -4.0]
    assert good.rh.stable


def test_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\n{bad\n[1]\n{"id": 2}\n')
    rows, errors = files.read_numbered(spark, str(tmp_path / "x.jsonl"), "id int")
    assert sorted((r._line, r.record.id) for r in rows.collect()) == [(1, 1), (5, 2)]
    assert sorted((r.place.rsplit(":", 1)[1], r.error) for r in errors.collect()) == [("2", "blank line"), ("3", "malformed"), ("4", "not an object")]
    folder = tmp_path / "in"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("one.txt", "same")
        z.writestr("two.txt", "same")
        z.writestr("skip.bin", "x")
    (folder / "b.md").write_text("same")
    found = files.inventory(spark, str(folder)).collect()
    assert sorted(r.member_path for r in found) == ["b.md", "one.txt", "two.txt"]
    assert sum(r.exact_duplicate_of is not None for r in found) == 1
    manifest = spark.createDataFrame([(1, (5, "d"), [(None, "s"), (7, None)])], "schema_version int, defaults struct<n:int,t:string>, sources array<struct<n:int,t:string>>")
    assert {tuple(r) for r in files.with_defaults(manifest, ["n", "t"]).collect()} == {(5, "s"), (7, "d")}


def test_html_and_notebooks(spark):
    page = "<body><nav>menu</nav><main><p>Text <b>bold</b></p><script>x</script></main></body>"
    assert files.html_text(page) == "Text\nbold" and files.html_text(None) == "" and files.html_text("<p>a") == "a"
    book = json.dumps({"cells": [{"cell_type": "raw", "source": ["r"]}, {"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": ["y=1"], "outputs": [1]}]})
    assert one(spark, files.notebook_text(F.col("t")), t=book) == "## Markdown cell 2\n\n# T\nx\n\n## Code cell 3\n\ny=1"
    assert one(spark, files.notebook_text(F.col("t")), t="version https://git-lfs.github.com/spec/v1") == ""
    feed = "<feed><entry><id>http://x/abs/2101.1v3</id><title>A  b</title><published>2021</published></entry></feed>"
    assert [tuple(r) for r in one(spark, files.feed_entries(F.col("t")), t=feed)] == [("2101.1", "A b", "2021")]


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "index"
    spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id long, text string").write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    for extra in (None, (3, "alpha")):
        if extra:
            spark.createDataFrame([extra], "doc_id long, text string").write.mode("append").parquet(str(src))
        streams.grow_index(stream, str(out), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(out / "postings")).filter("term = 'alpha'").count() == 2
    events = spark.createDataFrame([(1, 1, "token", "a ", None), (1, 2, "tool_end", None, "t"), (1, 3, "token", "b", None), (2, 1, "token", "x", None), (2, 2, "error", "e", None), (2, 3, "done", "whole", None)], "request_id long, seq long, type string, content string, tool string")
    got = {r.request_id: (r.text, r.tools, r.errors, r.finished) for r in streams.fold_trace(events).collect()}
    assert got == {1: ("a b", ["t"], 0, False), 2: ("whole", [], 1, True)}


def test_fuzzy_join(spark):
    from millrace.operators import matching

    targets = spark.createDataFrame([(1, "Feedback Systems: An Introduction", ["Karl Åström", "R. Murray"]), (2, "Unrelated", []), (3, "Robust Control Toolbox", ["A. Smith"])], "target_id long, title string, authors array<string>")
    works = spark.createDataFrame([(10, "Feedback systems - an introduction", ["Murray"], 5), (11, "Feedback Systems an introduction", ["X"], 9), (12, "robust control toolboxes", ["Smith"], 1), (13, "robust control tools", ["B. Other"], 1)], "work_id long, title string, authors array<string>, cited int")
    got = {r.target_id: (r.work_id, r.overlap) for r in matching.fuzzy_join(targets, works).collect()}
    assert got == {1: (10, 1), 3: (12, 1)}


def test_verification_needs_every_value(spark):
    from millrace.functions import verification

    rows = [("finite_discounted_return", {"gamma": 0.5, "value": 2.5}, {"rewards": [1.0, 2.0, 2.0], "terms": [1.0, 1.0, 0.5]}), ("residual_autocorrelation", {"lag": 1.0, "acf": 0.5}, {"residual": [1.0, 1.0, 0.0]}), ("finite_horizon_lqr", {"a": 1.0, "b": 1.0, "q": 1.0, "r": 1.0, "p_final": 1.0, "steps": 1.0, "p_initial": 1.5}, {"gains": [0.5]}), ("single_actuator_loss_isolation", {"measured": 4.0, "lost": 1.0}, {"b": [1.0, 2.0], "u": [4.0, 3.0]}), ("hinf_first_order", {"gain": -2.0}, {}), ("no_such_kind", {"x": 1.0}, {})]
    df = spark.createDataFrame(rows, "kind string, s map<string,double>, v map<string,array<double>>")
    assert [r.x for r in df.select(verification.verified(F.col("kind"), F.col("s"), F.col("v")).alias("x")).collect()] == [True, True, True, True, None, None]


def test_tool_calls_are_read_from_damaged_text(spark):
    from millrace.functions import calls

    cases = {
        'go <tool_call>{"name": "zoh", "arguments": {"A": [[0,1],[2,3]]}}</tool_call> on': ("zoh", {"A": [[0, 1], [2, 3]]}),
        '<tool_call>{"name": "x", "arguments": {"v": [1 2 3], "m": [1 0; 0 1],}}': ("x", {"v": [1, 2, 3], "m": [[1, 0], [0, 1]]}),
        'text ```json\n{"name": "y", "arguments": {"e": "a\\sigma"}}\n``` end': ("y", {"e": "a\\sigma"}),
        'so {"name": "z", "arguments": {"k": 1': ("z", {"k": 1}),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(9, None), (10, "no call")], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", calls.tool_calls("t").alias("c")).collect()}
    for i, (name, arguments) in enumerate(cases.values()):
        assert got[i].calls[0].name == name and json.loads(got[i].calls[0].arguments) == arguments
    assert got[9].calls == [] and got[10].cleaned == "no call" and got[0].cleaned == "go  on"
    df = spark.createDataFrame([('{"A": [[1, 3], [2, 4]], "x": [5, 6], "s": 1}', "use [1 2; 3 4] and [5, 6.0]"), ('{"x": [7, 7]}', "use [5 6]")], "a string, c string")
    assert [r.x for r in df.select(calls.unfounded_arguments("a", "c").alias("x")).collect()] == [[], ["x"]]


def test_near_dup_queries_have_a_row_for_every_document(spark, tmp_path):
    """Copies, the same words in other order, a neighbour within 3 bits by brute force, and texts without words."""
    import hashlib

    from millrace.plans import registry

    texts = {0: "alpha beta gamma delta", 1: "delta gamma beta alpha", 2: "alpha beta gamma delta", 3: "", 4: None, 5: "?!", 6: "wholly other words here"}
    texts |= {7 + n: " ".join(f"word{k}" for k in range(300) if k != n) for n in range(6)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def bits(text):
        votes = [0] * 64
        for w in set((text or "").split()):
            h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
            votes = [v + (1 if h >> (63 - b) & 1 else -1) for b, v in enumerate(votes)]
        return int("".join("1" if v >= 0 else "0" for v in votes), 2)

    fps = {i: bits(t) for i, t in texts.items() if i not in (3, 4, 5)}
    first = {i: min(j for j in fps if fps[j] == fps[i]) for i in fps}
    kept = []
    for i in sorted(fps):
        if all((fps[i] ^ fps[j]).bit_count() > 3 for j in kept):
            kept.append(i)
    members = {r.doc_id: r.class_id for r in registry.QUERIES["near_dup_members"](spark, str(tmp_path)).collect()}
    assert members == {i: first.get(i) for i in texts}
    got = {r.doc_id: (r.class_id, r.kept) for r in registry.QUERIES["near_dup_kept"](spark, str(tmp_path)).collect()}
    assert got == {i: (first.get(i), i in kept or i not in fps) for i in texts}


def test_human_size_rounds_ties_to_even(spark):
    sizes = (2304, 2816, 2303, 1024 * 1024 + 256 * 1024, 1024**3 + 1024**3 // 4, 1023)
    assert [one(spark, X.human_size(F.col("n")), n=n) for n in sizes] == ["2.2 KiB", "2.8 KiB", "2.2 KiB", "1.2 MiB", "1.2 GiB", "1023 B"]
    assert one(spark, X.human_size(F.col("n"), ("KiB",)), n=1024 * 1024 + 256) == "1024.2 KiB"
