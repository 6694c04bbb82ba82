"""Ids beyond 2^53 beside null ids: none is rounded and no row is lost."""

import time
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common, extraction, lines, media, packing, quality, simhash, token_files, tokens

from .helpers import words

BIG = 2**53 + 1


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, words(80, 1), "en", "a", 1), (None, words(80, 2), "en", "a", None), (3, words(80, 3), "en", "b", BIG), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).distinct().collect()), key=repr)


WANT = sorted([BIG, None, 3], key=repr)


def test_ids_stay_exact(docs, labels):
    assert ids(simhash.fingerprints(docs)) == WANT
    assert ids(simhash.near_copies(docs)) == WANT
    assert ids(token_files.read_shards(token_files.write_shards(docs))) == WANT
    assert ids(packing.pieces(docs)) == WANT
    assert ids(packing.pack(packing.pieces(docs))) == WANT
    held = media.with_media(docs)
    assert ids(held) == WANT and ids(held, "n_chars") == sorted([1, None, BIG], key=repr)
    assert ids(media.read_media(held)) == WANT
    assert ids(quality.classify(docs, labels)) == WANT
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"))
    assert ids(extraction.extract(pages), "page_id") == WANT


def test_no_stage_loses_a_document(spark, docs):
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.select(kept.columns).collect()))
    odd = docs.unionAll(docs).withColumn("extra", F.create_map(F.lit("k"), F.lit(1)))
    assert corpus_pipeline.near_duplicates(spark, odd, "").count() == 4
    assert ids(corpus_pipeline.pack(spark, docs, "")) == WANT


def test_lines_of_rows_without_id_are_kept_once(spark):
    rows = [(None, f"{words(5, i)}\nthe very same line of all these documents") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [r.text for r in lines.without_recurring_lines(docs).collect()]
    assert sum("very same" in t for t in texts) == 1 and all(t.split("\n")[0] in {r[1].split("\n")[0] for r in rows} for t in texts)


def test_equal_rows_spread_over_groups(spark):
    docs = spark.range(0, 4000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    found = packing.pack(packing.pieces(docs), room=64, group=500)
    per = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top")).collect()
    assert sum(r.n for r in per) == 4000 and all(r.n == r.top <= 64 for r in per)
    assert len(per) == -(-4000 // 64)
    groups = [r.n for r in found.groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.count("*").alias("n")).collect()]
    assert len(groups) >= 8 and max(groups) < 1000


def test_idle_workers_let_go_of_their_encoders(monkeypatch):
    monkeypatch.setattr(tokens, "IDLE", 0.4)
    monkeypatch.setattr(tokens, "_held", {})
    first = tokens.encoder("word_bpe_49k.json", False)
    want = first.flat(["some words, twice"])[0].tolist()
    assert tokens.encoder("word_bpe_49k.json", False) is first
    used = weakref.ref(first)
    for _ in range(6):  # what is in use stays
        time.sleep(0.1)
        first.flat(["some"])
        assert tokens._held
    del first
    deadline = time.monotonic() + 10
    while used() is not None and time.monotonic() < deadline:
        time.sleep(0.1)
    assert used() is None and not tokens._held
    assert tokens.encoder("word_bpe_49k.json", False).flat(["some words, twice"])[0].tolist() == want


def test_an_encoder_holds_little_at_a_time(monkeypatch):
    texts = [words(300, i) + f" {i}" for i in range(40)] + ["", "one  two\n\n three"] + [words(4000, 77)]
    for name, keeps in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        encoder = tokens.Encoder(name, keeps)
        want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
        monkeypatch.setattr(tokens, "RUN", 10_000, raising=False)
        most, cut = [], encoder._cut
        monkeypatch.setattr(encoder, "_cut", lambda a: most.append(sum(map(len, a.to_pylist()))) or cut(a))
        assert [x.tolist() for x in encoder.encode(texts)] == want
        assert max(most) <= max(10_000 + max(map(len, texts[:40])), len(texts[-1]) + 5_000)


def test_work_on_batches_gives_memory_back(spark, docs):
    called = []
    assert list(common.tidy(lambda frames: (called.append(0) or x for x in frames))([1, 2])) == [1, 2] and called == [0, 0]

    def held(frames):
        import pathlib

        yield from frames
        held.before = int(pathlib.Path("/proc/self/statm").read_text().split()[1])

    def filled(frames):
        small = [bytes(50_000) for _ in range(4_000)]
        yield from held(frames)
        del small[::2], small[:-1]

    import pathlib

    list(common.tidy(filled)([1]))
    assert held.before - int(pathlib.Path("/proc/self/statm").read_text().split()[1]) > 150_000_000 // 4096


def test_slices_cover_rows_of_any_size():
    text = ["a" * 5, None, "", "b" * 30, "ä" * 6, "c", "d" * 4]
    batch = pa.RecordBatch.from_pydict({"doc_id": [BIG, None, 3, 4, 5, 6, 7], "text": text})
    parts = list(common.slices([batch, batch.slice(0, 0)], "text", 12))
    assert [t for p in parts for t in p.column("text").to_pylist()] == text
    assert [p.num_rows for p in parts] == [3, 1, 1, 2]
