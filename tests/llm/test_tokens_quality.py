"""Tokens, packing, the classifier and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import packing, quality, repair, token_files
from millrace.llm.tokens import encoder, tokenizer_path

from .helpers import awkward, empty, words

PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", "\t", " ", "word", "Ünï", "it's", "l.", "a,", "...", "1,5", "<|endoftext|>", "\0", "\x01", "日本", "😀", "é", "'", "\r\n"]), max_size=14).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4))
def test_cached_ids_are_the_library_s(texts):
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        library = Tokenizer.from_file(tokenizer_path(name))
        for text, ids in zip(texts, encoder(name, keeps).encode(texts)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), min_size=1, max_size=6), st.integers(2, 5))
def test_grammar_round_trip(docs, least):
    ids = np.array([x for d in docs for x in d], np.uint32)
    shard = repair.Shard(repair.compress(ids, np.array([len(d) for d in docs]), 50, least=least))
    assert [x.tolist() for x in shard.documents()] == docs
    assert all(shard.document(i).tolist() == d for i, d in enumerate(docs))
    # no pair is left that occurs often enough, occurrences that overlap counted once
    left: Counter = Counter()
    for a, b in zip(shard.starts[:-1], shard.starts[1:]):
        last = None
        for i in range(a, b - 1):
            pair = (int(shard.symbols[i]), int(shard.symbols[i + 1]))
            if last == (pair, i - 1):
                last = None
                continue
            left[pair] += 1
            last = (pair, i)
    assert max(left.values(), default=0) < least


def test_grammar_makes_repeats_small():
    ids = np.tile(np.arange(16, dtype=np.uint32), 4000)
    data = repair.compress(ids, np.array([len(ids)]), 100)
    assert len(data) < len(ids) / 4 and (repair.Shard(data).document(0) == ids).all()


def test_token_files(spark):
    docs = awkward(spark)
    got = sorted((tuple(r) for r in token_files.read_shards(token_files.write_shards(docs)).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    start = 0
    for doc, at, n, ids in got:
        assert at == start and np.frombuffer(ids, "<u4").tolist() == want[doc] and n == len(want[doc])
        start += n
    assert [r[0] for r in got] == [None, *sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)]
    assert token_files.read_shards(token_files.write_shards(empty(spark))).count() == 0


def placed(rows, room):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= room
    return len(bins)


def test_packing(spark):
    docs = awkward(spark)
    rows = packing.pack(packing.pieces(docs)).collect()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 4096):
            part = np.array(ids[i : i + 4096], "<u4")
            want[r.doc_id, i // 4096, i, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert placed(rows, 4096) == -(-sum(r.length for r in rows) // 4096)
    assert packing.pack(packing.pieces(empty(spark))).count() == 0


def test_groups_of_pieces(spark):
    docs = spark.createDataFrame([(i, words(1 + i * 7 % 300, i)) for i in range(300)], "doc_id long, text string")
    rows = packing.pack(packing.pieces(docs), group=40).collect()
    assert placed(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_local_search_keeps_every_piece(lengths):
    first = packing.best_fit(lengths, 100)
    bins = packing.improve([list(b) for b in first], lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins) and len(bins) <= len(first)


def test_exchanges_empty_a_bin():
    lengths = [60, 30, 50, 45, 10, 5]
    bins = packing.improve([[0, 1], [2, 3], [4, 5]], lengths, 100)
    assert len(bins) == 2


def brute_kneser_ney(texts, order):
    """probability(context + char) by the definition, from python dictionaries."""
    top = Counter()
    for t in texts:
        found, _ = quality.grams([t], order)
        top.update(found.tolist())
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g & (1 << quality.BITS * k) - 1 for g in levels[k + 1])
    discounts = {}
    for k, counts in levels.items():
        n = [sum(v == i for v in counts.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0.0]
        for i in (1, 2, 3):
            d.append(min(max(i - (i + 1) * y * n[i + 1] / n[i] if i + 1 < 5 and n[i] else i / 2, 0.1), float(i)))
        discounts[k] = d

    def p(g, k):
        if k == 0:
            return 1 / quality.ALPHABET
        counts, d = levels[k], discounts[k]
        own = {h: n for h, n in counts.items() if h >> quality.BITS == g >> quality.BITS}
        lower = p(g & (1 << quality.BITS * (k - 1)) - 1, k - 1)
        if not own:
            return lower
        total = sum(own.values())
        free = sum(d[min(n, 3)] for n in own.values()) / total
        return (max(0, counts[g] - d[min(counts[g], 3)]) if g in counts else 0) / total + free * lower

    return lambda g: p(g, order)


def marked(spark, rows):
    """rows of (text, lang, trusted) as the classifier's own input."""
    return spark.createDataFrame([(i, i, lang, t, trusted, False) for i, (t, lang, trusted) in enumerate(rows)], "doc_id long, body long, lang string, text string, trusted boolean, held boolean")


def test_scores_match_the_definition(spark, monkeypatch):
    """Blocks of a few characters and groups of a few grams, so that every document asks by shards and salts."""
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the the cat", "日本語 の cat 😀"]
    rows = [(t, "en", True) for t in texts] + [("unseen zebra 日本", "en", False), (None, "en", False), ("ohne Modell", "de", False), ("", "", True)]
    want = brute_kneser_ney(texts, quality.ORDER)
    for block, asked in ((8_000_000, 8_000_000), (30, 3)):
        monkeypatch.setattr(quality, "BLOCK", block)
        monkeypatch.setattr(quality.answers, "__defaults__", (asked,))
        got = {r.doc_id: r for r in quality.scores(marked(spark, rows)).collect()}
        assert len(got) == len(rows)
        for i, (text, lang, _) in enumerate(rows):
            found, _ = quality.grams([text or ""])
            assert got[i].chars == len(found)
            if len(found) and lang == "en":
                assert abs(got[i].nll + sum(math.log(want(int(g))) for g in found)) < 1e-3
            else:
                assert got[i].nll is None


def test_code_points_keep_apart():
    points = [*range(32, 60_000, 7), *range(0x1F300, 0x1F700), *range(0x20000, 0x20400)]
    seen = {tuple(quality.grams([chr(p)])[0][-2:].tolist()) for p in points if not chr(p).isspace() and not 0xD800 <= p < 0xE000}
    assert len(seen) == len([p for p in points if not chr(p).isspace() and not 0xD800 <= p < 0xE000])


def test_junk_goes_and_clean_text_stays(spark):
    clean = [(i, words(80, i), "en") for i in range(120)]
    junk = [(500 + i, "".join(chr(33 + (i * 7 + k * 13) % 60) for k in range(300)), "en") for i in range(10)]
    odd = [(600, None, "en"), (601, "", "en"), (602, "irgendein Text", "de"), (None, words(80, 900), None)]
    docs = spark.createDataFrame([(*r, 1) for r in clean + junk + odd], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(500, 0, 0), (100, 1, 0), (100, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == len(clean + junk + odd)
    assert sum(found[i].keep for i in range(120)) >= 119 and not any(found[500 + i].keep for i in range(10))
    assert not found[600].keep and not found[601].keep and found[602].keep and found[602].high is None and found[None].keep
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in found.values())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    texts = [words(80 + i, i) for i in range(60)]
    near = texts[5].split()
    near[20] = "changed"
    foot = [f"seen at page {i} of the site" for i in range(60)]
    rows = [(i, f"{t}\n{foot[i]}", "en", f"src{i % 3}") for i, t in enumerate(texts)]
    rows += [(100, f"{texts[7]}\n{foot[7]}", "en", "src0"), (200, "!#%&()" * 60, "en", "src1"), (None, words(90, 77), "en", None), (300, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        seen.append(step.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert step.columns == docs.columns
    kept, lined, single, mixed, packed = seen
    ids = lambda rows: {r.doc_id for r in rows}
    assert 200 not in ids(kept) and 300 not in ids(kept) and ids(kept) >= {*range(60), 100, None}
    text = {r.doc_id: r.text for r in lined}
    assert text[0] == rows[0][1] and all(text[i] == texts[i] for i in range(1, 60)) and all(r.n_chars == len(r.text) for r in lined)
    assert ids(single) >= {*range(60), None} and 100 not in ids(single) and len(single) == 61
    assert ids(mixed) <= ids(single) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)
    placed(packed, 4096)
    assert {r.sequence_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


CLASHES = ["row", "body", "id", "own", "gone", "gone_id", "gone_body", "trusted", "held", "keep", "first", "class", "least", "node", "key", "range", "s", "r", "of", "size", "taken", "target", "n_lines", "n_dropped", "_n", "col", "block", "piece", "group"]


def test_stages_keep_rows_and_columns_apart(spark, tmp_path):
    """Columns named as the operators' own, null ids, repeated rows, and rows of one doc_id with different texts."""
    base = [words(60, i) for i in range(12)]
    rows = [(1, base[0]), (1, base[1]), (2, base[1]), (3, base[2]), (3, base[2]), (None, base[3]), (None, base[4]), (None, base[4]), (4, base[3]), (5, ""), (6, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(-7).alias(c) for c in CLASHES])
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        assert all(r[c] == -7 for r in found.collect() for c in CLASHES), name
    single = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert single == Counter([(1, base[0]), (1, base[1]), (3, base[2]), (4, base[3]), (None, base[4]), (5, "")])
    assert corpus_pipeline.line_dedup(spark, docs, "").count() == len(rows)
    assert sum(r.length for r in corpus_pipeline.pack(spark, docs, "").collect() if r.piece == 0) > 0
