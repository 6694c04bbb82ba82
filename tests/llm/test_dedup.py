"""Near-duplicates, substrings and lines against brute force."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from millrace.llm import lines, simhash, substring
from millrace.llm.components import components

from .helpers import SCHEMA, awkward, empty, words


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """pairs: (doc_id, fingerprint)."""
    root = {d: d for d, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in pairs:
        for b, y in pairs:
            if (x ^ y).bit_count() <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in pairs}


def test_classes_match_brute_force(spark):
    docs = awkward(spark)
    known = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect() if r.doc_id is not None]
    want = brute_components(known)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & (1 << 64) - 1) == dict(known)[r.doc_id]
            assert r.component_id == want[r.doc_id]
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {3}
    assert simhash.near_duplicates(empty(spark)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 2))
def test_bit_planes_count_distances(values, radius):
    fps = np.array(sorted({v for x in values for v in (x, x ^ 1, x ^ (1 << 63) ^ 6)}), np.uint64)
    bits = np.unpackbits(simhash.hits(fps, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps])
    assert (bits.astype(bool) == want).all()


def test_full_buckets_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FULL", 4)
    monkeypatch.setattr(simhash, "BUCKET", 4)
    draw = np.random.default_rng(3)
    base = int(draw.integers(0, 2**63))
    fps = {base}
    for _ in range(150):
        fps.add(base ^ int(1 << int(draw.integers(0, 20))) ^ int(1 << int(draw.integers(0, 64))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    keyed = simhash._buckets(nodes, len(fps))
    assert keyed.groupBy("key").count().agg({"count": "max"}).first()[0] <= 8 * 3
    together = {}
    for r in keyed.collect():
        together.setdefault(r.key, set()).add(r.node)
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 2:
                assert any(i in s and j in s for s in together.values())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 140))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_substrings(rows, window):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = set()
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.add((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_substrings_match_brute_force(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    got = {tuple(r) for r in substring.dedup_substrings(docs).collect()}
    assert {r for r in got if r[0] is not None} == brute_substrings(rows, 50)
    assert substring.dedup_substrings(docs).count() == docs.count()
    assert substring.dedup_substrings(empty(spark)).count() == 0


def test_substrings_of_repetitive_text(spark):
    passage = words(12, 9)
    rows = [(1, "a " * 80), (2, "b b " + "a " * 60), (3, " ".join([passage] * 6)), (4, passage.split()[3] + " " + " ".join([passage] * 5)), (5, "x " + "a " * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in substring.dedup_substrings(docs).collect()} == brute_substrings(rows, 50)
    assert {tuple(r) for r in substring.dedup_substrings(docs, window=20, anchor=5).collect()} == brute_substrings(rows, 20)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=120), st.lists(st.integers(0, 3), min_size=0, max_size=120))
def test_equal_windows_share_an_anchor(a, b):
    w = [[str(x).encode() for x in t] for t in (a, b)]
    lengths = np.array([len(t) for t in w])
    place, value = substring.anchors(lengths, substring.word_hashes(w[0] + w[1]) if a or b else np.empty((0, 2), np.uint64), 20, 6)
    grams = [set(), set()]
    for p, v in zip(place, value):
        grams[int(p >= len(a))].add((int(p - (len(a) if p >= len(a) else 0)), int(v)))
    for i in range(len(a) - 19):
        for j in range(len(b) - 19):
            if a[i : i + 20] == b[j : j + 20]:
                inside = [{(p - s, v) for p, v in grams[k] if s <= p <= s + 14} for k, s in ((0, i), (1, j))]
                assert inside[0] & inside[1]


def brute_lines(rows):
    """Drops lines of exactly recurring masked text; enough where no unmasked token varies."""
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            w = ["<*>" if any(c.isdigit() for c in x) else x for x in line.split()]
            if len(w) >= 3:
                held.setdefault(tuple(w), {}).setdefault(t, set()).add(d)
    return {k: min(d for s in v.values() for d in s if d is not None) for k, v in held.items() if len(v) >= 6}


def test_lines_of_recurring_templates_go(spark):
    rows = [(i, f"{words(8, i)}\nuser {i} logged in from 10.0.0.{i}\n{words(9, 100 + i)}") for i in range(8)]
    rows += [(20 + i, "the same line of every copy\nand another one") for i in range(9)]  # copies of one text alone don't recur
    rows += [(40, None), (41, ""), (42, "ok"), (None, "user 9 logged in from 1.1.1.1"), (43, "user 77 logged in from 9.9.9.9")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, line string")
    assert list(brute_lines(rows).values()) == [0]
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    for i in range(1, 8):
        assert got[i].text == "\n".join(x for n, x in enumerate(rows[i][1].split("\n")) if n != 1) and got[i].n_dropped == 1
    assert all(got[20 + i].n_dropped == 0 for i in range(9))
    assert got[40].text is None and got[40].n_lines == 0 and got[41].text == "" and got[42].text == "ok"
    assert got[43].text == "" and got[None].text == "" and got[None].n_dropped == 1
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    assert lines.dedup_lines(docs).columns == ["doc_id", "text", "line", "n_lines", "n_dropped"]


def test_words_that_vary_are_fields(spark):
    kinds = ["disk", "fan", "bus", "cpu", "net", "ram", "gpu"]
    rows = [(i, f"alarm raised for unit {k} at rack\n{words(7, i)}") for i, k in enumerate(kinds)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 for i in range(1, 7))


def edited(text, places):
    w = text.split()
    for p in places:
        w[p] = f"edit{p}"
    return " ".join(w)


def test_near_copies_match_exact_jaccard(spark):
    """Lightly edited copies of 100 and 1000 words, with 5-word similarities from 0.7 to 0.98, against all pairs."""
    texts = []
    for n in range(30):
        short, long = words(100, 1000 + n), words(1000, 2000 + n)
        texts += [short, edited(short, [50]), edited(short, [20, 70]), edited(short, [10, 40, 70]), long]
        texts += [edited(long, range(0, 1000, 1000 // k)) for k in (10, 20, 40)]
    texts += ["", None, "one", "ONE", "two words", words(7, 5), words(7, 5) + " more"]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    grams = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    stage = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert stage == {find(i) for i in range(len(texts))}
    assert simhash.near_copies(empty(spark)).count() == 0


def test_full_keys_are_cut_into_tiles_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    base = words(150, 77)
    texts = [edited(base, [n % 150]) for n in range(150)] + [words(60, 300 + n) for n in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: 0 if i < 150 else i for i in range(190)}


def test_near_copies_lose_no_link_to_caps(spark, monkeypatch):
    """Proposals cut to next to nothing: tiles of two rows in one way, one key, a tight radius; the prefixes find what is left."""
    draw = random.Random(11)
    base = words(60, 21).split()
    texts = []
    for i in range(40):
        mine = list(base)
        for at in draw.sample(range(5, 60), 1):
            mine[at] = f"w{i}"
        texts.append(" ".join(mine))
    texts += [words(50, 100 + i) for i in range(5)] + [words(3, 7), words(3, 7) + " x", "one", "one", ""]
    for name, value in {"KEYS": 1, "TILE": 2, "CUTS": 1, "SPARE": 1, "SURE": 0}.items():
        monkeypatch.setattr(simhash, name, value)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = _jaccard_classes(texts)
    for sample, often in ((16, 8), (1, 2)):
        monkeypatch.setattr(simhash, "SAMPLE", sample, raising=False)
        monkeypatch.setattr(simhash, "OFTEN", often, raising=False)
        got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, radius=12).collect()}
        assert got == want


def _jaccard_classes(texts):
    """The smallest index of each text's class, by all pairs."""
    sets = [set(simhash.shingle_hashes(t.encode(), simhash.COPY_SHINGLE).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a == b or (a and b and len(a & b) >= simhash.SIMILAR * len(a | b) - 1e-9):
                    root[i] = root[j] = min(root[i], root[j])
    return dict(enumerate(root))
