"""Personal data: base spans against the plain patterns, planted forms that they miss, clean text left alone."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import pii, queries

from .helpers import awkward, empty, words

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD, OTHER = "4736962573099581", "4550997810720808"


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=d: 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
                "phone": lambda d=d: 8 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns():
    draw = np.random.default_rng(7)
    pools = ["a.b@c-d.e 1@2.3", "0123456789", "0129.  ", "+() .-19x", f"{CARD} - +1 ", "ä@ß.é x@y z@@a.b-c.d", "255.256.0.1.2 "]
    texts = ["", "@", "a@b", "a@b.c@d.e", "x@y..z", "1.2.3.4.5", "+1 (480) 555-1234.", f"+1 (480) 555-1234 {CARD}", f"{CARD} {OTHER}", "0000001.2.3.255", "9" * 5000, "1 " * 30]
    texts += ["".join(draw.choice(list(pools[i % len(pools)]), int(draw.integers(0, 60)))) for i in range(3000)]
    for text in texts:
        assert pii.base_spans(text) == brute(text), repr(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000, "@" * 200_000, "1." * 200_000, "+" * 200_000, "(0" * 100_000, "1-" * 200_000, "at dot " * 50_000, "a@" * 100_000):
        spans = pii.base_spans(text)
        pii.candidates(text, spans)


def test_em_recovers_reliabilities():
    draw = np.random.default_rng(4)
    truth = draw.random(20_000) < 0.3
    right = np.array([0.95, 0.99, 0.8, 0.7, 0.7, 0.9])
    vote = np.where(draw.random((len(truth), 6)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    vote[:, 3][draw.random(len(truth)) < 0.5] = 0
    patterns, back, counts = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    share, table, posterior = pii.reliabilities(patterns, counts.astype(float))
    assert abs(share - truth.mean()) < 0.02
    assert np.abs(table[:, 1, 2] / (table[:, 1, 0] + table[:, 1, 2]) - right)[[0, 2, 3, 4, 5]].max() < 0.05
    assert ((posterior > 0.5)[back.ravel()] == truth).mean() > 0.97


PLANTED = {
    "email": ["jane.doe (at) example (dot) com", "bob at mail dot example dot org", "josé@exämple.com"],
    "ip": ["2001:db8::ff00:42:8329", "10[.]20[.]30[.]40"],
    "card": ["3782 822463 10005", CARD],
    "phone": ["(480) 555-1234", "+1 (487) 555-7209"],
}


@pytest.fixture(scope="module")
def corpus(spark):
    """Ordinary personal data, so that the labelers agree on something, and forms beyond the base patterns."""
    draw = np.random.default_rng(5)
    rows = []
    for i in range(300):
        number = "".join(map(str, draw.integers(0, 10, 15)))
        card = next(f"4{number[1:]}{c}" for c in "0123456789" if pii.luhn(f"4{number[1:]}{c}"))
        odd = card[:-1] + str((int(card[-1]) + 1) % 10)
        rows.append((i, f"{words(8, i)} u{i}@mail{i % 9}.example.com {words(5, i)} {card if i % 2 else odd} {words(3, i)} +1 ({200 + i}) 555-{1000 + i} {words(2, i)} {i % 200 + 5}.8.{i % 250}.9, {words(4, i)}"))
    n = 300
    for forms in PLANTED.values():
        for form in forms:
            tail = f" {OTHER}" if form in (CARD, "+1 (487) 555-7209") else ""
            rows.append((n, f"{words(6, n)} {form}{tail} {words(6, n)}"))
            n += 1
    clean = ["at 12:30:45 on 2024-01-15", "ISBN 978-3-16-148410-0", "order 1234567890123", "version 1.2.3.4.5.6.7", "look at home. Then we dot it", "pages 100-200, 300-4000", "4736962573099582"]
    rows += [(1000 + i, f"{words(6, i)} {t} {words(6, i)}") for i, t in enumerate(clean)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_planted_forms_are_found_and_clean_text_is_left(corpus):
    rows = {r.doc_id: r for r in pii.find_pii(corpus).collect()}
    texts = {r.doc_id: r.text for r in corpus.collect()}
    n = 300
    for kind, forms in PLANTED.items():
        for form in forms:
            assert (kind, form) in {(s.kind, texts[n][s.start : s.end]) for s in rows[n].spans}, form
            assert form not in rows[n].masked and f"<{kind}>" in rows[n].masked
            n += 1
    for i in range(1000, 1007):
        assert [s for s in rows[i].spans if not s.base] == [], texts[i]
    for i, r in rows.items():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == brute(texts[i])
    found = [s for i in range(300) for s in rows[i].spans if not s.base]
    assert not found


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("spans", F.lit(1))
    rows = pii.find_pii(docs).collect()
    assert len(rows) == docs.count() and all(not r.spans for r in rows)
    assert sorted(r.masked for r in rows) == sorted(r.text or "" for r in docs.collect())
    assert pii.find_pii(empty(spark)).count() == 0


def test_query_digests(spark, corpus, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in corpus.collect()}
    for r in queries.op11_pii(spark, str(tmp_path)).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
