"""Lossless WebP round trips, and the block labeller on held-out pages."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import extraction, labeller, media, pages, webp

from .helpers import awkward, empty, words


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (2, 1, 0), (0, 1, 2), (3, 0)])
@pytest.mark.parametrize("cache,references,tiles", [(0, False, 0), (5, True, 0), (0, True, 2), (3, False, 2)])
def test_every_part_of_the_format_round_trips(transforms, cache, references, tiles):
    draw = np.random.default_rng(hash((transforms, cache)) % 1000)
    few = draw.integers(0, 256, (5, 4), dtype=np.uint8)
    for height, width in ((1, 1), (5, 9), (12, 33)):
        pixels = few[draw.integers(0, 5, (height, width))]
        data = webp.encode(pixels, transforms, cache, references, tiles)
        assert (webp.decode(data) == pixels).all()
        for lanes in (1, 2 + webp.ALONE):  # read alone, and in step
            assert (webp.decode_batch([data] * lanes)[-1] == pixels).all()


def test_noise_round_trips():
    pixels = np.random.default_rng(2).integers(0, 256, (17, 31, 4), dtype=np.uint8)
    for transforms in ((), (0,), (1, 2)):
        assert (webp.decode(webp.encode(pixels, transforms, 4, True)) == pixels).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"abcd", b"abcdefgh", b"x", b"a line of text\n", b"\0\1\2\3"]), max_size=200).map(b"".join), st.integers(0, 3))
def test_long_lanes_end_alone(text, others):
    data = [media.payload(text.decode("latin-1"))] + [media.payload(f"{i} and {i * i}") for i in range(others * webp.ALONE)]
    for d, pixels in zip(data, webp.decode_batch(webp.encode_batch(data))):
        assert pixels.tobytes()[: len(d)] == d


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=8))
def test_batches_agree_with_single_images(texts):
    data = [t.ljust(max(64, -(-len(t) // 64) * 64), b"\0") for t in texts]
    files = webp.encode_batch(data)
    for d, f, pixels in zip(data, files, webp.decode_batch(files)):
        assert pixels.tobytes() == d and webp.decode(f).tobytes() == d


def test_stored_files_use_the_format():
    """References, colour caches and palettes stand in the files that the query's encoder writes, and the lanes read them."""
    draw, few = np.random.default_rng(6), words(40, 9).split()
    texts = [words(400, 1), " ".join(few[i] for i in draw.integers(0, 40, 900)), words(30, 2) * 8, "ab" * 400, "\n".join(["the same menu line, item 1"] * 60), words(3000, 3)[:12000] * 2, ""]
    data = [media.payload(t) for t in texts]
    files = webp.encode_batch(data)
    parts = [webp._lane(webp.chunk(f)) for f in files]
    assert sum(p[4] > 0 for p in parts) >= 1 and sum(int(p[5][4][0].max()) > 0 for p in parts) >= 3 and any(kind == webp.PALETTE for p in parts for kind, *_ in p[2])
    assert [p.tobytes()[: len(d)] for p, d in zip(webp.decode_batch(files), data)] == data
    assert len(files[5]) < 1.2 * len(webp.encode_batch([media.payload(words(3000, 3)[:12000])])[0])  # the second half is one reference
    with pytest.raises(ValueError):
        webp.decode_batch([files[0][:-40] + bytes(2)])


def test_mixed_batches():
    pixels = np.random.default_rng(4).integers(0, 3, (6, 16, 4), dtype=np.uint8)
    files = [webp.encode(pixels, (2,), 3, True), *webp.encode_batch([b"x" * 64]), webp.encode(pixels)]
    assert [p.tobytes() for p in webp.decode_batch(files)] == [pixels.tobytes(), b"x" * 64, pixels.tobytes()]
    with pytest.raises(ValueError):
        webp.decode(b"RIFF0000WEBPVP8 0000")


def test_code_lengths_are_complete_and_bounded():
    counts = [2**i for i in range(40)]
    lengths = webp.code_lengths(counts, 12)
    assert max(lengths) <= 12 and sum(2.0**-n for n in lengths) == 1


def test_tall_images_have_room():
    for n in (16, 16 * 16384, 16 * 16385, 16 * 40000):
        width, height = webp.shape(n)
        assert width * height >= n and max(width, height) <= 16384


def test_media_columns(spark):
    docs = awkward(spark)
    got = {r.doc_id: r for r in media.read_media(media.with_media(docs.drop("n_bytes"))).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        whole = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    assert got[0].feature == got[1].feature and got[0].media_sha256 == got[1].media_sha256
    assert media.read_media(media.with_media(empty(spark))).count() == 0


def test_labeller_on_held_out_pages():
    net = labeller.trained()
    for hard, least in ((False, 0.99), (True, 0.97)):
        inputs, labels = labeller.training_set(150, seed=1234, hard=hard)
        right = [((s > 0) == (l > 0.5)) for s, l in zip(net.score(inputs), labels)]
        assert np.concatenate(right).mean() > least, hard
    assert net.score([]) == [] and len(net.score([np.zeros((0, inputs[0].shape[1]), np.float32)])[0]) == 0


def test_gradients_are_those_of_the_loss():
    net = labeller.Labeller(3)
    inputs, labels = labeller.training_set(4, seed=5)
    inputs = [x.astype(np.float64) for x in inputs]
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    grads = net._gradients(inputs, labels)

    def loss():
        total = n = 0
        for odds, y in zip(net.score(inputs), labels):
            total += np.sum(np.log1p(np.exp(-np.where(y > 0.5, odds, -odds).astype(np.float64))))
            n += len(y)
        return total / n

    draw = np.random.default_rng(0)
    for name in ("xf", "hf", "bb", "hb", "o", "s"):
        i = tuple(draw.integers(0, d) for d in net.w[name].shape)
        if name in ("xf", "s"):
            i = (labeller.PATH + labeller.WORDS, *i[1:])
        old, eps = net.w[name][i], 1e-2
        net.w[name][i] = old + eps
        up = loss()
        net.w[name][i] = old - eps
        down = loss()
        net.w[name][i] = old
        assert abs((up - down) / (2 * eps) - grads[name][i]) < 2e-3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>Head &amp; line</h1><p><b>First &eacute; &#x41;  part<br>goes on.<p>Second <i>in</i>line.</p>
<form><p>Your name</p></form></article><div class="comments"><p>Nice one indeed.</p></div>
<footer>&copy; site</footer></body></html>"""


def test_blocks_and_extraction(spark):
    texts = [b.text for b in pages.blocks_of(PAGE)]
    assert texts == ["T", "One", "Two", "Buy now.", "Head & line", "First é A part goes on.", "Second inline.", "Your name", "Nice one indeed.", "© site"]
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>" * 3000), (None, "x", "plain"), (1, "u", PAGE), (5, "y", "<article><p>" + "word " * 60_000 + "</p></article>")]
    got = sorted((tuple(r) for r in extraction.extract(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text long")).collect()), key=repr)
    assert len(got) == len(rows)
    text = "Head & line\nFirst é A part goes on.\nSecond inline."
    assert [r for r in got if r[0] == 1] == [(1, "u", text, len(text))] * 2
    assert {r[0]: r[2] for r in got if r[0] in (2, 3, 4)} == {2: "", 3: "", 4: ""}
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/\"' abp=!-&;#ditv", max_size=80))
def test_broken_markup_never_fails(text):
    for b in pages.blocks_of(text):
        assert b.text == " ".join(b.text.split()) and 0 <= b.links <= 1
