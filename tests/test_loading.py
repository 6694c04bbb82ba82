"""The OAI source and its records; links in archives, dispatch, failures as rows and metrics of one pass."""

import io
import json
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import loaders, oai

SCHEMA = oai.PAGE


def page(numbers, token):
    body = "".join(
        f'<record><header><identifier>oai:{n}</identifier></header><metadata><oai_dc:dc><dc:title>Automatic Control {n}</dc:title><dc:language>en</dc:language>'
        f"<dc:identifier>http://x/{n}.pdf</dc:identifier></oai_dc:dc></metadata></record>"
        for n in numbers
    )
    return f'<OAI-PMH xmlns:oai_dc="urn:o" xmlns:dc="urn:d"><ListRecords>{body}<resumptionToken cursor="0">{token}</resumptionToken></ListRecords></OAI-PMH>'


def store(folder, pages):
    tokens = [oai.START, *(f"t{i}" for i in range(1, len(pages)))]
    for i, numbers in enumerate(pages):
        (folder / f"{tokens[i]}.xml").write_text(page(numbers, tokens[i + 1] if i + 1 < len(pages) else ""))


def run(spark, folder, out, log, batches=None):
    """Read the stream into out; at most `batches` pages, then stop as a crash would."""
    stream = spark.readStream.format("oai_pages").option("path", str(folder)).option("pagesPerBatch", "1").load()
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(log)).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(200):
            done = query.lastProgress["batchId"] + 1 if query.lastProgress else 0
            if batches is not None and done >= batches:
                break
            query.processAllAvailable()
            if batches is None:
                break
    finally:
        query.stop()


def test_a_stream_stops_after_any_page_and_gives_each_record_once(spark, tmp_path):
    oai.register(spark)
    folder = tmp_path / "pages"
    folder.mkdir()
    store(folder, [[1, 2], [3], [4, 5], [6]])
    out, log = tmp_path / "out", tmp_path / "log"
    run(spark, folder, out, log, batches=1)
    first = spark.read.parquet(str(out)).count()
    assert first >= 1
    run(spark, folder, out, log)
    store(folder, [[1, 2], [3], [4, 5], [6], [7, 8], [9]])  # the last page now names another
    (folder / "t3.xml").write_text(page([6], "t4"))
    run(spark, folder, out, log)
    pages = spark.read.parquet(str(out))
    assert pages.count() == pages.select("token").distinct().count()
    found = [r.oai_identifier for r in oai.candidates(pages).collect()]
    assert len(found) == len(set(found)) and {f"oai:{n}" for n in range(1, 7)} <= set(found)


def test_the_batch_reader_follows_tokens(spark, tmp_path):
    oai.register(spark)
    store(tmp_path, [[1], [2], [3]])
    rows = spark.read.format("oai_pages").option("path", str(tmp_path)).load().collect()
    assert sorted((r.page, r.token, r.next) for r in rows) == [(0, "start", "t1"), (1, "t1", "t2"), (2, "t2", "")]
    (tmp_path / "t2.xml").write_text(page([3], "start"))  # a token that leads back ends the walk
    assert spark.read.format("oai_pages").option("path", str(tmp_path)).load().count() == 3


def test_offsets_can_be_resumed_at_any_page(tmp_path):
    store(tmp_path, [[1], [2], [3], [4]])
    for cut in range(5):
        reader = oai._Stream(str(tmp_path), 1)
        at, seen = reader.initialOffset(), []
        for _ in range(cut):
            after = reader.latestOffset()
            seen += [p.token for p in reader.partitions(at, after)]
            at = after
        again = oai._Stream(str(tmp_path), 2)
        # what a restart does: the last planned batch is asked for first
        again.partitions(at, at)
        again.latest = at
        while (after := again.latestOffset()) != at:
            seen += [p.token for p in again.partitions(at, after)]
            at = after
        assert seen == ["start", "t1", "t2", "t3"]


def test_records_are_filtered_and_spread_by_address(spark):
    cases = [
        ("<dc:language>FR</dc:language>", 0), ("<dc:language>fr</dc:language><dc:language> English </dc:language>", 1), ("<dc:resourceType>article</dc:resourceType>", 0),
        ("<dc:resourceType>Textbook</dc:resourceType>", 1), ("", 1), ("<dc:identifier>http://x/b.PDF?q</dc:identifier><dc:identifier>http://x/a.pdf</dc:identifier>", 2), ("<dc:title/>", 1),
    ]
    for extra, n in cases:
        xml = f'<a xmlns:dc="d"><record><dc:title>Feedback  Control</dc:title><dc:identifier>http://x/a.pdf</dc:identifier><dc:identifier>doi:1.pdf</dc:identifier><dc:identifier>http://x</dc:identifier><dc:date type="Issued">1999</dc:date>{extra}</record></a>'
        rows = oai.candidates(spark.createDataFrame([(xml,)], "xml string")).collect()
        assert len(rows) == n, extra
        for r in rows:
            assert r.title == "Feedback Control" and r.issued == "1999" and r.landing_urls == ["http://x"] and r.relevance_score > 0
    bad = spark.createDataFrame([("<a>",), (None,), ("",), ("<a/>",)], "xml string")
    assert oai.candidates(bad).count() == 0


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, link in members:
            info = zipfile.ZipInfo(name)
            if link:
                info.external_attr = (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, data)
    return out.getvalue()


def test_links_are_followed_inside_the_archive_only(spark):
    chain = [(f"l{i}", f"l{i + 1}", True) for i in range(8)] + [("l8", "end", False)]
    data = archive([*chain, ("d/e/up", "../../l8", True), ("d/out", "../../l8", True), ("abs", "/etc/passwd", True), ("loop", "loop", True), ("gone", "nothing", True), ("..odd", "x", False)])
    containers = spark.createDataFrame([("a.zip", data), ("b.txt", b"plain"), ("c.zip", b"no archive")], "path string, content binary")
    wanted = [("a.zip", n) for n in ("l8", "l1", "l0", "d/e/up", "d/out", "abs", "loop", "gone", "absent")] + [("b.txt", "b.txt"), ("c.zip", "x"), ("c.zip", "y")]
    rows = {(r.container, r.member_path): r for r in loaders.read_members(containers, spark.createDataFrame(wanted, "container string, member_path string")).collect()}
    good = {k[1] for k, r in rows.items() if r.error is None}
    assert len(rows) == 12 and good == {"l8", "l1", "d/e/up", "b.txt"}
    assert bytes(rows["a.zip", "l1"].content) == b"end" and "too many" in rows["a.zip", "loop"].error and "too many" in rows["a.zip", "l0"].error
    assert rows["a.zip", "absent"].error_type == "KeyError" and rows["c.zip", "y"].error_type == "BadZipFile"


def test_walks_load_by_extension(spark, tmp_path):
    for name, data in {"a.txt": b"one \xff", "sub/b.MD": b"two", ".hidden.txt": b"no", ".git/c.txt": b"no", "d.exe": b"no", "e.pdf": b"%PDF-", "sub/deep/f.json": b"{}", "g.ipynb": b"{}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.filename: r for r in loaders.load_directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.MD", "e.pdf", "f.json"} and rows["a.txt"].text == "one �" and rows["e.pdf"].error_type == "NotImplementedError"
    assert loaders.load_file(spark, str(tmp_path / "a.txt")).count() == 1 and loaders.load_file(spark, str(tmp_path / "sub/deep/f.json")).count() == 0


@pytest.fixture()
def files(spark):
    notebook = {"cells": [{"cell_type": "markdown", "source": ["# a"]}, {"cell_type": "raw", "source": "x"}, {"cell_type": "code", "source": "b = 1"}, {"cell_type": "code", "source": []}]}
    rows = [
        ("1", ".html", b"<body><p>text of it</p><script>no</script></body>", "knowledge_candidate"), ("2", ".ipynb", json.dumps(notebook).encode(), "tool_example_candidate"), ("3", ".ipynb", b"{", "tool_example_candidate"),
        ("4", ".pdf", b"%PDF-1", "knowledge_candidate"), ("5", ".txt", b"  \n", "knowledge_candidate"), ("6", ".ipynb", b"version https://git-lfs.github.com/spec/v1", "tool_example_candidate"), ("7", ".txt", None, "other"), ("8", ".py", b"a b c", "other"),
    ]
    return spark.createDataFrame(rows, "document_id string, extension string, content binary, split_policy string").withColumns({"source_id": F.lit("s"), "member_path": F.lit("m")})


def test_failures_are_rows_and_metrics_come_from_the_same_pass(spark, files, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def pass_on(frames):
        for frame in frames:
            counted.add(len(frame))
            yield frame

    watched = files.mapInPandas(pass_on, files.schema)
    summary = loaders.write_units(loaders.units(watched), str(tmp_path / "units"))
    assert counted.value == 8  # the source was read once
    counts = {k: v for k, v in summary.items() if k not in ("characters", "words")}
    assert counts == {"attempted": 8, "failed": 3, "units": 5, "empty": 2, "by_split_policy": {"knowledge_candidate": 2, "tool_example_candidate": 2}}
    ok, failures = loaders.read_units(spark, str(tmp_path / "units"))
    texts = {r.document_id: r for r in ok.collect()}
    assert texts["1"].text == "text of it" and texts["2"].text == "## Markdown cell 1\n\n# a\n\n## Code cell 3\n\nb = 1" and texts["6"].extraction_status == "empty" and texts["8"].words == 3
    assert summary["characters"] == sum(r.characters for r in texts.values()) and summary["words"] == sum(r.words for r in texts.values())
    assert {r.document_id: r.error_type for r in failures.collect()} == {"3": "JSONDecodeError", "4": "NotImplementedError", "7": "ValueError"}
    loaders.write_summary(spark, summary, str(tmp_path / "summary"))
    assert json.loads(spark.read.text(str(tmp_path / "summary")).first().value) == summary
    none = loaders.write_units(loaders.units(files.limit(0)), str(tmp_path / "none"))
    assert none["attempted"] == 0 and loaders.read_units(spark, str(tmp_path / "none"))[0].count() == 0
