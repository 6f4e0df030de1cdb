"""Archives as a data source, pages by the first reader that takes them, and streams with state processors against batch."""

import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.operators import loading, positions, selection
from spanloom.sources import archives, markup, packages
from spanloom.streaming import state


def documents(spark, rows):
    return spark.createDataFrame(rows, "book string, ord int, name string, content binary")


CHAPTERS = [
    ("One", 1, "text/b.xhtml", b"<html><body><h1>Two</h1><p>second   part, long enough to be believed</p></body></html>"), ("One", 0, "text/a & b.xhtml", "<html><body><h1>Eins</h1><p>erster Teil, ß</p></body></html>".encode()),
    ("Two", 0, "x.xhtml", b"<p>alone</p>"), ("Two", 1, "empty.xhtml", None), ("Three", 0, "y.xhtml", b"<p>three</p>" * 1000),
]


def test_archives_come_back_as_they_were_written(spark, tmp_path):
    path = str(tmp_path / "books")
    packages.write(documents(spark, CHAPTERS), path)
    assert sorted(os.listdir(path)) == ["One.epub", "Three.epub", "Two.epub"]
    got = packages.read(spark, path)
    assert got.columns == ["path", "ord", "name", "content", "error"]
    rows = {(os.path.basename(r.path)[:-5], r.ord): (r["name"], bytes(r.content), r.error) for r in got.collect()}
    assert rows == {(b, k): (n, c or b"", None) for b, k, n, c in CHAPTERS}
    with zipfile.ZipFile(f"{path}/One.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.testzip() is None
    # the other reader sees the same
    other = {(os.path.basename(r.path)[:-5], r.ord): (r["name"], r.html) for r in archives.documents(spark, path).collect()}
    assert other == {k: (n, c.decode()) for k, (n, c, _) in rows.items()}
    # the same rows give the same bytes, and overwriting takes away what was there
    before = (tmp_path / "books" / "One.epub").read_bytes()
    packages.write(documents(spark, [r for r in CHAPTERS if r[0] == "One"]), path, "overwrite")
    assert os.listdir(path) == ["One.epub"] and (tmp_path / "books" / "One.epub").read_bytes() == before


def test_partitions_by_bytes(spark, tmp_path):
    path = str(tmp_path / "books")
    packages.write(documents(spark, CHAPTERS), path)
    (tmp_path / "books" / "notes.txt").write_text("no archive")
    reader = lambda **o: packages.ArchiveReader({"path": path, **o})
    assert [len(s.paths) for s in reader().partitions()] == [3]
    assert [len(s.paths) for s in reader(bytesPerPartition="1").partitions()] == [1, 1, 1]
    assert [os.path.basename(p) for s in reader(glob="T*.epub").partitions() for p in s.paths] == ["Three.epub", "Two.epub"]
    assert packages.read(spark, path, bytesPerPartition="1").rdd.getNumPartitions() == 3
    assert packages.read(spark, f"file:{path}/One.epub").count() == 2
    (tmp_path / "none").mkdir()
    assert packages.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        packages.ArchiveReader({"path": str(tmp_path / "nowhere")}).partitions()


def test_damaged_archives_tell_why(spark, tmp_path):
    path = tmp_path / "books"
    packages.write(documents(spark, CHAPTERS), str(path))
    whole = (path / "Three.epub").read_bytes()
    (path / "Torn.epub").write_bytes(whole[: len(whole) // 2])
    at = whole.index(b"y.xhtml") + 40
    (path / "Three.epub").write_bytes(whole[:at] + bytes(x ^ 255 for x in whole[at : at + 9]) + whole[at + 9 :])
    (path / "Void.epub").write_bytes(b"")
    rows = {(os.path.basename(r.path), r.ord): r for r in packages.read(spark, str(path)).collect()}
    assert rows["Torn.epub", None].error and rows["Void.epub", None].error and rows["Torn.epub", None].content is None
    assert rows["Three.epub", 0].error and rows["Three.epub", 0]["name"] == "y.xhtml"
    assert rows["One.epub", 0].error is None
    with pytest.raises(Exception, match="Torn|Three|Void"):
        packages.read(spark, str(path), mode="failfast").collect()
    books, blocks = loading.packaged(packages.read(spark, str(path)))
    assert {r.title for r in books.collect()} == {"One", "Two"}
    got = blocks.join(books.select("book_id", "title"), "book_id").orderBy("title", "start").collect()
    assert [(r.title, r.kind, r.level, r.text) for r in got] == [("One", "heading", 1, "Eins"), ("One", "paragraph", 0, "erster Teil, ß"), ("One", "heading", 1, "Two"), ("One", "paragraph", 0, "second   part, long enough to be believed"), ("Two", "paragraph", 0, "alone")]
    text = {r.title: r.text for r in books.collect()}
    assert all(text[r.title][r.start : r.end].split() == r.text.split() for r in got)


def test_failed_writes_leave_nothing(spark, tmp_path):
    """A job that fails midway, and one whose rows of a book are apart: what was there before is still all that there is."""
    path = tmp_path / "books"
    packages.write(documents(spark, CHAPTERS[:2]), str(path))
    broken = documents(spark, [(f"b{k}", 0, "x", b"y") for k in range(20)]).repartition(4).withColumn("ord", F.when(F.col("book") == "b7", F.raise_error(F.lit("no"))).otherwise(F.col("ord")).cast("int"))
    with pytest.raises(Exception, match="no"):
        broken.write.format(packages.FORMAT).mode("append").save(str(path))
    with pytest.raises(Exception, match="follow one another"):
        documents(spark, [("a", 0, "x", b"y"), ("b", 0, "x", b"y"), ("a", 1, "z", b"y")]).coalesce(1).write.format(packages.FORMAT).mode("append").save(str(path))
    assert [n for n in os.listdir(path) if not n.startswith("_")] == ["One.epub"]
    assert packages.read(spark, str(path)).count() == 2


def test_books_of_one_beginning_are_one(spark, tmp_path):
    for sub in ("a", "b"):
        packages.write(documents(spark, [("Same", 0, "x", b"<p>text</p>")]), str(tmp_path / sub))
    books, blocks = loading.packaged(packages.read(spark, str(tmp_path)))
    assert books.count() == blocks.count() == 1


def test_one_call_for_mixed_files(spark, tmp_path):
    packages.write(documents(spark, [*CHAPTERS[:2], ("Same", 0, "x", b"<p>Prologue</p>")]), str(tmp_path / "sub"))
    (tmp_path / "Plain.TXT").write_bytes(b"Prologue\n\nIt was early.\xff\n")
    (tmp_path / "Marked.md").write_text("# Head\n\n- one\n- two\n\nAll of the rest, which goes on for so long that what the marks say is believed.\n")
    (tmp_path / "Same.txt").write_text("Prologue")
    (tmp_path / "cover.jpg").write_bytes(b"\xff\xd8")
    books, blocks = loading.from_folder(spark, str(tmp_path))
    assert sorted(r.title for r in books.collect()) == ["Marked", "One", "Plain", "Same"]
    got = blocks.join(books.select("book_id", "title"), "book_id").orderBy("title", "start").collect()
    assert [(r.title, r.kind, r.text) for r in got] == [
        ("Marked", "heading", "Head"), ("Marked", "list_item", "one"), ("Marked", "list_item", "two"), ("Marked", "paragraph", "All of the rest, which goes on for so long that what the marks say is believed."), ("One", "heading", "Eins"), ("One", "paragraph", "erster Teil, ß"),
        ("One", "heading", "Two"), ("One", "paragraph", "second   part, long enough to be believed"), ("Plain", "heading", "Prologue"), ("Plain", "paragraph", "It was early."), ("Same", "heading", "Prologue"),
    ]


PAGES = [
    (b"<p>a</p>b", ("a\nb", 1)), (b"<p>a</p><![odd[x]]><p>b<br>c</p>", ("a\n\n b\nc", 2)), (b"<!-- x --><![odd[x]]> t &amp; u", ("t &amp; u", 3)), (b"", ("", 1)), (None, ("", 1)),
    (b"<p>caf\xe9</p>", ("café", 1)), (b'<meta charset="iso-8859-5"><p>\xd4\xd0</p>', ("да", 1)), (b'<meta charset="none-such"><p>\xc3\xa9</p>', ("é", 1)), ("﻿<p>é</p>".encode(), ("é", 1)),
    (b"<div>" * 600 + b"deep", ("deep", 2)), (b"<p>1 < 2 &lt; 3</p>", ("1 < 2 < 3", 1)), (b"<p>torn <b>off", ("torn\noff", 1)), (b"\xff<![odd[x]]>\xfe a", ("a", 3)), (b"<script>x<y</script><style>p{}</style><p>z</p>", ("z", 1)),
]


def test_tiers(spark):
    got = markup.read_pages(spark.createDataFrame([(k, c) for k, (c, _) in enumerate(PAGES)], "k int, content binary"), "k").collect()
    assert {r.k: (r.text, r.tier) for r in got} == {k: want for k, (_, want) in enumerate(PAGES)}
    assert all((r.error is None) == (r.tier == 1) and (r.blocks == [] or r.tier == 1) for r in got)


def test_names_without_a_semicolon(spark):
    """HTML reads them, XML does not; a title that was cut within a reference has one at its end."""
    page = b"<h1>cut &amp</h1><p>a &copy b &amp; c &amp;copy; &notit; &#169;</p>"
    for closed, want in ((False, "cut &\na \xa9 b & c &copy; \xacit; \xa9"), (True, "cut &amp\na &copy b & c &copy; \xacit; \xa9")):
        assert markup.read_page(page, closed)[:2] == (want, 1)
        assert markup.flat(page, closed)[0].replace("\n\n", "\n") == want
        assert markup.page_text(spark.createDataFrame([(1, page.decode())], "page_id int, html string"), closed).first().text == want


def test_list_levels():
    html = "<ul><li>one</li></ul><ul><ol><li>two<ul><li>within</li></ul></li></ol></ul><div><ul><p>x</p><ul><ul><li>three</li></ul></ul></ul></div><li>none</li>"
    assert [(b["kind"], b["level"], b["text"]) for b in markup.read_blocks(html)] == [("list_item", 1, "one"), ("list_item", 2, "two within"), ("paragraph", 0, "x"), ("list_item", 3, "three"), ("list_item", 1, "none")]


OPS = ("start", "begin", "pause", "resume", "request", "end", "stop")


def replay(spark, tmp_path, schema, parts, over):
    """Run a stream over the parts one after another, each run continued from the checkpoint of the last."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = over(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        writer = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        state.started(out, writer).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


EVENTS = "event_id long, book_id long, ts timestamp, op string, chunk long"


def seconds(spark, rows):
    return [(i, b, spark.sql(f"select timestamp_seconds({s})").first()[0], op, c) for i, b, s, op, c in rows]


def test_playback_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    log = [(k, k % 3, 1000 + 7 * (k // 2), rng.choice(OPS), rng.randrange(9)) for k in range(150)]
    rows = seconds(spark, log)
    late = sorted(rows, key=lambda r: (r[2].timestamp() + rng.randrange(60), r[0]))
    end = seconds(spark, [(-1, -1, 10**6, "", None)])
    got = replay(spark, tmp_path, EVENTS, [late[:50], late[50:90], late[90:], end], lambda s: state.playback_events(s, "120 seconds"))
    want = positions.narration_states(spark.createDataFrame(rows, EVENTS)).select("event_id", "status", "playing")
    assert sorted(map(str, got.select("event_id", "status", "playing").collect())) == sorted(map(str, want.collect()))


def test_playback_forced_stop_and_initial_state(spark, tmp_path):
    """A request that no end follows is forced; one that an end or a start follows is not. A book goes on from its given state."""
    rows = seconds(spark, [(1, 0, 100, "begin", 4), (2, 0, 110, "request", None), (3, 0, 200, "begin", 5), (4, 1, 100, "end", None), (5, 2, 100, "request", None), (6, 2, 105, "end", None), (7, 3, 100, "request", None), (8, 3, 101, "start", None), (9, 3, 300, "pause", None)])
    before = spark.createDataFrame([(1, "PLAYING", 7, True), (3, "PLAYING", 2, False)], "book_id long, status string, playing long, requested boolean")
    got = replay(spark, tmp_path, EVENTS, [rows, seconds(spark, [(-1, -1, 10**6, "", None)])], lambda s: state.playback_events(s, "10 seconds", 30_000, before))
    assert sorted((r.book_id, r.us // 10**6, r.op, r.status, r.playing) for r in got.collect()) == [
        (0, 100, "begin", "PLAYING", 4), (0, 110, "request", "PLAYING", 4), (0, 140, "forced", "STOPPED", None), (0, 200, "begin", "PLAYING", 5), (1, 100, "end", "STOPPED", None),
        (2, 100, "request", "IDLE", None), (2, 105, "end", "STOPPED", None), (3, 100, "request", "PLAYING", 2), (3, 101, "start", "PLAYING", 2), (3, 300, "pause", "PAUSED", 2),
    ]


def test_publisher_batch_and_stream(spark, tmp_path):
    rng = random.Random(4)
    results = [(b, n, f"{b}/{n}") for b in range(3) for n in range(40) if (b, n) not in ((1, 25), (2, 0))]
    rng.shuffle(results)
    parts = [results[:30], results[30:31] + results[:5], results[31:], [results[0]]]
    got = replay(spark, tmp_path, "book_id long, span_no long, result string", parts, state.published_events).collect()
    ready = spark.createDataFrame([(b, n, (b, n) not in ((1, 25), (2, 0))) for b in range(3) for n in range(40)], "book_id long, span_no long, ready boolean")
    want = selection.published(ready).select("book_id", "span_no").collect()
    assert sorted((r.book_id, r.span_no) for r in got) == sorted(map(tuple, want))
    assert all(r.result == f"{r.book_id}/{r.span_no}" and r.may_start == r.span_no + selection.AHEAD for r in got)
