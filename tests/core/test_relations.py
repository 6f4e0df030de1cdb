"""Operators over small relations, and streams against their batch forms."""

import json
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import audio
from spanloom.functions.dialect import SPARK
from spanloom.functions import predicates as P
from spanloom.operators import asof, chunking, concepts, layout, loading, positions, speech, structure
from spanloom.sources import books as B
from spanloom.sources import markup, stores
from spanloom.streaming import state

BOOK = "Contents\n\nPrologue . . . . 1\nChapter 1 . . . . 3\n\nPrologue\n\nIt was early.\nAll was still.\n\n12\n\nCHAPTER ONE\n\nThen it began, and it did not end.\n\n---"


def book(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "book_id long, text string")


def blocks_of(spark, *texts):
    return structure.blocks(structure.lines(book(spark, *texts)))


def test_lines_are_the_text(spark):
    rows = structure.lines(book(spark, BOOK, "", "x\n\n", "ß😀\nb")).collect()
    for i, text in enumerate([BOOK, "", "x\n\n", "ß😀\nb"]):
        mine = sorted((r for r in rows if r.book_id == i), key=lambda r: r.n)
        assert all(text[r.start : r.end] == r.line for r in mine)
        assert "\n".join(r.line for r in mine) == text


def test_blocks(spark):
    got = [(r.kind, r.level, r.text) for r in blocks_of(spark, BOOK).orderBy("block_no").collect()]
    assert got == [
        ("heading", 1, "Contents"), ("toc_entry", 0, "Prologue . . . . 1"), ("toc_entry", 0, "Chapter 1 . . . . 3"), ("heading", 1, "Prologue"), ("paragraph", 0, "It was early. All was still."),
        ("page_number", 0, "12"), ("heading", 1, "CHAPTER ONE"), ("paragraph", 0, "Then it began, and it did not end."), ("separator", 0, "---"),
    ]


def test_running_heads_need_three(spark):
    text = lambda n: "\n\n".join(f"THE BOOK {k}\n\nSome prose here, number {k}." for k in range(n))
    kinds = {r.book_id: r.k for r in blocks_of(spark, text(2), text(3)).groupBy("book_id").agg(F.collect_set("kind").alias("k")).collect()}
    assert "running_head" not in kinds[0] and "running_head" in kinds[1]


def test_boundary(spark):
    b = blocks_of(spark, BOOK, "Just prose here, nothing else.", "Contents\n\nOne\nTwo\n\nChapter 1\n\nBody, it is.")
    got = {r.book_id: r for r in structure.boundary(b).collect()}
    assert BOOK[got[0].contents_end :].lstrip().startswith("Prologue\n\nIt was")
    assert BOOK[got[0].body_opening :].startswith("Prologue\n\nIt") and got[0].reading_start == got[0].body_opening
    assert (got[1].contents_end, got[1].reading_start) == (0, 0)
    s = structure.sections(b)
    titles = [r.title for r in structure.chapters(s).where("book_id = 0").orderBy("chapter_no").collect()]
    assert titles == ["Prologue", "CHAPTER ONE"]


def test_guardrail(spark):
    sparse = "x" * 200 + "\n" * 300
    b = blocks_of(spark, BOOK, sparse)
    got = {r.book_id: r.structured for r in structure.coverage(book(spark, BOOK, sparse), b).collect()}
    assert got == {0: False, 1: False} or got[1] is False
    whole = structure.guarded_blocks(book(spark, BOOK, sparse), b).where("book_id = 1").collect()
    assert [(r.kind, r.start, r.end) for r in whole] == [("paragraph", 0, len(sparse))]


def test_render_round_trip(spark):
    b = blocks_of(spark, BOOK)
    r = structure.render_blocks(b, structure.boundary(b))
    text = structure.render_text(r).first().text
    rows = r.collect()
    assert all(text[x.render_start : x.render_end] == x.text for x in rows)
    probes = spark.createDataFrame([(0, x.start + 1) for x in rows if x.end - x.start > 1], "book_id long, pos long")
    there = structure.to_render(probes, r)
    back = structure.to_source(there.select("book_id", F.col("pos").alias("was"), F.col("mapped").alias("pos")), r).collect()
    assert all(x.was == x.mapped for x in back)


def test_runs(spark):
    b = blocks_of(spark, BOOK)
    runs = structure.narration_runs(book(spark, BOOK), b, structure.boundary(b)).orderBy("run_no").collect()
    assert [r.kind for r in runs] == ["heading", "paragraph", "heading", "paragraph"]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_asof(spark, parts):
    rows = spark.createDataFrame([(1, 10, 20), (1, 30, 40)], "k long, s long, e long")
    probes = spark.createDataFrame([(1, p) for p in (5, 10, 19, 20, 35, 50)] + [(2, 5)], "k long, p long")
    back = {(r.k, r.p): r.hit.s if r.hit else None for r in asof.backward(probes, "p", rows, "s", "k", parts=parts).collect()}
    assert back == {(1, 5): None, (1, 10): 10, (1, 19): 10, (1, 20): 10, (1, 35): 30, (1, 50): 30, (2, 5): None}
    ahead = {(r.k, r.p): r.hit.s if r.hit else None for r in asof.forward(probes, "p", rows, "e", "k", parts=parts).collect()}
    assert ahead == {(1, 5): 10, (1, 10): 10, (1, 19): 10, (1, 20): 30, (1, 35): 30, (1, 50): None, (2, 5): None}


def test_asof_of_a_hot_key_is_many_tasks(spark):
    """Four probes of five ask one key, many of them one place; ranges give what one window gives."""
    probes = spark.range(20_000).select(F.when(F.col("id") % 5 < 4, 1).otherwise(F.col("id") % 50).alias("k"), F.when(F.col("id") % 3 == 0, 777).otherwise(F.col("id") * 37 % 5000).cast("long").alias("p"), "id")
    rows = spark.range(300).select(F.when(F.col("id") < 250, 1).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 17).alias("s"), (F.col("id") * 17 + 9).alias("e"))
    for find in (lambda n: asof.backward(probes, "p", rows, "s", "k", parts=n), lambda n: asof.backward(probes, "p", rows, "s", "k", clamp=True, parts=n), lambda n: asof.forward(probes, "p", rows, "e", "k", parts=n)):
        one, many = ({r.id: r.hit and (r.hit.k, r.hit.s) for r in find(n).collect()} for n in (1, 12))
        assert one == many and len(one) == 20_000
    spread = asof._ranged(asof._both(probes, "p", rows, "s", "k"), 12).where("_k = 1 and _side = 1").groupBy("_part").count().collect()
    assert len(spread) >= 8 and max(r["count"] for r in spread) <= 4000


def test_parts_are_measured(spark, monkeypatch):
    probes = spark.range(1000).select((F.col("id") % 3).alias("k"))
    assert asof.parts_of(probes, "k") == asof.parts_of(probes.limit(0), "k") == 1
    monkeypatch.setattr(asof, "PROBES", 100)
    assert asof.parts_of(probes, "k") == 10


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_lines_in_segments(spark, segment):
    texts = book(spark, BOOK, "", "x\n\n", "ß😀\nb", "a" * 50, "\n".join("y" * (k % 7) for k in range(500)))
    assert sorted(structure.lines(texts, segment).collect()) == sorted(structure.lines(texts).collect())


def test_reports_of_one_very_long_chunk(spark):
    """Linear in the reports: an array that grows at each step would take hours here."""
    rows = spark.range(400_000).select(F.lit(0).cast("long").alias("book_id"), F.lit(0).cast("long").alias("chunk"), (F.col("id") * 25).alias("ms"), F.col("id").alias("span"))
    assert positions.reports(rows).count() == 400_000


def test_fold_keeps_states_apart(spark):
    from spanloom.operators.folds import folded

    rows = spark.createDataFrame([(k % 3, None if k % 7 == 0 else k, f"v{k}") for k in range(50)], "k int, n int, v string")

    def step(state, columns):
        seen = state or 0
        return [n is not None for n in columns[0]], [list(range(seen, seen + len(columns[0])))], seen + len(columns[0])

    got = folded(rows, ["k"], ["n"], ["n"], step, [("at", "long")]).collect()
    for k in range(3):
        mine = sorted((r.at, r.n) for r in got if r.k == k)
        nulls = sum(1 for j in range(50) if j % 3 == k and j % 7 == 0)
        assert [n for _, n in mine] == sorted(j for j in range(50) if j % 3 == k and j % 7) and [a for a, _ in mine] == list(range(nulls, nulls + len(mine)))
    assert folded(rows.limit(0), ["k"], ["n"], ["n"], step, [("at", "long")]).collect() == []


def test_progress(spark):
    ch = spark.createDataFrame([(0, 0, "Prologue", 0), (0, 1, "Chapter 1", 200), (0, 2, "Chapter 2", 600)], "book_id long, chapter_no long, title string, char_offset long")
    probes = spark.createDataFrame([(0, 800), (0, 50), (0, 200)], "book_id long, pos long")
    got = {r.pos: (r.label, r.previous, r.next) for r in structure.placed(probes, ch, book(spark, "x" * 1000)).collect()}
    assert got == {800: ("Chapter 2 - 50%", "Chapter 1", None), 50: ("Prologue - 25%", None, "Chapter 1"), 200: ("Chapter 1 - 1%", "Prologue", "Chapter 2")}


def layout_line(text, size=10.0, bold=False, top=400.0, page=0, block=0, ord_=0):
    return (0, ord_, page, block, text, float(size), bold, float(top), 800.0)


def test_layout(spark):
    rows = [layout_line("BOOK TITLE 7", top=20, page=p, ord_=10 * p) for p in range(4)]
    rows += [layout_line("A Heading", 18, page=0, ord_=1), layout_line("Body text that is much longer than the rest of it", page=0, ord_=2), layout_line("and breaks a wo-", page=0, block=1, ord_=3), layout_line("rd over lines", page=0, block=1, ord_=4), layout_line("12", top=780, page=1, ord_=11)]
    df = spark.createDataFrame(rows, B.LAYOUT)
    assert layout.body_sizes(df).first().body == 10.0
    kinds = {r.ord: r.kind for r in layout.classified(df).collect()}
    assert kinds == {0: "running_head", 10: "running_head", 20: "running_head", 30: "running_head", 1: "heading", 2: "paragraph", 3: "paragraph", 4: "paragraph", 11: "page_number"}
    drafts = [(r.kind, r.text) for r in layout.drafts(layout.classified(df)).orderBy("ord").collect()]
    assert drafts == [("heading", "A Heading"), ("paragraph", "Body text that is much longer than the rest of it"), ("paragraph", "and breaks a word over lines")]
    f = layout.furniture(layout.classified(df))
    assert layout.stripped(df, f).count() == 4


def test_layout_json(spark):
    page = {"height": 800, "blocks": [{"lines": [{"bbox": [0, 10, 5, 20], "spans": [{"text": "Hi ", "size": 9, "flags": 0}, {"text": "you", "size": 12, "flags": 16}]}, {"bbox": [0, 0, 0, 0], "spans": [{"text": " ", "size": 1, "flags": 0}]}]}, {"image": 1}]}
    got = B.layout_from_json(spark.createDataFrame([(0, 0, json.dumps(page)), (0, 1, "no json")], "book_id long, page_index int, json string")).collect()
    assert [(r.text, r.size, r.bold, r.top, r.bottom) for r in got] == [("Hi you", 12.0, True, 10.0, 20.0)]


def test_markup():
    html = "<h1>One</h1><script>var t='</p>'</script><blockquote><p>in <b>a</b></p></blockquote><ul><li>x<ul><li>y</li></ul></li></ul><p>a<br>b<p>c</p>"
    got = [(b["kind"], b["level"], b["text"]) for b in markup.read_blocks(html)]
    assert got == [("heading", 1, "One"), ("block_quote", 0, "in a"), ("list_item", 1, "x y"), ("paragraph", 0, "a b"), ("paragraph", 0, "c")]


def test_stores(spark):
    doc = {"next_id": 3, "bookmarks": [{"bookmark_id": 5, "name": "b", "char_offset": 9, "chunk_index": 1, "created_at": "x"}, {"name": "lost"}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "[]"), (3, "broken")], "book_id long, json string")
    assert [(r.book_id, r.bookmark_id) for r in stores.bookmarks_from_json(df).collect()] == [(1, 5)]
    assert {r.book_id: r.next_id for r in stores.next_ids(df).collect()} == {1: 6, 2: 1, 3: 1}


def test_timing(spark):
    text = "Hello world. This is a test."
    spans = speech.timed(spark.createDataFrame([(1, text, 1000)], "item_id long, speak_text string, duration_ms long"), "item_id")
    rows = spans.orderBy("k").collect()
    assert [text[r.start_char : r.end_char] for r in rows] == text.split()
    assert rows[0].start_ms == 0 and rows[-1].end_ms == 1000 and all(a.end_ms == b.start_ms for a, b in zip(rows, rows[1:], strict=False))
    heard = {r.ms: text[r.start_char : r.end_char] for r in speech.heard(spans, spark.createDataFrame([(1, 0), (1, 5000)], "item_id long, ms long"), "item_id").collect()}
    assert heard == {0: "Hello", 5000: "test."}


def test_audio(spark):
    df = spark.createDataFrame([([0.0, 0.5, 1.0, 0.0],)], "a array<double>")
    one = lambda e: df.select(F.expr(e).alias("o")).first().o
    assert one(audio.scaled(SPARK, "a", 0.5)) == [0.0, 0.25, 0.5, 0.0] and one(audio.scaled(SPARK, "a", 2)) == [0.0, 0.5, 1.0, 0.0]
    assert one(audio.resampled(SPARK, "a", 2.0)) == [0.0, 0.0] and len(one(audio.resampled(SPARK, "a", 0.75))) == 5
    loud = df.withColumn("f", F.expr(audio.loud(SPARK, "a", 0.1)))
    assert loud.select(F.expr(audio.trimmed(SPARK, "a", "f", 0)).alias("o")).first().o == [0.5]


LOG = [(k, k % 3, k, ["add", "delete", "add", "view", "delete"][k % 5 if k % 7 else 1], 10 * k) for k in range(60)]


def test_bookmarks_batch_and_stream(spark, tmp_path):
    log = spark.createDataFrame(LOG, "event_id long, book_id long, ts long, op string, char_offset long")
    want: dict = {}
    for book_id in range(3):
        live, n = [], 0
        for _, b, _, op, _ in LOG:
            if b == book_id and op == "add":
                n += 1
                live.append(n)
            elif b == book_id and op == "delete" and live:
                live.pop(0)
        want[book_id] = live
    got: dict = {k: [] for k in range(3)}
    for r in positions.bookmarks(log).orderBy("bookmark_id").collect():
        got[r.book_id].append(r.bookmark_id)
    assert got == want
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = state.bookmark_events(stream).writeStream.outputMode("append").format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    live: dict = {k: set() for k in range(3)}
    for r in spark.sql("select * from marks").collect():
        (live[r.book_id].add if r.live else live[r.book_id].discard)(r.bookmark_id)
    assert {k: sorted(v) for k, v in live.items()} == want


def brute_reports(rows, gap=25):
    """Reports (book, chunk, ms, span) that are sent: let through by the time since the last let through, and of another span than it."""
    out, last = [], {}
    for b, c, ms, span in sorted(rows):
        at = last.get((b, c))
        if at is None or ms - at[0] >= gap:
            if at is None or at[1] != span:
                out.append((b, c, ms, span))
            last[b, c] = ms, span
    return sorted(out)


def test_throttle_batch_and_stream(spark, tmp_path):
    data = [(k % 2, k // 50, 7 * k, k // 5) for k in range(120)] + [(0, 0, 3, 0), (1, 1, 900, 7), (1, 1, 924, 8), (1, 1, 925, 8)]
    rows = spark.createDataFrame(data, "book_id long, chunk long, ms long, span long")
    want = brute_reports(data)
    assert 5 < len(want) < len(data)
    assert sorted(map(tuple, positions.reports(rows).collect())) == want
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = state.throttled_events(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("sent").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select book_id, chunk, ms, span from sent").collect())) == want


def test_narration_states(spark):
    ops = ["start", "begin", "pause", "resume", "request", "request", "end", "begin", "end", "request", "start", "begin", "end", "stop", "pause"]
    log = spark.createDataFrame([(k, 0, k, op, 10 + k) for k, op in enumerate(ops)], "event_id long, book_id long, ts long, op string, chunk long")
    got = [(r.status, r.playing) for r in positions.narration_states(log).orderBy("event_id").collect()]
    assert got == [
        ("IDLE", None), ("PLAYING", 11), ("PAUSED", 11), ("PLAYING", 11), ("PLAYING", 11), ("PLAYING", 11), ("STOPPED", None), ("PLAYING", 17), ("PLAYING", 17),
        ("PLAYING", 17), ("PLAYING", 17), ("PLAYING", 21), ("PLAYING", 21), ("STOPPED", None), ("PAUSED", None),
    ]


def test_utf16_round_trip(spark):
    whole = ["😀a😀😀b", "plain", "", "x😀"]
    t = book(spark, *whole).withColumnRenamed("book_id", "k")
    probes = spark.createDataFrame([(k, p) for k, s in enumerate(whole) for p in range(len(s) + 1)], "k long, pos long")
    there = {(r.k, r.pos): r.utf16 for r in positions.to_utf16(t, probes, "k").collect()}
    assert there == {(k, p): len(s[:p].encode("utf-16-le")) // 2 for k, s in enumerate(whole) for p in range(len(s) + 1)}
    units = spark.createDataFrame([(k, u) for k, s in enumerate(whole) for u in range(len(s.encode("utf-16-le")) // 2 + 1)], "k long, utf16 long")
    back = {(r.k, r.utf16): r.pos for r in positions.from_utf16(t, units, "k").collect()}
    for (k, u), p in back.items():
        assert there[k, p] == u or there[k, p] == u - 1  # the second unit of a wide character is at its first


def test_admitted_jobs(spark):
    states = ["running", "running", "completed", "running", "cancelled", "running", "running"]
    log = spark.createDataFrame([(k, 0, k, s) for k, s in enumerate(states)], "event_id long, book_id long, ts long, state string")
    assert [r.event_id for r in positions.admitted(log).orderBy("event_id").collect()] == [0, 2, 3, 4, 5]


def test_text_files_leave_bad_bytes_out(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc\xff\xfedef")
    (tmp_path / "b.txt").write_bytes("fine � kept é".encode())
    (tmp_path / "c.txt").write_bytes(b"")
    got = {r.path[-5]: r.text for r in B.text_files(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"a": "abcdef", "b": "fine � kept é"}  # Spark gives no row for an empty file


def test_loaded_files(spark):
    plain, marked = "Prologue\n\nIt was early.\n\nCHAPTER ONE\n\nThen it began, and it did not end.", "# Title\n\nSome *text* here, which goes on for a while so that it covers enough.\n\n- a\n  - b"
    files = spark.createDataFrame([("/b/One.txt", plain.encode()), ("/b/Two.MD", marked.encode()), ("/b/copy/One.txt", plain.encode()), ("/b/Gap.txt", ("x" * 9 + "\n\n\n" + "\n").encode())], "path string, content binary")
    books, blocks = loading.loaded(files)
    assert books.count() == 3
    kinds = {}
    for r in blocks.join(books.select("book_id", "title"), "book_id").orderBy("title", "block_no").collect():
        kinds.setdefault(r.title, []).append(r.kind)
    assert kinds == {"Gap": ["paragraph"], "One": ["heading", "paragraph", "heading", "paragraph"], "Two": ["heading", "paragraph", "list_item", "list_item"]}
    with pytest.raises(Exception, match="unsupported format"):
        loading.parsed(spark.createDataFrame([("/b/x.doc", b"")], "path string, content binary")).collect()


def brute_nodes(text, start):
    """Headings and concepts of a text with the chunk that each leads to, one after another."""
    whole = text[: concepts.CHARACTERS]
    body = whole[start:]
    spans = [(s, e) for t, s, e in chunking.chunk(body) if chunking.spoken(t)]
    at, out = 0, [("Top Concepts", 0)] * bool(spans)
    for line in body.split("\n"):
        s = line.strip()
        if 3 <= len(s) <= 80 and not s.endswith(".") and any(c.isalpha() for c in s) and s.count(":") <= 1 and ".." not in s:
            w = s.split()
            if re.match(r"(?i)(?:chapter|part)[ \t]+(?:\d+|[ivxlcdm]+)\b", s) or (len(w) <= 8 and sum(x[0].isupper() for x in w) >= max(1, len(w) // 2)):
                out.append((s, at))
        at += len(line) + 1
    n = {}
    for w in re.findall(concepts.TOKEN, body):
        if w.lower() not in P.STOPWORDS and len(w) >= 3:
            n[w.lower()] = n.get(w.lower(), 0) + 1
    words = sorted(n, key=lambda k: (-n[k], k))[:5]
    out += sorted(((w.replace("-", " ").title(), body.lower().index(w)) for w in words), key=lambda x: x[1])
    return [(label, next(i for i, (s, e) in enumerate(spans) if s <= p < e or s >= p), start + p) for label, p in out if any(s <= p < e or s >= p for s, e in spans)]


def test_concept_index(spark):
    text = "Front\n\n" + "\n\n".join(f"Chapter {k}\n\nThe river ran past mills and towers. Boats went down the river, {k} of them, to the sea.\n\nPrologue .. 23" for k in range(4)) + "\n\n" + "word " * 120
    got = concepts.index_nodes(spark.createDataFrame([(0, text, 7), (1, "", 0), (2, None, None)], "book_id long, text string, from long")).where("book_id = 0").collect()
    mine = [(r.label, r.chunk_index, r.char_offset) for r in sorted(got, key=lambda r: int(r.node_id[1:]))]
    assert mine == brute_nodes(text, 7) and not any("Prologue" in m[0] for m in mine)
    assert [r.anchor_id[1:] for r in got] == [r.node_id[1:] for r in got]


def test_upserts_keep_the_last_of_a_batch(spark, tmp_path):
    log = spark.createDataFrame(LOG, "event_id long, book_id long, ts long, op string, char_offset long")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen: list = []
    q = state.upserted(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), "book_id", "ts", lambda b: seen.extend(map(tuple, b.select("book_id", "char_offset").collect())), str(tmp_path / "cp"))
    q.awaitTermination()
    want = {r.book_id: r.char_offset for r in positions.resume(log).collect()}
    assert dict(seen) == want


def test_archives(spark, tmp_path):
    import zipfile

    from spanloom.sources import archives

    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="nav"/><itemref idref="b"/><itemref idref="a"/></spine></package>'
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("OPS/package.opf", opf)
        for n in ("nav", "a", "b"):
            z.writestr(f"OPS/{n}.xhtml", f"<h1>{n}</h1>")
        z.writestr("OPS/img/1.png", b"one")
        z.writestr("OPS/cover.html", "<img class='c' src='img/1.png'>")
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    damaged = bytearray((tmp_path / "x.epub").read_bytes().replace(b"<h1>a</h1>", b"<h1>?</h1>", 1))
    (tmp_path / "damaged").mkdir()
    (tmp_path / "damaged" / "y.epub").write_bytes(bytes(damaged))
    assert [r.html for r in archives.documents(spark, str(tmp_path / "damaged")).collect()] == ["<h1>b</h1>"]
    got = archives.documents(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.name, r.html) for r in got] == [(0, "OPS/b.xhtml", "<h1>b</h1>"), (1, "OPS/a.xhtml", "<h1>a</h1>")]
    assert archives.cover_image((tmp_path / "x.epub").read_bytes()) == b"one" and archives.cover_image(b"") is None
    files = spark.createDataFrame([("f", "folder.png", 5), ("f", "Cover page.jpg", 5), ("f", "cover.webp", 0), ("g", "a.txt", 9)], "folder string, name string, length long")
    assert [tuple(r) for r in archives.covers(files).collect()] == [("f", "folder.png")]
