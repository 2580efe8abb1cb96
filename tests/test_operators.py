from __future__ import annotations

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quiremill.operators import blocks, catalog, contents, lines, matching, spans, structure, translation
from quiremill.sources import readers
from quiremill.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def line_rows(spark, items):
    return spark.createDataFrame([("w", i, *x) for i, x in enumerate(items)], "work_id string, line_index int, text string, blank_before boolean, indent int, role string, level int, join_next boolean, confidence double")


def test_line_table_offsets(spark):
    df = spark.createDataFrame([(1, "  a é\r\n\n​\nb"), (2, ""), (3, None)], "k int, text string")
    got = rows(lines.line_table(df, "k"))
    assert got == [(1, 0, "a é", 0, 5, True, 2), (1, 1, "b", 9, 10, False, 0)]
    text = "  a é\n\n​\nb"
    assert all(text[s:e].strip() == t for _, _, t, s, e, _, _ in got)


def test_blocks(spark):
    x = line_rows(spark, [("CHAPTER I", True, 0, "heading", 1, False, 1.0), ("It was a won-", True, 0, "prose", 0, True, 1.0), ("der to see", False, 0, "prose", 0, True, 1.0), ("it.", False, 0, "prose", 0, None, 1.0), ("Roses", True, 4, "verse_line", 0, False, 1.0), ("Violets", False, 4, "verse_line", 0, False, 1.0), ("Sugar", True, 4, "verse_line", 0, False, None)])
    b = blocks.from_labels(x, "work_id")
    assert [(r["type"], r["text"]) for r in b.orderBy("block").collect()] == [("heading", "CHAPTER I"), ("paragraph", "It was a wonder to see it."), ("stanza", "Roses\nViolets"), ("stanza", "Sugar")]
    m = blocks.markdown(b, "work_id").first()
    assert m["content_kind"] == "mixed" and m["markdown"].startswith("CHAPTER I\n\nIt was")
    assert rows(lines.uncertain_ranges(x, "work_id", "line_index")) == [("w", 4, 6)]


def test_block_ids_number_repeats(spark):
    b = spark.createDataFrame([("w", 1, "paragraph", "Hello, you!"), ("w", 2, "paragraph", "hello you"), ("w", 3, "heading", "…")], "work_id string, block int, type string, text string")
    assert [r["block_id"] for r in blocks.block_ids(b, "work_id").orderBy("block").collect()] == ["book:paragraph:hello-you", "book:paragraph:hello-you-2", "book:heading:empty"]


def test_merged_headings(spark):
    b = spark.createDataFrame([("w", 1, "heading", 1, "A"), ("w", 2, "heading", 2, "B"), ("w", 3, "heading", 3, "C"), ("w", 4, "paragraph", 0, "p")], "work_id string, block int, type string, level int, text string")
    assert [r["text"] for r in blocks.merged_headings(b, "work_id").orderBy("block").collect()] == ["A B", "C", "p"]


def test_patches(spark):
    b = spark.createDataFrame([("w", "a", "old"), ("w", "b", "keep")], "work_id string, block_id string, text string")
    p = spark.createDataFrame([("w", "a", 1, "one", True), ("w", "a", 2, "two", None), ("w", "gone", 3, "x", None)], "work_id string, block_id string, seq int, text string, hidden boolean")
    assert rows(blocks.patched(b, p, "work_id")) == [("w", "a", "two", True), ("w", "b", "keep", False)]


def test_sections_and_parents(spark):
    t = ["Title page", "BOOK I", "PART I", "CHAPTER I", "Text.", "BOOK II", "CHAPTER II", "NOTES"]
    df = spark.createDataFrame([("w", i, x, i * 10, i * 10 + len(x)) for i, x in enumerate(t)], "work_id string, line_index int, text string, start_char bigint, end_char bigint")
    s = structure.sections(df, "work_id")
    got = [(r["section"], r["kind"], r["start_char"], r["end_char"]) for r in s.orderBy("section").collect()]
    assert got[0] == (0, "front_matter", 0, 9) and got[3] == (3, "chapter", 30, 49) and [g[1] for g in got] == ["front_matter", "book", "part", "chapter", "book", "chapter"]
    assert [r["parent"] for r in structure.with_parents(s, "work_id").orderBy("section").collect()] == [None, None, 1, 2, None, 4]


def test_coverage(spark):
    r = spark.createDataFrame([("a", 2, 4), ("a", 4, 6), ("a", 9, 9)], "k string, start_char int, end_char int")
    n = spark.createDataFrame([("a", 12), ("b", 3), ("c", 0)], "k string, n int")
    assert rows(structure.coverage(r, n, "k")) == [("a", 3, 1, 6), ("b", 1, 0, 3), ("c", 0, 0, 0)]


def test_ranges_and_drops(spark):
    r = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 5), (1, 6, 8), (1, 7, 7)], "k int, start_char bigint, end_char bigint")
    assert rows(structure.merged_ranges(r, "k")) == [(1, 0, 3), (1, 6, 8)]
    t = spark.createDataFrame([(1, "abcdefghij"), (2, "xyz"), (3, None)], "k int, text string")
    assert rows(structure.dropped(t, r, "k")) == [(1, "defij"), (2, "xyz"), (3, None)]


def test_running_headers(spark):
    t = spark.createDataFrame([("w", x) for x in ["THE OLD MILL"] * 3 + ["CHAPTER II OF IT"] * 3 + ["Twice told"] * 4], "work_id string, text string")
    assert rows(lines.running_headers(t, "work_id")) == [("w", "THE OLD MILL", 3)]


def test_join_decisions(spark):
    t = ["It was the end of the", "road for him.", "CHAPTER II", "a new won-", "der"]
    df = spark.createDataFrame([("w", i, x, i == 2) for i, x in enumerate(t)], "work_id string, line_index int, text string, blank_before boolean")
    assert [(r["why"], r["join_next"]) for r in lines.join_decisions(df, "work_id").orderBy("line_index").collect()] == [("continuation", True), ("blank", False), ("continuation", True), ("hyphen", True)]


def test_reflow(spark):
    long = "x" * 54 + "-"
    df = lines.line_table(spark.createDataFrame([(1, f"{long}\nyes\n\nCHAPTER I\nnext")], "k int, text string"), "k")
    assert [r["text"] for r in lines.reflowed(df, "k").orderBy("block").collect()] == ["x" * 54 + "yes", "CHAPTER I", "next"]


def spans_of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    return [[(s.style, s.span, s.start, s.end) for s in r[0] or []] for r in df.orderBy("k").select(spans.inline_spans(F.col("t"))).collect()]


def test_inline_spans(spark):
    text = 'He _said_ “no, no”[12] (see Job) and (a (b) c d e f g h) 「はい」.'
    got = spans_of(spark, text, "", "(open", None, "  _all of it, to the end_ ", "a ) b (c) (d", "“a quotation with [7] inside”", "“x [7] y”", "（𝒜 (b)）", "()[ ]~~")
    assert [g[:2] for g in got[0]] == [("em", "_said_"), ("quote", "“no, no”"), ("footnote", "[12]"), ("paren_cite", "(see Job)"), ("paren_aside", "(a (b) c d e f g h)"), ("quote", "「はい」")]
    assert all(text[a:b] == s for _, s, a, b in got[0])
    assert got[1] == got[2] == got[3] == got[9] == []
    assert got[4] == [("em", "_all of it, to the end_", 0, 26)] and got[5] == [("paren_cite", "(c)", 6, 9)]
    assert got[6] == [("footnote", "[7]", 18, 21)] and got[7] == [("quote", "“x [7] y”", 0, 9)] and got[8] == [("paren_cite", "（𝒜 (b)）", 0, 7)]


def test_spans_offsets(spark, data):
    from quiremill.session import table

    s = spans.with_spans(table(spark, data, "inline_samples"), "sample_row", "text").join(table(spark, data, "inline_samples").select("sample_row", "text"), "sample_row")
    assert s.count() and s.where("substring(text, start + 1, end - start) <> span").count() == 0
    found = spans.expected_found(s, table(spark, data, "inline_samples")).agg(F.sum("expected"), F.sum("found")).first()
    assert found[1] / found[0] > 0.9


def test_pack_paragraphs_matches_a_loop(spark):
    import random

    rng = random.Random(4)
    counts = [rng.randint(1, 60) for _ in range(80)]
    df = spark.createDataFrame([(1, "\n\n".join(" ".join(["w"] * n) for n in counts)), (2, "")], "k int, text string")
    parts, cur, words = [], [], 0
    for i, n in enumerate(counts):
        if cur and (words + n > 120 or words >= 100):
            parts.append((cur[0], cur[-1], words))
            cur, words = [], 0
        cur, words = cur + [i], words + n
    parts.append((cur[0], cur[-1], words))
    got = [(r["first"], r["last"], r["words"]) for r in translation.packed(df, "k", "text", 100, 120).orderBy("part").collect()]
    assert got == parts


def test_repaired_paragraphs(spark):
    df = spark.createDataFrame([(1, "He went\n\non his way.\n\nCHAPTER I\n\nIt rained.")], "k int, text string")
    assert [r["text"] for r in translation.repaired_paragraphs(df, "k", "text").orderBy("paragraph").collect()] == ["He went\non his way.", "CHAPTER I", "It rained."]


def seg(spark, items):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, s, "w", ch, src, dr, fi, 30, t + dt.timedelta(days=i)) for i, (s, ch, src, dr, fi) in enumerate(items)], "seg_row bigint, segment_id string, work_id string, chapter string, source_text string, draft_raw string, final string, words int, arrived_at timestamp")


def test_completeness_and_assembly(spark):
    long = "A sentence that is quite long"
    s = seg(spark, [("a", "2", long + ".", None, long + "."), ("b", "1", long + ".", None, long), ("c", "3", "x", "draft", None), ("d", "4", "x", None, ""), ("a", "2", long + ".", None, "New text of it.")])
    assert {r["segment_id"]: r["completeness"] for r in translation.completeness(s).collect()} == {"a": "ok", "b": "truncated", "c": "raw_pending", "d": "empty"}
    a = translation.assembled(s).first()
    assert (a["segments"], a["missing"], a["chars"]) == (4, 3, len("New text of it."))
    assert translation.estimate(translation.completeness(s)).count() == 3


def test_parsed_objects(spark):
    df = spark.createDataFrame([(1, '```json\n{"n": 1}\n```'), (2, 'Sure: {"n": 2}. Done'), (3, "none"), (4, None)], "k int, t string")
    assert [r["value"] and r["value"]["n"] for r in translation.parsed_objects(df, "k", "t", "n int").orderBy("k").collect()] == [1, 2, None, None]


def test_contents_matching_goes_in_order(spark):
    body = spark.createDataFrame([("w", i, t) for i, t in enumerate(["The Mill", "x", "CHAPTER II", "CHAPTER I", "The road to the mill house", "CHAPTER II"])], "work_id string, line_index int, text string")
    toc = spark.createDataFrame([("w", 0, "Chapter I"), ("w", 1, "Mill road"), ("w", 2, "Chapter II. The End"), ("w", 3, "Chapter II")], "work_id string, entry int, label string")
    assert rows(contents.match_contents(body, toc, "work_id")) == [("w", 0, 3), ("w", 1, 4), ("w", 2, 5)]


def test_glossary_lookup(spark):
    g = spark.createDataFrame([("abbess", "x"), ("harbour", "y"), ("Été", "z")], "term_en string, term_vi string")
    asked = spark.createDataFrame([("Abbess",), ("harbours",), ("ete",), ("ab",), ("mill",)], "query string")
    assert rows(matching.glossary_lookup(asked, g)) == [("Abbess", "abbess", "exact"), ("ete", "Été", "exact"), ("harbours", "harbour", "prefix")]


def test_caption_score(spark):
    df = spark.createDataFrame([("old mill", "old mill"), ("old mill road", "the old mill road today"), ("mill", "the house where he was born by mill"), ("a b c", "a b z"), ("", "x")], "q string, c string")
    assert [r[0] for r in df.select(matching.caption_score(F.col("q"), F.col("c"))).collect()] == [1.0, 0.94, 0.0, pytest.approx(0.55 + 0.35 * 2 / 3), 0.0]


def test_catalog_faults(spark):
    w = spark.createDataFrame([(1, "a--x", "T", "ok"), (2, "a--x", "T", "ok"), (3, "Bad", "", "no"), (4, None, "T", None)], "work_row bigint, work_id string, work string, license string")
    lic = spark.createDataFrame([("ok",)], "id string")
    texts = spark.createDataFrame([("a--x",)], "work_id string")
    assert rows(catalog.check(w, lic, texts)) == sorted([(2, "duplicate id"), (3, "bad id"), (3, "missing title"), (3, "license not in catalog"), (3, "no text"), (4, "bad id"), (4, "license not in catalog"), (4, "no text")], key=repr)


def test_upsert(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    b = spark.createDataFrame([("2", "z"), ("3", "w")], "id string, v string")
    assert rows(catalog.upsert(a, b)) == [("1", "x"), ("2", "z"), ("3", "w")]


def test_readers(spark, tmp_path):
    (tmp_path / "kant").mkdir()
    (tmp_path / "kant" / "works.json").write_text(json.dumps([{"file": "a.txt", "work": "A", "concepts": ["x"]}, {"work": "no file"}]))
    got = readers.source_lists(spark, str(tmp_path)).collect()
    assert [(r["brain"], r["file"], r["concepts"]) for r in got] == [("kant", "a.txt", ["x"])]
    (tmp_path / "t.txt").write_text("héllo", encoding="utf-8")
    r = readers.text_files(spark, str(tmp_path / "t.txt")).first()
    assert r["text"] == "héllo" and len(r["digest"]) == 64
    (tmp_path / "rows.json").write_text('{"a": 1}\n{broken\n')
    good, bad = readers.json_rows(spark, str(tmp_path / "rows.json"), "a int")
    assert good.collect()[0]["a"] == 1 and bad.count() == 1


def test_html(spark):
    page = '<head><title>t</title></head><p>Hi&nbsp;you</p><img src="a/x.jpg" alt="X"><script>no()</script><img src=\'b/x.jpg\'><img alt="none"><img src="y.png">'
    df = spark.createDataFrame([(1, page)], "k int, html string")
    assert rows(readers.html_images(df, "k", "html")) == [(1, 0, "a/x.jpg", "X"), (1, 3, "y.png", "")]
    assert readers.html_text(df, "k", "html").first()["text"] == "Hi you"


def test_editions_cache(spark, tmp_path):
    e = spark.createDataFrame([("w", "h", "1.0", "en", "t"), ("v", "h", "0.9", "en", "u")], "work_id string, raw_hash string, parser_version string, language string, text string")
    readers.write_editions(e, str(tmp_path / "e"))
    hit = readers.cached_editions(spark, str(tmp_path / "e"), e.select("work_id", "raw_hash"), "1.0")
    assert [r["work_id"] for r in hit.collect()] == ["w"]


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    e = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i % 5), f"u{i % 3}", "a b") for i in range(30)], "id int, ts timestamp, who string, text string")
    e.write.parquet(str(src))
    batch = rows(streams.windowed_counts(e, "ts", "who"))
    stream = spark.readStream.schema(e.schema).parquet(str(src))
    done = streams.text_stream_stats(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert spark.read.parquet(str(out)).agg(F.sum("words")).first()[0] == 60
    counts = streams.windowed_counts(stream, "ts", "who").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert rows(spark.table("counts")) == batch


def test_rate(spark):
    e = spark.createDataFrame([("u", dt.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 10, 59)] + [("u", dt.datetime(2024, 1, 1, 0, 1, 0))], "who string, ts timestamp")
    assert [r["recent"] for r in streams.over_rate(e, "who", F.col("ts"), 60, 2).orderBy("ts").collect()] == [3, 3]


@pytest.mark.parametrize("name", ["line_table", "running_headers", "islands"])
def test_empty_tables(spark, name):
    empty = spark.createDataFrame([], "work_id string, line_index int, text string, extra string")
    if name == "line_table":
        assert lines.line_table(empty, "work_id").count() == 0
    elif name == "running_headers":
        assert lines.running_headers(empty, "work_id").count() == 0
    else:
        assert lines.islands(empty, ["work_id"], ["line_index"], F.col("text").isNotNull()).count() == 0


def test_notes(spark):
    from quiremill.operators import notes

    t = ["Text[1] and more[2, 4].", "FOOTNOTES:", "[1] First note", "goes on.", "[Footnote 2: Second.]", "CHAPTER II", "Not a note.", "NOTES", "1. Of the second chapter", "9. Nine"]
    df = spark.createDataFrame([("w", i, x) for i, x in enumerate(t)], "work_id string, line_index int, text string")
    b = notes.bodies(df, "work_id")
    assert rows(b) == [("w", 1, 1, "First note goes on."), ("w", 1, 2, "Second."), ("w", 2, 1, "Of the second chapter"), ("w", 2, 9, "Nine")]
    m = notes.marks(df.where("line_index = 0"), ["work_id"], "text")
    assert [r["number"] for r in m.orderBy("pos", "number").collect()] == [1, 2, 4]
    states = {r["number"]: r["state"] for r in notes.linked(m, b.where("dump = 1"), "work_id").collect()}
    assert states == {1: "linked", 2: "linked", 4: "no body"}
    assert rows(notes.gaps(m, "work_id")) == [("w", 2, 1)]
    blk = spark.createDataFrame([("w", 1, "none"), ("w", 2, "a[1]"), ("w", 3, "b[1][2]")], "work_id string, block int, text string")
    assert rows(notes.hosts(b.where("dump = 1"), blk, "work_id")) == [("w", 1, 2), ("w", 2, 3)]


def test_glossary_pointer(spark):
    from quiremill.operators import notes

    df = spark.createDataFrame([("See Glossary.",), ("[3] see glossary, “lute”.",), ("xem bảng chú giải: đàn",), ("See page 3",), (None,)], "b string")
    assert [r[0] for r in df.select(notes.glossary_pointer(F.col("b"))).collect()] == ["", "lute", "đàn", None, None]


def test_not_covered(spark):
    from quiremill.operators import notes

    e = spark.createDataFrame([("w", "old mill"), ("w", "river"), ("v", "old mill")], "work_id string, anchor string")
    n = spark.createDataFrame([("w", "About the Old Mill here.")], "work_id string, body string")
    assert rows(notes.not_covered(e, n, "work_id")) == [("v", "old mill"), ("w", "river")]


def test_edition(spark):
    from quiremill.operators import edition

    text = "*** START OF THE X EBOOK Y ***\n\nCHAPTER I\n\nIt was a long won-\nder of the road to the mill.\n\nTHE OLD MILL ROAD\n\nAnd so on.\n\nTHE OLD MILL ROAD\n\nMore.\n\nTHE OLD MILL ROAD\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string")
    made = edition.editions(df, "k")
    r = made.collect()
    assert len(r) == 1 and r[0]["markdown"] == "CHAPTER I\n\nIt was a long wonder of the road to the mill.\n\nAnd so on.\n\nMore."
    b = edition.edition_blocks(df, "k")
    assert list(edition.fidelity(df, b, made, "k").first())[1:] == [True] * 6
    worse = b.withColumn("text", F.when(F.col("type") == "heading", "CHAPTER 9").otherwise(F.col("text")))
    assert list(edition.fidelity(df, worse, made, "k").first())[1:] == [True, False, False, False, True, True]
    torn = b.withColumns({"type": F.when(F.col("type") == "heading", "odd").otherwise(F.col("type")), "spans": F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("em").alias("style"), F.lit("zz").alias("span")))})
    f = edition.fidelity(df, torn, made, "k").first()
    assert not f["schema"] and not f["spans_kept"] and not f["hash_kept"]


def test_verse_and_quotations(spark):
    from quiremill.operators import edition

    verse = ["The mill is old, the river wide,", "The ferry waits beyond the tide;", "And who shall cross it, who shall stay,", "And who shall sing the night away?"]
    quote = ["“He came to us at noon,", "and we were glad of him,", "and so was she.”"]
    text = "\n".join(verse) + "\n\n" + "\n".join(quote) + "\n\n" + "It was the first day of the year and the miller went down to the river with the baker,\nwho was his friend."
    got = [(r["text"], r["role"], r["join_next"]) for r in edition.labelled(lines_of(spark, text), "k").orderBy("line_index").collect()]
    assert [g[1] for g in got] == ["verse_line"] * 4 + ["prose"] * 5 and [g[2] for g in got[4:]] == [True, True, False, True, False]


def test_dialogue(spark):
    from quiremill.operators import edition

    t = ["HAMLET.", "To be", "or not to be.", "GHOST.", "Mark me.", "Enter the King", "HAMLET.", "I will.", "GHOST.", "CHAPTER II", "Plain."]
    df = spark.createDataFrame([("w", i, x, False, 0) for i, x in enumerate(t)], "work_id string, line_index int, text string, blank_before boolean, indent int")
    got = [r["role"] for r in edition.labelled(df, "work_id").orderBy("line_index").collect()]
    assert got == ["speaker_cue", "dialogue_line", "dialogue_line", "speaker_cue", "dialogue_line", "stage_direction", "speaker_cue", "dialogue_line", "speaker_cue", "heading", "prose"]


def test_block_errors(spark):
    from quiremill.operators import edition

    b = spark.createDataFrame([("paragraph", "x", 0), ("heading", "x", 9), ("odd", "", None), ("hr", None, None), (None, "x", 1)], "type string, text string, level int")
    assert [r["errors"] for r in edition.block_errors(b).collect()] == [["bad level"], ["unknown type", "no text"], ["unknown type"]]


def test_fallback_title(spark):
    df = spark.createDataFrame([("Chapter IV",), ("7",), ("Preface",), ("The Mill",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(translation.fallback_title(F.col("c"))).collect()] == ["Chương 4", "Chương 7", "Lời nói đầu", "The Mill", "Chương", "Chương"]


def test_content_matches(spark):
    t = spark.createDataFrame([("w", "the old mill"), ("w", "a very long title of the old mill road")], "k string, title string")
    x = spark.createDataFrame([("w", 0, "the old mill road"), ("w", 1, "the old mill"), ("w", 2, "a very long title of the mill and more"), ("v", 0, "the old mill")], "k string, line_index int, line string")
    assert rows(matching.content_matches(t, x, "k")) == [("w", "a very long title of the old mill road", 2), ("w", "the old mill", 1)]


def test_content_mentions(spark):
    t = spark.createDataFrame([("w", "the old mill"), ("w", "a very long title of the old mill road"), ("w", "mill"), ("w", "winter harbour")], "k string, title string")
    x = spark.createDataFrame([("w", 0, ""), ("w", 1, "17 the old mill 18"), ("w", 2, "a very long title of the mill and more"), ("w", 3, "mills"), ("w", 4, "winter"), ("v", 0, "the old mill"), ("w", 5, None)], "k string, line_index int, line string")
    assert rows(matching.content_mentions(t, x, "k")) == [("w", "a very long title of the old mill road", 2), ("w", "the old mill", 1), ("w", "winter harbour", 4)]


def test_heading_candidate_lines_are_not_capped(spark, tmp_path):
    from quiremill.plans import line_queries

    spark.createDataFrame([(i, "w", i, f"CHAPTER {i}", None) for i in range(15)], "line_id bigint, work_id string, line_index int, text string, gutenberg_id string").write.parquet(f"{tmp_path}/text_lines.parquet")
    spark.createDataFrame([(i, "heading" if i < 12 else "prose", i / 20) for i in range(15)], "line_id bigint, role string, confidence double").write.parquet(f"{tmp_path}/line_labels.parquet")
    assert sorted(tuple(r) for r in line_queries.heading_candidate_lines(spark, str(tmp_path)).collect()) == [("w", i, i / 20) for i in range(12)]


def brute_contents(body, entries):
    """Each entry takes the first line behind the last entry's that fits it."""
    numbered = re.compile(r"^\s*(?:chapter|chap\.?|book|part|volume)\s+([ivxlcdm]+|\d+)\b[.:]?\s*", re.I)
    out, at = [], -1
    for n, label in entries:
        m = numbered.match(label)
        key = matching.folded(numbered.sub("", label)) or matching.folded(label)
        weight = {w for w in key.split() if w not in matching.STOP_WORDS and len(w) > 1}
        for i, t in body:
            f, b = matching.folded(t), numbered.match(t)
            fits = b is not None and b[1].lower() == m[1].lower() if m else bool(f) and (f == key or (len(weight) >= 2 and weight <= set(f.split())))
            if i > at and len(t) <= 120 and fits:
                out.append((n, i))
                at = i
                break
    return out


def test_contents_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["mill", "river", "the", "Café", "old", "of", "harvest"]
    texts = {}
    for k in range(12):
        body = [(i, rng.choice([f"Chapter {rng.randint(1, 5)}", f"BOOK {rng.choice(['i', 'ii', 'IV'])}. {rng.choice(words)}", " ".join(rng.choices(words, k=rng.randint(1, 5)))])) for i in range(25)]
        entries = [(n, rng.choice([f"CHAPTER {rng.randint(1, 5)}.", f"Book {rng.choice(['I', 'ii'])}", " ".join(rng.choices(words, k=rng.randint(1, 3)))])) for n in range(8)]
        texts[f"w{k}"] = (body, entries)
    lines_ = spark.createDataFrame([(k, i, t) for k, (b, _) in texts.items() for i, t in b] + [("x", 0, None)], "work_id string, line_index int, text string")
    entries_ = spark.createDataFrame([(k, n, t) for k, (_, e) in texts.items() for n, t in e] + [("x", 0, None), ("y", 0, "mill")], "work_id string, entry int, label string")
    got = contents.match_contents(lines_, entries_, "work_id").collect()
    assert sorted(map(tuple, got)) == sorted((k, n, i) for k, (b, e) in texts.items() for n, i in brute_contents(b, e))
    assert contents.match_contents(lines_.limit(0), entries_, "work_id").count() == 0


def lines_of(spark, *texts):
    return lines.line_table(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string"), "k")


def test_contents_runs_and_stubs(spark):
    prose = "It was the first day of the year and the miller went down to the river with the baker and the widow."
    book = ["CONTENTS", "CHAPTER I. The Mill", "CHAPTER II. The River", "THE HARVEST", "", "CHAPTER I.", prose, prose, "CHAPTER II", "The ferry—the widow—the bell", "CHAPTER III", prose]
    t = lines_of(spark, "\n".join(book), prose, "", None, "1. Mill\n2. River\n3. Bell")
    runs = {r["k"]: r for r in contents.contents_runs(t, "k").where("run = 1").collect()}
    assert sorted(runs) == [0, 4] and runs[0]["headed"] and [runs[0][c] for c in ("first_line", "last_line")] == [0, 3] and runs[4]["rows"] == 3 and not runs[4]["headed"]
    assert rows(contents.stub_chapters(t, "k")) == [(0, 7)]
    assert contents.contents_runs(t.limit(0), "k").count() == contents.stub_chapters(t.limit(0), "k").count() == 0


def test_bound_captions(spark):
    rng = random.Random(2)
    scores = [(k, f, i, rng.choice([0.3, 0.6, 0.94, 1.0])) for k in "ab" for f in range(6) for i in range(5) if rng.random() < 0.7]
    want = set()
    for k in "ab":
        for _, f, i, x in sorted((s for s in scores if s[0] == k and s[3] >= 0.55), key=lambda s: (-s[3], s[1], s[2])):
            if not any(a == k and (b == f or c == i) for a, b, c in want):
                want.add((k, f, i))
    df = spark.createDataFrame(scores + [("a", None, 1, None)], "k string, figure int, image int, score double")
    assert set(rows(matching.bound_captions(df, "k"))) == want and want and matching.bound_captions(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("before,after,gap,gutenberg,why,joins", [
    ("The miller went down to the", "river.", True, False, "hanging across a blank", True), ("He came.", "She left.", True, True, "blank", False), ("The end of the matter", "CHAPTER II", False, True, "structure", False), ("one", "* * * * *", False, True, "rule", False),
    ("he wrote", "And in this wise:", False, True, "lead in", False), ("“no more.”[12]", "then", False, True, "closed quote", False), ("“He came to us,", "And we were glad", False, False, "quotation", True), ("a miller and a ba-", "ker came", False, False, "hyphen", True),
    ("the miller said", "nothing at all", False, False, "continuation", True), ("Said Dr.", "(so they tell)", False, False, "continuation", True), ("It was the longest day that anyone could remember, so", "The baker slept", False, False, "ended", False), ("It was the longest day that anyone could remember, so said", "The baker slept", False, False, "wrapped", True),
    ("as follows:", "“Come”", False, False, "continuation", True), ("see [Job", "12:3]", False, False, "open bracket", True), ("A short one", "Of two", False, True, "default", True), ("A short one", "Of two", False, False, "ended", False), ("LONDON", "MDCCCXC", True, True, "imprint", True), ("It ended here.", "The next", False, True, "ended", False),
])
def test_join_evidence(spark, before, after, gap, gutenberg, why, joins):
    df = spark.createDataFrame([("w", 0, before, False), ("w", 1, after, gap)], "k string, line_index int, text string, blank_before boolean")
    assert rows(lines.join_decisions(df, "k", F.lit(gutenberg))) == [("w", 0, joins, why)]


def test_blocks_of_all_types(spark):
    said = [("speaker_cue", "THE MILLER.", False), ("dialogue_line", "I came from the ri-", True), ("dialogue_line", "ver.", False), ("speaker_cue", "BAKER.", False), ("hr", "* * *", False), ("stage_direction", "Exit baker", False), ("metadata", "a", False), ("metadata", "b", False), ("toc", "I. One", True), ("toc", "II. Two", False)]
    said += [("verse_line", "“O mill,", False), ("verse_line", "O bell", False), ("blockquote", "quoted ba-", False), ("blockquote", "ker", False), ("list_item", "(1) one", False), ("heading", "ACT I", False), ("heading", "SCENE I", False), ("odd", "plain", None)]
    df = spark.createDataFrame([("w", i, r, 1 if r == "heading" else 0, t, j, False) for i, (r, t, j) in enumerate(said)], "k string, line_index int, role string, level int, text string, join_next boolean, blank_before boolean")
    made = blocks.from_labels(df, "k")
    got = [(r["type"], r["text"], r["speaker"]) for r in made.orderBy("block").collect()]
    assert got == [
        ("dialogue", "I came from the river.", "THE MILLER"), ("stage_direction", "BAKER.", None), ("hr", "", None), ("stage_direction", "Exit baker", None), ("metadata", "a\nb", None), ("metadata", "I. One\nII. Two", None), ("blockquote", "“O mill,\nO bell", None),
        ("blockquote", "quoted baker", None), ("list_item", "(1) one", None), ("heading", "ACT I", None), ("heading", "SCENE I", None), ("paragraph", "plain", None),
    ]
    both = blocks.merged_neighbours(blocks.merged_neighbours(made, "k", "metadata"), "k", "blockquote")
    assert [r["text"] for r in both.where("type in ('metadata', 'blockquote')").orderBy("block").collect()] == ["a\nb\nI. One\nII. Two", "“O mill,\nO bell quoted baker"]
    assert blocks.merged_headings(both, "k").where("type = 'heading'").count() == 2
    r = blocks.markdown(both.withColumn("hidden", F.col("type") == "list_item"), "k").first()
    assert r["content_kind"] == "drama" and "THE MILLER. I came" in r["markdown"] and "[Exit baker]" in r["markdown"] and "---" in r["markdown"] and "> “O mill" in r["markdown"] and "(1)" not in r["markdown"]
    assert blocks.from_labels(df.limit(0), "k").count() == 0
    stale = spark.createDataFrame([("w", "book:heading:act-i-2", 1, "x", None), ("w", "book:none:x", 2, "y", None)], "k string, block_id string, seq int, text string, hidden boolean")
    assert sorted((r["block_id"], r["candidate"]) for r in blocks.stale_patches(blocks.block_ids(both, "k"), stale, "k").collect()) == [("book:heading:act-i-2", "book:heading:act-i"), ("book:none:x", None)]


def test_glossary_terms_of_many_words(spark):
    t = dt.datetime(2024, 1, 1)
    seg = spark.createDataFrame([(0, "s", "The old mill of Saint-Denis, and the old mill; the miller's bell.", "cối xay cũ ở Saint-Denis", t), (1, "e", None, "x", t), (2, "n", "", None, t)], "seg_row bigint, segment_id string, source_text string, final string, arrived_at timestamp")
    terms = spark.createDataFrame([("old mill of Saint-Denis", "cối xay cũ ở Saint-Denis"), ("old mill", "cối xay"), ("mill", "xay"), ("miller's bell", "chuông"), ("miller", "thợ xay"), (None, "x")], "term_en string, term_vi string")
    assert rows(translation.glossary_hits(seg, terms)) == [("s", "miller's bell", False), ("s", "old mill of saint-denis", True), ("s", "old mill", True)]
    assert translation.glossary_hits(seg, terms.limit(0)).count() == translation.glossary_hits(seg.limit(0), terms).count() == 0


def test_glossary_keeps_last_rows(spark):
    df = spark.createDataFrame([(0, "mill", ["m"], "a"), (1, "mill", None, "b"), (2, "mill", ["m"], "c"), (3, "mill", [], "d")], "place int, name string, aliases array<string>, vi string")
    assert rows(translation.merged_glossary(df, "place")) == [("mill", ["m"], 0, "c"), ("mill", [], 1, "d")]


def test_oversized_paragraphs(spark):
    long = "One two three. Four five six! Seven eight nine? Ten"
    df = spark.createDataFrame([(1, f"{long}\n\nshort one"), (2, ""), (3, None), (4, "a b c d e f g h i")], "k int, t string")
    got = df.select("k", translation.sentence_pieces(F.col("t"), 6).alias("p")).orderBy("k").collect()
    assert got[0]["p"][0] == "One two three. Four five six!" and got[3]["p"] == ["a b c d e f g h i"] and got[1]["p"] == [""]
    parts = rows(translation.packed(df, "k", "t", 6, 6, split=True).select("k", "part", "words"))
    assert parts == [(1, 1, 6), (1, 2, 6), (4, 1, 9)]


def test_catalogue_faults_of_authors_and_originals(spark):
    cols = "work_row int, work_id string, brain string, work string, license string, origin string, derived_from string"
    works = spark.createDataFrame([(0, "a--x", "a", "X", "ok", None, None), (1, "b--y", "b", "Y", "ok", "hub_translation", "a--x"), (2, "b--z", "b", "Z", "ok", "hub_translation", "a--none"), (3, "b--q", "b", "Q", "ok", "hub_translation", None)], cols)
    ids, texts, authors = spark.createDataFrame([("ok",)], "id string"), spark.createDataFrame([("a--x",)], "work_id string"), spark.createDataFrame([("a",)], "id string")
    got = rows(catalog.check(works, ids, texts, authors))
    assert got == sorted([(1, "unknown author"), (2, "unknown author"), (3, "unknown author"), (2, "unknown original"), (3, "translation without its original")], key=repr)
    assert catalog.check(works.limit(0), ids, texts, authors).count() == 0
    assert catalog.unique(works, "work_id").count() == 4 and catalog.duplicates(works.union(works), "work_id").count() == 4
    with pytest.raises(Exception, match="duplicate id"):
        catalog.unique(works.union(works.limit(1)), "work_id").collect()
