"""Segments of a translation: completeness, packing, estimates, order and assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions import text as T
from quiremill.operators.catalog import latest
from quiremill.session import spread

OUTPUT_RATIO, OVERHEAD = 1.15, 2500


def current(segments: DataFrame) -> DataFrame:
    """The last delivery of each segment."""
    return latest(segments, ["segment_id"], "arrived_at", "seg_row")


def completeness(segments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """segment_id, work_id, chapter, words, completeness and the columns of `keep` of each segment's last delivery: truncated, ok, raw_pending or empty.

    Truncated is a final text that breaks off where its source doesn't, or that has two footnote marks
    more or less than it. Null texts count as empty.
    """
    # Told where the texts are read, so that what goes over the network is a word, not three texts.
    final, source = T.strip(F.coalesce("final", F.lit(""))), F.coalesce("source_text", F.lit(""))
    marks = F.abs(F.regexp_count(source, F.lit(T.MARKER)) - F.regexp_count(final, F.lit(T.MARKER)))
    state = F.when(T.truncated(source, final) | ((final != "") & (marks >= 2)), "truncated").when(final != "", "ok").when(T.strip(F.coalesce("draft_raw", F.lit(""))) != "", "raw_pending").otherwise("empty")
    kept = [F.col(c) for c in keep]
    told = spread(segments).select("segment_id", "work_id", "chapter", F.coalesce("words", F.lit(0)).alias("words"), state.alias("completeness"), *kept, "arrived_at", "seg_row")
    return current(told).select("segment_id", "work_id", "chapter", "words", "completeness", *keep)


def estimate(complete: DataFrame) -> DataFrame:
    """completeness, segments, words and tokens of what is still to be translated: source and output tokens by word counts, rounded half to even."""
    src = T.estimated_tokens(F.col("words"))
    out = F.greatest(F.lit(1), F.bround(src * F.lit(OUTPUT_RATIO), 0).cast("bigint"))
    polish = OVERHEAD + src + out + out
    tokens = F.when(F.col("completeness") == "raw_pending", polish).otherwise(polish + OVERHEAD + src + out)
    return complete.where("completeness <> 'ok'").groupBy("completeness").agg(F.count(F.lit(1)).alias("segments"), F.sum("words").alias("words"), F.sum(tokens).alias("tokens"))


def assembled(segments: DataFrame) -> DataFrame:
    """work_id, segments, missing, chars and hash of each work's final texts in order of chapters, joined by blank lines. Works without any final text have an empty one."""
    s = completeness(segments, ("final",))
    ok = F.col("completeness") == "ok"
    pieces = F.array_sort(F.collect_list(F.when(ok, F.struct(T.chapter_rank(F.col("chapter")).alias("r"), "chapter", "segment_id", T.strip(F.col("final")).alias("t")))))
    text = F.array_join(F.transform(pieces, lambda p: p["t"]), "\n\n")
    return s.groupBy("work_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if(~ok).alias("missing"), text.alias("text")).select("work_id", "segments", "missing", F.length("text").alias("chars"), F.sha2("text", 256).alias("hash"))


def chapter_order(segments: DataFrame) -> DataFrame:
    """segment_id, rank and place of each segment among its work's."""
    s = current(segments).withColumn("rank", T.chapter_rank(F.col("chapter")))
    return s.select("segment_id", "rank", F.row_number().over(Window.partitionBy("work_id").orderBy("rank", "chapter", "segment_id")).alias("place"))


def sentence_pieces(paragraph: Column, hard: int) -> Column:
    """A paragraph of more than `hard` words as pieces that end where sentences do, each of `hard` words at most unless a sentence is longer; any other as it is."""
    parts = F.filter(F.split(paragraph, r"(?<=[.!?…][\"'”’»)\]]{0,2})\s+"), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("words"))

    def step(acc, p):
        n = T.word_count(p)
        fresh = (F.size(acc["out"]) == 0) | (acc["words"] + n > hard)
        head = F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        longer = F.concat(head, F.array(F.concat(F.element_at(acc["out"], -1), F.lit(" "), p)))
        return F.struct(F.when(fresh, F.concat(acc["out"], F.array(p))).otherwise(longer).alias("out"), F.when(fresh, n).otherwise(acc["words"] + n).alias("words"))

    return F.when(T.word_count(paragraph) <= hard, F.array(paragraph)).otherwise(F.aggregate(parts, empty, step, lambda acc: acc["out"]))


def packed(texts: DataFrame, key: str, text: str, target: int = 1200, hard: int = 1500, split: bool = False) -> DataFrame:
    """key, part, first and last paragraph, and words: paragraphs packed greedily into parts of about `target` words and no more than `hard` unless one paragraph is longer.

    With `split` longer paragraphs are first taken apart where sentences end, and the pieces count as paragraphs.

    Whether a paragraph opens a part depends on all before it, which no window sum can say: each text's
    paragraphs are folded in order, in the JVM.
    """
    paras = F.filter(F.transform(F.split(text, r"\n[\s\p{Z}]*\n"), lambda p: T.strip(p)), lambda p: p != "")
    if split:
        paras = F.flatten(F.transform(paras, lambda p: sentence_pieces(p, hard)))
    counts = F.transform(paras, lambda p: T.word_count(p))
    empty = F.struct(F.array().cast("array<int>").alias("parts"), F.lit(0).alias("words"), F.lit(0).alias("part"))

    def step(acc, n):
        fresh = (F.size(acc["parts"]) > 0) & ((acc["words"] + n > hard) | (acc["words"] >= target))
        part = F.when(fresh, acc["part"] + 1).otherwise(acc["part"])
        return F.struct(F.concat(acc["parts"], F.array(part)).alias("parts"), F.when(fresh, n).otherwise(acc["words"] + n).alias("words"), part.alias("part"))

    folded = texts.select(key, counts.alias("counts")).withColumn("parts", F.aggregate("counts", empty, step)["parts"])
    each = folded.select(key, F.posexplode(F.arrays_zip("parts", "counts")).alias("n", "p"))
    return each.groupBy(key, (F.col("p.parts") + 1).alias("part")).agg(F.min("n").alias("first"), F.max("n").alias("last"), F.sum("p.counts").alias("words"))


def repaired_paragraphs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, paragraph and text: paragraphs that a blank line parted within a sentence made whole again.

    A paragraph is open when it doesn't end in a mark, bracket or quote, dashes aside, and its last line is no heading.
    """
    each = texts.select(key, F.posexplode(F.filter(F.transform(F.split(text, r"\n[\s\p{Z}]*\n"), lambda p: T.strip(p)), lambda p: p != "")).alias("n", "p"))
    w = Window.partitionBy(key).orderBy("n")
    bare = F.regexp_replace("p", r"[-–—]+$", "")
    last = T.strip(F.regexp_extract(bare, r"([^\n]*)$", 1))
    heading = (F.length(last) > 0) & (F.length(last) <= 80) & (T.count_of(last, r"\p{Ll}") == 0)
    open_end = (bare != "") & ~heading & ~bare.rlike(r"[.!?…:;\"'”’»)\]}*_]$")
    x = each.withColumn("fresh", ~F.coalesce(F.lag(open_end).over(w), F.lit(False)))
    x = x.withColumn("paragraph", F.sum(F.col("fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda s: s["p"]), "\n").alias("text"))


def annotation_latest(annotations: DataFrame) -> DataFrame:
    """The last delivery of each annotation, and of those the first of each segment and anchor text: one note for one place."""
    last = latest(annotations, ["id"], "generated_at", "annotation_row")
    place = Window.partitionBy("segment_id", F.coalesce("anchor_text", F.lit(""))).orderBy("generated_at", "annotation_row")
    return last.withColumn("n", F.row_number().over(place)).where("n = 1").drop("n")


def located_anchors(annotations: DataFrame, segments: DataFrame) -> DataFrame:
    """annotation_row and at: where the anchor stands in its segment's source text, from 0; -1 if it isn't there in the same characters. Nulls and empty anchors are -1."""
    src = current(segments).select("segment_id", "source_text")
    at = F.when(F.coalesce(F.length("anchor_text"), F.lit(0)) == 0, -1).otherwise(F.instr(F.coalesce("source_text", F.lit("")), F.col("anchor_text")) - 1)
    return annotations.join(src, "segment_id", "left").select("annotation_row", at.alias("at"))


WORDS = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


def glossary_hits(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """segment_id, term_en and used: which of the source's glossary terms have one of their renderings in the final text.

    Terms of any number of words are found as whole words, by an equi-join of the source's runs of words
    with the terms; runs are made of the lengths that terms have, so the work follows the words, not words
    times terms. Of terms that overlap the longer ones stay, then the earlier. Nulls match nothing.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))
    terms = glossary.where("term_en is not null").select(F.array_join(tokens("term_en"), " ").alias("term_en"), F.lower("term_vi").alias("term_vi")).where("term_en <> ''")
    terms = terms.groupBy("term_en").agg(F.collect_set("term_vi").alias("renderings")).withColumn("n", F.size(F.split("term_en", " ")))
    sizes = terms.agg(F.sort_array(F.collect_set("n")).alias("sizes"))  # one row, as many as terms have lengths
    s = current(segments).where("source_text is not null").select("segment_id", tokens("source_text").alias("words"), F.lower(F.coalesce("final", F.lit(""))).alias("out")).crossJoin(F.broadcast(sizes))
    runs = F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0))), lambda i: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("term_en")))))
    found = s.select("segment_id", "out", F.inline(runs)).join(terms, ["term_en", "n"])
    # A hit stays when no longer one, and no earlier one as long, shares a word with it: settled from the longest on.
    kind = "array<struct<term_en:string,at:int,n:int,used:boolean>>"
    used = F.exists("renderings", lambda r: F.contains(F.col("out"), r))
    hits = found.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "at", "n", "term_en", used.alias("used")))).alias("hits"))
    free = lambda kept, h: ~F.exists(kept, lambda x: (x["at"] < h["at"] + h["n"]) & (h["at"] < x["at"] + x["n"]))
    kept = F.aggregate("hits", F.array().cast(kind), lambda acc, h: F.when(free(acc, h), F.concat(acc, F.array(F.struct(h["term_en"].alias("term_en"), h["at"].alias("at"), h["n"].alias("n"), h["used"].alias("used"))))).otherwise(acc))
    return hits.select("segment_id", F.inline(kept)).select("segment_id", "term_en", "used").distinct()


def merged_glossary(rows: DataFrame, place: str) -> DataFrame:
    """The last row of each name and aliases, by `place`, at the place of the first one. A null name or list is an empty one."""
    keys = [F.coalesce("name", F.lit("")).alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")]
    rest = [c for c in rows.columns if c not in ("name", "aliases", place)]
    last = F.max_by(F.struct(*rest), place).alias("r")
    return rows.groupBy(*keys).agg(F.min(place).alias(place), last).select("name", "aliases", place, "r.*")


def parsed_objects(texts: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """key and value: a JSON object from a model's answer, out of its fence or from the outermost braces; null where there is none."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return texts.select(key, F.from_json(F.when(braces != "", braces), schema, {"mode": "PERMISSIVE"}).alias("value"))


def locate_fold(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: columns key, text, excerpt to key, start, end, where quotes of any kind count as equal; -1 where nothing fits."""
    same = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "«": '"', "»": '"'})
    for b in texts:
        out = []
        for k, t, e in zip(b["key"], b["text"], b["excerpt"]):
            t, e = t or "", (e or "").strip()
            at = t.find(e) if e else -1
            if at < 0 and len(e) >= 12:
                at = t.translate(same).find(e.translate(same))
            out.append((k, at, at + len(e) if at >= 0 else -1))
        yield pd.DataFrame(out, columns=["key", "start", "end"])


def inherited(blocks: DataFrame, existing: DataFrame) -> DataFrame:
    """seg_row and source_row of the translation that a new segment takes over: that of the same segment_id, else that of the same work and chapter; the last delivered of several. No match is null."""
    by_id = existing.groupBy("segment_id").agg(F.max("seg_row").alias("same_id"))
    by_place = existing.groupBy("work_id", "chapter").agg(F.max("seg_row").alias("same_place"))
    found = blocks.join(by_id, "segment_id", "left").join(by_place, ["work_id", "chapter"], "left")
    return found.select("seg_row", F.coalesce("same_id", "same_place").alias("source_row"))


def windows(located: DataFrame, texts: DataFrame, radius: int = 110) -> DataFrame:
    """annotation_row and context: the text around each place from `radius` characters before to as many after it; places that aren't found have none."""
    both = located.where("at >= 0").join(texts, "segment_id")
    start = F.greatest(F.lit(0), F.col("at") - radius)
    return both.select("annotation_row", F.substr(F.col("text"), (start + 1).cast("int"), (F.col("at") + F.col("size") + radius - start).cast("int")).alias("context"))


def fallback_title(chapter):
    """A Vietnamese title for a chapter without one: its number, the name of a known part, else the text itself."""
    s = T.strip(F.coalesce(chapter, F.lit("")))
    token = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]", ""), "^(?:chapter|chap)", "")
    number = F.when(token.rlike(r"^\d+$"), token.try_cast("int")).otherwise(T.roman_to_int(token))
    # Names of parts.
    named = {"preface": "Lời nói đầu", "introduction": "Dẫn nhập", "prologue": "Mở đầu", "epilogue": "Lời kết", "appendix": "Phụ lục", "bibliography": "Thư mục", "glossary": "Bảng chú giải"}
    by_name = F.coalesce(*(F.when(token == k, F.lit(v)) for k, v in named.items()))
    return F.when(number.isNotNull(), F.concat(F.lit("Chương "), number)).when(by_name.isNotNull(), by_name).when(s == "", "Chương").otherwise(s)
