"""Blocks of a text: paragraphs, headings and stanzas from labelled lines, their ids, rendering and hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions import text as T


#: Roles whose lines are blocks of their own, and what a block is called by the role of its first line.
ALONE = ("hr", "stage_direction", "list_item")
TYPES = {"prose": "paragraph", "dialogue_line": "paragraph", "verse_line": "stanza", "toc": "metadata"}
#: What a quotation in verse begins with.
QUOTE_START = "^[\"“«_]"


def glued(pieces: Column) -> Column:
    """An ordered array of texts as one: a blank between two, or nothing where a hyphen breaks a word."""
    return F.aggregate(pieces, F.lit(""), lambda acc, p: F.when(acc == "", p).when(acc.endswith("-") & p.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(acc, "-$", ""), p)).otherwise(F.concat(acc, F.lit(" "), p)))


def from_labels(lines: DataFrame, key: str) -> DataFrame:
    """key, block, type, level, lines, text and speaker. lines: with role, level and join_next.

    A line goes on with the one before it: prose, headings and contents rows when that one's label says
    join, verse without a blank line between (a stanza), speech after its cue and then by joins, metadata
    and quotations with their like. Words broken at a line's end are made whole. A cue without speech is a
    stage direction, a stanza in quotes a quotation. A null join_next joins nothing; an unknown or null
    role is prose.
    """
    w = Window.partitionBy(key).orderBy("line_index")
    known = ("prose", "heading", "verse_line", "speaker_cue", "dialogue_line", "toc", "metadata", "blockquote", *ALONE)
    x = lines.withColumn("role", F.when(F.col("role").isin(*known), F.col("role")).otherwise("prose"))
    role, before = F.col("role"), F.lag("role").over(w)
    joins = F.coalesce(F.lag("join_next").over(w), F.lit(False))
    goes_on = F.when(before == role, F.when(role == "verse_line", ~F.col("blank_before")).when(role.isin("metadata", "blockquote"), True).otherwise(joins & ~role.isin("speaker_cue", *ALONE))).otherwise((before == "speaker_cue") & (role == "dialogue_line"))
    x = x.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    x = x.withColumns({"block": F.sum((~F.col("goes_on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "nxt": F.when(F.lead("goes_on").over(w), F.lead("text").over(w))})
    broken = F.col("text").endswith("-") & F.col("nxt").rlike(r"^\p{Ll}")
    apart = role.isin("metadata", "toc") | ((role == "verse_line") & ~F.coalesce("join_next", F.lit(False)))
    piece = F.when(role == "speaker_cue", "").when(F.col("nxt").isNull(), F.col("text")).when(apart, F.concat("text", F.lit("\n"))).when(broken, F.regexp_replace("text", "-$", "")).otherwise(F.concat("text", F.lit(" ")))
    pieces = F.array_sort(F.collect_list(F.struct("line_index", piece.alias("p"))))
    made = x.groupBy(key, "block").agg(
        F.min_by("role", "line_index").alias("first"), F.max("level").alias("level"), F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(pieces, lambda s: s["p"]), "").alias("text"),
        F.regexp_replace(F.trim(F.min_by(F.when(role == "speaker_cue", F.col("text")), "line_index")), r"\.$", "").alias("speaker"),
    )
    cue = F.col("first") == "speaker_cue"
    kind = F.when(cue & (F.col("lines") > 1), "dialogue").when(cue, "stage_direction").when((F.col("first") == "verse_line") & F.trim("text").rlike(QUOTE_START), "blockquote")
    for r, t in TYPES.items():
        kind = kind.when(F.col("first") == r, t)
    made = made.withColumns({"type": kind.otherwise(F.col("first")), "text": F.when(cue & (F.col("lines") == 1), F.concat("speaker", F.lit("."))).when(F.col("first") == "hr", "").otherwise(F.col("text"))})
    return made.select(key, "block", "type", "level", "lines", "text", F.when(F.col("type") == "dialogue", F.col("speaker")).alias("speaker"))


def merged_neighbours(blocks: DataFrame, key: str, kind: str) -> DataFrame:
    """Neighbouring blocks of one type made one: metadata by lines, others glued; the rest as it is."""
    w = Window.partitionBy(key).orderBy("block")
    goes_on = F.coalesce((F.col("type") == kind) & (F.lag("type").over(w) == kind), F.lit(False))
    x = blocks.withColumn("g", F.sum((~goes_on).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"])
    rest = [c for c in blocks.columns if c not in (key, "block", "text")]
    first = lambda c: F.sum("lines").alias(c) if c == "lines" else F.min_by(c, "block").alias(c)
    return x.groupBy(key, "g").agg(F.min("block").alias("block"), *map(first, rest), (F.array_join(texts, "\n") if kind == "metadata" else glued(texts)).alias("text")).select(*blocks.columns)


ACT, SCENE = r"(?i)^ACT\s+[IVXLC]+\.?$", r"(?i)^SCENE\s+[IVXLC]+"
ARTICLE = r"(?i)^(?:QUESTION\s+\d|(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH)\s+ARTICLE\b|TREATISE\b)"


def merged_headings(blocks: DataFrame, key: str, max_level: int = 2, longest: int = 90) -> DataFrame:
    """Neighbouring headings of level 2 and less made one, the further ones being short; other blocks as they are. Acts, scenes, questions and articles stay by themselves."""
    w = Window.partitionBy(key).orderBy("block")
    head = (F.col("type") == "heading") & (F.col("level") <= max_level)
    own = lambda c: c.rlike(ACT) | c.rlike(SCENE) | c.rlike(ARTICLE)
    goes_on = F.coalesce(head & F.lag(head).over(w) & (F.length("text") <= longest) & ~own(F.col("text")) & ~F.lag(F.col("text").rlike(ARTICLE)).over(w), F.lit(False))
    x = blocks.withColumn("g", F.sum((~goes_on).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct("block", "text")))
    rest = [F.min_by(c, "block").alias(c) for c in blocks.columns if c not in (key, "block", "type", "level", "text")]
    return x.groupBy(key, "g").agg(F.min("block").alias("block"), F.min_by("type", "block").alias("type"), F.min("level").alias("level"), F.array_join(F.transform(pieces, lambda s: s["text"]), " ").alias("text"), *rest).drop("g")


def block_ids(blocks: DataFrame, key: str) -> DataFrame:
    """block_id: the type and the first 48 characters as a slug, numbered from the second block of the same."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(T.collapse(F.col("text"))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    x = blocks.withColumn("slug", F.when(slug == "", "empty").otherwise(F.left(slug, F.lit(48))))
    nth = F.row_number().over(Window.partitionBy(key, "type", "slug").orderBy("block"))
    return x.withColumn("block_id", F.concat(F.lit("book:"), F.col("type"), F.lit(":"), F.col("slug"), F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise(""))).drop("slug")


def visible(blocks: DataFrame) -> DataFrame:
    """The blocks a reader sees: not hidden and not suppressed. Without such columns all of them; null counts as shown."""
    for c in ("hidden", "suppressed"):
        if c in blocks.columns:
            blocks = blocks.where(~F.coalesce(F.col(c), F.lit(False)))
    return blocks


def markdown(blocks: DataFrame, key: str, family: Column | None = None) -> DataFrame:
    """key, blocks, content_kind, reading text and the hash of the blocks: an ordered aggregate of each text's blocks.

    The hash is that of the blocks as canonical JSON (level, text and type of each, in order), so that it
    changes with a block's type as well. Hidden blocks count in the hash and not in the reading text.
    """
    text = F.trim("text")
    speaker = F.col("speaker") if "speaker" in blocks.columns else F.lit(None).cast("string")
    shown = F.lit(True)
    for c in ("hidden", "suppressed"):
        if c in blocks.columns:
            shown = shown & ~F.coalesce(F.col(c), F.lit(False))
    kind = F.col("type")
    part = (
        F.when(~shown, "").when(kind == "hr", "---").when(kind == "blockquote", F.concat(F.lit("> "), text)).when((kind == "dialogue") & (speaker != ""), F.concat(speaker, F.lit(". "), text))
        .when((kind == "stage_direction") & ~text.startswith("["), F.concat(F.lit("["), F.regexp_replace(text, r"\]+$", ""), F.lit("]"))).otherwise(text)
    )
    rows = F.array_sort(F.collect_list(F.struct("block", part.alias("p"), F.struct(F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("type")).alias("j"))))
    has = lambda *k: F.bool_or(kind.isin(*k) & shown)
    x = blocks.groupBy(key).agg(F.count_if(shown).alias("blocks"), has("dialogue", "stage_direction").alias("drama"), has("stanza", "verse_line").alias("verse"), has("paragraph").alias("prose"), rows.alias("rows"))
    told = F.when(F.col("drama"), "drama").when(F.col("verse") & ~F.col("prose"), "verse").when(F.col("verse"), "mixed").otherwise("prose")
    if family is not None:
        told = F.when(family == "scholastic", "scholastic").otherwise(told)
    reading = F.array_join(F.filter(F.transform("rows", lambda s: s["p"]), lambda p: p != ""), "\n\n")
    return x.select(key, "blocks", told.alias("content_kind"), reading.alias("markdown"), F.sha2(F.to_json(F.transform("rows", lambda s: s["j"])), 256).alias("hash"))


def patched(blocks: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Blocks with the fields of the patches of the same block_id put in their place.

    patches: key, block_id, seq, text, hidden. Later ones win field by field; nulls change nothing.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}")
    folded = patches.groupBy(key, "block_id").agg(last("text"), last("hidden"))
    return blocks.join(folded, [key, "block_id"], "left").withColumns({"text": F.coalesce("new_text", "text"), "hidden": F.coalesce("new_hidden", F.lit(False))}).drop("new_text", "new_hidden")


def stale_patches(blocks: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """The patches that find no block, with candidate: the only block whose id begins as theirs does up to its number, null if there is none or several."""
    missing = patches.join(blocks.select(key, "block_id"), [key, "block_id"], "left_anti")
    stem = F.regexp_replace("block_id", r"-\d+$", "")
    near = blocks.select(key, F.col("block_id").alias("candidate"), stem.alias("stem")).groupBy(key, "stem").agg(F.min("candidate").alias("candidate"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return missing.withColumn("stem", stem).join(near, [key, "stem"], "left").drop("stem")
