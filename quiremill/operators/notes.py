"""Footnotes: marks in the text, note bodies, links between them, gaps in their numbers, hosts, and glossary pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions import text as T

# How notes begin and how they point to a glossary.
BODY = r"^(?:\[(?:Footnote\s+)?(\d{1,4})[\]:]|(\d{1,4})\.\s)"
POINTER = r"(?i)^(?:see\s+glossary|xem\s+bảng\s+chú\s+giải)\s*(?:[,:]\s*)?[“\"«(\[]*([^”\"»)\].]*)[”\"»)\].]*\s*\.?$"


def marks(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos and number of every mark [12] or [3, 4] in order; a mark of several numbers gives a row for each."""
    inner = F.regexp_extract_all(text, F.lit(r"\[(\d{1,4}(?:,\s*\d{1,4})*)\]"), F.lit(1))
    each = rows.select(*keys, F.posexplode(inner).alias("pos", "m"))
    return each.select(*keys, "pos", F.explode(F.split("m", r",\s*")).alias("n")).select(*keys, "pos", F.col("n").cast("int").alias("number"))


def bodies(lines: DataFrame, key: str) -> DataFrame:
    """key, dump, number and body of the notes after each FOOTNOTES or NOTES heading.

    A note goes on over lines until the next one begins; a heading of a unit ends the notes. Each
    heading begins a dump of its own, whose notes belong to the text before it.
    """
    w = Window.partitionBy(key).orderBy("line_index")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    s = T.strip(F.col("text"))
    head = s.rlike(r"(?i)^(?:FOOTNOTES|NOTES)\s*[:.]?$")
    x = lines.withColumns({"head": head, "stop": T.unit_heading(s) & ~s.rlike(BODY)})
    x = x.withColumn("dump", F.sum(F.col("head").cast("int")).over(running))
    x = x.withColumn("closed", F.max(F.col("stop").cast("int")).over(Window.partitionBy(key, "dump").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)))
    number = F.coalesce(F.nullif(F.regexp_extract("text", BODY, 1), F.lit("")), F.nullif(F.regexp_extract("text", BODY, 2), F.lit(""))).cast("int")
    x = x.where("dump > 0 and not head and closed = 0").withColumn("start", number)
    x = x.withColumn("note", F.count("start").over(Window.partitionBy(key, "dump").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0))).where("note > 0")
    bare = F.regexp_replace(F.regexp_replace("text", BODY, ""), r"\]$", "")
    return x.groupBy(key, "dump", "note").agg(F.max("start").alias("number"), T.collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", bare.alias("t")))), lambda p: p["t"]), " ")).alias("body")).select(key, "dump", "number", "body")


def linked(found: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """key, number, marks, body and state (linked, no body, no mark) of each number of a text, from a full join of both sides; several bodies of a number are joined by blanks."""
    m = found.groupBy(key, "number").agg(F.count(F.lit(1)).alias("marks"))
    b = notes.groupBy(key, "number").agg(F.array_join(F.sort_array(F.collect_list("body")), " ").alias("body"))
    state = F.when(F.col("body").isNull(), "no body").when(F.col("marks").isNull(), "no mark").otherwise("linked")
    return m.join(b, [key, "number"], "full").select(key, "number", F.coalesce("marks", F.lit(0)).alias("marks"), "body", state.alias("state"))


def gaps(found: DataFrame, key: str, most: int = 8) -> DataFrame:
    """key, after and missing: where numbers of notes leave out 1 to `most`; more means that counting began anew."""
    distinct = found.select(key, "number").distinct()
    before = F.lag("number").over(Window.partitionBy(key).orderBy("number"))
    return distinct.withColumn("after", before).withColumn("missing", F.col("number") - F.col("after") - 1).where(F.col("missing").between(1, most)).select(key, "after", "missing")


def hosts(notes: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key, number and block: the first block that holds the note's mark. Marks are taken out of the blocks and joined by number; texts aren't searched note by note."""
    return marks(blocks, [key, "block"], "text").groupBy(key, "number").agg(F.min("block").alias("block")).join(notes.select(key, "number").distinct(), [key, "number"], "left_semi")


def glossary_pointer(body: Column) -> Column:
    """The term that a note refers to the glossary for, empty for a bare reference, null for other notes."""
    b = T.collapse(F.regexp_replace(body, r"^\s*\[\d+\]\s*", ""))
    return F.when(b.rlike(POINTER), F.regexp_replace(F.regexp_extract(b, POINTER, 1), r"^[\s.,;:]+|[\s.,;:]+$", ""))


def not_covered(extra: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Extra annotations whose anchor no note of the same text has in its body: an anti-join by text and folded anchor words.

    Anchors of several words are looked for by their first word, then as a whole.
    """
    first = lambda c: F.regexp_extract(F.lower(c), r"([\p{L}\p{N}]+)", 1)
    e = extra.withColumn("_w", first(F.col("anchor")))
    n = notes.select(F.col(key).alias("_k"), "body", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("_v"))
    return e.join(n, (F.col(key) == F.col("_k")) & (F.col("_w") == F.col("_v")) & F.contains(F.lower("body"), F.lower("anchor")), "left_anti").drop("_w")
