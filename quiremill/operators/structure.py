"""Sections of a text: boundaries, nesting, coverage, headings inside, and ranges that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions import text as T


def heading_lines(lines: DataFrame, key: str) -> DataFrame:
    """key, line_index, start_char, text and kind of the lines that begin a section."""
    return lines.where(T.body_heading(F.col("text"))).select(key, "line_index", "start_char", "text", T.contents_kind(F.col("text")).alias("kind"))


def sections(lines: DataFrame, key: str) -> DataFrame:
    """key, section, kind, title, start_char, end_char and lines.

    A section ends, inclusively, before the next one begins; what comes before the first heading is
    front matter; a text without headings is one chapter.
    """
    w = Window.partitionBy(key).orderBy("line_index")
    is_head = T.body_heading(F.col("text"))
    x = lines.withColumns({"head": is_head, "section": F.sum(is_head.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    first = lambda c: F.min_by(c, "line_index")
    grouped = x.groupBy(key, "section").agg(first("text").alias("title"), first("head").alias("headed"), F.min("start_char").alias("start_char"), F.max("end_char").alias("last_char"), F.count(F.lit(1)).alias("lines"))
    by = Window.partitionBy(key).orderBy("section")
    end = F.coalesce(F.lead("start_char").over(by), F.col("last_char")) - 1
    alone = F.count(F.lit(1)).over(Window.partitionBy(key)) == 1
    kind = F.when(F.col("headed"), T.contents_kind(F.col("title"))).when(alone, "chapter").otherwise("front_matter")
    return grouped.select(key, "section", kind.alias("kind"), F.when(F.col("headed"), F.col("title")).otherwise("").alias("title"), "start_char", F.greatest(end, F.col("start_char")).alias("end_char"), "lines")


def with_parents(secs: DataFrame, key: str) -> DataFrame:
    """parent: the book or part that a part or chapter lies in. A book ends the part before it; front and back matter and notes end both."""
    w = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    era = F.sum(F.col("kind").isin("front_matter", "back_matter", "notes").cast("int")).over(w)
    x = secs.withColumn("era", era)
    in_era = Window.partitionBy(key, "era").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("book", F.last(F.when(F.col("kind") == "book", F.col("section")), ignorenulls=True).over(in_era))
    in_book = Window.partitionBy(key, "era", "book").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    part = F.last(F.when(F.col("kind") == "part", F.col("section")), ignorenulls=True).over(in_book)
    parent = F.when(F.col("kind") == "part", F.col("book")).when(F.col("kind") == "chapter", F.coalesce(part, F.col("book")))
    return x.withColumn("parent", parent).drop("era", "book")


def coverage(ranges: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """key, gaps, overlaps and orphans of inclusive ranges (start_char, end_char) against totals (key, n). Texts without ranges are one gap; empty ones are covered."""
    w = Window.partitionBy(key).orderBy("start_char", "end_char")
    x = ranges.withColumn("reach", F.coalesce(F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    gap = F.greatest(F.lit(0), F.col("start_char") - F.col("reach") - 1)
    per = x.groupBy(key).agg(F.count_if(gap > 0).alias("g"), F.sum(gap).alias("o"), F.count_if((F.col("start_char") <= F.col("reach"))).alias("overlaps"), F.max("end_char").alias("last"))
    tail = F.greatest(F.lit(0), F.col("n") - 1 - F.coalesce("last", F.lit(-1)))
    return totals.join(per, key, "left").select(key, (F.coalesce("g", F.lit(0)) + (tail > 0).cast("int")).alias("gaps"), F.coalesce("overlaps", F.lit(0)).alias("overlaps"), (F.coalesce("o", F.lit(0)) + tail).cast("bigint").alias("orphans"))


def inner_headings(heads: DataFrame, secs: DataFrame, key: str) -> DataFrame:
    """Headings that begin inside a section but not at its start: a range join kept to one text by its key."""
    s = secs.select(F.col(key).alias("k"), "section", F.col("start_char").alias("s"), F.col("end_char").alias("e"))
    return heads.join(s, (F.col(key) == F.col("k")) & F.col("start_char").between(F.col("s"), F.col("e")) & (F.col("start_char") > F.col("s"))).select(key, "section", "line_index", "text")


def merged_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """key, start_char and end_char of half-open ranges joined where they overlap or touch; empty ranges vanish."""
    w = Window.partitionBy(key).orderBy("start_char", "end_char")
    x = ranges.where("end_char > start_char").withColumn("reach", F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("g", F.sum((F.coalesce(F.col("start_char") > F.col("reach"), F.lit(True))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "g").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).drop("g")


def dropped(texts: DataFrame, ranges: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and text without the given half-open ranges, in order. Texts without ranges stay as they are; a null text stays null."""
    cuts = merged_ranges(ranges, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("cuts"))
    keep = F.aggregate("cuts", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), lambda acc, c: F.struct(c["end_char"].alias("at"), F.concat(acc["out"], F.substr(F.col(text), (acc["at"] + 1).cast("int"), (c["start_char"] - acc["at"]).cast("int"))).alias("out")), lambda acc: F.concat(acc["out"], F.substr(F.col(text), (acc["at"] + 1).cast("int"))))
    return texts.join(cuts, key, "left").select(key, F.when(F.col("cuts").isNull(), F.col(text)).otherwise(keep).alias(text))


def division_level(kinds: DataFrame, key: str) -> DataFrame:
    """key and level: the finest kind of heading that divides a text reliably, from counts of chapters, books, parts and the rest."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    c = kinds.groupBy(key).agg(n("chapter"), n("book"), n("part"))
    level = F.when(F.col("chapter") >= 2, "chapter").when(F.col("book") >= 2, "book").when(F.col("part") >= 2, "part").when(F.col("chapter") >= 1, "chapter").when(F.col("book") >= 1, "book").otherwise("none")
    return c.withColumn("level", level)


def prioritised(candidates: DataFrame, key: str, order: str, confidence: str, most: int) -> DataFrame:
    """key, order and place of the `most` candidates of each text with the greatest confidence, null the least, ties by order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(confidence), order))
    return candidates.select(key, order, place.alias("place")).where(F.col("place") <= most)
