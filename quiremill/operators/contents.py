"""Tables of contents: their runs of rows, chapter lines that are only rows, and entries found in the body."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quiremill.functions import text as T
from quiremill.operators.lines import islands
from quiremill.operators.matching import STOP_WORDS, folded
from quiremill.session import cut, spread

# Chapter lines, headers of contents, titles.
CHAPTER_LINE = r"(?i)^(?:(?:CHAPTER|CHAP\.?)\s+[IVXLC\d]+(?:\.\s*$|[.:]\s|\.\s|\s+[A-Z])|(?:BOOK|PART|VOLUME)\s+[IVXLC\d]+(?:[.:]\s|\.\s|\s+[A-Z]))"
HEADER = r"(?i)^(?:(?:TABLE OF )?CONTENTS\.?:?$|Mục\s+lục(?:[^\p{L}]|$))"
DASH = "—|–| - "
CHAPTER_ANY, CHAPTER_BARE = r"(?i)^(?:CHAPTER|CHAP\.?)\s+[IVXLC\d]+", r"(?i)^(?:CHAPTER|CHAP\.?)\s+[IVXLC\d]+\.?\s*$"
NUMBERED = r"(?i)^\s*(?:chapter|chap\.?|book|part|volume)\s+([ivxlcdm]+|\d+)(?:[^\p{L}\p{N}_]|$)[.:]?\s*"
#: Rows that make contents without a header, and with one; characters from which a line is body text; lines looked at after a chapter line.
LEAST, LEAST_HEADED, BODY, AHEAD = 3, 2, 55, 13


def chapter_line(s: Column) -> Column:
    return s.rlike(CHAPTER_LINE)


def title_line(s: Column) -> Column:
    """Short, with dots before a page number, with a dash, or without more than one full stop."""
    plain = (F.length(s) < 90) & ~s.rlike(r"[.!?]\s") & (T.count_of(s, ".") <= 1)
    return F.length(s).between(1, 120) & ~chapter_line(s) & (s.rlike(T.DOT_LEADER) | s.rlike(DASH) | plain)


def contents_runs(lines: DataFrame, key: str) -> DataFrame:
    """key, run, first_line, last_line, rows and headed of each table of contents in a text.

    Rows are entries, chapter lines, titles and continuations under them. A chapter line before a long
    line of body text begins the body. A run begins with a header or entry; it is contents from LEAST_HEADED
    lines on with a header, from LEAST without. Null texts are no rows.
    """
    w = Window.partitionBy(key).orderBy("line_index")
    s = T.strip(F.coalesce("text", F.lit("")))
    x = lines.select(key, "line_index", s.alias("s"))
    x = x.withColumns({"before": F.coalesce(F.lag("s").over(w), F.lit("")), "after": F.coalesce(F.lead("s").over(w), F.lit(""))})
    here, before, after = F.col("s"), F.col("before"), F.col("after")
    long = (F.length(after) >= BODY) & ~chapter_line(after) & ~T.contents_entry(after) & ~title_line(after) & after.rlike(r"(?i)(?:^|[^\p{L}])the(?:[^\p{L}]|$)")
    header = here.rlike(HEADER)
    entry = (T.contents_entry(here) | chapter_line(here)) & ~(chapter_line(here) & long)
    wrapped = ~chapter_line(here) & (F.length(here) <= 100) & title_line(here)
    letters = T.count_of(here, r"\p{L}")
    capitals = (letters > 0) & (T.count_of(here, r"\p{Lu}") * 100 >= letters * 85) & (F.length(here) < 120)
    goes_on = ~chapter_line(here) & ~T.unit_heading(here) & ~before.rlike("[.!?]$") & (here.rlike(r"^\p{Ll}") | capitals)
    x = x.withColumns({"header": header, "strong": header | entry, "member": (here != "") & (header | entry | wrapped | goes_on)})
    runs = islands(x, [key], ["line_index"], F.col("member"))
    begun = F.sum(F.col("strong").cast("int")).over(Window.partitionBy(key, "island").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)) > 0
    grouped = runs.withColumn("begun", begun).where("begun").groupBy(key, "island").agg(F.min("line_index").alias("first_line"), F.max("line_index").alias("last_line"), F.count(F.lit(1)).alias("rows"), F.bool_or("header").alias("headed"), F.count_if("strong").alias("strong"))
    enough = (F.col("headed") & (F.col("rows") >= LEAST_HEADED)) | ((F.col("rows") >= LEAST) & (F.col("strong") >= 2))
    return grouped.where(enough).select(key, F.row_number().over(Window.partitionBy(key).orderBy("first_line")).alias("run"), "first_line", "last_line", "rows", "headed")


def stub_chapters(lines: DataFrame, key: str) -> DataFrame:
    """key and line_index of bare chapter lines that are rows of contents left in the body: another chapter
    line follows at once or after titles only, or a page number, before any line that reads as body text."""
    s = T.strip(F.coalesce("text", F.lit("")))
    w = Window.partitionBy(key).orderBy("line_index")
    x = lines.select(key, "line_index", s.alias("s")).where("s <> ''")
    t = F.col("s")
    dashes = F.regexp_count(t, F.lit("—|–|--"))
    body = (F.length(t) >= BODY) & ~t.rlike(CHAPTER_ANY) & ~chapter_line(t) & (dashes < 2) & F.when(dashes == 1, t.rlike("[.!?]$")).otherwise(~(title_line(t) & ~t.rlike("[.!?]$")))
    row = T.contents_row(t) | t.rlike(T.PAGE_TAIL)
    kind = F.when(t.rlike(CHAPTER_ANY), "c").when(row, "r").when(body, "b").when((dashes > 0) | (title_line(t) & ~t.rlike("[.!?]$")), "t").otherwise("o")
    # The kinds of the lines that follow, as a word.
    after = F.array_join(F.collect_list("kind").over(w.rowsBetween(1, AHEAD)), "")
    told = x.withColumn("kind", kind).withColumn("after", after)
    return told.where(t.rlike(CHAPTER_BARE) & F.col("after").rlike("^(?:c|[to]{0,7}r|o{0,7}t[to]{0,7}c)")).select(key, "line_index")


@pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    """Words without accents and case: no built-in function decomposes characters."""
    return s.map(lambda v: None if v is None else folded(v))


def _number(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, NUMBERED, 1))


def match_contents(lines: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """key, entry and line_index: contents entries found in the body in order.

    Each entry takes the first line behind the last entry's that has its chapter number or, for entries
    without one, its title or all its words of weight. Entries meet lines by number, title or their longest
    word, never all lines; then each text's hits are gone through once. Texts without lines or entries
    have no rows; lines over 120 characters are no headings; null labels match nothing.
    """
    weight = F.array_distinct(F.filter(F.split("k", " "), lambda v: (F.length(v) > 1) & ~v.isin(*sorted(STOP_WORDS))))
    e = entries.where("label is not null").select(key, "entry", _number(F.col("label")).alias("number"), _folded(F.regexp_replace("label", NUMBERED, "")).alias("bare"), _folded(F.col("label")).alias("whole")).withColumn("k", F.coalesce(F.nullif("bare", F.lit("")), "whole")).drop("bare", "whole").withColumn("weight", weight)
    e = e.withColumn("asked", F.try_element_at(F.array_sort("weight", lambda a, b: F.length(a) - F.length(b)), F.lit(-1)))
    # Both are asked for by number, title and word: folded once.
    e = cut(e)
    x = cut(spread(lines.where("length(text) between 1 and 120").select(key, "line_index", "text")).select(key, "line_index", _number(F.col("text")).alias("number"), _folded(F.col("text")).alias("k")))
    cols = [key, "entry", "line_index"]
    by_number = e.where("number <> ''").join(x.where("number <> ''").drop("k"), [key, "number"]).select(*cols)
    plain = e.where("number = '' and k <> ''").drop("number")
    by_title = plain.join(x.drop("number"), [key, "k"]).select(*cols)
    many = plain.where(F.size("weight") >= 2)
    # Of a line only the words that its text's entries ask for are told apart.
    asked = many.groupBy(key).agg(F.collect_set("asked").alias("wanted"))
    words = x.join(asked, key).select(key, "line_index", F.array_distinct(F.split("k", " ")).alias("words"), "wanted").withColumn("asked", F.explode(F.array_intersect("words", "wanted"))).drop("wanted")
    by_words = many.join(words, [key, "asked"]).where(F.size(F.array_except("weight", "words")) == 0).select(*cols)
    hits = by_number.union(by_title).union(by_words).groupBy(key, "entry").agg(F.sort_array(F.collect_set("line_index")).alias("at"))
    one = "array<struct<entry:int,line_index:int>>"

    def step(acc: Column, h: Column) -> Column:
        free = F.filter(h["at"], lambda i: i > acc["last"])
        some = F.size(free) > 0
        return F.struct(F.when(some, F.element_at(free, 1)).otherwise(acc["last"]).alias("last"), F.when(some, F.concat(acc["out"], F.array(F.struct(h["entry"].cast("int").alias("entry"), F.element_at(free, 1).cast("int").alias("line_index"))))).otherwise(acc["out"]).alias("out"))

    order = F.array_sort(F.collect_list(F.struct("entry", "at")))
    start = F.struct(F.lit(-1).alias("last"), F.array().cast(one).alias("out"))
    return hits.groupBy(key).agg(F.aggregate(order, start, step, lambda acc: acc["out"]).alias("m")).select(key, F.inline("m"))
