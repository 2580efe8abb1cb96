"""Values that were cut off by field limits or in transfer (problem 4).

The length of every value is worked out anew in several encodings. A storage limit shows as a heap of
values at one length of a model's field in one encoding, with next to none above it; the encoding with
the highest heap is the one the limit was meant in. Then the endings are looked at. A value at its
limit is cut off unless its last sentence is finished: there every other ending is doubtful. A value
away from it is cut off only by an ending that tells by itself: a mark of the cut that its source
doesn't end with too, or a word or sentence broken off in another way than such sources are
regularly translated, as counted over all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may be put behind a cut: an ellipsis, in brackets or not, the head of a tag or entity, a replacement character.
MARK = r"(?:\s*(?:[\[(]\s*(?:\.\.\.|…)\s*[\])]?|\.\.\.|…|<[^<>\n]{0,12}>?|&#?\w{0,8};?|\x{FFFD}+))+\s*$"
#: What can stand behind the end of a finished sentence, and its end.
CLOSERS, ENDS = "'\"”’»)]」』） \t\r\n", ".!?。！？"
#: A limit shows by at least so many values at one length that break off though their sources don't, and so many times what the NEAR lengths below have.
LEAST, TIMES, NEAR = 3, 5, 128
#: Values above a limit that it may have as a share of those at it: strays from before it was set.
STRAY = 0.1
#: Bytes by which a value in bytes can end below the limit, as characters aren't divided.
SLACK = 3
#: Share of the values of one kind of source ending that must end alike to count as finished.
USUAL = 0.1


def finished(c: Column) -> Column:
    """Whether the last sentence has its end. Only the end of the text is looked at."""
    return F.right(F.rtrim(c, F.lit(CLOSERS)), F.lit(1)).isin(*ENDS)


def mark_of(c: Column) -> Column:
    """The mark of a cut at the end, empty if there is none. The last part of one has 14 characters at most, so most texts needn't be searched."""
    return F.when(F.right(F.rtrim(c, F.lit(" \t\r\n")), F.lit(16)).rlike(MARK), F.trim(F.regexp_extract(c, MARK, 0))).otherwise("")


def _count(c: Column, chars: str) -> Column:
    return sum((F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in chars), F.lit(0))


def lengths(c: Column) -> dict[str, Column]:
    """Lengths under alternative encodings and conversions."""
    n, lines = F.char_length(c), _count(c, "\n")
    escaped = _count(c, "\"\\\n\r\t")
    beyond_ascii = F.regexp_count(c, F.lit(r"[^\x00-\x7F]"))
    return {
        "characters": n,
        "utf8_bytes": F.octet_length(c),
        "utf16_units": n + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]")),
        "html_escaped": n + 4 * _count(c, "&") + 3 * _count(c, "<>") + 5 * _count(c, "\""),
        "numeric_entities": n + 5 * beyond_ascii,
        "json_escaped": n + escaped,
        "json_ascii": n + escaped + 5 * beyond_ascii,
        "crlf_characters": n + lines,
        "crlf_utf8_bytes": F.octet_length(c) + lines,
    }


def values(segments: DataFrame) -> DataFrame:
    """seg_row, field_name, model, source_text and value of every value that isn't null or empty."""
    both = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(m).alias("model"), F.col(f).alias("value")) for f, m in (("draft_raw", "draft_model"), ("final", "polish_model"))))
    return segments.select("seg_row", "source_text", F.explode(both).alias("v")).select("seg_row", "v.field_name", "v.model", "source_text", "v.value").where("value <> ''")


def limits(vals: DataFrame) -> DataFrame:
    """field_name, model, encoding, limit, slack and values at it: at most one limit for each field and model."""
    each = F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in lengths(F.lit("")))), "lengths")).alias("encoding", "length")
    torn = (~finished(F.col("value")) | (mark_of(F.col("value")) != "")) & finished(F.coalesce("source_text", F.lit(".")))
    told = vals.select("field_name", "model", torn.alias("torn"), F.array(*(v.cast("int") for v in lengths(F.col("value")).values())).alias("lengths"))
    counts = told.select("field_name", "model", "torn", each).groupBy("field_name", "model", "encoding", "length").agg(F.count(F.lit(1)).alias("n"), F.count_if("torn").alias("torn"))
    group = ["field_name", "model", "encoding"]
    by = Window.partitionBy(*group).orderBy("length")
    bytes_ = F.col("encoding").contains("bytes")
    near = lambda lo, hi: F.coalesce(F.sum("n").over(by.rangeBetween(lo, hi)), F.lit(0))
    heaps = counts.withColumns({
        "slack": F.when(bytes_, SLACK).otherwise(0), "at": F.when(bytes_, near(-SLACK, 0)).otherwise(F.col("n")), "below": F.when(bytes_, near(-SLACK - NEAR, -SLACK - 1)).otherwise(near(-NEAR, -1)), "above": F.sum("n").over(Window.partitionBy(*group)) - near(Window.unboundedPreceding, 0),
        "torn": F.when(bytes_, F.coalesce(F.sum("torn").over(by.rangeBetween(-SLACK, 0)), F.lit(0))).otherwise(F.col("torn")),
    })
    heaps = heaps.withColumn("limit", F.col("length")).where((F.col("torn") >= LEAST) & (F.col("at") >= F.col("below") * (F.col("slack") + 1) / NEAR * TIMES) & (F.col("above") <= F.col("at") * STRAY))
    best = F.max_by(F.struct("encoding", "limit", "slack", "at"), F.struct(F.col("at") / (F.col("slack") + 1), F.col("at"), -F.array_position(F.array(*(F.lit(k) for k in lengths(F.lit("")))), F.col("encoding")), F.col("limit")))
    return heaps.groupBy("field_name", "model").agg(best.alias("b")).select("field_name", "model", "b.*")


def _signature(c: Column) -> Column:
    """The last two words with numbers made alike."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.rtrim(c), r"(?s)(\S+\s+\S+|\S+)$", 1), r"\d+", "#"))


def judged(segments: DataFrame) -> DataFrame:
    """seg_row, field_name, model, encoding and limit it is at if any, and cut, for every value.

    Null and empty values have no row; a null source text counts as one that ends in a full stop. Rows
    delivered twice are judged twice. A model may be null; it is a group of its own.
    """
    vals = values(segments)
    found = limits(vals)
    here = F.coalesce(*(F.when(F.col("encoding") == k, v) for k, v in lengths(F.col("value")).items()))
    v = (
        vals.join(found.withColumnRenamed("model", "of_model").withColumnRenamed("field_name", "of_field"), F.col("model").eqNullSafe(F.col("of_model")) & (F.col("field_name") == F.col("of_field")), "left")
        .withColumn("at_limit", F.coalesce(here >= F.col("limit") - F.col("slack"), F.lit(False)))
        .withColumn("mark", mark_of(F.col("value")))
        .withColumn("finished", finished(F.col("value")))
        .withColumn("source", F.coalesce("source_text", F.lit(".")))
        .withColumn("source_finished", finished(F.col("source")))
        .withColumn("source_sig", F.when(~F.col("source_finished") & ~F.rtrim("source").endswith("…"), _signature(F.col("source"))))
        .withColumn("sig", F.when(F.col("source_sig").isNotNull() & ~F.col("finished") & (F.col("mark") == ""), _signature(F.col("value"))))
    )
    told = v.select("seg_row", "field_name", "model", "at_limit", "encoding", "limit", "mark", "finished", F.rtrim("source").endswith("…").alias("source_open"), "source_sig", "sig")
    open_ones = told.where("sig is not null").groupBy("source_sig", "sig").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("source_sig"))
    usual = open_ones.withColumn("share", share).where((F.col("share") >= USUAL) & (F.col("n") >= 2)).select(F.col("source_sig").alias("a"), F.col("sig").alias("b"), F.lit(True).alias("usual"))
    # Values without a signature have no partner; keys of their own keep them from being one task's.
    told = told.withColumns({"a": F.coalesce("source_sig", F.concat(F.lit("\0"), F.col("seg_row"))), "b": F.coalesce("sig", F.lit(""))}).join(usual, ["a", "b"], "left")
    cut = (
        F.when(F.col("finished") & (F.col("mark") == ""), False)
        .when(F.col("at_limit"), True)
        .when(F.col("mark") != "", ~((F.col("mark") == "…") & F.col("source_open")))
        .otherwise(F.col("usual").isNull())
    )
    return told.select("seg_row", "field_name", "model", F.when(F.col("at_limit"), F.col("encoding")).alias("encoding"), F.when(F.col("at_limit"), F.col("limit")).alias("limit"), cut.alias("cut"))


def cut_rates(segments: DataFrame) -> DataFrame:
    """For each field and model its values, how many were cut off, their share, and how many of them at the limit."""
    return judged(segments).groupBy("field_name", "model").agg(F.count(F.lit(1)).alias("values"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("int")).alias("share"), F.count_if(F.col("cut") & F.col("limit").isNotNull()).alias("cut_at_limit"), F.first("encoding", ignorenulls=True).alias("encoding"), F.max("limit").alias("limit"))
