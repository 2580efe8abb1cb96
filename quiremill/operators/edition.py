"""From a raw text to an edition: families, apparatus to drop, line roles, blocks, hash, checks.

Each stage is columns and windows over lines; only the check of characters in order is Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from quiremill.functions import text as T
from quiremill.operators import blocks as B
from quiremill.operators import contents as C
from quiremill.operators import lines as L
from quiremill.operators import spans as S

# Cues, directions and apparatus lines.
CUE = r"^[A-Z][A-Z ,.'-]{2,40}\.$"
NO_CUE = r"(?i)^(?:(?:ACT|SCENE|CHAPTER|CHAP|BOOK|PART|VOLUME|INTRODUCTION|PROLOGUE|CONTENTS|PREFACE|DEDICATION|LETTER|FOREWORD)\b|[MDCLXVI. ]+$)"
DIRECTION = r"(?i)^(?:Enter |Exit |Exeunt |Re-enter |Scene continues|\[Aside|\[Within|\[Coming|\[Exit)"
WIKI = r"(?i)^(?:←(?:TỰA|\d+)$|.*→$|\d{3,6}$|\d{4,6}[A-Za-zÀ-ỹ].*|.*(?:Wikipedia|Wikidata|wiki khác|bài viết Wikipedia).*)"
WRAPPER = r"(?i)^\*\*\*\s*(?:START|END) OF (?:THE |THIS )?[^*\n]*EBOOK[^*\n]*\*\*\*$"


def wiki_parts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the text, and lines of navigation and metadata."""
    junk = T.strip(F.col("text")).rlike(WIKI)
    return lines.where(~junk), lines.where(junk)


def drop_spans(lines: DataFrame, key: str) -> DataFrame:
    """key, start_char, end_char, kind and confidence of what isn't the text: wrappers and repeated running heads, a union of detectors."""
    wrap = lines.where(T.strip(F.col("text")).rlike(WRAPPER)).select(key, "start_char", "end_char", F.lit("wrapper").alias("kind"), F.lit(0.95).alias("confidence"))
    heads = L.running_headers(lines, key).select(key, "heading")
    shaped = lines.where((F.length("text") < 90) & T.running_header_shape(F.col("text")) & ~T.unit_heading(F.col("text"))).withColumn("heading", T.heading_key(F.col("text")))
    repeated = shaped.join(heads, [key, "heading"], "left_semi").select(key, "start_char", "end_char", F.lit("running_header").alias("kind"), F.lit(0.9).alias("confidence"))
    return wrap.unionByName(repeated)


def _runs(x: DataFrame, key: str, member: Column, least: int, score: float) -> DataFrame:
    """Runs of at least `least` member lines without a blank line inside, that end as verse does in a share of `score` and none of which is no verse, become verse."""
    w = Window.partitionBy(key).orderBy("line_index")
    m = F.coalesce(member, F.lit(False))
    fresh = m & (~F.coalesce(F.lag(m).over(w), F.lit(False)) | F.coalesce("blank_before", F.lit(False)))
    x = x.withColumns({"_m": m, "_run": F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    run = Window.partitionBy(key, "_run", "_m")
    bad, hit = L.no_verse(F.col("text")), L.verse_end(F.col("text"))
    verse = F.col("_m") & (F.count(F.lit(1)).over(run) >= least) & ~F.bool_or(bad).over(run) & (F.avg(hit.cast("double")).over(run) >= score)
    return x.withColumn("role", F.when(verse, "verse_line").otherwise(F.col("role"))).drop("_m", "_run")


def with_contents(x: DataFrame, key: str) -> DataFrame:
    """Lines of tables of contents get the role toc and are joined within their table."""
    runs = C.contents_runs(x, key).select(key, "first_line", "last_line")
    at = runs.select(key, F.explode(F.sequence("first_line", "last_line")).alias("line_index"), (F.col("last_line")).alias("_last"))
    both = x.join(at, [key, "line_index"], "left")
    toc = F.col("_last").isNotNull()
    return both.withColumns({"role": F.when(toc, "toc").otherwise(F.col("role")), "level": F.when(toc, 0).otherwise(F.col("level")), "join_next": F.when(toc, F.col("line_index") < F.col("_last")).otherwise(F.col("join_next"))}).drop("_last")


def labelled(lines: DataFrame, key: str, gutenberg: Column | None = None) -> DataFrame:
    """Lines with role, level, confidence and join_next by rules.

    Roles of single lines come first; then lines after a speaker's cue are dialogue until another role
    comes; a quotation that goes on over lines keeps the role of its first one; then runs of indented lines
    and of short ones that end as verse does become verse (gutenberg: in texts from there, true where it
    isn't given); then join_next is decided for pairs of prose.
    """
    gutenberg = F.lit(True) if gutenberg is None else gutenberg
    s = T.strip(F.col("text"))
    play = F.count_if(s.rlike(CUE) & ~s.rlike(NO_CUE)).over(Window.partitionBy(key)) >= 4
    hard = T.hard_structural(s)
    single = {
        "metadata": s.rlike(WIKI), "hr": s.rlike(T.RULE), "stage_direction": F.col("_play") & s.rlike(DIRECTION), "speaker_cue": F.col("_play") & s.rlike(CUE) & ~s.rlike(NO_CUE) & ~s.rlike(T.CAPS_YEAR),
        "list_item": s.rlike(T.CAPS_YEAR) | s.rlike(r"^\(\d+\)\s+"), "heading": hard, "verse_line": (F.col("indent") >= 4) & (F.length(s) < 72) & ~s.rlike(r"\.$"),
    }
    role = F.coalesce(*(F.when(c, F.lit(k)) for k, c in single.items()), F.lit("prose"))
    x = lines.withColumn("_play", play).withColumn("role", role)
    w = Window.partitionBy(key).orderBy("line_index")
    plain = F.col("role").isin("prose", "verse_line")
    # The last line that isn't plain says whether plain ones belong to a cue.
    before = F.last(F.when(~plain, F.col("role")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("role", F.when(plain & (before == "speaker_cue"), "dialogue_line").otherwise(F.col("role")))
    quoted = L.join_evidence(F.lag("text").over(w), F.col("text"), F.lit(False), F.lit(False))[1]["quotation"] & plain & F.lag(plain).over(w)
    x = x.withColumn("_goes_on", F.coalesce(quoted & F.col("role").isin("prose", "verse_line"), F.lit(False)))
    x = x.withColumn("_quote", F.sum((~F.col("_goes_on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("role", F.when(F.col("_goes_on"), F.first("role").over(Window.partitionBy(key, "_quote").orderBy("line_index"))).otherwise(F.col("role"))).drop("_quote")
    x = _runs(x, key, gutenberg & (F.col("role") == "prose") & (F.col("indent") >= 2), 3, 0.45)
    x = _runs(x, key, gutenberg & (F.col("role") == "prose") & (F.length("text") <= 85), 4, 0.55)
    level = F.when(F.col("role") != "heading", 0).when(s.rlike(r"(?i)^(?:CHAPTER|BOOK|PART|VOLUME)(?:[^\p{L}]|$)"), 1).otherwise(2)
    x = x.withColumns({"level": level, "confidence": F.when(F.col("role") == "prose", 0.92).when(F.col("role") == "verse_line", 0.87).otherwise(0.95), "_next": F.lead("role").over(w), "_quote_next": F.lead("_goes_on").over(w)})
    decided = L.join_decisions(x.select(key, "line_index", "text", "blank_before"), key).select(key, "line_index", F.col("join_next").alias("_joins"))
    both = x.join(decided, [key, "line_index"], "left")
    same = (F.col("role") == F.col("_next")) & (F.col("role").isin("prose", "dialogue_line") | (F.col("role").isin("verse_line") & F.col("_quote_next")))
    return both.withColumn("join_next", F.coalesce(F.col("_joins") & same, F.lit(False))).drop("_play", "_next", "_joins", "_goes_on", "_quote_next")


def edition_blocks(texts: DataFrame, key: str) -> DataFrame:
    """key, block, type, level, lines, text, speaker and spans of each text: apparatus dropped, lines labelled, contents found, blocks made and merged, inline spans marked. Null and empty texts have no blocks."""
    table = L.line_table(texts, key)
    kept = table.join(drop_spans(table, key).select(key, "start_char"), [key, "start_char"], "left_anti")
    made = B.from_labels(with_contents(labelled(kept, key), key), key)
    for kind in ("metadata", "blockquote"):
        made = B.merged_neighbours(made, key, kind)
    return B.merged_headings(made, key).withColumn("spans", S.inline_spans(F.col("text")))


def editions(texts: DataFrame, key: str) -> DataFrame:
    """key, blocks, content_kind, markdown and hash of each text's edition. Null and empty texts have none."""
    return B.markdown(edition_blocks(texts, key), key)


@pandas_udf(BooleanType())
def in_order(source: pd.Series, part: pd.Series) -> pd.Series:
    """Whether the characters of the second, white space aside, stand in the first in the same order. Each character depends on where the last one was found."""

    def one(s: str, p: str) -> bool:
        source, at = "".join((s or "").split()), 0
        for c in "".join((p or "").split()):
            at = source.find(c, at) + 1  # searched in C, not character by character
            if not at:
                return False
        return True

    return pd.Series([one(s, p) for s, p in zip(source, part)])


def fidelity(texts: DataFrame, blocks: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """key and five checks of an edition: schema (no block has errors), order_kept (its characters stand in the
    text in the same order), markdown_kept and hash_kept (reading text and hash are those of the blocks),
    spans_kept (each span is what stands at its place) and sane (500 blocks at most, none of text empty)."""
    again = B.markdown(blocks, key).select(key, F.col("markdown").alias("_markdown"), F.col("hash").alias("_hash"))
    wrong = F.exists("spans", lambda s: F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]) != s["span"])
    faults = block_errors(blocks).groupBy(key).agg(F.count(F.lit(1)).alias("_errors"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n")
    empty = F.col("type").isin("paragraph", "heading", "verse_line", "stanza", "blockquote") & (F.trim(F.coalesce("text", F.lit(""))) == "")
    told = blocks.groupBy(key).agg(whole.alias("_body"), F.count_if(F.coalesce(wrong, F.lit(False))).alias("_wrong"), F.count_if(empty).alias("_empty"))
    x = texts.select(key, F.col("text").alias("_source")).join(made, key).join(again, key).join(told, key).join(faults, key, "left")
    # Hyphens at line ends are undone by design, so they don't count.
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    return x.select(
        key, F.col("_errors").isNull().alias("schema"), in_order(bare(F.col("_source")), bare(F.col("_body"))).alias("order_kept"), (F.col("markdown") == F.col("_markdown")).alias("markdown_kept"), (F.col("hash") == F.col("_hash")).alias("hash_kept"),
        (F.col("_wrong") == 0).alias("spans_kept"), ((F.col("blocks") <= 500) & (F.col("_empty") == 0)).alias("sane"),
    )


def block_errors(blocks: DataFrame) -> DataFrame:
    """Blocks with errors: an unknown type, no text where it is needed, a level outside 1 to 4 on a heading."""
    known = ("paragraph", "heading", "verse_line", "stanza", "blockquote", "dialogue", "stage_direction", "list_item", "metadata", "hr")
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("type").isin(*known), F.lit(False)), "unknown type"), F.when((F.col("type") != "hr") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "no text"),
        F.when((F.col("type") == "heading") & ~F.coalesce(F.col("level").between(1, 4), F.lit(False)), "bad level"),
    ))
    return blocks.withColumn("errors", errors).where(F.size("errors") > 0)


def chapters(lines: DataFrame, key: str) -> DataFrame:
    """key, chapter, label, words: a text split at its chapter lines, what comes before them being front matter (label empty)."""
    w = Window.partitionBy(key).orderBy("line_index")
    head = T.strip(F.col("text")).rlike(r"(?i)^(?:CHAPTER|CHAP\.?|BOOK|VOLUME|PART|CHƯƠNG|CHAPITRE)\s+(?:[IVXLC]+|\d+)\.?$")
    x = lines.withColumns({"head": head, "chapter": F.sum(head.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return x.groupBy(key, "chapter").agg(F.max(F.when(F.col("head"), F.upper(T.strip(F.col("text"))))).alias("label"), F.sum(T.word_count(F.col("text"))).alias("words"), F.count(F.lit(1)).alias("lines")).withColumn("label", F.coalesce("label", F.lit("")))

