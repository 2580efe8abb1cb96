"""Texts as lines with offsets, and what lines of one text say about each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions import text as T

INVISIBLE = r"^[\x{200B}\x{FEFF}\x{2060}]+$"


def line_table(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_index, text, start_char, end_char, blank_before, indent of the lines that aren't blank.

    Offsets count code points and are half open, indent counts spaces. Lines of nothing but invisible
    characters are dropped. CR and CR LF end lines as LF does. Null and empty texts have no lines.
    """
    raw = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("n", "raw"))
    by = Window.partitionBy(key).orderBy("n")
    at = F.sum(F.length("raw") + 1).over(by) - F.length("raw") - 1
    stripped = T.strip(F.col("raw"))
    x = raw.withColumns({"s": stripped, "start_char": at, "blank_before": F.coalesce(F.lag(stripped == "").over(by), F.lit(True))})
    kept = x.where((F.col("s") != "") & ~F.col("s").rlike(INVISIBLE))
    indent = F.length("raw") - F.length(F.regexp_replace("raw", "^ +", ""))
    return kept.select(key, (F.row_number().over(by) - 1).alias("line_index"), F.col("s").alias("text"), F.col("start_char").cast("bigint").alias("start_char"), (F.col("start_char") + F.length("raw")).cast("bigint").alias("end_char"), "blank_before", indent.alias("indent"))


def islands(rows: DataFrame, partition: list[str], order: list[str], flag: Column) -> DataFrame:
    """The rows where `flag` holds, with island: a number for each run of neighbours that all have it."""
    w = Window.partitionBy(*partition).orderBy(*order)
    f = F.coalesce(flag, F.lit(False))
    starts = F.sum((f & ~F.coalesce(F.lag(f).over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_in": f, "island": starts}).where("_in").drop("_in")


def running_headers(lines: DataFrame, key: str, least: int = 3) -> DataFrame:
    """key, heading and times of the short lines in capitals or italics that come at least `least` times in a text; headings of units never count."""
    short = lines.where((F.length("text") < 90) & T.running_header_shape(F.col("text")) & ~T.unit_heading(F.col("text")))
    return short.select(key, T.heading_key(F.col("text")).alias("heading")).where("heading <> ''").groupBy(key, "heading").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= least)


def uncertain_ranges(labels: DataFrame, key: str, order: str, threshold: float = 0.8) -> DataFrame:
    """key, first and last line of the stretches to be looked at again: low confidence or verse, and what lies between two such if it is one line.

    A null confidence counts as certain.
    """
    w = Window.partitionBy(key).orderBy(order)
    low = (F.coalesce("confidence", F.lit(1.0)) < threshold) | (F.col("role") == "verse_line")
    number = F.row_number().over(w)
    x = labels.withColumn("n", number).where(low)
    fresh = F.coalesce(F.col("n") > F.lag("n").over(w) + 2, F.lit(True))
    grouped = x.withColumn("g", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "g").agg(F.min(order).alias("first_line"), F.max(order).alias("last_line")).drop("g")


def no_verse(s: Column) -> Column:
    """A line that no verse has: too long, with a brace, or naming a unit."""
    return (F.length(s) > 85) | s.contains("{") | s.rlike(r"(?i)(?:^|[^\p{L}\p{N}_])(?:CHAPTER|ACT|SCENE|BOOK)(?:[^\p{L}\p{N}_]|$)")


def verse_end(s: Column) -> Column:
    """A line that ends as verse does: in a note's mark, or short and in a comma or the like."""
    return s.rlike(r"\[\d+\]$") | (s.rlike(T.VERSE_END) & (F.length(s) < 75))


def verse_runs(lines: DataFrame, key: str, least: int = 3, score: float = 0.45) -> DataFrame:
    """key, first_line, lines and score of runs of indented prose that read as verse: the share of lines that end as verse does, none of them disqualified."""
    prose = (F.col("role") == "prose") & (F.col("indent") >= 2)
    w = Window.partitionBy(key).orderBy("line_index")
    runs = islands(lines, [key], ["line_index"], prose).withColumn("part", F.sum(F.col("blank_before").cast("int")).over(w))
    bad, hit = no_verse(F.col("text")), verse_end(F.col("text"))
    found = runs.groupBy(key, "island", "part").agg(F.min("line_index").alias("first_line"), F.count(F.lit(1)).alias("lines"), F.when(F.bool_or(bad), 0.0).otherwise(F.avg(hit.cast("double"))).alias("score"))
    return found.where((F.col("lines") >= least) & (F.col("score") >= score)).drop("island", "part")


#: Characters from which a line is long enough to have been wrapped, and to be so in a Gutenberg text.
WRAPPED, WRAPPED_GUTENBERG = 55, 40


def join_evidence(before: Column, after: Column, gap: Column, gutenberg: Column, family: Column | None = None) -> tuple[dict[str, Column], dict[str, Column]]:
    """What forbids that a line goes on in the next, and what speaks for it, by name and in order of weight.

    gap: a blank line between them; gutenberg: whether the text comes from there, where lines are wrapped
    by default. A hanging word or an imprint reaches across a blank line.
    """
    p, n = F.rtrim(before), F.trim(after)
    whole = F.trim(before)
    ended, begins = T.sentence_ended(p), n.rlike(T.CONTINUATION)
    hanging = p.rlike(T.HANGING) & ~ended
    printed = gutenberg & (T.imprint_line(p) | T.imprint_line(n))
    forbids = {
        "blank": gap & ~hanging & ~printed,
        "structure": T.hard_structural(n, family),
        "rule": n.rlike(T.RULE),
        "lead in": n.rlike(T.LEAD_IN),
        "closed quote": whole.rlike(T.CLOSED_QUOTE),
    }
    quoted = whole.rlike(T.OPENED_QUOTE) & (n.rlike(r"^\p{Ll}") | whole.rlike(T.OPEN_END)) & (~whole.rlike(T.SENTENCE_END) | whole.rlike(T.OPEN_END))
    speaks = {
        "hanging across a blank": gap & hanging & n.rlike(r"^[A-Za-z(\[\"]"),
        "imprint": gutenberg & T.imprint_line(p) & (T.imprint_line(n) | n.rlike("^(?:AND|and) ")),
        "quotation": quoted,
        "hanging word": hanging & (F.length(before) >= WRAPPED),
        "hyphen": p.endswith("-") & n.rlike(r"^\p{Ll}"),
        "continuation": begins & ~ended,
        "wrapped": (F.length(p) >= WRAPPED) & ~ended & n.rlike("^[A-Z]") & ~n.rlike(T.NEW_UNIT),
        "open clause": p.rlike(r"(?:[,;]|--)$") & begins,
        "colon": p.endswith(":") & n.rlike("^[\"“_«]"),
        "open bracket": p.rlike(T.OPEN_BRACKET) & n.rlike(T.BRACKET_REST),
        "default": ~gap & gutenberg & ((F.length(p) >= WRAPPED_GUTENBERG) | ~ended),
    }
    return forbids, speaks


def _first_of(named: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(c, F.lit(k)) for k, c in named.items()))


def join_decisions(lines: DataFrame, key: str, gutenberg: Column | None = None, family: str | None = None) -> DataFrame:
    """key, line_index, join_next and why for each line and the one after it; the last line of a text joins nothing.

    A line goes on when nothing forbids it and something speaks for it. gutenberg: whether the text is
    from there, true where it isn't given. A null text is an empty line, a null blank_before no blank line.
    """
    w = Window.partitionBy(key).orderBy("line_index")
    x = lines.withColumns({"_g": F.lit(True) if gutenberg is None else gutenberg, "_text": F.coalesce("text", F.lit(""))})
    x = x.withColumns({"_last": F.lead("line_index").over(w).isNull(), "_nxt": F.lead("_text").over(w), "_gap": F.coalesce(F.lead("blank_before").over(w), F.lit(False))}).where("not _last")
    forbids, speaks = join_evidence(F.col("_text"), F.col("_nxt"), F.col("_gap"), F.col("_g"), None if family is None else F.lit(family))
    x = x.withColumns({"_no": _first_of(forbids), "_yes": _first_of(speaks)})
    return x.select(key, "line_index", (F.col("_no").isNull() & F.col("_yes").isNotNull()).alias("join_next"), F.coalesce("_no", "_yes", F.lit("ended")).alias("why"))


def wrap_review(decided: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs on which the rules and the parser's labels disagree, by reason; a null label is no answer and agrees."""
    both = decided.join(labels, "line_id").where(F.col("parser_join").isNotNull())
    return both.groupBy("why", "join_next", "parser_join").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("join_next") != F.col("parser_join")).alias("disagree"))


def suspect_wraps(decided: DataFrame, labels: DataFrame, least: float = 0.8) -> DataFrame:
    """line_id, why, rule_join, parser_join, confidence and suspect of each pair: one that the rules and the parser's label disagree on, or of which the parser isn't sure."""
    both = decided.join(labels, "line_id")
    suspect = F.coalesce(F.col("join_next") != F.col("parser_join"), F.lit(False)) | (F.coalesce("confidence", F.lit(1.0)) < least)
    return both.select("line_id", "why", F.col("join_next").alias("rule_join"), "parser_join", "confidence", suspect.alias("suspect"))


def reflowed(lines: DataFrame, key: str) -> DataFrame:
    """key, block and text: lines joined where the printer wrapped them, hyphens undone; headings stand alone and blank lines separate."""
    w = Window.partitionBy(key).orderBy("line_index")
    hard = T.hard_structural(F.col("text"))
    x = lines.withColumns({"hard": hard, "before": F.lag("text").over(w), "hard_before": F.lag(hard).over(w)})
    fresh = F.col("before").isNull() | F.col("blank_before") | F.col("hard") | F.coalesce("hard_before", F.lit(False)) | (F.length("before") < 55)
    x = x.withColumns({"block": F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "nxt": F.lead("text").over(w), "fresh_next": F.lead(fresh).over(w)})
    hyphen = F.col("text").endswith("-") & F.col("nxt").rlike(r"^\p{Ll}") & ~F.coalesce("fresh_next", F.lit(True))
    piece = F.when(hyphen, F.regexp_replace("text", "-$", "")).otherwise(F.concat("text", F.lit(" ")))
    return x.groupBy(key, "block").agg(F.rtrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", piece.alias("p")))), lambda s: s["p"]), "")).alias("text"))
