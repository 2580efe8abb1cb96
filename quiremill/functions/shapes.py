"""What stands in brackets, told by its shape: a table of classes over a few measures, evaluated as columns.

Each class is a row of ranges; a text belongs to the first class all of whose ranges its measures are in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiremill.functions.text import count_of, strip

FAR = 1 << 30
# The measures of a text in brackets.
MEASURES = {
    "chars": r"length",
    "blanks": r"blanks",
    "words": r"words",
    "number": r"^\d{1,4}$",
    "numbers": r"^\d{1,4}(?:,\s*\d{1,4})*$",
    "years": r"^\d{3,4}\s*[-–—]\s*\d{3,4}$",
    "era": r"^[A-Za-zÀ-ỹ-]+\s+\d+\s*\(\d{3,4}(?:-\d{3,4})?\)$",
    "letter": r"[A-Za-zÀ-ỹ]",
    "word": r"[A-Za-zÀ-ỹ]{4,}",
    "citing": r"(?i)^(?:as |see |cf\. |e\.g\. |i\.e\. )",
    "quoting": "[\"'“”‘’]",
    "short": r"^[A-Za-z]{1,3}\.?[A-Za-z0-9 .-]{0,40}$",
}
YES = (1, 1)
# The classes of square and of round brackets.
SQUARE = (
    ("footnote", {"numbers": YES}),
    ("bracket_note", {"chars": (18, FAR)}),
    ("bracket_note", {"blanks": (3, FAR)}),
    ("bracket_note", {"word": YES}),
    ("bracket_cite", {"short": YES}),
    ("bracket_other", {}),
)
ROUND = (
    ("list_marker", {"number": YES, "chars": (1, 2)}),
    ("paren_aside", {"number": YES, "value": (1000, 9999)}),
    ("paren_page", {"number": YES}),
    ("footnote", {"numbers": YES}),
    ("paren_cite", {"era": YES}),
    ("paren_aside", {"years": YES}),
    ("paren_cite", {"citing": YES}),
    ("paren_aside", {"blanks": (5, FAR)}),
    ("paren_aside", {"chars": (40, FAR)}),
    ("paren_quote", {"quoting": YES}),
    ("paren_cite", {"letter": YES, "words": (0, 6)}),
    ("paren_aside", {}),
)


def measures(inner: Column) -> dict[str, Column]:
    b = strip(inner)
    counted = {"chars": F.length(b), "blanks": count_of(b, " "), "words": F.size(F.split(b, r"[\s\p{Z}]+")), "value": F.coalesce(b.try_cast("int"), F.lit(-1))}
    return counted | {k: b.rlike(p).cast("int") for k, p in MEASURES.items() if k not in counted}


def class_of(inner: Column, classes: tuple) -> Column:
    """The class of a text; null for null."""
    m = measures(inner)
    told = F.lit(None).cast("string")
    for name, ranges in reversed(classes):
        inside = F.lit(True)
        for k, (lo, hi) in ranges.items():
            inside = inside & m[k].between(lo, hi)
        told = F.when(inside, name).otherwise(told)
    return F.when(inner.isNotNull(), told)


def bracket_class(inner: Column) -> Column:
    return class_of(inner, SQUARE)


def paren_class(inner: Column) -> Column:
    return class_of(inner, ROUND)


def class_sql(b: str, classes: tuple, like) -> str:
    """The same table as SQL on an expression without white space at its ends."""
    m = {"chars": f"length({b})", "blanks": f"length({b}) - length(replace({b}, ' ', ''))", "words": rf"len(regexp_split_to_array({b}, '[\s\p{{Z}}]+'))", "value": f"coalesce(try_cast({b} as int), -1)"}
    m |= {k: f"{like(b, p)}::int" for k, p in MEASURES.items() if k not in m}
    cases = [" and ".join(f"{m[k]} between {lo} and {hi}" for k, (lo, hi) in ranges.items()) for _, ranges in classes]
    return "case " + " ".join(f"when {c or 'true'} then '{name}'" for (name, _), c in zip(classes, cases)) + " end"
