"""Matching titles, contents entries, captions and glossary terms to where they belong."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quiremill.session import cut

STOP_WORDS = {"a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"}


def folded(s: str) -> str:
    """Lower case without accents; anything but letters and digits makes one blank."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).casefold()
    return re.sub(r"[^a-z0-9]+", " ", s).strip()


@pandas_udf(StringType())
def fold_key(s: pd.Series) -> pd.Series:
    """Letters and digits without accents and case, for keys: no built-in function decomposes characters."""
    return s.map(lambda v: None if v is None else folded(v).replace(" ", ""))


def title_scores(titles: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """key, title, label and score of the best label for each title of the same text: 1 if equal, at least 0.8 if one holds the other as whole words; others don't match.

    Both sides are folded (columns title and label). Ties go to the smaller label.
    """
    pairs = titles.join(labels, key)
    a, b = F.col("title"), F.col("label")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    inside = F.contains(pad(b), pad(a)) | F.contains(pad(a), pad(b))
    score = F.when(a == b, 1.0).when(inside, F.greatest(F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)), F.lit(0.8)))
    good = pairs.where((F.length(a) >= 4) & (F.length(b) >= 4)).withColumn("score", F.round(score, 3)).where("score is not null")
    best = F.row_number().over(Window.partitionBy(key, "title").orderBy(F.desc("score"), "label"))
    return good.withColumn("n", best).where("n = 1").select(key, "title", "label", "score")


def glossary_lookup(queries: DataFrame, glossary: DataFrame) -> DataFrame:
    """query, term and how: each query's entry by equal key, the shortest of several, else by a key that begins the query's or is begun by it, the nearest in length.

    Keys under 3 letters match nothing, under 4 only whole. Prefixes are joined by their first four letters.
    """
    q = queries.select("query", fold_key("query").alias("k")).where("length(k) >= 3")
    g = glossary.select(F.col("term_en").alias("term"), fold_key("term_en").alias("t")).distinct().where("length(t) >= 3")
    exact = q.join(g, F.col("k") == F.col("t")).groupBy("query", "k").agg(F.min_by("term", F.struct(F.length("t"), "term")).alias("term"))
    rest = q.join(exact.select("query"), "query", "left_anti")
    near = rest.where("length(k) >= 4").join(g.where("length(t) >= 4"), (F.left("k", F.lit(4)) == F.left("t", F.lit(4))) & (F.col("k").startswith(F.col("t")) | F.col("t").startswith(F.col("k"))))
    by_prefix = near.groupBy("query", "k").agg(F.min_by("term", F.struct(F.abs(F.length("t") - F.length("k")), "term")).alias("term"))
    return exact.select("query", "term", F.lit("exact").alias("how")).unionByName(by_prefix.select("query", "term", F.lit("prefix").alias("how")))


def caption_score(query: Column, caption: Column) -> Column:
    """1 if equal, 0.94 if one holds the other, else 0.55 and more by the share of the query's words, from 0.55 of them on; else 0. Both folded."""
    qw, cw = F.array_distinct(F.split(query, " ")), F.array_distinct(F.split(caption, " "))
    share = F.size(F.array_intersect(qw, cw)) / F.greatest(F.size(qw), F.lit(1))
    few = (F.size(F.split(query, " ")) <= 2) & (F.size(F.split(caption, " ")) > F.size(F.split(query, " ")) + 3)
    inside = F.contains(caption, query) | F.contains(query, caption)
    return F.when((query == "") | (caption == ""), 0.0).when(query == caption, 1.0).when(inside & few, 0.0).when(inside, 0.94).when(share >= 0.55, 0.55 + 0.35 * share).otherwise(0.0)


def bound_captions(scores: DataFrame, key: str, least: float = 0.55) -> DataFrame:
    """key, figure and image: each figure with one image and each image with one figure, by falling score, ties by figure and image.

    scores: key, figure, image and score. A pair is taken when it is the best that is left for both, over
    and over until none is: the same as going through all pairs in order. Nulls and scores under `least` bind nothing.
    """
    left = cut(scores.where(F.col("score") >= least).select(key, "figure", "image", "score").distinct())
    taken = None
    while not left.isEmpty():
        rank = lambda side: F.row_number().over(Window.partitionBy(key, side).orderBy(F.desc("score"), "figure", "image"))
        best = cut(left.withColumns({"f": rank("figure"), "i": rank("image")}).where("f = 1 and i = 1").select(key, "figure", "image"))
        taken = best if taken is None else taken.unionByName(best)
        left = cut(left.join(best.select(key, "figure"), [key, "figure"], "left_anti").join(best.select(key, "image"), [key, "image"], "left_anti"))
    return left.select(key, "figure", "image") if taken is None else taken


def content_matches(titles: DataFrame, lines: DataFrame, key: str, head: int = 24) -> DataFrame:
    """key, title and line_index: the first line of a text that equals a title or begins with its first `head` characters, all folded.

    Titles and lines are joined by text and by the first `head` characters of what is longer than that, so no pair is tried in vain.
    """
    t = titles.select(key, "title", F.left("title", F.lit(head)).alias("h")).where("length(title) >= 4")
    x = lines.select(key, "line_index", "line", F.left("line", F.lit(head)).alias("h"))
    hit = t.join(x, [key, "h"]).where((F.col("line") == F.col("title")) | (F.length("title") >= head))
    return hit.groupBy(key, "title").agg(F.min("line_index").alias("line_index"))


def content_mentions(titles: DataFrame, lines: DataFrame, key: str, head: int = 24) -> DataFrame:
    """key, title and line_index: the first line of a text that equals a title or, for titles of 8 letters on, holds it, is held by it or begins with its first `head` characters, all folded.

    Lines meet the titles of their own text only; lines without letters and digits match nothing.
    """
    t, x = titles.where("title <> ''").select(key, "title").distinct(), lines.where("line <> ''").select(key, "line_index", "line")
    title, line = F.col("title"), F.col("line")
    near = F.contains(line, title) | F.contains(title, line) | F.startswith(line, F.left(title, F.lit(head)))
    hit = x.join(t, key).where((line == title) | ((F.length(title) >= 8) & near))
    return hit.groupBy(key, "title").agg(F.min("line_index").alias("line_index"))
