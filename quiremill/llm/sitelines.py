"""Lines and blocks that a site puts into many of its works (problem 5).

Each line gets an identifier, a hash of its form and site, and the works of a site laid end to end
are its text over these identifiers. The suffix array of that text is built by prefix doubling: the
rank of a suffix by its first 2h lines comes from two ranks by h lines. Only equality of ranks is
asked, so ranks are hashes, and suffixes of one rank are those with a common prefix of so many
lines: a block. A rank that doesn't span enough works is dropped at once, as no longer block can
span more; so all rounds after the first work on the few lines that a site repeats. When no rank
doubles any further, each suffix is lengthened by halves, which gives the longest block that begins
with it, however long. Blocks that no longer block contains are the maximal ones; the lines that
their occurrences cover are the site's and are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.tables import cut_table

#: Put in place of the work's title.
SIGN = "#"


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def site_of(gutenberg_id: Column, url: Column) -> Column:
    """One site for all works with a gutenberg_id, else the host without letter case and a leading www."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
    return F.when(gutenberg_id.isNotNull(), F.lit("gutenberg")).when(host != "", host)


def _latest(works: DataFrame) -> DataFrame:
    """work (a hash), site and title of each work that has a site, by its last delivery."""
    w = F.struct(site_of(F.col("gutenberg_id"), F.col("source_url")).alias("site"), letters(F.coalesce("work", F.lit(""))).alias("title"))
    return works.where("work_id is not null").groupBy(F.xxhash64("work_id").alias("work")).agg(F.max_by(w, F.struct("ingested_at", "work_row")).alias("w")).where("w.site is not null").select("work", "w.site", "w.title")


def line_ids(lines: DataFrame, works: DataFrame, least_letters: int = 20) -> DataFrame:
    """line_id, work, pos (line_index), site and id of each line of enough letters besides the title; work and site are hashes."""
    text = letters(F.coalesce(F.col("text"), F.lit("")))
    x = lines.where(F.col("work_id").isNotNull() & (F.length("text") >= least_letters)).select("line_id", F.xxhash64("work_id").alias("work"), F.col("line_index").alias("pos"), text.alias("all"))
    at = F.when((F.col("title") != "") & F.col("title").isNotNull(), F.instr(F.col("all"), F.col("title"))).otherwise(0)
    form = F.when(F.col("at") > 0, F.concat(F.expr("left(all, at - 1)"), F.lit(SIGN), F.expr("substr(all, at + length(title))"))).otherwise(F.col("all"))
    x = x.join(_latest(works).hint("shuffle_hash"), "work").withColumn("at", at).withColumn("form", form).where(F.length("form") - (F.col("at") > 0).cast("int") >= least_letters)
    return x.select("line_id", "work", "pos", F.xxhash64("site").alias("site"), F.xxhash64("site", "form").alias("id"))


def _sites(lines: DataFrame, works: DataFrame) -> DataFrame:
    """Hash of each site and the number of its works that have text lines."""
    have = lines.where("work_id is not null").select(F.xxhash64("work_id").alias("work")).distinct()
    return have.join(_latest(works), "work").groupBy(F.xxhash64("site").alias("site")).agg(F.count(F.lit(1)).alias("site_works"))


def _spanning(rows: DataFrame, sites: DataFrame, least_works: int, least_share: float) -> DataFrame:
    """The rows whose rank spans enough works of its site, with their number. Works are counted in two steps, so that no rank is one task's."""
    works = rows.select("site", "rank", "work").distinct().groupBy("site", "rank").agg(F.count(F.lit(1)).alias("works"))
    enough = works.join(sites, "site").where((F.col("works") >= least_works) & (F.col("works") >= F.col("site_works") * least_share))
    return rows.drop("works").join(enough.select("rank", "works"), "rank")


def longest_blocks(hot: DataFrame, sites: DataFrame, least_works: int = 3, least_share: float = 0.1) -> DataFrame:
    """work, pos, site, rank, works and depth of the longest block that begins at each line of `hot`.

    hot: work, pos, site, rank and works of the lines that span enough works by themselves.
    """
    keep = ["work", "pos", "site", "rank", "works"]
    both = F.xxhash64("rank", "next")
    at = lambda t, by: t.select("work", (F.col("pos") - by).alias("pos"), F.col("rank").alias("next"))
    levels, depth = [hot.select(*keep)], 1
    while True:  # ranks by 1, 2, 4, 8 ... lines
        grown = cut_table(_spanning(levels[-1].join(at(levels[-1], depth), ["work", "pos"]).withColumn("rank", both).drop("next"), sites, least_works, least_share).select(*keep))
        if grown.isEmpty():
            break
        levels.append(grown)
        depth *= 2
    cols = [*keep, "depth"]
    longest = occurs = levels[-1].withColumn("depth", F.lit(depth))
    for level in reversed(levels[:-1]):  # lengthened by ... 8, 4, 2, 1 lines
        depth //= 2
        level = level.withColumn("depth", F.lit(depth)).select(*cols)
        follows = level.select("work", F.col("pos").alias("end"), F.col("rank").alias("next"))
        more = occurs.withColumn("end", F.col("pos") + F.col("depth")).join(follows, ["work", "end"]).withColumn("base", F.col("rank")).withColumn("rank", both).withColumn("depth", F.col("depth") + depth)
        more = cut_table(_spanning(more.drop("next", "end"), sites, least_works, least_share))
        longer = longest.select("work", "pos", F.col("rank").alias("base")).join(more, ["work", "pos", "base"]).select(*cols)
        rest = longest.join(longer.select("work", "pos"), ["work", "pos"], "left_anti").select(*cols)
        fresh = level.join(longest.select("work", "pos"), ["work", "pos"], "left_anti").select(*cols)
        longest = cut_table(longer.unionByName(rest).unionByName(fresh))
        # All occurrences of the blocks that some suffix has come to: also those that go on count for the ones that don't.
        occurs = cut_table(occurs.unionByName(more.select(*cols)).unionByName(level).join(longest.select("rank").distinct(), "rank", "left_semi")) if depth > 1 else None
    return longest


def repeated_lines(lines: DataFrame, works: DataFrame, least_works: int = 3, least_share: float = 0.1, least_letters: int = 20) -> tuple[DataFrame, DataFrame]:
    """The lines that span enough works by themselves (line_id, work, pos, site, rank and works), and the sites with their works."""
    ids = cut_table(line_ids(lines, works, least_letters))
    sites = cut_table(_sites(lines, works))
    often = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_works).select("id")
    return cut_table(_spanning(ids.join(often.hint("shuffle_hash"), "id", "left_semi").withColumnRenamed("id", "rank"), sites, least_works, least_share)), sites


def site_lines(lines: DataFrame, works: DataFrame, least_works: int = 3, least_share: float = 0.1, least_letters: int = 20) -> tuple[DataFrame, DataFrame]:
    """The lines (line_id, work, pos) that a site repeats, and the occurrences of maximal blocks (work, pos, site, rank, works, depth).

    A line counts when its form occurs in at least `least_works` works and `least_share` of those
    works of its site that have text lines, a block when the same lines follow each other in as many.
    Lines follow each other when their line_index does. Works without a site, lines of unknown works or
    without a work and null texts never count; equal rows count once per work. Of several lines with
    one line_index all count, and the one of the least rank stands in blocks.
    """
    hot, sites = repeated_lines(lines, works, least_works, least_share, least_letters)
    at_pos = hot.groupBy("work", "pos").agg(F.min(F.struct("rank", "site", "works")).alias("r")).select("work", "pos", "r.*")
    found = longest_blocks(at_pos, sites, least_works, least_share)
    w = Window.partitionBy("work").orderBy("pos")
    inner = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("depth").over(w) > F.col("depth"))
    maximal = found.withColumn("inner", F.coalesce(inner, F.lit(False))).where("not inner").drop("inner")
    return hot.select("line_id", "work", "pos"), maximal


def covered(hot: DataFrame, blocks: DataFrame) -> DataFrame:
    """line_id of the lines that an occurrence of a block covers."""
    ends = blocks.select("work", "pos", (F.col("pos") + F.col("depth")).alias("end"))
    w = Window.partitionBy("work").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    x = hot.join(ends, ["work", "pos"], "left").withColumn("reach", F.max("end").over(w))
    return x.where(F.col("reach") > F.col("pos")).select("line_id")


def found_lines(lines: DataFrame, works: DataFrame, **limits: float) -> DataFrame:
    """line_id of every line of a maximal block."""
    return covered(*site_lines(lines, works, **limits))


def repeated_blocks(lines: DataFrame, works: DataFrame, **limits: float) -> DataFrame:
    """block, depth, works, occurrences, first_line (the least line_id that one begins with) of each maximal block."""
    hot, blocks = site_lines(lines, works, **limits)
    first = hot.groupBy("work", "pos").agg(F.min("line_id").alias("line_id"))
    return blocks.join(first, ["work", "pos"]).groupBy(F.col("rank").alias("block"), "depth").agg(F.max("works").alias("works"), F.count(F.lit(1)).alias("occurrences"), F.min("line_id").alias("first_line"))


def without_site_lines(lines: DataFrame, works: DataFrame, **limits: float) -> DataFrame:
    """The lines that stay when the maximal blocks are deleted, every column as it was."""
    return lines.join(found_lines(lines, works, **limits), "line_id", "left_anti")
