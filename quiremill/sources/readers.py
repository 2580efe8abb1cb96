"""Readers and writers: source lists, texts, catalogues, HTML pages, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.functions.text import strip

#: Explicit, so that no file has to be read twice and a missing column is null.
SOURCE_ROW = "file string, work string, year int, source_url string, license string, concepts array<string>, gutenberg_id string, translator string, lang string, chunking string"
CORRUPT = "_corrupt_record"


def source_lists(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every <brain>/works.json under root, with brain. Files that hold no list, and rows without a file, are skipped."""
    rows = spark.read.schema(SOURCE_ROW).option("multiLine", True).json(f"{root}/*/works.json")
    return rows.where(F.coalesce("file", F.lit("")) != "").withColumn("brain", F.regexp_extract(F.input_file_name(), r"([^/]+)/works\.json$", 1))


def json_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the unreadable lines set aside, of a file of JSON lines."""
    both = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    kept = both.persist()  # Spark refuses to select the corrupt column alone from the file
    return kept.where(F.col(CORRUPT).isNull()).drop(CORRUPT), kept.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def text_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, text and digest (of the bytes) of whole text files; bytes that aren't UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").load(glob)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("digest"))


def html_images(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, n, src and alt of the images of pages in order; of several with one file name the first."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    each = pages.select(key, F.posexplode(tags).alias("n", "tag"))
    attribute = lambda a: F.regexp_extract("tag", rf"(?is)\b{a}\s*=\s*[\"']([^\"']*)", 1)
    named = each.select(key, "n", attribute("src").alias("src"), attribute("alt").alias("alt")).where("src <> ''").withColumn("file", F.regexp_extract("src", r"([^/?#]+)(?:[?#].*)?$", 1))
    return named.groupBy(key, "file").agg(F.min_by(F.struct("n", "src", "alt"), "n").alias("i")).select(key, "i.n", "i.src", "i.alt")


BLOCK_TAGS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|blockquote|section|article)\b[^>]*>"


def html_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and text of pages without tags, scripts and styles; block tags become line ends, the commonest entities characters."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(F.regexp_replace(t, BLOCK_TAGS, "\n"), r"<[^>]*>", "")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return pages.select(key, strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")).alias("text"))


def write_editions(editions: DataFrame, path: str) -> None:
    """Editions as parquet, a folder for each parser version and language, so that either prunes; written again, only the folders at hand are replaced."""
    editions.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("parser_version", "language").parquet(path)


def cached_editions(spark: SparkSession, path: str, wanted: DataFrame, parser_version: str) -> DataFrame:
    """Editions of the wanted (work_id, raw_hash) made by this version of the parser."""
    return spark.read.parquet(path).where(F.col("parser_version") == parser_version).join(wanted.select("work_id", "raw_hash").distinct(), ["work_id", "raw_hash"], "left_semi")
