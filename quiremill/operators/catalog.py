"""The catalogue of works: building, checking, updating, statistics, credits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions import text as T

ID_PATTERN = r"^[a-z][a-z0-9_]{0,40}--[a-z0-9_]{1,80}$"


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the given columns, by partial aggregation rather than by sorting.

    Rows with a null key form a key of their own. Ties are broken by the columns' order; the last one should be unique.
    """
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def with_canonical_license(works: DataFrame, licenses: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """license_id (canonical) and license_known (whether the catalogue has that). A null licence is empty and not known.

    aliases: alias and id, which come before everything else; then the catalogue's own ids and the
    table of labels. The labels that there are, far fewer than works, are looked up once and joined.
    """
    label = F.trim(F.coalesce("license", F.lit("")))
    known = licenses.select(F.col("id").alias("label"), F.col("id").alias("own")).distinct()
    labels = works.select(label.alias("label")).distinct().join(known, "label", "left")
    labels = labels.join(aliases.select(F.col("alias").alias("label"), F.col("id").alias("aliased")).distinct(), "label", "left") if aliases is not None else labels.withColumn("aliased", F.lit(None).cast("string"))
    told = labels.select("label", F.coalesce("aliased", "own", T.license_by_label(F.col("label")), "label").alias("license_id"))
    told = told.join(known.select(F.col("label").alias("license_id"), F.lit(True).alias("has")), "license_id", "left").select(F.col("label").alias("_label"), "license_id", (F.coalesce("has", F.lit(False)) & (F.col("license_id") != "")).alias("license_known"))
    return works.withColumn("_label", label).join(told, "_label").drop("_label")


def build(works: DataFrame, licenses: DataFrame) -> DataFrame:
    """The catalogue from source rows: the last delivery of each work in the catalogue's shape. Rows without a file are skipped."""
    rows = latest(works.where(F.coalesce("file", F.lit("")) != ""), ["work_id"], "ingested_at", "work_row")
    shaped = with_canonical_license(rows, licenses)
    return shaped.select(
        T.work_key(F.col("brain"), F.col("file")).alias("id"), F.coalesce("work", F.regexp_replace("file", r"\.[^.]*$", "")).alias("title"), F.col("brain").alias("author_id"), T.known_language(F.col("lang")).alias("language"), "year",
        F.col("license_id").alias("license"), F.coalesce("license", F.lit("")).alias("license_source"), F.coalesce("source_url", F.lit("")).alias("source_url"), "gutenberg_id", "translator",
        F.array_join(F.coalesce("concepts", F.array().cast("array<string>")), ",").alias("concepts"), F.concat(F.lit("sources/"), F.col("brain"), F.lit("/raw/"), F.col("file")).alias("content_file"), F.lit(1).alias("version"),
    )


def upsert(catalogue: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `changes` replace those of the same key, others are added. Columns are matched by name; missing ones become null."""
    return catalogue.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def statistics(works: DataFrame) -> DataFrame:
    """One row: works, works with each label, and the sorted languages. No rows give zeros and an empty list."""
    return works.agg(F.count(F.lit(1)).alias("works"), F.count_distinct("brain").alias("brains"), F.count("translator").alias("translated"), F.count_if(F.col("gutenberg_id").isNotNull()).alias("with_gutenberg_id"), F.array_join(F.sort_array(F.collect_set(T.known_language(F.col("lang")))), ",").alias("languages"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """key and rows of each key that more than one row has; nulls are no key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows as they are; the job fails with the key's name when two of them have one key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    told = F.when((n > 1) & F.col(key).isNotNull(), F.raise_error(F.concat(F.lit("duplicate id: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return rows.withColumn(key, told)


def check(works: DataFrame, licenses: DataFrame, texts: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """work_row and error of every fault: bad id, duplicate id, missing title, unknown licence, no text, and
    where they can be told unknown author (authors: id, against brain) and unknown or missing original of a
    translation (columns origin and derived_from).

    A null id is bad; the first delivery of an id is no duplicate. A translation needs no text of its own.
    """
    rows = with_canonical_license(works, licenses)
    nth = F.row_number().over(Window.partitionBy("work_id").orderBy("work_row"))
    fault = lambda df, error: df.select("work_row", F.lit(error).alias("error"))
    made = F.coalesce(F.col("origin") == "hub_translation", F.lit(False)) if "origin" in works.columns else F.lit(False)
    out = [
        fault(rows.where(~F.coalesce(F.col("work_id").rlike(ID_PATTERN), F.lit(False))), "bad id"),
        fault(rows.where("work_id is not null").withColumn("nth", nth).where("nth > 1"), "duplicate id"),
        fault(rows.where(F.trim(F.coalesce("work", F.lit(""))) == ""), "missing title"),
        fault(rows.where("not license_known"), "license not in catalog"),
        fault(rows.where(~made).join(texts.select("work_id").distinct(), "work_id", "left_anti"), "no text"),
    ]
    if authors is not None:
        out.append(fault(rows.join(authors.select(F.col("id").alias("brain")).distinct(), "brain", "left_anti"), "unknown author"))
    if "derived_from" in works.columns:
        derived = rows.where(made).withColumn("of", F.coalesce("derived_from", F.lit("")))
        out.append(fault(derived.where("of = ''"), "translation without its original"))
        out.append(fault(derived.where("of <> ''").join(works.select(F.col("work_id").alias("of")).distinct(), "of", "left_anti"), "unknown original"))
    all_faults = out[0]
    for x in out[1:]:
        all_faults = all_faults.unionByName(x)
    return all_faults


def credits(works: DataFrame, segments: DataFrame) -> DataFrame:
    """For each translated work its title and translator and the models that made the drafts; works without segments aren't listed."""
    models = F.array_join(F.sort_array(F.collect_set("draft_model")), ",")
    made = segments.groupBy("work_id").agg(F.count(F.lit(1)).alias("segments"), models.alias("draft_models"))
    return latest(works, ["work_id"], "ingested_at", "work_row").join(made, "work_id").select("work_id", F.coalesce("work", F.col("work_id")).alias("title"), "translator", "segments", "draft_models")


def hash_refresh(documents: DataFrame, known: DataFrame) -> DataFrame:
    """status and documents: updated, unchanged or missing, by comparing digests with known (doc_id, digest). A null text has no digest and counts as missing."""
    now = documents.select("doc_id", F.sha2("text", 256).alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("digest") == F.col("now"), "unchanged").otherwise("updated")
    return now.join(known.select("doc_id", "digest"), "doc_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("documents"))
