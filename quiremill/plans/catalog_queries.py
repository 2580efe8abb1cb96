"""Queries over the catalogue of works, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiremill.functions import text as T
from quiremill.operators import catalog
from quiremill.plans.text_queries import strip_sql
from quiremill.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LATEST = "l as (select * from works qualify row_number() over (partition by work_id order by ingested_at desc, work_row desc) = 1)"
_LANG = f"case when lower({strip_sql("coalesce(lang, '')")}) in ('en', 'vi', 'fr', 'ja') then lower({strip_sql('lang')}) else 'en' end"
_STEM = r"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(file, '^.*/', ''), '(.)\.[^.]*$', '\1')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_ID = f"brain || '--' || left(case when {_STEM} = '' then 'work' else {_STEM} end, 80)"
_CANON = r"""case when trim(coalesce(license, '')) in (select id from licenses) then trim(license) when regexp_matches(trim(coalesce(license, '')), '^public_domain_usa_archive_\d{4}$') then 'public_domain_usa_archive'
  when regexp_matches(trim(coalesce(license, '')), '^public_domain_usa_\d{4}$') or trim(license) in ('public_domain_usa','public_domain_original','public_domain_primary_excerpt','public_domain_usa_journal','public_domain_usa_wikisource','public_domain_usa_wikisource_legge') then 'public_domain_usa_gutenberg'
  when starts_with(trim(coalesce(license, '')), 'public_domain_vn') then 'public_domain_vn_wikisource' else trim(coalesce(license, '')) end"""


@query(f"select work_row, {_ID} as id from works where file is not null")
def work_id(spark, d):
    """Ids made from brain and file."""
    return table(spark, d, "works").where("file is not null").select("work_row", T.work_key(F.col("brain"), F.col("file")).alias("id"))


@query(f"select {_LANG} as language, count(*) as works from works group by 1")
def language_guess(spark, d):
    """Works by the language their label gives, English where it gives none."""
    return table(spark, d, "works").groupBy(T.known_language(F.col("lang")).alias("language")).agg(F.count(F.lit(1)).alias("works"))


@query(f"select license_id, license_id in (select id from licenses) and license_id <> '' as allowed, count(*) as works from (select {_CANON} as license_id from works) group by all")
def license_canonical(spark, d):
    """Works by canonical licence, and whether the catalogue has it."""
    rows = catalog.with_canonical_license(table(spark, d, "works"), table(spark, d, "licenses"))
    return rows.groupBy("license_id", F.col("license_known").alias("allowed")).agg(F.count(F.lit(1)).alias("works"))


@query(f"""with {_LATEST} select {_ID} as id, coalesce(work, regexp_replace(file, '\\.[^.]*$', '')) as title, brain as author_id, {_LANG} as language, year, {_CANON} as license, coalesce(license, '') as license_source, coalesce(source_url, '') as source_url,
  gutenberg_id, translator, coalesce(array_to_string(concepts, ','), '') as concepts, 'sources/' || brain || '/raw/' || file as content_file, 1 as version from l where coalesce(file, '') <> ''""")
def build_catalog(spark, d):
    """The catalogue."""
    return catalog.build(table(spark, d, "works"), table(spark, d, "licenses"))


@query(f"""with {_LATEST}, first as (select * from works qualify row_number() over (partition by work_id order by ingested_at, work_row) = 1), twice as (select work_id from works group by 1 having count(*) > 1)
  select work_id, work_row from first where work_id not in (select work_id from twice) union all select work_id, work_row from l where work_id in (select work_id from twice)""")
def upsert_work(spark, d):
    """First deliveries, replaced by later ones."""
    works = table(spark, d, "works")
    first = catalog.latest(works.withColumn("back", -F.col("work_row")), ["work_id"], "back")
    again = works.join(works.groupBy("work_id").count().where("count > 1").select("work_id"), "work_id", "left_semi")
    return catalog.upsert(first.drop("back"), catalog.latest(again, ["work_id"], "ingested_at", "work_row"), "work_id").select("work_id", "work_row")


@query(f"select count(*) as works, count(distinct brain) as brains, count(translator) as translated, count(gutenberg_id) as with_gutenberg_id, (select string_agg(x, ',' order by x) from (select distinct {_LANG} as x from works)) as languages from works")
def catalog_stats(spark, d):
    """Statistics of the catalogue."""
    return catalog.statistics(table(spark, d, "works"))


@query(f"""select work_row, 'bad id' as error from works where work_id is null or not regexp_matches(work_id, '{catalog.ID_PATTERN}')
  union all select work_row, 'duplicate id' from works where work_id is not null qualify row_number() over (partition by work_id order by work_row) > 1
  union all select work_row, 'missing title' from works where trim(coalesce(work, '')) = ''
  union all select work_row, 'license not in catalog' from works where not ({_CANON} in (select id from licenses)) or ({_CANON}) = ''
  union all select work_row, 'no text' from works where work_id not in (select work_id from text_lines where work_id is not null)""")
def validate_catalog(spark, d):
    """Faults of the catalogue."""
    return catalog.check(table(spark, d, "works"), table(spark, d, "licenses"), table(spark, d, "text_lines"))


@query(f"""with {_LATEST}, m as (select work_id, count(*) as segments, coalesce((string_agg(distinct draft_model, ',' order by draft_model)), '') as draft_models from segments group by 1)
  select work_id, coalesce(work, work_id) as title, translator, segments, draft_models from l join m using (work_id)""")
def work_credits(spark, d):
    """Who made the translated works."""
    return catalog.credits(table(spark, d, "works"), table(spark, d, "segments"))


@query("""with k as (select doc_id, sha256(first_value(text) over (partition by work_id, chapter order by fetched_at, doc_id)) as digest from documents where text is not null and work_id is not null)
  select case when text is null then 'missing' when k.digest = sha256(text) then 'unchanged' else 'updated' end as status, count(*) as documents from documents left join k using (doc_id) group by 1""")
def hash_refresh(spark, d):
    """Documents by whether their digest is that of the chapter's first fetch; those without a work are known by none."""
    docs = table(spark, d, "documents")
    first = F.first("text").over(Window.partitionBy("work_id", "chapter").orderBy("fetched_at", "doc_id"))
    return catalog.hash_refresh(docs, docs.where("text is not null and work_id is not null").select("doc_id", F.sha2(first, 256).alias("digest")))


@query(f"""with {_LATEST} select work_id, case when chunking = 'verse' then 'poetry' when regexp_matches(lower(array_to_string(concepts, ' ')), 'memoir|autobiograph|life') then 'memoir-biography' else 'essays' end as category from l""")
def category_guess(spark, d):
    """Works by what kind of reading they are."""
    works = catalog.latest(table(spark, d, "works"), ["work_id"], "ingested_at", "work_row")
    return works.select("work_id", T.category(F.col("brain"), F.col("chunking"), F.col("concepts")).alias("category"))


@query("select work_id, count(*) as deliveries from works group by 1 having count(*) > 1")
def duplicate_ids(spark, d):
    """Ids that several rows have."""
    return catalog.duplicates(table(spark, d, "works"), "work_id").withColumnRenamed("rows", "deliveries")


@query("select w.brain, count(distinct w.work_id) as works, count(distinct t.work_id) as with_lines, count(t.line_id) as lines from (select distinct brain, work_id from works) w left join text_lines t using (work_id) group by 1")
def brain_rollup(spark, d):
    """Works and lines by brain."""
    lines = table(spark, d, "text_lines").groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "works").select("brain", "work_id").distinct().join(lines, "work_id", "left").groupBy("brain").agg(F.count(F.lit(1)).alias("works"), F.count("n").alias("with_lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
