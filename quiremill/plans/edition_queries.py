"""Queries over editions and notes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiremill.functions import text as T
from quiremill.operators import edition, lines, matching, notes, translation
from quiremill.operators.catalog import latest
from quiremill.plans.line_queries import labelled
from quiremill.plans.text_queries import like, strip_sql
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


_MARKS = r"m as (select sample_row, unnest(regexp_extract_all(text, '\[(\d{1,4}(?:,\s*\d{1,4})*)\]', 1)) as m, generate_subscripts(regexp_extract_all(text, '\[(\d{1,4}(?:,\s*\d{1,4})*)\]', 1), 1) - 1 as pos from inline_samples), k as (select sample_row, pos, cast(unnest(regexp_split_to_array(m, ',\s*')) as int) as number from m)"


def _marks(spark, d):
    return notes.marks(table(spark, d, "inline_samples"), ["sample_row"], "text")


@query(f"with {_MARKS} select sample_row, pos, number from k")
def footnote_marks(spark, d):
    """Marks of notes in the samples."""
    return _marks(spark, d)


@query(f"with {_MARKS}, g as (select distinct sample_row, number from k), l as (select *, lag(number) over (partition by sample_row order by number) as after from g) select sample_row, after, number - after - 1 as missing from l where number - after - 1 between 1 and 40")
def footnote_gaps(spark, d):
    """Numbers left out, 40 at most."""
    return notes.gaps(_marks(spark, d), "sample_row", 40)


@query(r"""with c as (select * from segments qualify row_number() over (partition by segment_id order by arrived_at desc, seg_row desc) = 1), l as (select * from annotations qualify row_number() over (partition by id order by generated_at desc, annotation_row desc) = 1),
  k as (select segment_id, cast(unnest(flatten(list_transform(regexp_extract_all(source_text, '\[(\d{1,4}(?:,\s*\d{1,4})*)\]', 1), lambda x: regexp_split_to_array(x, ',\s*')))) as int) as number from c), a as (select segment_id, number, count(*) as marks from k group by all),
  n as (select segment_id, row_number() over (partition by segment_id order by annotation_row) as number, body_vi from l), b as (select segment_id, number, coalesce(string_agg(body_vi, ' ' order by body_vi), '') as body from n group by all)
  select segment_id, number, coalesce(marks, 0) as marks, body, case when body is null then 'no body' when marks is null then 'no mark' else 'linked' end as state from a full join b using (segment_id, number)""")
def footnote_links(spark, d):
    """Marks of the segments' sources linked to the bodies of their annotations, which are numbered in order within a segment."""
    found = notes.marks(translation.current(table(spark, d, "segments")), ["segment_id"], "source_text")
    last = latest(table(spark, d, "annotations"), ["id"], "generated_at", "annotation_row")
    number = F.row_number().over(Window.partitionBy("segment_id").orderBy("annotation_row"))
    return notes.linked(found, last.select("segment_id", number.alias("number"), F.col("body_vi").alias("body")), "segment_id")


@query(f"with {_MARKS}, l as (select sample_row, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as block from inline_samples), b as (select sample_row, block, cast(unnest(flatten(list_transform(regexp_extract_all(t, '\\[(\\d{{1,4}}(?:,\\s*\\d{{1,4}})*)\\]', 1), lambda x: regexp_split_to_array(x, ',\\s*')))) as int) as number from l) select sample_row, number, min(block) as block from b group by all")
def note_hosts(spark, d):
    """The first line of a sample that holds each mark."""
    samples = table(spark, d, "inline_samples")
    parts = samples.select("sample_row", F.posexplode(F.split("text", "\n")).alias("block", "text"))
    return notes.hosts(_marks(spark, d), parts, "sample_row")


@query(f"select line_id from text_lines where {like(strip_sql('text'), edition.WIKI)}")
def wiki_junk_lines(spark, d):
    """Lines of navigation and metadata."""
    return edition.wiki_parts(table(spark, d, "text_lines"))[1].select("line_id")


@query()
def collect_spans(spark, d):
    """What isn't the text of each work: wrappers and running heads."""
    return edition.drop_spans(table(spark, d, "text_lines"), "work_id")


@query()
def label_lines(spark, d):
    """Roles, levels and joins of the documents' lines by rules."""
    return edition.labelled(lines.line_table(table(spark, d, "documents"), "doc_id"), "doc_id").select("doc_id", "line_index", "role", "level", "confidence", "join_next")


@query()
def build_edition(spark, d):
    """Editions of the documents."""
    made = edition.editions(table(spark, d, "documents"), "doc_id")
    return made.select("doc_id", "blocks", "content_kind", F.length("markdown").alias("chars"), "hash")


@query()
def fidelity_checks(spark, d):
    """Checks of the editions against their texts."""
    docs = table(spark, d, "documents")
    return edition.fidelity(docs, edition.edition_blocks(docs, "doc_id"), edition.editions(docs, "doc_id"), "doc_id")


@query(rf"""with s as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null), l as (select *, {strip_sql('t')} as s from s), k as (select *, regexp_matches(s, '(?i)^(?:CHAPTER|CHAP\.?|BOOK|VOLUME|PART|CHƯƠNG|CHAPITRE)\s+(?:[IVXLC]+|\d+)\.?$') as head from l where s <> ''),
  c as (select *, sum(case when head then 1 else 0 end) over (partition by doc_id order by n rows unbounded preceding) as chapter from k)
  select doc_id, chapter, coalesce(max(case when head then upper(s) end), '') as label, sum(len(regexp_extract_all(s, '{T.WORD}'))) as words, count(*) as lines from c group by doc_id, chapter""".replace(T.WORD, T.WORD.replace("'", "''")))
def split_chapters(spark, d):
    """The documents by chapters."""
    return edition.chapters(lines.line_table(table(spark, d, "documents"), "doc_id"), "doc_id")


@query("select role, level, coalesce(source, 'none') as source, count(*) as lines, count(*) filter (where join_next) as joined, count(*) filter (where confidence is null) as unsure from text_lines join line_labels using (line_id) group by all")
def label_summary(spark, d):
    """The parser's labels by role."""
    return labelled(spark, d).groupBy("role", "level", F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("lines"), F.count_if("join_next").alias("joined"), F.count_if(F.col("confidence").isNull()).alias("unsure"))


@query("""with n as (select * from segments qualify row_number() over (partition by segment_id order by arrived_at desc, seg_row desc) = 1), o as (select * from segments where seg_row not in (select seg_row from n)), i as (select segment_id, max(seg_row) as a from o group by 1), p as (select work_id, chapter, max(seg_row) as b from o group by 1, 2)
  select n.seg_row, coalesce(a, b) as source_row from n left join i using (segment_id) left join p on p.work_id = n.work_id and p.chapter = n.chapter""")
def inherit_translations(spark, d):
    """What the last delivery of each segment takes over from all earlier ones."""
    s = table(spark, d, "segments")
    new = translation.current(s).select("seg_row", "segment_id", "work_id", "chapter")
    return translation.inherited(new, s.join(new.select("seg_row"), "seg_row", "left_anti"))


@query("""with c as (select * from segments qualify row_number() over (partition by segment_id order by arrived_at desc, seg_row desc) = 1), l as (select annotation_row, length(anchor_text) as size, instr(source_text, anchor_text) - 1 as pos, source_text from annotations join c using (segment_id) where length(coalesce(anchor_text, '')) > 0)
  select annotation_row, substr(source_text, greatest(0, pos - 110) + 1, pos + size + 110 - greatest(0, pos - 110)) as context from l where pos >= 0""")
def span_windows(spark, d):
    """What stands around each anchor."""
    notes_, segs = table(spark, d, "annotations"), table(spark, d, "segments")
    at = translation.located_anchors(notes_, segs).join(notes_.select("annotation_row", "segment_id", F.length("anchor_text").alias("size")), "annotation_row")
    return translation.windows(at, translation.current(segs).select("segment_id", F.col("source_text").alias("text")))


@query("select distinct chapter, case when regexp_matches(chapter, '^\\d+$') then 'Chương ' || cast(cast(chapter as int) as varchar) else chapter end as title from segments where chapter is not null")
def title_fallback(spark, d):
    """Titles of chapters that have none."""
    return table(spark, d, "segments").where("chapter is not null").select("chapter").distinct().select("chapter", translation.fallback_title(F.col("chapter")).alias("title"))


@query("select lower(term_en) as name, count(*) as renderings, max(term_vi) as term_vi from glossary group by 1")
def glossary_merge(spark, d):
    """One entry for each term: the last of its rows by rendering, the table having no order of its own."""
    g = table(spark, d, "glossary").select(F.lower("term_en").alias("name"), F.array().cast("array<string>").alias("aliases"), F.col("term_vi").alias("place"), "term_vi")
    n = g.groupBy("name").agg(F.count(F.lit(1)).alias("renderings"))
    return translation.merged_glossary(g, "place").join(n, "name").select("name", "renderings", "term_vi")


@query("select work_id, count(*) as deliveries, count(distinct segment_id) as segments, count(*) filter (where status = 'ok') as ok, max_by(seg_row, (updated_at, seg_row)) as latest from segments group by 1")
def project_rollup(spark, d):
    """Segments of each work, and the last that was touched."""
    return table(spark, d, "segments").groupBy("work_id").agg(F.count(F.lit(1)).alias("deliveries"), F.count_distinct("segment_id").alias("segments"), F.count_if(F.col("status") == "ok").alias("ok"), F.max_by("seg_row", F.struct("updated_at", "seg_row")).alias("latest"))


@query(r"""with t as (select distinct work_id, trim(regexp_replace(lower(work), '[^a-z0-9]+', ' ', 'g')) as title from works where work is not null), l as (select work_id, line_index, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as line from text_lines)
  select t.work_id, title, min(line_index) as line_index from t join l on l.work_id = t.work_id and left(title, 24) = left(line, 24) where length(title) >= 4 and (line = title or length(title) >= 24) group by 1, 2""")
def content_match(spark, d):
    """The first line of each work that repeats its title or begins as it does."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    titles = table(spark, d, "works").where("work is not null").select("work_id", fold("work").alias("title")).distinct()
    return matching.content_matches(titles, table(spark, d, "text_lines").select("work_id", "line_index", fold("text").alias("line")), "work_id")


@query(r"""with t as (select distinct work_id, trim(regexp_replace(lower(work), '[^a-z0-9]+', ' ', 'g')) as title from works where work is not null), l as (select work_id, line_index, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as line from text_lines where length(text) <= 160)
  select t.work_id, title, min(line_index) as line_index from t join l on l.work_id = t.work_id where title <> '' and line <> '' and (line = title or (length(title) >= 8 and (contains(line, title) or contains(title, line) or starts_with(line, left(title, 24))))) group by 1, 2""")
def content_match_whole(spark, d):
    """The first line of each work that equals its title, holds it, is held by it or begins as it does; lines of 160 characters at most."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    titles = table(spark, d, "works").where("work is not null").select("work_id", fold("work").alias("title"))
    return matching.content_mentions(titles, table(spark, d, "text_lines").where("length(text) <= 160").select("work_id", "line_index", fold("text").alias("line")), "work_id")


@query("""with o as (select id, min_by(kind, annotation_row) as decided from annotations group by 1 having count(*) > 1) select annotation_row, coalesce(decided, 'pending') as decision from annotations left join o using (id)""")
def decision_carry_over(spark, d):
    """Annotations with the decision on an earlier delivery of theirs; the kind stands in for it, as the tables hold none."""
    a = table(spark, d, "annotations")
    earlier = a.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min_by("kind", "annotation_row").alias("decided")).where("n > 1")
    return a.join(earlier, "id", "left").select("annotation_row", F.coalesce("decided", F.lit("pending")).alias("decision"))
