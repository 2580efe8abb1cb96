"""Queries over documents, segments, samples and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiremill.functions import shapes
from quiremill.functions import text as T
from quiremill.operators import matching, spans, translation
from quiremill.session import table
from quiremill.streaming import streams


def q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def like(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def sub(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def strip_sql(c: str) -> str:
    return sub(c, T.EDGES)


def words_sql(c: str) -> str:
    return f"len(regexp_extract_all({c}, {q(T.WORD)}))"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"select coalesce(lang, 'none') as lang, count(*) as documents, sum({words_sql('text')}) as words, sum(len(string_split(text, chr(10)))) as lines, sum(length({sub('text', r'[\s\p{Z}]+')})) as solid_chars from documents where text is not null group by 1")
def doc_word_stats(spark, d):
    """Words, lines and solid characters of the documents by language."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("documents"), F.sum(T.word_count(F.col("text"))).alias("words"), F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.sum(F.length(T.compact(F.col("text")))).alias("solid_chars"))


@query("select doc_id, sha256(text) as digest, length(text) as chars from documents where text is not null")
def text_digest(spark, d):
    """SHA-256 of each text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"))


@query(r"""select doc_id, case
  when regexp_matches(text, '(?i)\*\*\*\s*(?:START|END) OF (?:THE |THIS )?PROJECT GUTENBERG EBOOK') then 'gutenberg'
  when lower(coalesce(lang, 'en')) like 'ja%' or regexp_matches(left(text, 8000), '本文終わり|底本[：:]|【テキスト中に現れる記号について】') then 'aozora'
  when coalesce(source, '') like '%archive%' then 'archive_scan'
  when len(regexp_extract_all(left(text, 80000), '(?m)^(?:QUESTION\s+\d|Objection\s+\d:|_On the contrary)')) >= 4 then 'scholastic' else 'plain' end as family
  from documents where text is not null""")
def family_detect(spark, d):
    """The family of each document's source."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.source_family(F.col("text"), F.col("lang"), F.col("source"), F.lit("")).alias("family"))


_CUT = lambda c: f"(length({sub(c, r'[\s\p{Z}]+$')}) >= 20 and {like(sub(c, r'[\s\p{Z}]+$'), r'\p{L}$')} and not (length({strip_sql(f'regexp_extract({sub(c, r"[\s\p{Z}]+$")}, {q(r"([^\n]*)$")}, 1)')}) between 1 and 80 and not {like(strip_sql(f'regexp_extract({sub(c, r"[\s\p{Z}]+$")}, {q(r"([^\n]*)$")}, 1)'), r'\p{Ll}')}))"


@query(f"select doc_id from documents where text is not null and {_CUT('text')}")
def cut_off_text(spark, d):
    """Documents that end in the middle of a sentence."""
    return table(spark, d, "documents").where(F.col("text").isNotNull() & T.cut_off(F.col("text"))).select("doc_id")


@query(f"select seg_row from segments where {_CUT(chr(39)*0 + 'coalesce(final, ' + chr(39)*2 + ')')} and not {_CUT('coalesce(source_text, ' + chr(39)*2 + ')')}")
def truncated_translation(spark, d):
    """Final texts that break off though their sources don't."""
    return table(spark, d, "segments").where(T.truncated(F.col("source_text"), F.col("final"))).select("seg_row")


_CURRENT = "c as (select * from segments qualify row_number() over (partition by segment_id order by arrived_at desc, seg_row desc) = 1)"
_STATE = f"""k as (select segment_id, work_id, chapter, coalesce(words, 0) as words, source_text, coalesce(final, '') as f, case
   when ({_CUT("coalesce(final, '')")} and not {_CUT("coalesce(source_text, '')")}) or ({strip_sql("coalesce(final, '')")} <> '' and abs(len(regexp_extract_all(coalesce(source_text, ''), '\\[\\d+\\]')) - len(regexp_extract_all(coalesce(final, ''), '\\[\\d+\\]'))) >= 2) then 'truncated'
   when {strip_sql("coalesce(final, '')")} <> '' then 'ok' when {strip_sql("coalesce(draft_raw, '')")} <> '' then 'raw_pending' else 'empty' end as completeness from c)"""


@query(f"with {_CURRENT}, {_STATE} select segment_id, work_id, chapter, words, completeness from k")
def completeness(spark, d):
    """How complete each segment's translation is."""
    return translation.completeness(table(spark, d, "segments"))


@query(f"""with {_CURRENT}, {_STATE}, e as (select *, cast(round_even(words * 4.0 / 3.0, 0) as bigint) as src from k where completeness <> 'ok'),
  o as (select *, greatest(1, cast(round_even(src * 1.15, 0) as bigint)) as out from e)
  select completeness, count(*) as segments, sum(words) as words, sum(case when completeness = 'raw_pending' then 2500 + src + out + out else 2500 + src + out + out + 2500 + src + out end) as tokens from o group by 1""")
def token_estimate(spark, d):
    """Tokens that the missing translations will take."""
    return translation.estimate(translation.completeness(table(spark, d, "segments")))


_RANK = r"""case when regexp_matches(x, '^\d+$') then cast(x as bigint) when x in ('preface','foreword','introduction','prologue') then 0 when x = 'epilogue' then 10000 when x = 'appendix' then 10001 else 999 end"""


@query(f"""with {_CURRENT}, r as (select *, regexp_replace(lower(chapter), '[^a-z0-9]', '', 'g') as x from c), k as (select *, {_RANK} as rank from r)
  select segment_id, rank, row_number() over (partition by work_id order by rank, chapter, segment_id) as place from k""")
def segment_order(spark, d):
    """The order of each work's segments."""
    return translation.chapter_order(table(spark, d, "segments"))


@query(f"""with {_CURRENT}, {_STATE}, r as (select *, regexp_replace(lower(chapter), '[^a-z0-9]', '', 'g') as x from k), t as (
  select work_id, count(*) as segments, count(*) filter (where completeness <> 'ok') as missing, coalesce(string_agg({strip_sql('f')}, chr(10) || chr(10) order by {_RANK}, chapter, segment_id) filter (where completeness = 'ok'), '') as text from r group by work_id)
  select work_id, segments, missing, length(text) as chars, sha256(text) as hash from t""")
def assemble_finals(spark, d):
    """Each work's final texts in one."""
    return translation.assembled(table(spark, d, "segments"))


@query()
def pack_paragraphs(spark, d):
    """The documents' paragraphs packed into parts of 200 to 250 words."""
    return translation.packed(table(spark, d, "documents").where("text is not null"), "doc_id", "text", 200, 250)


@query()
def repair_paragraphs(spark, d):
    """The documents' paragraphs, whole again where a blank line parted a sentence."""
    return translation.repaired_paragraphs(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query("""with l as (select * from annotations qualify row_number() over (partition by id order by generated_at desc, annotation_row desc) = 1)
  select annotation_row, id, segment_id, kind from l qualify row_number() over (partition by segment_id, coalesce(anchor_text, '') order by generated_at, annotation_row) = 1""")
def annotation_merge(spark, d):
    """One note for each place."""
    return translation.annotation_latest(table(spark, d, "annotations")).select("annotation_row", "id", "segment_id", "kind")


@query(f"with {_CURRENT} select annotation_row, case when length(coalesce(anchor_text, '')) = 0 then -1 else instr(coalesce(source_text, ''), anchor_text) - 1 end as at from annotations left join c using (segment_id)")
def excerpt_locate(spark, d):
    """Where each annotation's anchor stands in its segment."""
    return translation.located_anchors(table(spark, d, "annotations"), table(spark, d, "segments"))


_TOKENS = lambda c: f"regexp_extract_all(lower({c}), {q(translation.WORDS)})"


@query(f"""with recursive {_CURRENT}, g as (select array_to_string({_TOKENS('term_en')}, ' ') as term_en, lower(term_vi) as term_vi from glossary where term_en is not null), w as (select segment_id, lower(coalesce(final, '')) as out, {_TOKENS('source_text')} as ws from c where source_text is not null),
  z as (select distinct len(string_split(term_en, ' ')) as n from g where term_en <> ''), e as (select segment_id, out, n, unnest(range(0, len(ws) - n + 1)) as pos, ws from w, z where len(ws) >= n),
  h as (select segment_id, pos, n, term_en, bool_or(contains(out, term_vi)) as used from (select *, array_to_string(ws[pos + 1:pos + n], ' ') as term from e) join g on term = term_en group by all),
  o as (select *, row_number() over (partition by segment_id order by -n, pos) as k from h),
  r as (select segment_id, 0 as k, []::struct(a bigint, b bigint)[] as kept, null::varchar as term_en, null::boolean as used, false as fresh from (select distinct segment_id from o)
    union all select r.segment_id, o.k, case when f then list_append(kept, {{'a': o.pos::bigint, 'b': (o.pos + o.n)::bigint}}) else kept end, o.term_en, o.used, f from r join o on o.segment_id = r.segment_id and o.k = r.k + 1, lateral (select len(list_filter(kept, lambda x: x.a < o.pos + o.n and o.pos < x.b)) = 0 as f))
  select distinct segment_id, term_en, used from r where fresh""")
def glossary_scan(spark, d):
    """Glossary terms of each source and whether the translation uses a rendering of theirs."""
    return translation.glossary_hits(table(spark, d, "segments"), table(spark, d, "glossary"))


@query()
def glossary_lookup(spark, d):
    """Titles of annotations and works' concepts looked up in the glossary."""
    asked = table(spark, d, "works").select(F.explode("concepts").alias("query")).union(table(spark, d, "glossary").select(F.concat("term_en", F.lit("s")))).distinct()
    return matching.glossary_lookup(asked, table(spark, d, "glossary"))


@query()
def inline_spans(spark, d):
    """Inline spans of the samples."""
    return spans.with_spans(table(spark, d, "inline_samples").where("text is not null"), "sample_row", "text")


@query()
def quotation_profile(spark, d):
    """Spans by style."""
    return spans.style_profile(inline_spans(spark, d))


@query()
def inline_expected(spark, d):
    """How many of the expected spans of each sample are found."""
    return spans.expected_found(inline_spans(spark, d), table(spark, d, "inline_samples"))


_BRACKETS = r"\[([^\]\n]+?)\]"


_ROUND = r"[(（]([^()（）\n]+?)[)）]"


def _classes(pattern: str, classes: tuple, counted: str) -> str:
    return f"with b as (select unnest(regexp_extract_all(text, '{pattern}', 1)) as x from inline_samples), s as (select {strip_sql('x')} as b from b) select {shapes.class_sql('b', classes, like)} as style, count(*) as {counted} from s group by 1"


@query(_classes(_BRACKETS, shapes.SQUARE, "brackets"))
def bracket_classes(spark, d):
    """What the square brackets of the samples hold."""
    each = table(spark, d, "inline_samples").select(F.explode(F.regexp_extract_all("text", F.lit(_BRACKETS), F.lit(1))).alias("x"))
    return each.groupBy(shapes.bracket_class(F.col("x")).alias("style")).agg(F.count(F.lit(1)).alias("brackets"))


@query(_classes(_ROUND, shapes.ROUND, "parens"))
def paren_classes(spark, d):
    """What the round brackets of the samples hold."""
    each = table(spark, d, "inline_samples").select(F.explode(F.regexp_extract_all("text", F.lit(_ROUND), F.lit(1))).alias("x"))
    return each.groupBy(shapes.paren_class(F.col("x")).alias("style")).agg(F.count(F.lit(1)).alias("parens"))


@query("select year, case when year between 1 and 3999 then repeat('M', year // 1000) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][(year // 100) % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(year // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][year % 10 + 1] end as roman, year as back from (select distinct year from works where year is not null)")
def roman_numerals(spark, d):
    """Years as Roman numerals and back."""
    years = table(spark, d, "works").where("year is not null").select("year").distinct()
    roman = T.int_to_roman(F.col("year"))
    return years.select("year", roman.alias("roman"), T.roman_to_int(roman).alias("back"))


@query("select doc_id, case when length(text) <= 2000 then text else left(text, 800) || chr(10) || '…' || chr(10) || right(text, 400) end as preview from documents where text is not null")
def head_tail_preview(spark, d):
    """Heads and tails of long documents."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.preview(F.col("text"), 2000, 800, 400).alias("preview"))


@query("""with x as (select seg_row, source_text, draft_raw, 'draft' as side from segments where draft_raw is not null)
  select seg_row, cast(json_extract(to_json({'seg': seg_row, 'n': length(draft_raw)}), '$.n') as bigint) as n, side from x""")
def json_from_answer(spark, d):
    """Objects out of answers that wrap them in fences and talk."""
    seg = table(spark, d, "segments").where("draft_raw is not null")
    answer = F.concat(F.lit("```json\nHere it is: "), F.to_json(F.struct(F.col("seg_row").alias("seg"), F.length("draft_raw").alias("n"))), F.lit("\n```"))
    return translation.parsed_objects(seg.select("seg_row", answer.alias("answer")), "seg_row", "answer", "seg bigint, n bigint").select("seg_row", "value.n", F.lit("draft").alias("side"))


@query("select event_type, date_trunc('hour', ts) as start, count(*) as rows from events group by all")
def event_windows(spark, d):
    """Events by hour and type. An extension: the surveyed system has no event time."""
    return streams.windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("""with e as (select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 59999999 preceding and current row) as recent from events) select event_id, user_id, recent from e where recent > 1""")
def rate_limited(spark, d):
    """Events of users who had another within the minute before."""
    e = table(spark, d, "events")
    return streams.over_rate(e, "user_id", F.col("ts"), 60, 1).select("event_id", "user_id", "recent")


@query("""with g as (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g)
  select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as rows from s group by user_id, n""")
def event_sessions(spark, d):
    """Sessions of users. An extension, as event_windows."""
    return streams.sessions(table(spark, d, "events"), "user_id", "ts")
