"""Queries over lines, blocks and sections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiremill.functions import text as T
from quiremill.operators import blocks, contents, lines, matching, structure
from quiremill.plans.text_queries import like, q, strip_sql, sub
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


def labelled(spark, d):
    return table(spark, d, "text_lines").drop("gutenberg_id").join(table(spark, d, "line_labels"), "line_id")


_S = strip_sql("text")
_LETTERS, _UPPER = f"length({sub(_S, r'[^\p{L}]')})", f"length({sub(_S, r'[^\p{Lu}]')})"
_CAPS = f"(not {like(_S, T.CAPS_YEAR)} and {_LETTERS} >= 8 and length({_S}) < 90 and length({sub(_S, '[^,]')}) < 2 and {_UPPER} * 100 >= {_LETTERS} * 85)"
_HARD = f"({like('text', T.HARD_PLAIN)} or {_CAPS})"
_SHAPE = f"({like(_S, T.ITALIC_LINE)} or ({_LETTERS} >= 8 and {_LETTERS} = {_UPPER}))"
_FLAT = sub(strip_sql("replace(text, '_', ' ')"), r"[\s\p{Z}]+", " ")
_UNIT = f"({like(_FLAT, T.UNIT_HEADING)} or {like(_FLAT, T.NUMBERED_ESSAY)})"
_ROW = f"({like(_S, T.DOT_LEADER)} or ({like(_S, T.SPACED_PAGE)} and length({_S}) < 90))"
_BODY = f"(length({_S}) between 1 and 160 and ({like(_S, T.UNIT_HEADING)} or {like(_S, T.NAMED_FRONT)}) and not {_ROW})"
_KIND = lambda c: f"case when regexp_matches({c}, '^(?:CHAPTER|CHAP)') then 'chapter' when regexp_matches({c}, '^BOOK') then 'book' when regexp_matches({c}, '^(?:PART|VOLUME)') then 'part' when regexp_matches({c}, '^(?:ESSAY|SUB-SECTION|SUBSECTION|SUB SECTION)') then 'chapter' when regexp_matches({c}, '^SECTION') then 'part' when regexp_matches({c}, '^(?:PREFACE|FOREWORD)') then 'preface' when regexp_matches({c}, '^INTRODUCTION') then 'introduction' when regexp_matches({c}, '^PROLOGUE') then 'prologue' when regexp_matches({c}, '^APPENDIX') then 'appendix' when regexp_matches({c}, '^(?:NOTES|INDEX|BIBLIOGRAPHY|GLOSSARY|CATALOGUE|CATALOG|ERRATA|FOOTNOTES)') then 'back_matter' else 'other' end"


def _picked(name: str, condition, sql: str, doc: str) -> None:
    def run(spark, d):
        return table(spark, d, "text_lines").where(condition(F.col("text"))).select("line_id")

    run.__name__, run.__doc__ = name, doc
    query(f"select line_id from text_lines where {sql}")(run)


_picked("hard_structural_lines", T.hard_structural, _HARD, "Lines that can't be joined to the one before.")
_picked("caps_headings", T.caps_heading, _CAPS, "Headings in capitals.")
_picked("wrapped_lines", T.wrapped, f"length(text) >= 55 and not {_HARD}", "Lines that a printer may have wrapped.")
_picked("running_header_shapes", T.running_header_shape, _SHAPE, "Lines in capitals or italics.")
_picked("toc_list_rows", T.contents_row, _ROW, "Rows of a table of contents.")
_picked("toc_entry_lines", T.contents_entry, f"length({_S}) between 1 and 220 and not {like(_S, r'^[*\-–—_=\s]+$')} and ({like(_S, T.UNIT_HEADING)} or {like(_S, r'(?i)^[IVXLC]{1,8}\.?$')} or {like(_S, r'(?i)^SECT\.?\s+[IVXLC\d]+')} or {like(_S, r'^\d+\.\s+\S')} or (({like(_S, T.SPACED_PAGE)} or {like(_S, T.DOT_LEADER)}) and length({_S}) < 90) or (length({_S}) < 140 and {like(_S, T.LIST_RANGE)}))", "Lines that look like contents entries.")
_picked("body_heading_lines", T.body_heading, _BODY, "Lines that begin a section.")


@query(f"select {_KIND(f'upper({_S})')} as kind, count(*) as lines from text_lines where {_UNIT} group by 1")
def toc_label_kinds(spark, d):
    """Unit headings by kind."""
    return table(spark, d, "text_lines").where(T.unit_heading(F.col("text"))).groupBy(T.contents_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


@query(r"""with s as (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as ls from documents where text is not null), e as (select doc_id, unnest(ls) as raw, generate_subscripts(ls, 1) as n from s),
  o as (select *, regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as t, sum(length(raw) + 1) over (partition by doc_id order by n) - length(raw) - 1 as pos from e), b as (select *, coalesce(lag(t = '') over (partition by doc_id order by n), true) as blank from o)
  select doc_id, row_number() over (partition by doc_id order by n) - 1 as line_index, t as text, cast(pos as bigint) as start_char, cast(pos + length(raw) as bigint) as end_char, blank as blank_before, length(raw) - length(ltrim(raw, ' ')) as indent from b where t <> '' and not regexp_matches(t, '^[\x{200B}\x{FEFF}\x{2060}]+$')""")
def line_table(spark, d):
    """The documents' lines with offsets."""
    return lines.line_table(table(spark, d, "documents"), "doc_id")


@query(f"""with k as (select work_id, trim({sub(sub(f'upper({_FLAT})', T.PAGE_TAIL), '^[ .]+|[ .]+$')}) as heading from text_lines where length(text) < 90 and {_SHAPE} and not {_UNIT})
  select work_id, heading, count(*) as times from k where heading <> '' group by all having count(*) >= 3""")
def running_header_keys(spark, d):
    """Headings that come again and again in a work."""
    return lines.running_headers(table(spark, d, "text_lines"), "work_id")


@query("""with x as (select work_id, line_index, row_number() over (partition by work_id order by line_index) as n, coalesce(confidence, 1) < 0.8 or role = 'verse_line' as low from text_lines join line_labels using (line_id)),
  f as (select *, case when n > lag(n) over (partition by work_id order by line_index) + 2 or lag(n) over (partition by work_id order by line_index) is null then 1 else 0 end as fresh from x where low), g as (select *, sum(fresh) over (partition by work_id order by line_index rows unbounded preceding) as g from f)
  select work_id, min(line_index) as first_line, max(line_index) as last_line from g group by work_id, g""")
def uncertain_ranges(spark, d):
    """Stretches of lines to be looked at again."""
    return lines.uncertain_ranges(labelled(spark, d), "work_id", "line_index")


@query("""with x as (select work_id, line_index, text, blank_before, role = 'prose' and indent >= 2 as p from text_lines join line_labels using (line_id)), i as (select *, sum(case when p and not coalesce(lag_p, false) then 1 else 0 end) over (partition by work_id order by line_index rows unbounded preceding) as island from (select *, lag(p) over (partition by work_id order by line_index) as lag_p from x)),
  r as (select *, sum(case when blank_before then 1 else 0 end) over (partition by work_id order by line_index rows unbounded preceding) as part from i where p),
  g as (select work_id, min(line_index) as first_line, count(*) as lines, case when bool_or(length(text) > 85 or contains(text, '{') or regexp_matches(text, '(?i)\\b(?:CHAPTER|ACT|SCENE|BOOK)\\b')) then 0.0 else avg(case when regexp_matches(text, '\\[\\d+\\]$') or (regexp_matches(text, '[,;!?]$') and length(text) < 75) then 1.0 else 0.0 end) end as score from r group by work_id, island, part)
  select work_id, first_line, lines, score from g where lines >= 1 and score >= 0.45""".replace("\\\\", "\\"))
def verse_runs(spark, d):
    """Runs of indented lines that read as verse; a run may be one line here, as the paragraphs' first lines are all that is indented."""
    return lines.verse_runs(labelled(spark, d), "work_id", least=1)


def _evidence_sql() -> str:
    """before, nxt, gap and g to forbidding and speaking reasons, the first of each."""
    p, n, b = "rtrim(before)", "trim(nxt)", "trim(before)"
    ended = f"({like(p, T.SENTENCE_END)} and not {like(p, T.ABBREVIATED)})"
    begins, hanging = like(n, T.CONTINUATION), f"({like(p, T.HANGING)} and not {ended})"

    def imprint(c: str) -> str:
        s, letters, caps = strip_sql(c), f"length({sub(strip_sql(c), '[^A-Za-z]')})", f"length({sub(strip_sql(c), '[^A-Z]')})"
        return f"({s} <> '' and ({like(s, T.IMPRINT)} or {like(s, T.ROMAN_YEAR)} or (length({sub(s, '[^,]')}) >= 3 and length({s}) >= 30 and {letters} >= 12 and {caps} * 10 >= {letters} * 7)))"

    hard = _HARD.replace("text", "nxt")
    forbids = {
        "blank": f"gap and not {hanging} and not (g and ({imprint(p)} or {imprint(n)}))", "structure": hard, "rule": like(n, T.RULE), "lead in": like(n, T.LEAD_IN), "closed quote": like(b, T.CLOSED_QUOTE),
    }
    speaks = {
        "hanging across a blank": f"gap and {hanging} and {like(n, '^[A-Za-z(' + chr(92) + '[' + chr(34) + ']')}", "imprint": f"g and {imprint(p)} and ({imprint(n)} or {like(n, '^(?:AND|and) ')})",
        "quotation": f"{like(b, T.OPENED_QUOTE)} and ({like(n, '^' + chr(92) + 'p{Ll}')} or {like(b, T.OPEN_END)}) and (not {like(b, T.SENTENCE_END)} or {like(b, T.OPEN_END)})",
        "hanging word": f"{hanging} and length(before) >= 55", "hyphen": f"{p} like '%-' and {like(n, '^' + chr(92) + 'p{Ll}')}", "continuation": f"{begins} and not {ended}", "wrapped": f"length({p}) >= 55 and not {ended} and {like(n, '^[A-Z]')} and not {like(n, T.NEW_UNIT)}",
        "open clause": f"{like(p, '(?:[,;]|--)$')} and {begins}", "colon": f"{p} like '%:' and {like(n, '^[' + chr(34) + '“_«]')}", "open bracket": f"{like(p, T.OPEN_BRACKET)} and {like(n, T.BRACKET_REST)}",
        "default": f"not gap and g and (length({p}) >= 40 or not {ended})",
    }
    first = lambda named: "case " + " ".join(f"when {c} then '{k}'" for k, c in named.items()) + " end"
    return f"{first(forbids)} as no, {first(speaks)} as yes"


_JOINS = f"""n as (select line_id, work_id, line_index, coalesce(text, '') as before, gutenberg_id is not null as g, lead(coalesce(text, '')) over w as nxt, coalesce(lead(blank_before) over w, false) as gap, lead(line_index) over w as after from text_lines window w as (partition by work_id order by line_index)),
  e as (select line_id, work_id, line_index, {_evidence_sql()} from n where after is not null), j as (select line_id, work_id, line_index, no is null and yes is not null as join_next, coalesce(no, yes, 'ended') as why from e)"""


def _decided(spark, d):
    rows = table(spark, d, "text_lines")
    ids = rows.select("work_id", "line_index", "line_id")
    return lines.join_decisions(rows, "work_id", F.col("gutenberg_id").isNotNull()).join(ids, ["work_id", "line_index"])


@query(f"with {_JOINS} select work_id, line_index, join_next, why from j")
def join_decisions(spark, d):
    """Whether each line goes on in the next."""
    return lines.join_decisions(table(spark, d, "text_lines"), "work_id", F.col("gutenberg_id").isNotNull())


@query(f"with {_JOINS} select why, j.join_next, l.join_next as parser_join, count(*) as pairs, count(*) filter (where j.join_next <> l.join_next) as disagree from j join line_labels l using (line_id) where l.join_next is not null group by all")
def wrap_review(spark, d):
    """How the rules and the parser's labels agree on joins, by reason."""
    return lines.wrap_review(_decided(spark, d), table(spark, d, "line_labels").select("line_id", F.col("join_next").alias("parser_join")))


@query(f"with {_JOINS} select line_id, why, j.join_next as rule_join, l.join_next as parser_join, confidence, coalesce(j.join_next <> l.join_next, false) or coalesce(confidence, 1.0) < 0.8 as suspect from j join line_labels l using (line_id)")
def suspect_wraps(spark, d):
    """Each pair of lines with the rules' and the parser's answer."""
    return lines.suspect_wraps(_decided(spark, d), table(spark, d, "line_labels").select("line_id", F.col("join_next").alias("parser_join"), "confidence"))


@query()
def reflow(spark, d):
    """The documents' lines joined where they were wrapped."""
    return lines.reflowed(lines.line_table(table(spark, d, "documents"), "doc_id"), "doc_id")


_BLOCKS = """x as (select *, lag(role) over w as lr, lag(join_next) over w as lj from text_lines join line_labels using (line_id) window w as (partition by work_id order by line_index)),
  y as (select *, coalesce(lr = role and ((role in ('prose', 'heading') and coalesce(lj, false)) or (role = 'verse_line' and not blank_before)), false) as go from x),
  z as (select *, sum(case when go then 0 else 1 end) over (partition by work_id order by line_index rows unbounded preceding) as block, case when lead(go) over w then lead(text) over w end as nxt from y window w as (partition by work_id order by line_index)),
  p as (select *, case when nxt is null then text when role = 'verse_line' and not coalesce(join_next, false) then text || chr(10) when text like '%-' and regexp_matches(nxt, '^\\p{Ll}') then left(text, length(text) - 1) else text || ' ' end as piece from z),
  b0 as (select work_id, block, min_by(role, line_index) as role, max(level) as level, count(*) as lines, string_agg(piece, '' order by line_index) as text from p group by work_id, block),
  b as (select work_id, block, case when role = 'heading' then 'heading' when role = 'verse_line' and regexp_matches(trim(text), '^["“«_]') then 'blockquote' when role = 'verse_line' then 'stanza' else 'paragraph' end as type, level, lines, text from b0)"""


def _blocks(spark, d):
    return blocks.from_labels(labelled(spark, d), "work_id").drop("speaker")


@query(f"with {_BLOCKS} select work_id, block, type, level, lines, text from b")
def labels_to_blocks(spark, d):
    """Blocks from labelled lines, stanzas among them."""
    return _blocks(spark, d)


@query(f"""with {_BLOCKS}, h as (select *, type = 'heading' and level <= 2 as h from b), g as (select *, sum(case when h and coalesce(lh, false) and length(text) <= 90 and not ({like('text', blocks.ACT)} or {like('text', blocks.SCENE)} or {like('text', blocks.ARTICLE)} or {like('lt', blocks.ARTICLE)}) then 0 else 1 end) over (partition by work_id order by block rows unbounded preceding) as g from (select *, lag(h) over w as lh, lag(text) over w as lt from h window w as (partition by work_id order by block)))
  select work_id, min(block) as block, min_by(type, block) as type, min(level) as level, string_agg(text, ' ' order by block) as text from g group by work_id, g""")
def merged_headings(spark, d):
    """Blocks with neighbouring headings made one."""
    return blocks.merged_headings(_blocks(spark, d), "work_id").drop("lines")


@query(rf"""with {_BLOCKS}, s as (select *, regexp_replace(regexp_replace(lower({sub(strip_sql('text'), r'[\s\p{Z}]+', ' ')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as raw from b), k as (select *, case when raw = '' then 'empty' else left(raw, 48) end as slug from s),
  n as (select *, row_number() over (partition by work_id, type, slug order by block) as n from k) select work_id, block, 'book:' || type || ':' || slug || case when n > 1 then '-' || n else '' end as block_id from n""")
def block_ids(spark, d):
    """Ids of blocks."""
    return blocks.block_ids(_blocks(spark, d), "work_id").select("work_id", "block", "block_id")


@query(f"""with {_BLOCKS}, m as (select work_id, count(*) as blocks, case when bool_or(type = 'stanza') and not bool_or(type = 'paragraph') then 'verse' when bool_or(type = 'stanza') then 'mixed' else 'prose' end as content_kind, coalesce(string_agg(case when type = 'blockquote' then '> ' else '' end || trim(text), chr(10) || chr(10) order by block) filter (where trim(text) <> ''), '') as markdown,
  to_json(list(struct_pack(level := level, text := text, type := type) order by block)) as canonical from b group by work_id) select work_id, blocks, content_kind, length(markdown) as chars, sha256(canonical) as hash from m""")
def edition_markdown(spark, d):
    """Each work's blocks as one text, with its kind and hash."""
    return blocks.markdown(_blocks(spark, d), "work_id").select("work_id", "blocks", "content_kind", F.length("markdown").alias("chars"), "hash")


_SECTIONS = f"""h as (select work_id, line_index, start_char, end_char, text, {_BODY} as head from text_lines), n as (select *, sum(case when head then 1 else 0 end) over (partition by work_id order by line_index rows unbounded preceding) as section from h),
  g as (select work_id, section, min_by(text, line_index) as title, min_by(head, line_index) as headed, min(start_char) as start_char, max(end_char) as last_char, count(*) as lines from n group by all),
  s as (select work_id, section, case when headed then {_KIND("upper(title)")} when count(*) over (partition by work_id) = 1 then 'chapter' else 'front_matter' end as kind, case when headed then title else '' end as title, start_char, greatest(coalesce(lead(start_char) over (partition by work_id order by section), last_char) - 1, start_char) as end_char, lines from g)"""


@query(f"with {_SECTIONS} select * from s")
def sections(spark, d):
    """Sections of the works."""
    return structure.sections(table(spark, d, "text_lines"), "work_id")


@query(f"""with {_SECTIONS}, e as (select *, sum(case when kind in ('front_matter', 'back_matter', 'notes') then 1 else 0 end) over (partition by work_id order by section rows unbounded preceding) as era from s),
  b as (select *, last_value(case when kind = 'book' then section end ignore nulls) over (partition by work_id, era order by section rows unbounded preceding) as book from e),
  p as (select *, last_value(case when kind = 'part' then section end ignore nulls) over (partition by work_id, era, book order by section rows unbounded preceding) as part from b)
  select work_id, section, case when kind = 'part' then book when kind = 'chapter' then coalesce(part, book) end as parent from p""")
def container_parents(spark, d):
    """What book or part each section lies in."""
    return structure.with_parents(structure.sections(table(spark, d, "text_lines"), "work_id"), "work_id").select("work_id", "section", "parent")


_TOTALS = "t as (select work_id, max(end_char) as n from text_lines group by 1)"


@query(f"""with {_TOTALS}, r as (select *, coalesce(max(end_char - 1) over (partition by work_id order by start_char, end_char - 1 rows between unbounded preceding and 1 preceding), -1) as reach from text_lines),
  p as (select work_id, count(*) filter (where start_char - reach - 1 > 0) as g, sum(greatest(0, start_char - reach - 1)) as o, count(*) filter (where start_char <= reach) as laps, max(end_char - 1) as final_char from r group by 1)
  select work_id, g + (case when n - 1 - final_char > 0 then 1 else 0 end) as gaps, laps as "overlaps", cast(o + greatest(0, n - 1 - final_char) as bigint) as orphans from t join p using (work_id)""")
def coverage(spark, d):
    """Gaps and overlaps of the works' lines over their texts."""
    t = table(spark, d, "text_lines")
    return structure.coverage(t.select("work_id", "start_char", (F.col("end_char") - 1).alias("end_char")), t.groupBy("work_id").agg(F.max("end_char").alias("n")), "work_id")


@query(f"""with {_SECTIONS} select l.work_id, s.section, l.line_index, l.text from text_lines l join line_labels using (line_id) join s on s.work_id = l.work_id and l.start_char between s.start_char and s.end_char and l.start_char > s.start_char where role = 'heading'""")
def inner_headings(spark, d):
    """Headings inside sections."""
    heads = labelled(spark, d).where("role = 'heading'").select("work_id", "line_index", "start_char", "text")
    return structure.inner_headings(heads, structure.sections(table(spark, d, "text_lines"), "work_id"), "work_id")


@query("""with r as (select work_id, start_char, end_char, max(end_char) over (partition by work_id order by start_char, end_char rows between unbounded preceding and 1 preceding) as reach from text_lines join line_labels using (line_id) where role = 'prose' and end_char > start_char),
  g as (select *, sum(case when reach is null or start_char > reach + 1 then 1 else 0 end) over (partition by work_id order by start_char, end_char rows unbounded preceding) as g from r) select work_id, min(start_char) as start_char, max(end_char) + 1 as end_char from g group by work_id, g""")
def range_merge(spark, d):
    """Ranges of prose, with the line ends between them, merged."""
    r = labelled(spark, d).where("role = 'prose' and end_char > start_char").select("work_id", "start_char", (F.col("end_char") + 1).alias("end_char"))
    return structure.merged_ranges(r, "work_id")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null)
  select doc_id, string_agg(raw, chr(10) order by n) as text from l where not regexp_matches(raw, '^(?:CHAPTER|CHƯƠNG|CHAPITRE) ') or n = 0 group by 1""")
def drop_spans(spark, d):
    """The documents without their chapter lines: what the spans cover is cut out."""
    docs = table(spark, d, "documents").where("text is not null")
    at = lines.line_table(docs, "doc_id").where(F.col("text").rlike("^(?:CHAPTER|CHƯƠNG|CHAPITRE) "))
    kept = structure.dropped(docs.select("doc_id", "text"), at.select("doc_id", "start_char", (F.col("end_char") + 1).alias("end_char")), "doc_id")
    return kept.where("text <> ''")


@query(f"""with k as (select work_id, {_KIND(f'upper({_S})')} as kind from text_lines where {_BODY}), c as (select work_id, count(*) filter (where kind = 'chapter') as chapter, count(*) filter (where kind = 'book') as book, count(*) filter (where kind = 'part') as part from k group by 1)
  select *, case when chapter >= 2 then 'chapter' when book >= 2 then 'book' when part >= 2 then 'part' when chapter >= 1 then 'chapter' when book >= 1 then 'book' else 'none' end as level from c""")
def division_level(spark, d):
    """How each work is divided."""
    return structure.division_level(structure.heading_lines(table(spark, d, "text_lines"), "work_id"), "work_id")


@query()
def toc_runs(spark, d):
    """Tables of contents in the documents."""
    return contents.contents_runs(lines.line_table(table(spark, d, "documents"), "doc_id"), "doc_id")


@query()
def stub_chapters(spark, d):
    """Chapter lines of the documents that are only rows of contents."""
    return contents.stub_chapters(lines.line_table(table(spark, d, "documents"), "doc_id"), "doc_id")


@query()
def toc_match(spark, d):
    """Headings of the works as contents entries, found again in the body in order."""
    entries = labelled(spark, d).where("role = 'heading' and level >= 1").select("work_id", F.col("line_index").alias("entry"), F.col("text").alias("label"))
    return contents.match_contents(table(spark, d, "text_lines"), entries, "work_id")


@query(rf"""with l as (select distinct work_id, {sub(sub('lower(text)', '[^a-z0-9]+', ' '), '^ +| +$')} as label from text_lines join line_labels using (line_id) where role = 'heading'), w as (select distinct work_id, {sub(sub('lower(work)', '[^a-z0-9]+', ' '), '^ +| +$')} as title from works where work is not null),
  s as (select w.work_id, title, label, case when title = label then 1.0 when contains(' ' || label || ' ', ' ' || title || ' ') or contains(' ' || title || ' ', ' ' || label || ' ') then greatest(least(length(title), length(label)) / greatest(length(title), length(label)), 0.8) end as score from w join l using (work_id) where length(title) >= 4 and length(label) >= 4)
  select work_id, title, label, round(score, 3) as score from s where score is not null qualify row_number() over (partition by work_id, title order by round(score, 3) desc, label) = 1""")
def fuzzy_titles(spark, d):
    """The heading that repeats each work's title best."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    heads = labelled(spark, d).where("role = 'heading'").select("work_id", fold("text").alias("label")).distinct()
    titles = table(spark, d, "works").where("work is not null").select("work_id", fold("work").alias("title")).distinct()
    return matching.title_scores(titles, heads, "work_id")


@query(f"with {_BLOCKS} select work_id, block, case when type = 'heading' then 'x' || block else text end as text, type = 'heading' as hidden from b")
def patch_blocks(spark, d):
    """Blocks with a log of edits applied: two edits of every heading, of which the last of each field holds."""
    b = blocks.block_ids(_blocks(spark, d), "work_id")
    some = b.where("type = 'heading'")
    log = some.select("work_id", "block_id", F.lit(1).alias("seq"), F.lit("first").alias("text"), F.lit(True).alias("hidden")).unionByName(some.select("work_id", "block_id", F.lit(2).alias("seq"), F.concat(F.lit("x"), F.col("block")).alias("text"), F.lit(None).cast("boolean").alias("hidden")))
    return blocks.patched(b, log, "work_id").select("work_id", "block", "text", "hidden")


@query("select work_id, line_index, row_number() over (partition by work_id order by coalesce(confidence, -1) desc, line_index) as place from text_lines join line_labels using (line_id) where role = 'heading' qualify place <= 500")
def heading_candidates(spark, d):
    """The first 500 candidates for headings of each work, those of the greatest confidence, then in order: as many as a reviewer is given."""
    return structure.prioritised(labelled(spark, d).where("role = 'heading'"), "work_id", "line_index", "confidence", 500)


@query("""select work_id, line_index, confidence from text_lines join line_labels using (line_id) where role = 'heading'""")
def heading_candidate_lines(spark, d):
    """All candidates for headings with their confidence, however many a work has."""
    return labelled(spark, d).where("role = 'heading'").select("work_id", "line_index", "confidence")
