"""The pN_ queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.session import table


def _unified(spark: SparkSession, d: str) -> DataFrame:
    """Anchors are quoted from their segments, so the words of those belong to the vocabulary."""
    from quiremill.llm.lookalikes import unify

    each = [table(spark, d, t).select(F.lit(t).alias("table_name"), F.col(key).alias("row_key"), F.col(text).alias("text")) for t, key, text in (("text_lines", "line_id", "text"), ("annotations", "annotation_row", "anchor_text"))]
    rows = each[0].unionByName(each[1])
    return unify(rows, ["table_name", "row_key"], "text", rows.select("text").union(table(spark, d, "segments").select("source_text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d).select("table_name", "row_key")


def p6_usual(spark: SparkSession, d: str) -> DataFrame:
    """The changed rows in their usual form."""
    return _unified(spark, d).where("usual <> text").select("table_name", "row_key", "usual")


def p6_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that mix scripts and of which no reading is a word of the corpus."""
    return _unified(spark, d).select("table_name", "row_key", F.explode("unresolved").alias("token"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from quiremill.llm.language import mislabelled

    return mislabelled(table(spark, d, "documents"), table(spark, d, "works"), table(spark, d, "inline_samples"))


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every work, sample and line with its language and confidence."""
    from quiremill.llm.language import languages

    return languages(table(spark, d, "documents"), table(spark, d, "works"), table(spark, d, "inline_samples"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from quiremill.llm.leaks import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_containment(spark: SparkSession, d: str) -> DataFrame:
    """How much of each leaked item a document is estimated to contain, with the item's size class."""
    from quiremill.llm.leaks import containment

    return containment(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from quiremill.llm.scans import defects

    return defects(table(spark, d, "text_lines"), table(spark, d, "line_labels"), table(spark, d, "works"))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Each work in whole paragraphs."""
    from quiremill.llm.scans import paragraphs

    return paragraphs(table(spark, d, "text_lines"), table(spark, d, "line_labels"), table(spark, d, "works"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from quiremill.llm.bitext import aligned

    return aligned(table(spark, d, "segments"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from quiremill.llm.names import linked_names

    works = table(spark, d, "works")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("name")) for f in ("translator", "work")))).alias("v")
    return linked_names(works.select(each).select("v.*"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from quiremill.llm.cutoff import judged

    return judged(table(spark, d, "segments")).where("cut").select("seg_row", "field_name")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each model's values are cut off, and at what limit."""
    from quiremill.llm.cutoff import cut_rates

    return cut_rates(table(spark, d, "segments"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from quiremill.llm.sitelines import found_lines

    return found_lines(table(spark, d, "text_lines"), table(spark, d, "works"))


def p5_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The maximal blocks of lines that sites repeat."""
    from quiremill.llm.sitelines import repeated_blocks

    return repeated_blocks(table(spark, d, "text_lines"), table(spark, d, "works")).select("depth", "works", "occurrences", "first_line")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each work's lines without those of its site."""
    from quiremill.llm.sitelines import without_site_lines

    kept = without_site_lines(table(spark, d, "text_lines"), table(spark, d, "works"))
    return kept.select("line_id", "work_id", "line_index", "text")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    from quiremill.llm.quality import document_statistics

    return document_statistics(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


#: Where the tokenizers' files lie, and the one that documents are measured with.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    from quiremill.llm.mixing import mixture

    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture really reaches."""
    from quiremill.llm.mixing import reached

    return reached(p9_mixture(spark, d), table(spark, d, "mix_targets"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_paragraphs": p1_paragraphs,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_blocks": p5_blocks,
    "p5_clean": p5_clean,
    "p6_found": p6_found,
    "p6_usual": p6_usual,
    "p6_unresolved": p6_unresolved,
    "p7_found": p7_found,
    "p7_languages": p7_languages,
    "p8_found": p8_found,
    "p8_containment": p8_containment,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

#: Lines of works with their form and site.
_FORMS = r"""
  w as (select work_id, case when gutenberg_id is not null then 'gutenberg' else regexp_replace(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') end as site,
        regexp_replace(lower(coalesce(work, '')), '[^\p{L}]+', '', 'g') as title
        from works qualify row_number() over (partition by work_id order by ingested_at desc, work_row desc) = 1),
  l as (select line_id, work_id, site, title, regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', '', 'g') as k from text_lines join w using (work_id) where site is not null and site <> ''),
  p as (select *, case when title <> '' then instr(k, title) else 0 end as i from l),
  f as (select line_id, work_id, site, i, case when i > 0 then left(k, i - 1) || '#' || substr(k, i + length(title)) else k end as form from p),
  n as (select site, count(distinct work_id) as n from f group by site),
  hit as (select site, form from f where length(form) - (i > 0)::int >= 20 group by site, form
          having count(distinct work_id) >= 3 and count(distinct work_id) >= 0.1 * (select n from n where n.site = f.site))
"""

#: Characters that never are the usual ones, for RE2.
_VARIANT = r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF65}-\x{FF9F}\x{FB00}-\x{FB06}\x{2E80}-\x{2FDF}\x{F900}-\x{FAFF}\x{1D400}-\x{1D7FF}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2010}\x{2011}\x{FE63}\x{FF0D}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
_MIXED = r"\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{Latin}"


def _unusual(t: str, key: str, text: str) -> str:
    return f"select '{t}' as table_name, {key} as row_key from {t} where regexp_matches({text}, '{_VARIANT}') or nfc_normalize({text}) <> {text} or regexp_matches({text}, '{_MIXED}')"


def _runs(t: str, key: str) -> str:
    return rf"""select distinct {key}, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' '))) as g from (select {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as ws from {t}) where len(ws) >= 12"""


SQL: dict[str, str] = {
    "p8_found": f"with d as ({_runs('documents', 'doc_id')}), i as ({_runs('eval_items', 'item_id')}) select distinct doc_id, item_id from d join i using (g)",
    "p6_found": f"{_unusual('text_lines', 'line_id', 'text')} union all {_unusual('annotations', 'annotation_row', 'anchor_text')}",
    "p5_found": f"with {_FORMS} select line_id from f where length(form) - (i > 0)::int >= 20 and (site, form) in (select (site, form) from hit)",
    "p5_clean": f"with {_FORMS} select line_id, work_id, line_index, text from text_lines where line_id not in (select line_id from f where length(form) - (i > 0)::int >= 20 and (site, form) in (select (site, form) from hit))",
}
