"""One form for text that looks the same (problem 6): script-aware repair.

A row goes through three steps: invisible characters leave, letters and digits take their usual
width and shape and composed accents, spaces and hyphens become plain ones; then each token that
mixes scripts gets a dominant script, and its letters of other scripts are replaced by look-alikes
of that script, or else of another script that the token has, if the word that results is in the
vocabulary of the corpus. A mixed token of which no reading is in the vocabulary is left as it is and
reported as unresolved: nothing tells what was meant. The candidates' hashes make a bitmap of bounded
size, so that the corpus is read once and only words that may be asked for leave the scan.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm.tables import Bitmap, bitmap, cut_table
from quiremill.llm.words import hash_words, split_words

# Cyrillic and Greek letters and the Latin letters they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x", "г": "r", "п": "n", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԝ": "W", "Ԛ": "Q",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "η": "n", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}

#: Width and shape variants: full-width letters and digits, half-width kana, ligatures, CJK radicals
#: and compatibility ideographs, mathematical letters.
VARIANTS = r"\uFF10-\uFF19\uFF21-\uFF3A\uFF41-\uFF5A\uFF65-\uFF9F\uFB00-\uFB06\u2E80-\u2FDF\uF900-\uFAFF\U0001D400-\U0001D7FF"
SPACES = r"\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
HYPHENS = r"\u2010\u2011\uFE63\uFF0D"
INVISIBLE = r"\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFE00-\uFE0F\uFEFF"
OTHER_SCRIPTS = r"\u0370-\u03FF\u1F00-\u1FFF\u0400-\u052F"
#: A row without any of these is in its usual form.
SUSPECT = rf"[\u0300-\u036F\u3099\u309A{VARIANTS}{SPACES}{HYPHENS}{INVISIBLE}{OTHER_SCRIPTS}]"

#: Scripts that are mixed by look-alikes, in the order in which ties are decided.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
_INVISIBLE, _SPACES, _HYPHENS, _VARIANTS = (re.compile(f"[{x}]+") for x in (INVISIBLE, SPACES, HYPHENS, VARIANTS))
_TOKEN = re.compile(r"[^\W\d_]+")


def for_java(pattern: str) -> str:
    """The same class for Java's regular expressions, which write code points above the BMP another way."""
    return re.sub(r"\\U000([0-9A-F]{5})", r"\\x{\1}", pattern)


@lru_cache(1 << 16)
def script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ", 1)[0]


def plain(text: str) -> str:
    """The first step: everything but mixed scripts."""
    text = _INVISIBLE.sub("", text)
    text = _VARIANTS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = _HYPHENS.sub("-", _SPACES.sub(lambda m: " " * len(m[0]), text))
    return unicodedata.normalize("NFC", text)


def candidates(token: str) -> list[str]:
    """The token in its dominant script, then in the others that it has, where every letter has a look-alike; none if it has one script only."""
    scripts = [script(c) for c in token]
    kinds = set(scripts) & set(SCRIPTS)
    if len(kinds) < 2:
        return []
    out = []
    for main in sorted(kinds, key=lambda k: (-scripts.count(k), SCRIPTS.index(k))):
        back = _backwards(main)
        letters = [c if s == main or s not in SCRIPTS else LOOKALIKES.get(c, c) if main == "LATIN" else back.get(LOOKALIKES.get(c, c), "") for c, s in zip(token, scripts)]
        if all(letters) and (main != "LATIN" or all(script(c) not in ("CYRILLIC", "GREEK") for c in letters)):
            out.append("".join(letters))
    return out


@lru_cache
def _backwards(kind: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in LOOKALIKES.items():
        if script(k) == kind:
            out.setdefault(v, k)
    return out


def repair(text: str, known: dict[str, str] | None) -> str:
    """The usual form; known maps mixed tokens to what replaces them."""
    text = plain(text)
    return _TOKEN.sub(lambda m: known.get(m[0], m[0]), text) if known else text


def _mixed(keys: list[str]):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*k, t, w) for *k, text in zip(*(b[c] for c in keys), b["text"]) for t in sorted(set(_TOKEN.findall(plain(text)))) if (w := _asked(t)) is not None]
            yield pd.DataFrame(rows, columns=[*keys, "token", "words"])

    return over


@lru_cache(1 << 14)
def _asked(token: str) -> list[str] | None:
    """The candidates of a token that mixes scripts, maybe none; None for any other token."""
    return candidates(token) if len({script(c) for c in token} & set(SCRIPTS)) > 1 else None


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(hash_words(b.column(0)).view(np.int64))], names=["hash"])


def _vocabulary(asked: Bitmap):
    """A mapInArrow function: texts to those of their words that the bitmap may have."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = split_words(b.column(0))[0].dictionary_encode()
            words = flat.combine_chunks().dictionary if isinstance(flat, pa.ChunkedArray) else flat.dictionary
            yield pa.RecordBatch.from_arrays([words.filter(pa.array(asked.has(hash_words(words))))], names=["low"])

    return over


def _repaired(keys: list[str]):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["usual"] = [repair(t, dict(k) if k is not None else None) for t, k in zip(b["text"], b["known"])]
            yield b[[*keys, "text", "usual", "unresolved"]]

    return over


def unify(rows: DataFrame, keys: list[str], text: str, corpus: DataFrame | None = None) -> DataFrame:
    """The keys, text, usual and unresolved (tokens that stay mixed) of the rows whose text isn't in its usual form.

    corpus: one column of texts whose words are the vocabulary, the rows' own if there is none. Null
    texts and empty texts are in their usual form. Two rows of one key are each repaired, tokens of
    both being known to both.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    all_rows = rows.select(*keys, F.col(text).alias("text")).where("text is not null")
    texts = all_rows.select("text") if corpus is None else corpus.select(F.col(corpus.columns[0]).alias("text")).where("text is not null")
    # Texts of ASCII alone are in their usual form; that is cheaper to see than by pattern.
    suspects = cut_table(all_rows.where((F.octet_length("text") > F.char_length("text")) & F.col("text").rlike(for_java(SUSPECT))))
    mixed = cut_table(suspects.where(F.col("text").rlike(f"[{OTHER_SCRIPTS}]")).mapInPandas(_mixed(keys), f"{schema}, token string, words array<string>"))
    asked = mixed.select("token", "words").distinct().select("token", F.posexplode("words").alias("place", "word")).withColumn("low", F.lower("word"))
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap(asked.select("low").distinct().mapInArrow(_hashed, "hash bigint")))
    vocabulary = texts.mapInArrow(lambda it: _vocabulary(wanted.value)(it), "low string").distinct()
    accepted = asked.join(vocabulary, "low").groupBy("token").agg(F.min_by("word", "place").alias("word"))
    told = mixed.select(*keys, "token").join(accepted, "token", "left")
    pair = F.struct("token", "word")
    known = told.groupBy(*keys).agg(F.map_from_entries(F.array_distinct(F.array_compact(F.collect_list(F.when(F.col("word").isNotNull(), pair))))).alias("known"), F.array_sort(F.collect_set(F.when(F.col("word").isNull(), F.col("token")))).alias("unresolved"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = suspects.alias("a").join(known.alias("b"), same, "left").select(*(F.col(f"a.{k}").alias(k) for k in keys), "a.text", "b.known", F.coalesce("b.unresolved", F.array().cast("array<string>")).alias("unresolved"))
    out = both.mapInPandas(_repaired(keys), f"{schema}, text string, usual string, unresolved array<string>")
    return out.where((F.col("usual") != F.col("text")) | (F.size("unresolved") > 0))
