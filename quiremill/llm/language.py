"""Languages of documents, works and lines (problem 7): hyperdimensional profiles.

Every symbol has a random vector of +1 and -1. An n-gram binds its symbols' vectors, each permuted
by its place, by multiplication; a text bundles its n-grams by addition, and so does a language with
the texts of its sample. A text's language is that of the prototype with the greatest cosine. The
texts' own norms are the same for all prototypes, so a text needs only the products of its n-grams
with the prototypes, and those are worked out once for every n-gram there can be.

Each language has two prototypes, one of them of texts whose accents were left out, as some writers
leave them out. The labels of the sample may be wrong at places: prototypes are bundled by label
first and then again by the language that the first ones give.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiremill.llm import codes as C
from quiremill.session import spread

LANGUAGES = ("en", "vi", "fr", "ja")
#: Other ways of writing the labels, before any region.
SPELLINGS = {"eng": "en", "english": "en", "vie": "vi", "vietnamese": "vi", "fra": "fr", "fre": "fr", "french": "fr", "jpn": "ja", "japanese": "ja", "jp": "ja", "vn": "vi"}
SYMBOLS = 64
WIDTH = 3
DIMENSIONS = 2048
SEED = 20240229
#: Documents that the prototypes are bundled from, about; a bound that doesn't grow with the corpus.
SAMPLE = 4000


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """A symbol for each code point of the BMP: 0 for all but letters, then letters, letters with
    marks by base and kind of mark, and one symbol for each other script."""
    out = np.zeros(C.SIZE, np.uint8)
    marks = {"̂": 0, "̆": 1, "̛": 2, "̀": 3, "́": 3, "̉": 4, "̃": 4, "̣": 4, "̧": 5, "̈": 6}
    shapes: dict[tuple[str, int], int] = {}
    for i in range(0x41, 0x2000):
        c = chr(i)
        if not unicodedata.name(c, "").startswith("LATIN") or not c.isalpha():
            continue
        parts = unicodedata.normalize("NFD", c.lower())
        base = parts[0]
        if "a" <= base <= "z":
            kinds = [marks.get(m, 6) for m in parts[1:]]
            out[i] = 1 + ord(base) - 97 if not kinds else 27 + shapes.setdefault((base if base in "aeiouy" else "x", max(kinds)), len(shapes)) % (SYMBOLS - 33)
        else:
            out[i] = {"đ": 58, "œ": 59, "æ": 59}.get(c.lower(), 60)
    out[0x3041:0x30A0], out[0x30A0:0x3100], out[0x3400:0xA000], out[0x3005] = 61, 62, 63, 63
    out[0x370:0x530] = 60
    return out


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSIONS))


def bundle(counts: np.ndarray) -> np.ndarray:
    """The unit vector that bundles n-grams by their counts, counts[a, b, c] for the symbols a, b, c in order."""
    v = letter_vectors()
    inner = counts.reshape(-1, SYMBOLS) @ v.astype(np.float64)
    inner = (inner.reshape(SYMBOLS, SYMBOLS, DIMENSIONS) * np.roll(v, 1, axis=1)[None]).sum(axis=1)
    total = (inner * np.roll(v, 2, axis=1)).sum(axis=0)
    return (total / max(float(np.linalg.norm(total)), 1e-9)).astype(np.float32)


def products(prototypes: np.ndarray) -> np.ndarray:
    """The product of every n-gram's vector with every prototype, over the n-gram's norm."""
    v = letter_vectors()
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    out = np.empty((SYMBOLS**WIDTH, len(prototypes)), np.float32)
    for k, p in enumerate(prototypes):
        out[:, k] = ((first[:, None] * second[None] * p).reshape(-1, DIMENSIONS) @ v.T).reshape(-1) / np.sqrt(DIMENSIONS)
    return out


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that have no two blanks in a row, and where each begins."""
    s = symbol_table()[np.minimum(codes, C.SIZE - 1)].astype(np.int32)
    if len(s) < WIDTH:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    gram = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
    at = np.flatnonzero(((s[:-2] > 0) | (s[1:-1] > 0)) & ((s[1:-1] > 0) | (s[2:] > 0)))
    return gram[at], at


def unbroken(text: str) -> str:
    """UTF-8 that was read as a one-byte encoding, read again; other texts as they are."""
    if "Ã" in text or "á»" in text or "áº" in text or "ã\x81" in text or "ã\x82" in text:
        for encoding in ("latin-1", "cp1252"):
            try:
                return text.encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
    return text


def scores(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text and prototype the sum over its n-grams, and the number of n-grams."""
    out, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for a, b in C.pieces(texts):
        codes, starts = C.encode([unbroken(t) for t in texts[a:b]])
        gram, at = grams(codes)
        bounds = np.searchsorted(at, starts)
        n[a:b] = np.diff(bounds)
        for k in range(table.shape[1]):
            sums = np.concatenate([[0.0], np.cumsum(table[gram, k], dtype=np.float64)])
            out[a:b, k] = sums[bounds[1:]] - sums[bounds[:-1]]
    return out, n


def stripped(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")


def label_of(c: Column) -> Column:
    """The language that a label names, whatever way it is written; null for none."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1)
    known = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return F.when(base.isin("", "und"), None).otherwise(F.coalesce(F.try_element_at(known, base), base))


def fit_prototypes(documents: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The table of products for the prototypes of LANGUAGES, with accents and then without."""
    labelled = documents.select("doc_id", "text", label_of(F.col("lang")).alias("lang")).where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    n = labelled.count()
    part = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1)))).select("text", "lang")

    def counted(table: np.ndarray | None):
        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2 * len(LANGUAGES), SYMBOLS**WIDTH), np.int64)
            for b in batches:
                texts = b["text"].tolist()
                lang = [LANGUAGES.index(x) for x in b["lang"]]
                if table is not None:
                    s, _ = scores(texts, table)
                    lang = np.maximum(s[:, : len(LANGUAGES)], s[:, len(LANGUAGES) :]).argmax(axis=1)
                for t, k in zip(texts, lang):
                    t = unbroken(t)
                    for row, x in ((k, t), (k + len(LANGUAGES), stripped(t))):
                        gram, _ = grams(C.encode([x])[0])
                        np.add.at(total[row], gram, 1)
            row, gram = np.nonzero(total)
            yield pd.DataFrame({"proto": row, "gram": gram, "n": total[row, gram]})

        return over

    table = None
    for _ in range(2):
        rows = part.mapInPandas(counted(table), "proto int, gram int, n bigint").groupBy("proto", "gram").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((2 * len(LANGUAGES), SYMBOLS**WIDTH))
        counts[rows["proto"], rows["gram"]] = rows["n"]
        table = products(np.stack([bundle(c) for c in counts]))
    return table


def text_scores(rows: DataFrame, table: np.ndarray, text: str) -> DataFrame:
    """The rows without their text, with grams and the score of each language, summed over the n-grams."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    keep = [f for f in rows.schema.fields if f.name != text]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s, n = scores(b[text].tolist(), shared.value)
            best = np.maximum(s[:, : len(LANGUAGES)], s[:, len(LANGUAGES) :])
            out = b.drop(columns=[text])
            out["grams"] = n
            for k, lang in enumerate(LANGUAGES):
                out[lang] = best[:, k]
            yield out

    return rows.mapInPandas(over, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "grams bigint", *(f"{x} double" for x in LANGUAGES)]))


def decide(scored: DataFrame, sharpness: float = 12.0) -> DataFrame:
    """The best language, null without n-grams, and its confidence: a softmax over the scores by
    n-gram, as sharp as the root of their number allows."""
    best = F.greatest(*LANGUAGES)
    lang = F.when(F.col("grams") > 0, F.coalesce(*[F.when(F.col(x) == best, F.lit(x)) for x in LANGUAGES]))
    mean = lambda x: F.exp((F.col(x) - best) / F.col("grams") * F.sqrt("grams") * sharpness)
    confidence = F.when(F.col("grams") > 0, 1.0 / sum((mean(x) for x in LANGUAGES), F.lit(0.0)))
    return scored.withColumns({"detected": lang, "confidence": confidence}).drop("grams", *LANGUAGES)


def languages(documents: DataFrame, works: DataFrame, samples: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """record_type, record_key, line_no, label, detected and confidence of works, samples and their lines.

    A work's language is that of all text of its documents, bundled; a sample's is the one of most of
    its lines, of equal ones that with more n-grams. Works without text and texts without letters have
    no language; rows that come twice come out twice. line_no is -1 but for lines.
    """
    table = fit_prototypes(documents, sample)
    texts = spread(documents.where("work_id is not null and text is not null").select("work_id", "text"))
    by_work = text_scores(texts, table, "text").groupBy("work_id").agg(F.sum("grams").alias("grams"), *(F.sum(x).alias(x) for x in LANGUAGES))
    of_works = works.select("work_id", F.col("work_row").alias("record_key"), label_of(F.col("lang")).alias("label")).join(decide(by_work), "work_id").select(F.lit("work").alias("record_type"), "record_key", F.lit(-1).alias("line_no"), "label", "detected", "confidence")
    lines = samples.where("text is not null").select(F.col("sample_row").alias("record_key"), label_of(F.col("language")).alias("label"), F.posexplode(F.split("text", r"\n|\r\n?")).alias("line_no", "text"))
    scored = text_scores(lines, table, "text")
    told = decide(scored.withColumn("size", F.col("grams"))).where("detected is not null")
    votes = told.groupBy("record_key", "label", "detected").agg(F.count(F.lit(1)).alias("lines"), F.sum("size").alias("size"), F.avg("confidence").alias("confidence"))
    of_samples = votes.groupBy("record_key", "label").agg(F.max_by(F.struct("detected", "confidence"), F.struct("lines", "size", "detected")).alias("d")).select(F.lit("sample").alias("record_type"), "record_key", F.lit(-1).alias("line_no"), "label", "d.detected", "d.confidence")
    of_lines = told.join(of_samples.select("record_key", F.col("detected").alias("of_sample")), "record_key").select(F.lit("sample_line").alias("record_type"), "record_key", "line_no", F.col("of_sample").alias("label"), "detected", "confidence")
    return of_works.unionByName(of_samples).unionByName(of_lines)


def mislabelled(documents: DataFrame, works: DataFrame, samples: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The works and samples without the right label, and the lines in another language than their sample."""
    return languages(documents, works, samples, sample).where("detected is not null and not (detected <=> label)").select("record_type", "record_key", "line_no", F.col("detected").alias("lang"))
