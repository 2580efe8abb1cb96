"""Evaluation passages inside training documents (problem 8): size-partitioned MinHash containment search.

Items are partitioned by size: class k holds those of `run` * 2^k words up to twice as many. An item's
signature are the MinHashes of its bands, a band being the shingles of `run` consecutive words; an item
has as many bands as its size allows and about a fifth as many different MinHashes. A document that
holds a run of an item has a band of the item, and so its MinHash, however short the item and long the
document are. The MinHashes of a document's bands are looked up among the signatures where it is read,
by a bitmap of bounded size, and so are the bands themselves; those that may be in one are joined to them.
The share of an item's signature that a document has estimates how much of the item it contains; one
MinHash in the largest signature of the class is what a single run gives, so nothing under that bound is
a candidate. Candidates are verified exactly, by the real words of the shingles around each collision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm import words as W
from quiremill.llm.tables import Bitmap, bitmap, cut_table
from quiremill.session import spread

#: Consecutive words that two texts must share.
RUN = 12
#: Words of a shingle.
SHINGLE = 5


def minhashes(hashes: np.ndarray, doc: np.ndarray, width: int, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MinHash of every band of `width` words that lies in one text, the first word of the shingle that has it, and a hash of the whole band.

    hashes: a hash for each word of the texts laid end to end; doc: the text of each word.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = W.rolling(hashes, shingle)
    inside = np.flatnonzero(doc[:n] == doc[width - 1 : width - 1 + n])
    low, at = grams[inside], inside.copy()
    for k in range(1, width - shingle + 1):
        other = grams[inside + k]
        less = other < low
        low, at = np.where(less, other, low), np.where(less, inside + k, at)
    return low, at, W.rolling(hashes, width)[inside]


def _around(words: list[str], doc: np.ndarray, at: int, reach: int) -> tuple[list[str], list[str]]:
    """The words of the same text that stand before and from `at` on, `reach` of the former and a shingle more of the latter at most."""
    lo, hi = max(at - reach, 0), min(at + SHINGLE + reach, len(words))
    while doc[lo] != doc[at]:
        lo += 1
    while doc[hi - 1] != doc[at]:
        hi -= 1
    return words[lo:at], words[at:hi]


def _signatures(run: int):
    """A mapInArrow function: items to their size class, words, and for each MinHash the words around it."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, doc, flat = W.word_hashes(batch.column(1))
            low, at, band = minhashes(hashes, doc, run)
            at, first, of = np.unique(at, return_index=True, return_inverse=True)
            low, words = low[first], flat.to_pylist()
            bands = np.split(band.view(np.int64)[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(at)))[:-1]) if len(at) else []
            size = np.bincount(doc, minlength=batch.num_rows)[doc[at]] if len(at) else at
            sides = [_around(words, doc, k, run - SHINGLE) for k in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[at])), pa.array(np.log2(np.maximum(size, 1) / run).astype(np.int32)), pa.array(low.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array([a for a, _ in sides], pa.list_(pa.string())), pa.array([b for _, b in sides], pa.list_(pa.string()))],
                names=["item_id", "size_class", "minhash", "bands", "item_before", "item_after"],
            )

    return over


def _collisions(key: str, run: int, known: Bitmap, bands: Bitmap):
    """A mapInArrow function: documents to their shingles that the signatures may have, with the words around them."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, doc, flat = W.word_hashes(batch.column(1))
            low, at, band = minhashes(hashes, doc, run)
            hit = known.has(low)
            hit[hit] = bands.has(band[hit])
            at, first = np.unique(at[hit], return_index=True)
            low = low[hit][first]
            if not len(at):
                continue
            # Only the words around collisions become strings.
            reach = run - SHINGLE
            wanted = np.unique((at[:, None] + np.arange(-reach, SHINGLE + reach)).clip(0, len(flat) - 1))
            words = dict(zip(wanted.tolist(), flat.take(pa.array(wanted)).to_pylist()))
            sides = []
            for k in at.tolist():
                lo, hi = max(k - reach, 0), min(k + SHINGLE + reach, len(flat))
                sides.append(([words[i] for i in range(lo, k) if doc[i] == doc[k]], [words[i] for i in range(k, hi) if doc[i] == doc[k]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[at])), pa.array(low.view(np.int64)), pa.array([a for a, _ in sides], pa.list_(pa.string())), pa.array([b for _, b in sides], pa.list_(pa.string()))],
                names=[key, "minhash", "before", "after"],
            )

    return over


def _alike(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _verified(run: int):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # Alike from the shingle on, whole shingle included, and backwards from it.
            ahead = [_alike(list(x), list(y)) for x, y in zip(b["after"], b["item_after"])]
            back = [_alike(list(x)[::-1], list(y)[::-1]) for x, y in zip(b["before"], b["item_before"])]
            keep = [m >= SHINGLE and m + n >= run for m, n in zip(ahead, back)]
            yield b.loc[keep, ["doc_id", "item_id", "size_class", "minhash"]]

    return over


def containment(documents: DataFrame, items: DataFrame, run: int = RUN, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, size_class, signature (MinHashes of the item), shared (of them in the document) and estimate of every candidate that holds a run.

    A word is a run of letters and digits without letter case. Null and empty texts, and texts of
    fewer than `run` words, never match; repeated rows give one pair; other columns are ignored.
    """
    kinds = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    words = "array<string>"
    of_items = cut_table(
        items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null").mapInArrow(_signatures(run), f"item_id {kinds[1]}, size_class int, minhash bigint, bands array<bigint>, item_before {words}, item_after {words}").distinct()
    )
    sizes = of_items.groupBy("item_id", "size_class").agg(F.count_distinct("minhash").alias("signature"))
    classes = sizes.groupBy("size_class").agg(F.max("signature").alias("most"))
    known = documents.sparkSession.sparkContext.broadcast((bitmap(of_items.select("minhash").distinct()), bitmap(of_items.select(F.explode("bands").alias("band")).distinct())))
    texts = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))
    hits = texts.mapInArrow(lambda it: _collisions("doc_id", run, *known.value)(it), f"doc_id {kinds[0]}, minhash bigint, before {words}, after {words}").distinct()
    near = hits.join(of_items.drop("bands"), "minhash").mapInPandas(_verified(run), f"doc_id {kinds[0]}, item_id {kinds[1]}, size_class int, minhash bigint")
    shared = near.groupBy("doc_id", "item_id", "size_class").agg(F.count_distinct("minhash").alias("shared"))
    estimated = shared.join(sizes, ["item_id", "size_class"]).join(classes, "size_class").withColumn("estimate", F.col("shared") / F.col("signature"))
    return estimated.where(F.col("estimate") >= 1 / F.col("most")).select("doc_id", "item_id", "size_class", "signature", "shared", "estimate")


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document and item that share a run of at least `run` consecutive words; see `containment`."""
    return containment(documents, items, run, doc_id, item_id, text).groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared")).select("doc_id", "item_id")
