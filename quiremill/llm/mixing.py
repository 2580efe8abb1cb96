"""A mixture of sources by target weights (problem 9): weighted fair queueing.

The documents of each source are shuffled by a hash. A document's virtual finish time is the number
of its source's tokens up to and with it, divided by the source's target share; a source that is
repeated goes on with its next copy where the last one ended. All documents together are sorted by
finish time and cut where the total budget ends, so at every point of the order the sources have
their shares. Running sums are taken in buckets of the shuffled order, with the sums of the buckets
before: no task holds a whole source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.session import cut, spread

#: Documents that a bucket of the shuffled order holds, about.
BUCKET = 20_000


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source and tokens of each document; null texts have none. tokenizer: a .tiktoken file that every executor can read."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            b["tokens"] = [len(enc.encode_ordinary(t)) for t in b["text"]]
            yield b[["doc_id", "source", "tokens"]]

    kind = dict(documents.dtypes)["doc_id"]
    return spread(documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))).mapInPandas(over, f"doc_id {kind}, source string, tokens bigint")


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str, budget: int | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, copy (from 0), tokens and finish of the documents in the mixture.

    Without a budget it is the largest total at which every source can have its share within its
    repeats. With one, a source that runs out ends there, and the others go on to the total.
    Documents without a source or a target, sources with no share, and texts without tokens are left
    out; equal rows are documents of their own, in the order of their hashes.
    """
    counted = cut(token_counts(documents, tokenizer).where("tokens > 0").join(F.broadcast(_targets(targets)), "source"))
    key = F.xxhash64(F.lit(seed), "source", "doc_id")
    # The number of buckets follows the number of documents; sums of the buckets stay small.
    n = counted.count()
    buckets = max(1, -(-n // BUCKET))
    rows = counted.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftright("key", 20), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
    # One row for each source and bucket: a 20,000th of the documents and the number of sources at most.
    before = sums.select("source", "bucket", (F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")) - F.col("tokens")).alias("before"), F.sum("tokens").over(Window.partitionBy("source")).alias("of_source"))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(before, ["source", "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    totals = sums.groupBy("source").agg(F.sum("tokens").alias("t")).join(_targets(targets), "source")
    if budget is None:
        budget = totals.agg(F.min(F.col("t") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0
        last = float(budget)
    else:
        last = _level(totals.select((F.col("t") * F.col("max_repeats")).cast("double"), "target_share").collect(), budget)
    copies = placed.withColumn("copies", F.least("max_repeats", F.ceil(F.lit(last) * F.col("target_share") / F.col("of_source")).cast("int"))).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    finish = (F.col("upto") + F.col("copy") * F.col("of_source")) / F.col("target_share")
    return copies.withColumn("finish", finish).where(F.col("finish") <= last).select("doc_id", "source", "copy", "tokens", "finish").sort("finish", "source", "doc_id")


def _targets(targets: DataFrame) -> DataFrame:
    """One target of each source: a list of sources, small by nature."""
    return targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def _level(sources: list, budget: int) -> float:
    """The finish time at which the sources' tokens, each up to what it has, add up to the budget."""
    left, weight = float(budget), sum(w for _, w in sources)
    for have, w in sorted(sources, key=lambda x: x[0] / x[1]):
        if have / w * weight >= left:
            return left / weight
        left, weight = left - have, weight - w
    return float("inf") if not sources else max(h / w for h, w in sources)


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, tokens, documents, share and repeats of each target source; sources without documents have zeros."""
    by = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), (F.max("copy") + 1).alias("repeats"))
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
    return _targets(targets).join(by, "source", "left").select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("share"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
