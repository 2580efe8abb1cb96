"""Text quality (problem 10): a hidden Markov model labels the lines of a document.

Each line that isn't blank has a few discrete statistics. A hidden Markov model with the states
prose, list, table and junk emits them; its posterior labels the lines, and the shares of the
labels by line make the document's kind. The model is fitted by expectation maximisation on the
labelled sample, whose labels are evidence, not truth: each line of a labelled document is a priori
of that label with odds of SLIP to one. Priors on the emissions carry states of which the sample
has few lines. Common words are those in a given share of all documents, counted over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm import codes as C
from quiremill.llm.tables import cut_table
from quiremill.session import spread

STATES = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
#: Odds that a line has its document's label rather than one of the others.
SLIP = 8.0
#: Labelled documents that the model is fitted on, at most, and characters that they have together: those of the least hash.
SAMPLE, SAMPLE_CHARS = 4000, 20_000_000
#: Lines of a text that are decoded one after the other; longer texts are taken apart into blocks that advance together.
BLOCK = 256
#: A word is common when so large a share of the documents has it; this bounds the number of common words.
COMMON_SHARE = 0.02

#: Upper bounds of the statistics' bins, in the order of the columns of `line_statistics`. Lengths count characters of double width twice; alien lines have 25 letters and no common word.
BINS = {
    "length": (8, 25, 50, 100),
    "common": (0.001, 0.12, 0.3, 0.5),
    "symbols": (0.0, 0.04, 0.12, 0.3),
    "digits": (0.0, 0.06, 0.25, 0.5),
    "cells": (0, 1, 2),
    "mark": (0, 1, 2),
    "ending": (0, 1),
    "broken": (0, 1),
    "word_length": (2.0, 3.6, 6.5, 9.0),
    "again": (1, 2, 4),
    "longest": (14, 20, 30),
    "variety": (0.25, 0.5),
    "alien": (0,),
}

# Prior weights of the bins by state: what a line of the state looks like, before any label is seen.
PRIOR = {
    "length": ((1, 2, 5, 10, 10), (1, 10, 8, 2, 1), (1, 8, 8, 2, 1), (3, 5, 7, 8, 3)),
    "common": ((0.2, 1, 6, 10, 10), (6, 2, 4, 4, 4), (8, 2, 3, 3, 2), (14, 3, 1, 1, 1)),
    "symbols": ((20, 3, 1, 0.1, 0.02), (14, 4, 3, 0.5, 0.1), (14, 4, 3, 0.5, 0.1), (6, 2, 3, 6, 14)),
    "digits": ((14, 5, 1, 0.2, 0.1), (8, 3, 6, 3, 1), (1, 1, 4, 7, 6), (8, 4, 4, 2, 1)),
    "cells": ((20, 1, 0.2, 0.1), (12, 6, 0.5, 0.2), (1, 2, 8, 6), (10, 3, 2, 3)),
    "mark": ((20, 0.5, 0.1, 0.4), (6, 6, 4, 4), (6, 1, 0.3, 8), (14, 1, 1, 2)),
    "ending": ((8, 3, 7), (2, 1, 14), (1, 1, 14), (4, 2, 12)),
    "broken": ((30, 0.3, 0.1), (20, 0.3, 0.1), (20, 0.3, 0.1), (12, 2, 6)),
    "word_length": ((2, 6, 10, 1, 0.2), (3, 3, 8, 6, 2), (6, 4, 6, 5, 2), (6, 4, 5, 5, 4)),
    "again": ((30, 1, 0.2, 0.05), (20, 1, 0.2, 0.05), (20, 1, 0.2, 0.05), (8, 2, 2, 4)),
    "longest": ((30, 2, 0.2, 0.1), (25, 3, 0.4, 0.1), (25, 2, 0.3, 0.1), (12, 4, 2, 4)),
    "variety": ((0.02, 0.5, 30), (0.05, 0.5, 20), (0.05, 0.5, 20), (8, 2, 14)),
    "alien": ((30, 0.05), (20, 1.5), (20, 1), (8, 12)),
}
#: Bits of a word's hash that count; the low ones make room for the number of a text in a piece.
HIGH = np.uint64(0xFFFFFFFFFFFFC000)
WEIGHT = 2.0  # lines that one unit of a prior weighs


def word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of each word, without its low bits, and the number of documents of the batch that hold it."""
    for b in batches:
        texts = b["text"].tolist()
        found = []
        for lo, hi in C.pieces(texts):
            codes, starts = C.encode(texts[lo:hi])
            s, e = C.word_bounds(C.classes(codes))
            doc = np.searchsorted(starts, s, "right") - 1
            found.append(_unique((C.run_hashes(C.lowered(codes), s, e) & HIGH) | doc.astype(np.uint64)) & HIGH)
        words, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pd.DataFrame({"word": words.view(np.int64), "docs": n})


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def common_words(documents: DataFrame, share: float = COMMON_SHARE) -> np.ndarray:
    """Hashes of the words in at least `share` of the documents and in two, sorted; at most mean distinct words / share."""
    counts = documents.select("text").mapInPandas(word_counts, "word bigint, docs bigint").groupBy("word").agg(F.sum("docs").alias("docs"))
    n = documents.count()
    rows = counts.where(F.col("docs") >= max(2.0, share * n)).select("word").toPandas()
    return np.sort(rows["word"].to_numpy(np.int64).view(np.uint64))


def line_statistics(texts: list[str], common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The binned statistics of each line that isn't blank, its text's number and its length, and of
    each text words, common words, letters in words, symbols and characters that aren't blank."""
    parts = [_statistics(texts[a:b], common) for a, b in C.pieces(texts)]
    if not parts:
        return np.zeros((0, len(BINS)), np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 5))
    shift = [a for a, _ in C.pieces(texts)]
    x, doc, length, of_text = zip(*parts)
    return np.concatenate(x), np.concatenate([d + k for d, k in zip(doc, shift)]), np.concatenate(length), np.concatenate(of_text)


def _statistics(texts: list[str], common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes, starts = C.encode(texts)
    kind = C.classes(codes)
    ends = np.flatnonzero(kind == C.NEWLINE)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.empty(0, np.int64)
    n = len(ends)
    line = np.repeat(np.arange(n), ends - begins + 1)
    counts = np.bincount(line * 16 + kind, minlength=n * 16).reshape(n, 16) if n else np.zeros((0, 16), np.int64)
    blank = ends - begins - counts[:, C.SPACE] - counts[:, C.TAB] == 0
    doc = np.searchsorted(starts, begins, "right") - 1
    solid = np.maximum(1, ends - begins - counts[:, C.SPACE] - counts[:, C.TAB])
    low = C.lowered(codes)

    s, e = C.word_bounds(kind)
    hashes = C.run_hashes(low, s, e)
    known = C.within(hashes & HIGH, common)
    of = line[s]
    words = np.bincount(of, minlength=n)
    shared = np.bincount(of, weights=known, minlength=n)
    letters = np.bincount(of, weights=e - s, minlength=n)
    longest = np.zeros(n, np.int64)
    if len(of):
        head_word = np.flatnonzero(np.diff(of, prepend=-1))
        longest[of[head_word]] = np.maximum.reduceat(e - s, head_word)

    gap = np.zeros(n, np.int64)  # runs of three or more spaces inside a line
    is_space = kind == C.SPACE
    run = is_space[:-2] & is_space[1:-1] & is_space[2:] if len(kind) > 2 else np.empty(0, bool)
    if len(run):
        first = run & ~np.concatenate([[False], run[:-1]])
        gap = np.bincount(line[:-2][first], minlength=n)
    cells = counts[:, C.TAB] + counts[:, C.PIPE] + counts[:, C.SEMICOLON] + gap

    # The first and last characters that aren't blank.
    real = np.flatnonzero(kind > C.NEWLINE)
    head, tail = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(real):
        rl = line[real]
        edge = np.flatnonzero(np.diff(rl, prepend=-1))
        head[rl[edge]] = real[edge]
        tail[rl[edge]] = real[np.concatenate([edge[1:], [len(real)]]) - 1]
    after = kind[np.minimum(head + 1, len(kind) - 1)] if n else head
    third = kind[np.minimum(head + 2, len(kind) - 1)] if n else head
    h = kind[head] if n else head
    numbered = (h == C.DIGIT) & ((after == C.STOP) | ((after == C.DIGIT) & np.isin(third, (C.STOP, C.DIGIT))))
    bullet = ((codes[head] == ord("-")) | (codes[head] == ord("*")) | (codes[head] == ord("•"))) & (after == C.SPACE) if n else numbered
    dots = np.zeros(n, bool)
    stop = kind == C.STOP
    if len(stop) > 3:
        dots[line[:-3][stop[:-3] & stop[1:-2] & stop[2:-1] & stop[3:]]] = True
    t = kind[tail] if n else tail
    colon = np.bincount(line[codes == ord(":")], minlength=n) > 0
    pairs = colon & (counts[:, C.SEMICOLON] > 0) & (t != C.STOP)  # entry: reference; reference
    mark = np.where(dots, 2, np.where(numbered | bullet | pairs, 1, np.where(t == C.DIGIT, 3, 0)))
    ending = np.where((t == C.STOP) | (t == C.QUOTE), 0, np.where((t == C.COMMA) | (t == C.SEMICOLON), 1, 2))

    # Bytes of one encoding read as another come out as pairs such as capital A with tilde and a control or sign.
    lead = ((codes >= 0xC2) & (codes <= 0xF4))[:-1]
    trail = (((codes >= 0x80) & (codes <= 0xBF)) | np.isin(codes, _CP1252))[1:]
    broken = np.bincount(line[:-1][lead & trail], minlength=n) if len(codes) > 1 else np.zeros(n, np.int64)
    broken = broken + np.bincount(line[codes == 0xFFFD], minlength=n)

    # How often each line comes in its text.
    key = C.run_hashes(low, begins, ends)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    group = np.cumsum(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) - 1 if n else order
    again = np.zeros(n, np.int64)
    again[order] = np.bincount(group)[group] if n else 0

    # Share of different words in lines of ten words or more.
    with np.errstate(over="ignore"):
        _, at = np.unique(hashes + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)
    variety = np.where(words >= 10, np.bincount(of[at], minlength=n) / np.maximum(words, 1), 1.0)

    raw = {
        "length": ends - begins + counts[:, C.HIRAGANA] + counts[:, C.KATAKANA] + counts[:, C.HAN], "common": np.where(words > 0, shared / np.maximum(words, 1), 0.0), "symbols": counts[:, C.SYMBOL] / solid, "digits": counts[:, C.DIGIT] / solid,
        "cells": cells, "mark": mark, "ending": ending, "broken": broken, "word_length": letters / np.maximum(words, 1), "again": again, "longest": longest, "variety": variety, "alien": (letters >= 25) & (shared == 0),
    }
    binned = np.stack([np.searchsorted(np.array(BINS[k], float), raw[k].astype(float), "left") for k in BINS], axis=1) if n else np.zeros((0, len(BINS)), np.int64)
    keep = ~blank
    by_text = lambda v: np.bincount(doc, weights=v, minlength=len(texts))
    of_text = np.stack([by_text(v) for v in (words, shared, letters, counts[:, C.SYMBOL], (ends - begins) - counts[:, C.SPACE] - counts[:, C.TAB])], axis=1)
    return binned[keep].astype(np.int8), doc[keep], (ends - begins)[keep], of_text


# What the code page 1252 has in place of the control characters.
_CP1252 = np.array([ord(c) for c in "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"], np.uint32)


class LineModel:
    """The hidden Markov model: log emissions by statistic, transitions and starts."""

    def __init__(self) -> None:
        self.emit = [np.log(_normal(np.array(PRIOR[k], float))) for k in BINS]
        self.move = np.log(_normal(np.full((4, 4), 1.0) + np.eye(4) * 40))
        self.start = np.log(np.array([0.7, 0.1, 0.1, 0.1]))

    def likelihood(self, x: np.ndarray) -> np.ndarray:
        return sum(e[:, x[:, k]].T for k, e in enumerate(self.emit))

    def posterior(self, x: np.ndarray, doc: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each state for each line, and expected moves; all texts advance together, line by line."""
        n = len(x)
        if not n:
            return np.zeros((0, 4)), np.zeros((4, 4))
        b = self.likelihood(x)
        b = np.exp(np.maximum(b - b.max(axis=1, keepdims=True), -60))
        if prior is not None:
            b = b * prior
        move, start = np.exp(self.move), np.exp(self.start)
        head = np.diff(doc, prepend=-1) != 0  # first lines of texts
        place = np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0))
        first = np.flatnonzero(place % BLOCK == 0)
        size = np.diff(np.concatenate([first, [n]]))
        enter, leave = self._borders(b, first, size, head, move, start)
        by_size = np.argsort(-size, kind="stable")
        first, size, enter, leave = first[by_size], size[by_size], enter[by_size], leave[by_size]
        alpha, beta = np.empty((n, 4)), np.empty((n, 4))
        alpha[first] = _normal(np.where(head[first][:, None], start, enter @ move) * b[first])
        for t in range(1, int(size[0])):
            at = first[: np.searchsorted(-size, -t, "left")] + t
            alpha[at] = _normal((alpha[at - 1] @ move) * b[at])
        beta[first + size - 1] = leave
        for t in range(int(size[0]) - 1, 0, -1):
            at = first[: np.searchsorted(-size, -t, "left")] + t
            beta[at - 1] = _normal((b[at] * beta[at]) @ move.T)
        moves = np.zeros((4, 4))
        if prior is not None:
            at = np.flatnonzero(~head)
            joint = alpha[at - 1][:, :, None] * move * (b[at] * beta[at])[:, None, :]
            moves = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return _normal(alpha * beta), moves

    def _borders(self, b: np.ndarray, first: np.ndarray, size: np.ndarray, head: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block the forward message of the line before it and the backward message of its last line.

        The lines of a block make one matrix, all blocks at once; only these are chained from block to block.
        """
        enter, leave = np.zeros((len(first), 4)), np.ones((len(first), 4))
        goes_on = np.concatenate([~head[first[1:]], [False]])  # the next block is the same text's
        many = np.flatnonzero(goes_on | ~head[first])
        if not len(many):
            return enter, leave
        order = many[np.argsort(-size[many], kind="stable")]
        whole = np.tile(np.eye(4), (len(first), 1, 1))
        for t in range(int(size[order[0]])):
            k = order[: np.searchsorted(-size[order], -t, "left")]
            at = first[k] + t
            step = (whole[k] @ move) * b[at][:, None, :]
            if t == 0:
                step = np.where(head[at][:, None, None], start * b[at][:, None, :] * np.ones((4, 1)), step)
            whole[k] = step / step.sum(axis=(1, 2), keepdims=True)
        for k in many.tolist():
            if goes_on[k]:
                enter[k + 1] = _normal((np.ones(4) if head[first[k]] else enter[k]) @ whole[k])
        for k in many[::-1].tolist():
            if not head[first[k]]:
                leave[k - 1] = _normal(whole[k] @ leave[k])
        return enter, leave

    def fit(self, x: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 12) -> LineModel:
        """label: the state that the document of each line is said to have."""
        prior = np.ones((len(x), 4))
        prior[np.arange(len(x)), label] = SLIP
        for _ in range(rounds if len(x) else 0):
            p, moves = self.posterior(x, doc, prior)
            for k, name in enumerate(BINS):
                counts = np.stack([np.bincount(x[:, k], weights=p[:, s], minlength=len(BINS[name]) + 1) for s in range(4)])
                self.emit[k] = np.log(_normal(counts + np.array(PRIOR[name], float) * WEIGHT))
            self.move = np.log(_normal(moves + 1.0 + np.eye(4) * 40))
            head = np.flatnonzero(np.diff(doc, prepend=-1))
            self.start = np.log(_normal(p[head].sum(axis=0) + 1.0))
        return self


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def fit_model(documents: DataFrame, labels: DataFrame, common: np.ndarray, sample: int = SAMPLE) -> LineModel:
    """The model fitted on at most `sample` labelled documents."""
    taken = labels.where(F.col("label").isin(*STATES) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, doc, _, _ = line_statistics(b["text"].tolist(), common)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[doc], "label": b["label"].to_numpy()[doc], "x": [r.tobytes() for r in x]})

    kind = dict(documents.dtypes)["doc_id"]
    mine = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.max("text").alias("text"))
    mine = cut_table(mine.where(F.length("text") <= SAMPLE_CHARS))
    chars = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # of SAMPLE rows
    ids = [r[0] for r in mine.select("doc_id", F.coalesce(chars, F.lit(0)).alias("before")).where(F.col("before") < SAMPLE_CHARS).select("doc_id").collect()]
    bound = documents.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {kind}")
    rows = mine.join(F.broadcast(bound), "doc_id").mapInPandas(over, f"doc_id {kind}, label string, x binary").toPandas()
    doc = pd.factorize(rows["doc_id"])[0]
    order = np.argsort(doc, kind="stable")
    x = np.frombuffer(b"".join(rows["x"]), np.int8).reshape(-1, len(BINS))[order] if len(rows) else np.zeros((0, len(BINS)), np.int8)
    label = np.array([STATES.index(s) for s in rows["label"]], np.int64)[order] if len(rows) else np.zeros(0, np.int64)
    return LineModel().fit(x, doc[order], label)


STATISTICS = "lines bigint, words bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, prose double, list double, table double, junk double, kind string"


def document_statistics(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, statistics, the shares of prose, list, table and junk by line, and kind.

    lines counts the lines that aren't blank; ended_lines is the share of them that end in a full stop,
    a mark or a quote. kind is prose when at least half of the lines' weight is prose, else the
    commonest other label. A text without any line, a null one among them, has no words, zero shares
    and kind null. Equal rows come out as often as they are there.
    """
    kind = dict(documents.dtypes)["doc_id"]
    rows = spread(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    common = common_words(rows)
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast((common, fit_model(rows, labels, common)))

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, model = shared.value
        for b in batches:
            yield describe(b, known, model)

    return rows.mapInPandas(over, f"doc_id {kind}, {STATISTICS}")


def describe(b: pd.DataFrame, common: np.ndarray, model: LineModel) -> pd.DataFrame:
    texts = b["text"].tolist()
    n = len(texts)
    x, doc, length, of_text = line_statistics(texts, common)
    p, _ = model.posterior(x, doc)
    weight = np.minimum(length, 200) ** 0.5
    total = np.bincount(doc, weights=weight, minlength=n)
    share = np.stack([np.bincount(doc, weights=weight * p[:, s], minlength=n) / np.maximum(total, 1e-9) for s in range(4)], axis=1)
    words, known, letters, symbols, solid = of_text.T
    lines = np.bincount(doc, minlength=n)
    ended = np.bincount(doc, weights=x[:, list(BINS).index("ending")] == 0, minlength=n)
    best = np.where(share[:, PROSE] >= 0.5, PROSE, 1 + share[:, 1:].argmax(axis=1))
    return pd.DataFrame({
        "doc_id": b["doc_id"], "lines": lines, "words": words.astype(np.int64), "mean_word_length": letters / np.maximum(words, 1), "symbol_ratio": symbols / np.maximum(solid, 1),
        "ended_lines": ended / np.maximum(lines, 1), "common_words": known / np.maximum(words, 1), **{k: share[:, i] for i, k in enumerate(STATES)},
        "kind": [STATES[k] if m else None for k, m in zip(best, lines)],
    })
