"""Sentence alignment of rough translations (problem 2).

The lexicon comes from the texts themselves: sentences of one segment that alone share a name or a
number are taken as pairs, the units (words of the source; syllables and pairs of syllables of the
translation) that occur in them together are counted over all segments, and pairs of units stay
whose log-likelihood ratio is high. Units too rare to make an entry are counted out first, so only pairs
of the others are formed, as numbers, and put together over the cluster; the tests of an entry run there
too, and what the driver gets is the lexicon. A unit of the translation speaks for a source word as much as
the word's chance is raised by it. Sentence pairs get the shares of each other's weight that they
cover. A Hungarian assignment with null costs picks the pairs of greatest total weight; sentences
that are left over then join a pair as a merged span, again by assignment, when they cover what the
span has uncovered so far.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm.cutoff import judged
from quiremill.llm.tables import cut_table
from quiremill.session import shuffled

#: Log-likelihood ratio, and rise of the word's chance by the unit and of the unit's by the word, from which a pair is an entry.
RATIO, RISE, BACK = 15.0, 0.25, 0.06
#: Sentence pairs, and share of all of them, that a unit must occur in. With some 60 units in a pair there are at most 60 / SHARE units, whatever the corpus, and each has at most 60 / RISE entries.
LEAST, SHARE = 3, 1e-5
#: Pairs of units that a task counts at a time.
KEYS = 1 << 23
#: Share of either sentence that the other must cover for a pair to count, and the cost of leaving both alone.
COVER, NULL = 0.55, 0.42
#: Share of a span's weight that a further sentence must newly cover, and share of its own that must be covered.
GAIN, OWN = 0.08, 0.58
#: Weight of names and numbers, as of a unit in one of e^NAME sentences.
NAME = 5.0

_END = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_CLAUSE = re.compile(r"[,;:.!?…“”\"()\n]+")


def sentences(text: str) -> list[str]:
    """A sentence ends at . ! ? or … followed by white space, or at the end of the text."""
    return [s for s in _END.split(text.strip()) if s]


class _Hashes(dict):
    """Units by their 63-bit hashes, remembered for the vocabulary of a task."""

    def __missing__(self, unit: str) -> int:
        h = xxhash.xxh64_intdigest(unit) >> 1
        if len(self) < 1 << 20:
            self[unit] = h
        return h


_hash = _Hashes()


def source_units(s: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(s)}


def target_units(s: str) -> set[str]:
    out: set[str] = set()
    for clause in _CLAUSE.split(s):
        words = [w.lower() for w in _WORD.findall(clause)]
        out.update(words)
        out.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    return out


def _marks(words: list[str]) -> set[str]:
    return {w for w in words if w[0] not in _SMALL and (w.isdigit() or (len(w) >= 4 and w[0].isupper() and w.isascii() and w.isalpha()))}


_SMALL = frozenset("abcdefghijklmnopqrstuvwxyz")


def marks(s: str) -> set[str]:
    """Numbers, and words of plain letters with a capital: they are the same in both languages."""
    return _marks(_WORD.findall(s))


def anchor_pairs(src: list[str], tgt: list[str]) -> set[tuple[int, int]]:
    """Pairs of sentences that alone have a mark in common."""
    where: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for side, texts in enumerate((src, tgt)):
        for i, s in enumerate(texts):
            for m in marks(s):
                where[m][side].append(i)
    return {(a[0], b[0]) for a, b in where.values() if len(a) == 1 and len(b) == 1}


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hashed source and translation units of each anchor pair; names are left out."""
    for b in batches:
        rows = []
        for s, t in zip(b["source_text"], b["value"]):
            src, tgt = sentences(s), sentences(t)
            anchors = anchor_pairs(src, tgt)
            if not anchors:
                continue
            named = {m.lower() for m in marks(s) & marks(t)}
            for i, j in anchors:
                e, v = source_units(src[i]) - named, target_units(tgt[j])
                rows.append(([_hash[x] for x in e], [_hash[x] for x in v if not named or named.isdisjoint(x.split())]))
        yield pd.DataFrame(rows, columns=["e", "v"])


def log_likelihood(both, left, right, total):
    """Dunning's ratio of a two by two table from its count of both, margins and total."""
    k = np.array([both, left - both, right - both, total - left - right + both], float)
    rows = np.array([left, left, total - left, total - left], float)
    cols = np.array([right, total - right, right, total - right], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(k > 0, k * np.log(k * total / (rows * cols)), 0.0)
    return 2 * part.sum(axis=0)


class Margins:
    """Sentence pairs, and the units of both sides by hash, sorted, with the pairs that they are in."""

    def __init__(self, total: int, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> None:
        self.total, self.left, self.right = total, left, right

    def entries(self, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are entries, by key (number of the source unit times the translation's units, plus the number of that one), and how much each raises the word's chance."""
        width = max(1, len(self.right[0]))
        a, b, n = self.left[1][key // width].astype(float), self.right[1][key % width].astype(float), n.astype(float)
        base = a / self.total
        rise = (n / b - base) / np.maximum(1 - base, 1e-9)
        back = (n / a - b / self.total) / np.maximum(1 - b / self.total, 1e-9)
        return (n >= LEAST) & (log_likelihood(n, a, b, self.total) >= RATIO) & (rise >= RISE) & (back >= BACK), rise


class Lexicon:
    """Entries by translation unit, and weights of the units of both sides, all by hash."""

    def __init__(self, m: Margins, key: np.ndarray, rise: np.ndarray) -> None:
        width = max(1, len(m.right[0]))
        e, v = key // width, key % width
        order = np.argsort(v, kind="stable")
        units, first = np.unique(v[order], return_index=True)
        self.entries = dict(zip(m.right[0][units].tolist(), zip(np.split(m.left[0][e[order]], first[1:]), np.split(rise[order], first[1:]))))
        e, v = np.unique(e), np.unique(v)
        self.left = dict(zip(m.left[0][e].tolist(), np.log(m.total / m.left[1][e]).tolist()))
        self.right = dict(zip(m.right[0][v].tolist(), np.log(m.total / m.right[1][v]).tolist()))


NO_LEXICON = Lexicon(Margins(1, (np.empty(0, np.int64),) * 2, (np.empty(0, np.int64),) * 2), np.empty(0, np.int64), np.empty(0))


def _numbers(lists: pd.Series, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the known units of all lists laid end to end, and how many each list has."""
    size = lists.map(len).to_numpy()
    flat = np.concatenate(lists.to_numpy()) if len(lists) else np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
    here = known[at] == flat if len(known) else np.zeros(len(flat), bool)
    return at[here], np.bincount(np.repeat(np.arange(len(lists)), size)[here], minlength=len(lists))


def _counted(margins):
    """A mapInPandas function: anchor pairs to the number of those with each pair of units, by key."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = margins.value
        width = max(1, len(m.right[0]))
        for b in batches:
            e, many = _numbers(b["e"], m.left[0])
            v, more = _numbers(b["v"], m.right[0])
            e_at, v_at = np.concatenate([[0], np.cumsum(many)]), np.concatenate([[0], np.cumsum(more)])
            done = np.concatenate([[0], np.cumsum(many * more)])
            lo = 0
            while lo < len(b):  # as many sentence pairs at a time as have KEYS pairs of units
                hi = max(lo + 1, int(np.searchsorted(done, done[lo] + KEYS, "right")) - 1)
                per = np.repeat(more[lo:hi], many[lo:hi])  # each source unit meets as many
                first = np.repeat(v_at[lo:hi], many[lo:hi])
                of = np.repeat(np.arange(len(per)), per)
                place = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
                key, n = np.unique(e[e_at[lo] : e_at[hi]][of] * width + v[first[of] + place], return_counts=True)
                yield pd.DataFrame({"key": key, "n": n})
                lo = hi

    return over


def _tested(margins):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good, rise = margins.value.entries(b["key"].to_numpy(), b["n"].to_numpy())
            yield pd.DataFrame({"key": b["key"][good], "rise": rise[good]})

    return over


def induce(vals: DataFrame) -> Lexicon:
    """The lexicon of all values."""
    sc = vals.sparkSession.sparkContext
    pairs = cut_table(vals.mapInPandas(_pairs, "e array<bigint>, v array<bigint>"))
    total = pairs.count()
    least = max(LEAST, SHARE * total)

    def units(side: str) -> tuple[np.ndarray, np.ndarray]:
        rows = pairs.select(F.explode(side).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).toPandas().sort_values("unit")
        return rows["unit"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)

    margins = Margins(total, units("e"), units("v"))
    shared = sc.broadcast(margins)
    counts = pairs.mapInPandas(_counted(shared), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    rows = counts.mapInPandas(_tested(shared), "key bigint, rise double").toPandas().sort_values("key")
    return Lexicon(margins, rows["key"].to_numpy(np.int64), rows["rise"].to_numpy(float)) if len(rows) else NO_LEXICON


def hungarian(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of an assignment of greatest total weight, each row and column at most once and only where the weight is positive."""
    n, m = weight.shape
    cost = np.zeros((n, m + n))
    cost[:, :m] = -np.maximum(weight, 0.0)
    size = m + n
    u, v = np.zeros(n + 1), np.zeros(size + 1)
    match, way = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            open_ = np.where(used, np.inf, least)
            open_[0] = np.inf
            j1 = int(open_.argmin())
            delta = open_[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j] and weight[match[j] - 1, j - 1] > 0]


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """The same, taken apart into the components of the positive weights: what isn't connected can't compete."""
    rows, cols = np.nonzero(weight > 0)
    by_row: dict[int, list[int]] = defaultdict(list)
    by_col: dict[int, list[int]] = defaultdict(list)
    for i, j in zip(rows.tolist(), cols.tolist()):
        by_row[i].append(j)
        by_col[j].append(i)
    out, done = [], set()
    for start in by_row:
        if start in done:
            continue
        some_rows, some_cols, todo = [start], set(), [start]
        done.add(start)
        while todo:
            for j in by_row[todo.pop()]:
                if j not in some_cols:
                    some_cols.add(j)
                    for i in by_col[j]:
                        if i not in done:
                            done.add(i)
                            some_rows.append(i)
                            todo.append(i)
        c = sorted(some_cols)
        if len(some_rows) == 1:
            out.append((start, max(c, key=lambda j: weight[start, j])))
        elif len(c) == 1:
            out.append((max(some_rows, key=lambda i: weight[i, c[0]]), c[0]))
        else:
            out.extend((some_rows[i], c[j]) for i, j in hungarian(weight[np.ix_(some_rows, c)]))
    return out


def align(src: list[str], tgt: list[str], lexicon: Lexicon) -> list[tuple[int, int]]:
    """Pairs of numbers of sentences of which the second translates the first or a part of it."""
    if not src or not tgt:
        return []
    s_words, t_words = [_WORD.findall(x) for x in src], [[_WORD.findall(c) for c in _CLAUSE.split(x)] for x in tgt]
    s_named, t_named = [_marks(w) for w in s_words], [_marks([x for c in w for x in c]) for w in t_words]
    common = set().union(*s_named) & set().union(*t_named)
    left, right = [], []
    for words, own in zip(s_words, s_named):
        named = own & common
        low = {m.lower() for m in named}
        left.append(named | {h for w in {w.lower() for w in words} - low if (h := _hash[w]) in lexicon.left})
    for clauses, own in zip(t_words, t_named):
        named = own & common
        low = {m.lower() for m in named}
        units: set[int] = set()
        for clause in clauses:
            before = None
            for w in clause:
                w = w.lower()
                if w in low:
                    before = None
                    continue
                if (h := _hash[w]) in lexicon.right:
                    units.add(h)
                if before is not None and (h := _hash[f"{before} {w}"]) in lexicon.right:
                    units.add(h)
                before = w
        right.append(named | units)
    e_at = {w: i for i, w in enumerate(sorted(set().union(*left), key=str))}
    v_at = {w: i for i, w in enumerate(sorted(set().union(*right), key=str))}
    if not e_at or not v_at:
        return []
    link = np.zeros((len(e_at), len(v_at)))
    for m in common:
        if m in v_at and m in e_at:
            link[e_at[m], v_at[m]] = 1.0
    asked = [v for v in v_at if v not in common]
    if asked:
        hashes = np.array([e for e in e_at if e not in common], np.int64)
        by_hash = np.argsort(hashes)
        size = [len(lexicon.entries[v][0]) for v in asked]
        e, r = (np.concatenate([lexicon.entries[v][k] for v in asked]) for k in (0, 1))
        at = np.minimum(np.searchsorted(hashes, e, sorter=by_hash), max(0, len(hashes) - 1))
        here = hashes[by_hash[at]] == e if len(hashes) else np.zeros(len(e), bool)
        rows = np.array([e_at[x] for x in hashes.tolist()], np.int64)
        link[rows[by_hash[at[here]]], np.repeat([v_at[v] for v in asked], size)[here]] = r[here]
    we = np.array([NAME if e in common else lexicon.left[e] for e in e_at])
    wv = np.array([NAME if v in common else lexicon.right[v] for v in v_at])
    s_has, t_has = np.zeros((len(src), len(e_at)), bool), np.zeros((len(tgt), len(v_at)), bool)
    for i, x in enumerate(left):
        s_has[i, [e_at[w] for w in x]] = True
    for j, x in enumerate(right):
        t_has[j, [v_at[w] for w in x]] = True
    by_s = np.stack([link[h].max(axis=0) if h.any() else np.zeros(len(v_at)) for h in s_has])  # how well each source sentence explains each translation unit
    by_t = np.stack([link[:, h].max(axis=1) if h.any() else np.zeros(len(e_at)) for h in t_has])
    s_weight, t_weight = np.maximum(s_has @ we, 1e-9), np.maximum(t_has @ wv, 1e-9)
    cover_t = (by_s * wv) @ t_has.T / t_weight
    cover_s = ((by_t * we) @ s_has.T).T / s_weight[:, None]
    # Marks that both texts have: sentences that each have some must have one in common.
    order = sorted(common)
    s_marks = np.array([[m in x for m in order] for x in s_named]).reshape(len(src), -1)
    t_marks = np.array([[m in x for m in order] for x in t_named]).reshape(len(tgt), -1)
    shared = (s_marks.astype(int) @ t_marks.T.astype(int)) > 0
    fits = shared | ~(s_marks.any(axis=1)[:, None] & t_marks.any(axis=1)[None])
    weight = np.where(fits & (np.maximum(cover_s, cover_t) >= COVER), (cover_s + cover_t) / 2 - NULL, 0.0)
    pairs = assign(weight)
    # A part of a span needs no marks, but those that it has must be the span's.
    fits_s, fits_t = shared | ~s_marks.any(axis=1)[:, None], shared | ~t_marks.any(axis=1)[None]
    spans_s, spans_t = {j: [i] for i, j in pairs}, {i: [j] for i, j in pairs}
    while True:  # merged spans grow by a sentence at a time, until no round adds one
        taken_s, taken_t = {i for i, _ in pairs}, {j for _, j in pairs}
        free_s, free_t = [i for i in range(len(src)) if i not in taken_s], [j for j in range(len(tgt)) if j not in taken_t]
        more = []
        if free_s and spans_s:
            cols = list(spans_s)
            have = np.stack([by_s[spans_s[j]].max(axis=0) for j in cols])
            gain = np.array([[float((np.maximum(by_s[i] - h, 0) * wv * t_has[j]).sum() / t_weight[j]) for h, j in zip(have, cols)] for i in free_s])
            own = cover_s[np.ix_(free_s, cols)]
            more += [(free_s[a], cols[b]) for a, b in assign(np.where((gain >= GAIN) & (own >= OWN) & fits_s[np.ix_(free_s, cols)], gain + own, 0.0))]
        if free_t and spans_t:
            rows = list(spans_t)
            have = np.stack([by_t[spans_t[i]].max(axis=0) for i in rows])
            gain = np.array([[float((np.maximum(by_t[j] - h, 0) * we * s_has[i]).sum() / s_weight[i]) for h, i in zip(have, rows)] for j in free_t])
            own = cover_t[np.ix_(rows, free_t)].T
            more += [(rows[b], free_t[a]) for a, b in assign(np.where((gain >= GAIN) & (own >= OWN) & fits_t[np.ix_(rows, free_t)].T, gain + own, 0.0))]
        if not more:
            break
        for i, j in more:
            if (i, j) not in pairs:
                pairs.append((i, j))
                spans_s.setdefault(j, []).append(i)
                spans_t.setdefault(i, []).append(j)
    return sorted(pairs)


def aligned(segments: DataFrame) -> DataFrame:
    """seg_row, field_name, src_no and tgt_no of all pairs of sentences that translate each other.

    The last sentence of a value that was cut off pairs with nothing. Null and empty texts have no
    sentences; rows delivered twice come out twice. Without any names or numbers in common there is no
    lexicon and nothing is paired.
    """
    both = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("draft_raw", "final")))).alias("v")
    vals = segments.where("source_text <> ''").select("seg_row", "source_text", both).select("seg_row", "source_text", "v.*").where("value <> ''")
    ends = judged(segments).select(F.col("seg_row").alias("row"), F.col("field_name").alias("field"), "cut").distinct()
    # The texts are the heavy part: they are spread over the cores before Python sees them.
    vals = shuffled(vals)
    lexicon = segments.sparkSession.sparkContext.broadcast(induce(vals))
    rows = vals.join(ends, (F.col("seg_row") == F.col("row")) & (F.col("field_name") == F.col("field")), "left").select("seg_row", "field_name", "source_text", "value", F.coalesce("cut", F.lit(False)).alias("cut"))
    kind = dict(segments.dtypes)["seg_row"]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, field, s, t, is_cut in zip(b["seg_row"], b["field_name"], b["source_text"], b["value"], b["cut"]):
                tgt = sentences(t)
                if is_cut:
                    tgt = tgt[:-1]
                out.extend((row, field, i, j) for i, j in align(sentences(s), tgt, lexicon.value))
            yield pd.DataFrame(out, columns=["seg_row", "field_name", "src_no", "tgt_no"])

    return rows.mapInPandas(over, f"seg_row {kind}, field_name string, src_no int, tgt_no int")
