"""Texts from scanned pages (problem 1): furniture, broken words, misread words and paragraphs.

Lines are told apart by gradient-boosted classifiers: one finds running heads by their shape, taught
by those lines that repeat the title of the work or chapter; one decides for each pair of lines of
body text whether the paragraph goes on, taught by the parser's join_next, whose faults are too few
and too scattered to be learnt. It sees the layout only: sentences end within paragraphs as well. Both are fitted on a bounded sample of works and scored as a lookup by features.

Words of scanned works that the other works don't know are looked up in their vocabulary: candidates
come from an inverted join on character bigrams, and a third classifier ranks them by the shape of
the edit. It is taught by words of the vocabulary with letters changed the way scanners change them,
against words of works that weren't scanned, which are rare but right.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.boost import Boost
from quiremill.llm.lookalikes import LOOKALIKES, plain
from quiremill.llm.sitelines import letters, repeated_lines
from quiremill.llm import words as W
from quiremill.llm.tables import Bitmap, bitmap, cut_table
from quiremill.session import BROADCAST_LIMIT

#: Works that the classifiers of lines are fitted on, about.
SAMPLE_WORKS = 1500
#: Words that the ranking is fitted on, at most.
SAMPLE_WORDS = 3000
#: Times that a word must occur in works that weren't scanned to be a candidate, and with a capital to be one for words with a capital.
KNOWN, KNOWN_CAPITAL = 3, 3
#: Edits between a word and its candidate, at most: two confusions of a letter with two. Short words can have one.
EDITS, EDITS_SHORT, SHORT = 4, 2, 6
#: Bigrams that two confusions can destroy, and one; a candidate has one more in the index, its rarest, so that one of them is left.
DESTROYED, DESTROYED_SHORT = 6, 3

# Letters that scanners take for others or for signs.
CONFUSIONS = (
    ("m", "rn"), ("m", "in"), ("m", "nn"), ("d", "cl"), ("đ", "cl"), ("ư", "ir"), ("h", "li"), ("h", "b"), ("w", "vv"), ("u", "ii"), ("n", "ri"), ("n", "u"), ("n", "h"), ("e", "c"), ("e", "o"), ("a", "o"), ("a", "e"), ("c", "e"), ("o", "0"), ("o", "e"), ("l", "1"), ("l", "|"), ("l", "i"), ("l", "!"),
    ("i", "l"), ("i", "1"), ("i", "!"), ("i", "j"), ("t", "f"), ("t", "l"), ("t", "r"), ("f", "t"), ("s", "5"), ("s", "f"), ("b", "6"), ("b", "h"), ("g", "9"), ("g", "q"), ("q", "g"), ("r", "v"), ("v", "r"), ("u", "n"), ("u", "v"), ("v", "y"), ("y", "v"), ("z", "2"), ("k", "lc"), ("p", "n"), ("H", "N"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "l"), ("E", "F"), ("T", "F"), ("A", "4"),
)
#: What stands at the end of a line in place of a hyphen.
BREAK = r"[-\x{AC}~=\x{AD}\x{2010}\x{2011}]$"
_NUMBER = r"(?i)^[\[(|\s.\x{2014}\x{2013}-]*(?:(?:pg|p|page|trang)\b\.?\s*)?(?:(?=[0-9lIO|oSB]{0,3}[0-9])[0-9lIO|oSB]{1,4}|(?-i:[lIO|]{2,3})|(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))[\])|\s.\x{2014}\x{2013}-]*$"
_WORD = r"[\s,.;:?\x{201C}\x{201D}\"\x{AB}\x{BB}()\[\]\x{2014}\x{2013}\x{2026}'\x{2019}\x{2018}-]+"


def _bin(c: Column, *bounds: float) -> Column:
    return sum((F.when(c > b, 1).otherwise(0) for b in bounds), F.lit(0))


SHAPE = ["f_caps", "f_level", "f_role", "f_indent", "f_blank", "f_digits", "f_length", "f_spaced", "f_stop"]
#: Values of each feature.
SHAPE_SIZES = {"f_caps": 2, "f_level": 4, "f_role": 3, "f_indent": 6, "f_blank": 2, "f_digits": 2, "f_length": 5, "f_spaced": 2, "f_stop": 2}
#: Bits of a line's pack, and where its other numbers begin: indent (8 bits), size (12), line_index (31). The order of packs is that of the lines.
BLANK, CAPS, NUMBER, DIGITS, SPACED, STOP, BROKEN, LETTER, HYPHEN, BODY = (1 << k for k in range(10))
INDENT, SIZE, INDEX = 10, 18, 30
#: Between the first word of a line and the last one.
GAP = "\x01"


def narrow(lines: DataFrame) -> DataFrame:
    """What the next steps need of each line, taken where it is read, so that texts are never shuffled: line_id, wk (hash of
    the work), pack, key (letters, where they matter) and edge (the first word and, where it may be broken, the last one).

    Lines without a work have none: no paragraph can be told for them.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    last, first = F.right(t, F.lit(1)), F.left(t, F.lit(1))
    two = F.left(t, F.lit(2))
    # Most lines begin with two small letters and needn't be matched.
    few_lower = (F.length(t) <= 120) & ~((F.lower(two) == two) & (F.upper(first) != first) & (F.upper(F.right(two, F.lit(1))) != F.right(two, F.lit(1)))) & t.rlike(r"^[^\p{Ll}]*(?:\p{Ll}[^\p{Ll}]*){0,3}$") & t.rlike(r"(?:\p{Lu}[^\p{Lu}]*){4}")
    number = (F.length(t) <= 16) & t.rlike(r"[0-9ivxlcdmIVXLCDM]") & t.rlike(_NUMBER)
    clip = lambda c, most: F.greatest(F.lit(0), F.least(F.coalesce(c, F.lit(0)), F.lit(most))).cast("bigint")
    x = lines.where("work_id is not null").select(
        "line_id", F.xxhash64("work_id").alias("wk"), F.shiftleft(clip(F.col("line_index"), (1 << 31) - 1), INDEX).alias("index"), F.shiftleft(clip(F.col("indent"), 255), INDENT).alias("indent"), F.shiftleft(clip(F.length(t), 4095), SIZE).alias("size"),
        F.coalesce("blank_before", F.lit(False)).alias("blank"), few_lower.alias("caps"), number.alias("number"), t.alias("t"), last.alias("last"), first.alias("first"),
    )
    break_mark = F.col("last").isin("-", "\u00AC", "~", "=", "\u00AD", "\u2010", "\u2011")
    bit = lambda c, b: F.when(c, b).otherwise(0)
    bits = (
        bit(F.col("blank"), BLANK) + bit(F.col("caps"), CAPS) + bit(F.col("number"), NUMBER) + bit(F.col("caps") & F.col("t").rlike(r"^[\[(]?[0-9lIO]+|[0-9lIO]+[\])]?$"), DIGITS) + bit(F.col("caps") & F.col("t").rlike(r"^(?:\S ){4}"), SPACED)
        + bit(F.col("last").isin(".", "!", "?", ",", ";"), STOP) + bit(break_mark, BROKEN) + bit(F.lower("first") != F.upper("first"), LETTER) + bit(F.col("last").isin("-", "\u2010", "\u2011"), HYPHEN)
    )
    word = F.substring_index("t", " ", 1)
    edge = F.when(break_mark, F.concat(word, F.lit(GAP), F.substring_index("t", " ", -1))).otherwise(word)
    return x.select("line_id", "wk", (F.col("index") + F.col("size") + F.col("indent") + bits).alias("pack"), F.when(F.col("caps") | ((F.length("t") <= 60) & F.col("blank")), letters(F.col("t"))).alias("key"), edge.alias("edge"))


def _part(pack: Column, begin: int, bits: int) -> Column:
    return F.shiftright(pack, begin).bitwiseAND((1 << bits) - 1).cast("int")


def indent(pack: Column) -> Column:
    return _part(pack, INDENT, 8)


def size(pack: Column) -> Column:
    return _part(pack, SIZE, 12)


def index(pack: Column) -> Column:
    return F.shiftright(pack, INDEX).cast("int")


def has(bit: int, pack: Column | None = None) -> Column:
    return (F.col("pack") if pack is None else pack).bitwiseAND(bit) > 0


def _order() -> Window:
    return Window.partitionBy("wk").orderBy("pack", "line_id")


def lines_with_shape(lines: DataFrame, labels: DataFrame, works: DataFrame, site: DataFrame) -> DataFrame:
    """Narrow lines with their labels, their likeness to titles, and whether the work is scanned."""
    title = works.where("work_id is not null").groupBy(F.xxhash64("work_id").alias("wk")).agg(letters(F.max_by(F.coalesce("work", F.lit("")), F.struct("ingested_at", "work_row"))).alias("title"))
    # A label in one number, so that labels are hashed, not sorted: role, level, and whether the next line is joined.
    role = F.when(F.col("role") == "heading", 1).when(F.col("role") == "verse_line", 2).when(F.col("role") == "prose", 0).when(F.col("role").isNull(), 0).otherwise(3)
    packed = role * 1024 + F.greatest(F.lit(0), F.least(F.coalesce("level", F.lit(0)), F.lit(200))) * 4 + F.when(F.col("join_next"), 2).when(F.col("join_next").isNotNull(), 1).otherwise(0)
    label = labels.groupBy("line_id").agg(F.max(packed.cast("int")).alias("label"))
    x = narrow(lines).join(label.hint("shuffle_hash"), "line_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    x = x.join(site.select("line_id", F.lit(True).alias("site_line")).hint("shuffle_hash"), "line_id", "left").withColumn("site_line", F.coalesce("site_line", F.lit(False)))
    heading = F.col("label").bitwiseAND(3072) == 1024
    x = x.withColumn("key", F.when(has(CAPS) | heading, F.col("key"))).join(title.hint("shuffle_hash"), "wk", "left")
    x = x.withColumns({"role": F.shiftright("label", 10), "level": F.shiftright("label", 2).bitwiseAND(255)})
    # A work is scanned when its paragraphs are indented.
    paragraph = (F.col("role") == 0) & indent(F.col("pack")).between(2, 4) & ~has(CAPS) & (size(F.col("pack")) > 30)
    scanned = F.max(paragraph.cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 1
    head = F.last(F.when((F.col("role") == 1) & (F.col("level") >= 2), F.col("key")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumns({"scanned": scanned, "head": head})
    x = x.withColumn("is_number", F.col("scanned") & has(NUMBER) & (has(BLANK) | (indent(F.col("pack")) > 0)) & (F.col("level") == 0))
    near = lambda other: F.when(has(CAPS) & F.col("key").isNotNull() & (F.length(other) >= 4), F.levenshtein("key", other) <= F.greatest(F.length("key"), F.length(other)) * 0.2).otherwise(False)
    x = x.withColumn("repeats", F.coalesce(near(F.col("title")) | near(F.col("head")), F.lit(False)))
    join_next = F.when(F.col("label").bitwiseAND(3) == 2, True).when(F.col("label").bitwiseAND(3) == 1, False)
    return x.select("line_id", "wk", "pack", "edge", "role", "level", join_next.alias("join_next"), "site_line", "scanned", "is_number", "repeats")


def _shape_columns(x: DataFrame) -> DataFrame:
    p = F.col("pack")
    return x.withColumns({
        "f_caps": has(CAPS).cast("int"), "f_level": F.least("level", F.lit(3)), "f_role": F.when(F.col("role").isin(1, 2), F.col("role")).otherwise(0), "f_indent": _bin(indent(p), 0, 2, 3, 4, 8),
        "f_blank": has(BLANK).cast("int"), "f_digits": has(DIGITS).cast("int"), "f_length": _bin(size(p), 15, 30, 50, 75), "f_spaced": has(SPACED).cast("int"), "f_stop": has(STOP).cast("int"),
    })


PAIR = ["p_next", "p_indent", "p_blank", "p_scanned"]
PAIR_SIZES = {"p_next": 2, "p_indent": 6, "p_blank": 2, "p_scanned": 2}


def pair_features(here: Column, after: Column) -> dict[str, Column]:
    """The features of a line and the next one that isn't furniture, from their packs; `after` is null behind the last line."""
    body = F.coalesce(has(BODY, after), F.lit(False))
    return {
        "p_next": F.when(body, 1).otherwise(0),
        "p_indent": F.when(body, _bin(indent(after), 0, 2, 3, 4)).otherwise(0),
        # Blank lines around furniture that was taken out say nothing about the paragraph.
        "p_blank": F.when(index(after) > index(here) + 1, 0).when(after.isNull(), 1).otherwise(has(BLANK, after).cast("int")),
        "p_scanned": F.col("scanned").cast("int"),
    }


def pairs(told: DataFrame) -> DataFrame:
    """Lines with the packs of the lines beside them that aren't furniture, and the next one's id and edge."""
    skip = lambda f, c: F.expr(f"{f}(if(furniture, null, {c})) ignore nulls over (partition by wk order by pack, line_id)")
    x = told.withColumn("pack", F.col("pack") + F.when(F.col("body"), BODY).otherwise(0))
    return x.withColumns({"n_pack": skip("lead", "pack"), "n_id": skip("lead", "line_id"), "n_edge": skip("lead", "edge"), "b_pack": skip("lag", "pack")})


def _counted(df: DataFrame, names: list[str], label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and number of rows of each combination there is: no more than the features have values."""
    rows = df.groupBy(*names, F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values([*names, "y"])
    return np.clip(rows[names].to_numpy(np.int64), 0, 15), rows["y"].to_numpy(float), rows["n"].to_numpy(float)


def fit_lines(lines: DataFrame, labels: DataFrame, works: DataFrame, site: DataFrame) -> tuple[Boost, Boost]:
    """The classifiers of running heads and of pairs of lines, fitted on about SAMPLE_WORKS works, those of the least hashes."""
    n = works.where("work_id is not null").select(F.xxhash64("work_id").alias("wk")).distinct().count()
    some = F.pmod(F.xxhash64("work_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_WORKS / max(n, 1)))
    part = lines.where(some & F.col("work_id").isNotNull())
    ids = cut_table(part.select("line_id"))
    if ids.count() * 16 <= BROADCAST_LIMIT:
        ids = F.broadcast(ids)
    x = cut_table(_shape_columns(lines_with_shape(part, labels.join(ids, "line_id", "left_semi"), works.where(some), site.join(ids, "line_id", "left_semi"))))
    taught = x.where(F.col("scanned") & ~F.col("site_line") & ~F.col("is_number") & (has(CAPS) | (F.col("level") >= 1) | (indent(F.col("pack")) > 0) | (F.pmod(F.xxhash64("line_id"), F.lit(7)) == 0))).withColumn("y", F.col("repeats") & (F.col("level") == 0))
    heads = Boost(SHAPE, rounds=16).fit(*_counted(taught, SHAPE, "y"))
    p = pairs(_told(x, heads).drop(*SHAPE))
    p = p.withColumns(pair_features(F.col("pack"), F.col("n_pack")))
    known = p.where(~F.col("furniture") & (index(F.col("n_pack")) == index(F.col("pack")) + 1) & F.col("body") & F.col("join_next").isNotNull())
    joins = Boost(PAIR, rounds=20).fit(*_counted(known, PAIR, "join_next"))
    return heads, joins


def _told(x: DataFrame, heads: Boost) -> DataFrame:
    """Which lines are running heads, furniture at all, and body text."""
    shape = heads.lookup(SHAPE_SIZES)
    head = F.col("scanned") & ~F.col("site_line") & has(CAPS) & (F.col("level") == 0) & (F.col("role") != 2) & (F.col("repeats") | shape)
    x = x.withColumn("running_head", head & ~F.col("is_number")).withColumn("furniture", F.col("running_head") | F.col("is_number"))
    return x.withColumn("body", (F.col("role") == 0) & (size(F.col("pack")) > 0) & ~F.col("furniture") & ~F.col("site_line"))


def judged_lines(lines: DataFrame, labels: DataFrame, works: DataFrame) -> DataFrame:
    """line_id, wk, line_index, scanned, running_head, is_number, body, join_next, goes_on (the paragraph
    does), broken, continues, hyphen, and the words at the line's end (tail) and after it (after).

    Without texts: those are read again where they lie.
    """
    # Each line of a repeated block is repeated itself, so the blocks needn't be put together to leave out their lines.
    site = repeated_lines(lines, works)[0].select("line_id")
    heads, joins = fit_lines(lines, labels, works, site)
    told = _told(_shape_columns(lines_with_shape(lines, labels, works, site)), heads)
    # All windows are of one order, so lines are sorted once; furniture is skipped as null.
    p = pairs(told.select("line_id", "wk", "pack", "edge", "join_next", "scanned", "running_head", "is_number", "furniture", "body"))

    def goes_on(here: Column, after: Column) -> Column:
        at = F.lit(0)
        for name, c in pair_features(here, after).items():
            at = at * PAIR_SIZES[name] + c
        return has(BODY, here) & F.coalesce(has(BODY, after), F.lit(False)) & joins.looked_up(at, PAIR_SIZES)

    broken = lambda here, after: has(BROKEN, here) & F.coalesce(has(LETTER, after), F.lit(False))
    pack, after, before = F.col("pack"), F.col("n_pack"), F.col("b_pack")
    p = p.withColumn("goes_on", ~F.col("furniture") & goes_on(pack, after)).withColumn("broken", F.col("goes_on") & broken(pack, after))
    p = p.withColumn("continues", ~F.col("furniture") & F.coalesce(has(BROKEN, before) & goes_on(before, pack) & has(LETTER, pack), F.lit(False)))
    when = lambda c: F.when(F.col("broken"), c)
    return p.select(
        "line_id", "wk", index(pack).alias("line_index"), "scanned", "running_head", "is_number", "body", "join_next", "goes_on", "broken", "continues", has(HYPHEN).alias("hyphen"),
        when(F.substring_index("edge", GAP, -1)).alias("tail"), when(F.substring_index("n_edge", GAP, 1)).alias("after"), when(F.col("n_id")).alias("n_id"),
    )


def tidy(word: str) -> str:
    """A word in its usual characters, as problem 6 has them; look-alikes only where all of it can be Latin."""
    if word.isascii():
        return word
    word = plain(word)
    if any(c in LOOKALIKES for c in word) and any("a" <= c <= "z" for c in word.lower()):
        word = "".join(LOOKALIKES.get(c, c) for c in word)
    return word


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of the batch with their number, by whether the work is scanned. Words of capitals alone are left out."""
    for b in batches:
        for flag in (True, False):
            texts = b.column(0).filter(pc.equal(b.column(1), flag))
            counts = pc.value_counts(pc.list_flatten(pc.split_pattern_regex(texts, pattern=_WORD)))
            words, n = counts.field("values"), counts.field("counts")
            usual = [_known_as(w) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(usual, pa.string()), pa.array([flag] * len(words), pa.bool_()), n.cast(pa.int64())], names=["raw", "word", "scanned", "n"])


def _known_as(word: str) -> str:
    word = tidy(word)
    return "" if len(word) > 1 and word.isupper() or len(word) > 40 else word


def _bigrams(c: Column) -> Column:
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(padded, i, 2)))


@lru_cache(1)
def _by_letter() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for right, wrong in CONFUSIONS:
        out.setdefault(wrong, []).append((right, wrong))
    return out


def edit_shape(read: str, meant: str) -> tuple[float, int]:
    """The cheapest way from what was meant to what was read, where a known confusion costs a part of an edit, and the edits that are none."""
    n, m = len(meant), len(read)
    if abs(n - m) > 3:
        return 9.0, 9
    far = (9.0, 9)
    d = [[far] * (m + 1) for _ in range(n + 1)]
    d[0][0] = (0.0, 0)
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 and j == 0:
                continue
            best = far
            if i and j:
                c, k = d[i - 1][j - 1]
                if meant[i - 1] == read[j - 1]:
                    best = (c, k)
                else:
                    known = (meant[i - 1], read[j - 1]) in _PAIRS
                    same = not known and _base(meant[i - 1]) == _base(read[j - 1])
                    best = (c + (0.35 if known else 0.5 if same else 1.0), k + (not known))
            if i:
                c, k = d[i - 1][j]
                best = min(best, (c + 1.0, k + 1))
            if j:
                c, k = d[i][j - 1]
                best = min(best, (c + 1.0, k + 1))
            if i and j > 1 and (meant[i - 1], read[j - 2 : j]) in _PAIRS:
                c, k = d[i - 1][j - 2]
                best = min(best, (c + 0.4, k))
            if i > 1 and j and (read[j - 1], meant[i - 2 : i]) in _PAIRS:
                c, k = d[i - 2][j - 1]
                best = min(best, (c + 0.4, k))
            d[i][j] = best
    return d[n][m]


_PAIRS = frozenset(CONFUSIONS) | {(b, a) for a, b in CONFUSIONS if len(b) == 1}


@lru_cache(1 << 12)
def _base(c: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFD", c)[0]


RANK = ["r_cost", "r_other", "r_read", "r_meant", "r_known", "r_seen", "r_first", "r_last", "r_capital", "r_overlap"]


def _rank_features(read: list[str], meant: list[str], known: np.ndarray, seen: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    rows = []
    for a, b, k, s, o in zip(read, meant, known, seen, overlap):
        low = a[0].lower() + a[1:]
        cost, other = edit_shape(low, b)
        rows.append((min(15, int(cost * 4)), min(3, other), min(15, len(a)), min(15, len(b)), min(15, int(np.log2(k + 1))), min(15, int(np.log2(s + 1))), low[0] == b[0], low[-1] == b[-1], a[0].isupper(), min(15, int(o * 16))))
    return np.array(rows, np.int64).reshape(-1, len(RANK))


def fit_ranking(vocabulary: pd.DataFrame, right: pd.DataFrame, seed: int = 5) -> Boost:
    """vocabulary: word and n; right: word, candidate, n, seen and overlap of words that are rare but right."""
    rng = random.Random(seed)
    words = [(w, n) for w, n in zip(vocabulary["word"], vocabulary["n"]) if len(w) >= 3]
    read, meant, known, seen, overlap = [], [], [], [], []
    for w, n in words[:SAMPLE_WORDS] * 2:
        spots = [(i, a, b) for a, b in CONFUSIONS for i in range(len(w)) if w.startswith(a, i)]
        if not spots:
            continue
        for i, a, b in rng.sample(spots, min(len(spots), 1 + (len(w) > 6 and rng.random() < 0.15))):
            x = w[:i] + b + w[i + len(a) :]
            x = x[0].upper() + x[1:] if rng.random() < 0.2 else x
            ga, gb = ({f"^{s}$"[k : k + 2] for k in range(len(s) + 1)} for s in (x.lower(), w))
            read.append(x), meant.append(w), known.append(n), seen.append(1 + int(rng.expovariate(0.5))), overlap.append(len(ga & gb) / max(1, len(ga | gb)))
    good = _rank_features(read, meant, np.array(known), np.array(seen), np.array(overlap))
    bad = _rank_features(right["word"].tolist(), right["candidate"].tolist(), right["n"].to_numpy(), right["seen"].to_numpy(), right["overlap"].to_numpy())
    return Boost(RANK, rounds=30).fit(np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))]))


def candidates(asked: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of a word that is asked for and a candidate within so many edits that two confusions can explain it.

    asked: low and other columns; words: candidate and other columns. An inverted index has the rarest
    bigrams of each candidate, one more than confusions can destroy, so that no candidate is missed and
    no frequent bigram brings together all words that have it.
    """
    grams = cut_table(words.select("candidate", F.explode(_bigrams(F.col("candidate"))).alias("g")))
    ranked = grams.join(grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "g")
    most = F.when(F.length("candidate") <= SHORT, DESTROYED_SHORT).otherwise(DESTROYED) + 1
    index = ranked.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs")).select("candidate", F.explode(F.slice("gs", F.lit(1), most)).alias("e")).select("candidate", "e.g")
    few = lambda c: F.when(F.length(c) <= SHORT, EDITS_SHORT).otherwise(EDITS)
    probe = asked.select("low", F.explode(_bigrams(F.col("low"))).alias("g")).distinct()
    near = F.abs(F.length("low") - F.length("candidate")) <= 2
    pairs = probe.join(index, "g").where(near).select("low", "candidate").distinct().where(F.levenshtein("low", "candidate") <= F.greatest(few("low"), few("candidate")))
    return asked.join(pairs, "low").join(words, "candidate")


def corrections(body: DataFrame) -> DataFrame:
    """raw (as it stands in the lines), meant and chance of the misread words; body: text and scanned of lines and of whole words that are broken in them."""
    counted = cut_table(body.mapInArrow(_words, "raw string, word string, scanned boolean, n bigint").where("word <> ''").groupBy("raw", "word", "scanned").agg(F.sum("n").alias("n")))
    capital = F.col("word").rlike(r"^\p{Lu}")
    low = F.concat(F.lower(F.substring("word", 1, 1)), F.expr("substr(word, 2)"))
    per = counted.withColumns({"capital": capital, "low": low}).groupBy("low").agg(F.sum(F.when(~F.col("scanned") & ~capital, F.col("n")).otherwise(0)).alias("plain_n"), F.sum(F.when(~F.col("scanned") & capital, F.col("n")).otherwise(0)).alias("capital_n"))
    words = per.where("length(low) >= 2 and low rlike '^[\\\\p{L}]+$'").where(F.col("plain_n") >= KNOWN).select(F.col("low").alias("candidate"), F.col("plain_n").alias("n"), "capital_n")
    # Words of scanned works that the others don't have, and a sample of words of the others that are as rare.
    word_n = counted.groupBy("word").agg(F.sum(F.when(F.col("scanned"), F.col("n")).otherwise(0)).alias("seen"), F.sum(F.when(F.col("scanned"), 0).otherwise(F.col("n"))).alias("other"))
    word_n = word_n.withColumn("low", low).join(per, "low").withColumn("capital", capital)
    lettered = F.col("word").rlike(r"\p{L}") & (F.length("word") >= 2)
    unknown = word_n.where(lettered & (F.col("seen") > 0) & (F.col("other") == 0) & (F.col("plain_n") < KNOWN)).select("word", "low", "capital", "seen", F.lit(False).alias("right"))
    rare = word_n.where(lettered & (F.col("other").between(1, 3)) & (F.col("plain_n") < KNOWN)).select("word", "low", "capital", F.col("other").alias("seen"), F.lit(True).alias("right")).orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS)
    asked = cut_table(unknown.union(rare))
    # Words with a capital can only be misread from words that stand with one elsewhere.
    both = lambda f: F.size(f(_bigrams(F.col("low")), _bigrams(F.col("candidate"))))
    hit = candidates(asked, words).where(~F.col("capital") | (F.col("capital_n") >= KNOWN_CAPITAL)).select("word", "right", "seen", "candidate", "n", (both(F.array_intersect) / both(F.array_union)).alias("overlap"))
    hit = cut_table(hit)
    vocabulary = words.select(F.col("candidate").alias("word"), "n").orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).toPandas()
    right = hit.where("right").orderBy(F.xxhash64("word", "candidate"), "word", "candidate").limit(SAMPLE_WORDS * 10).toPandas()
    model = body.sparkSession.sparkContext.broadcast(fit_ranking(vocabulary, right))

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _rank_features(b["word"].tolist(), b["candidate"].tolist(), b["n"].to_numpy(), b["seen"].to_numpy(), b["overlap"].to_numpy())
            yield pd.DataFrame({"word": b["word"], "candidate": b["candidate"], "n": b["n"], "chance": model.value.probability(x)})

    best = hit.where("not right").mapInPandas(ranked, "word string, candidate string, n bigint, chance double").groupBy("word").agg(F.max_by("candidate", F.struct("chance", "n", "candidate")).alias("meant"), F.max("chance").alias("chance"))
    # A sign or digit inside a word is a misread letter, whatever the word was.
    mixed = asked.where(~F.col("right") & F.col("word").rlike(r"\p{L}[0-9|!]+\p{L}|^[0-9|][\p{L}|]{2,}$|\p{L}{2,}[0-9|]$")).select("word", F.lit(None).cast("string").alias("meant0"), F.lit(True).alias("mixed"))
    told = best.join(mixed, "word", "full").where((F.col("chance") > 0.5) | F.col("mixed")).select("word", F.when(F.col("chance") > 0.5, F.col("meant")).alias("meant"), "chance")
    return counted.where("scanned").select("raw", "word").distinct().join(told, "word").select("raw", "meant", "chance")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(W.hash_words(b.column(0)).view(np.int64))], names=["hash"])


def _holding(known: Bitmap):
    """A mapInArrow function: lines to those of their words that the bitmap may have, and whether each stands first or last."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pc.split_pattern_regex(b.column(1), pattern=_WORD)
            flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
            real = pc.greater(pc.binary_length(flat), 0)
            flat, parent = flat.filter(real), parent.filter(real).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(known.has(W.hash_words(flat)))
            first = np.searchsorted(parent, parent[hit], "left") == hit
            last = np.searchsorted(parent, parent[hit], "right") - 1 == hit
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(parent[hit])), flat.take(pa.array(hit)), pa.array(first), pa.array(last)], names=["line_id", "raw", "first", "last"])

    return over


def _texts(lines: DataFrame, judged: DataFrame) -> DataFrame:
    """line_id, text and scanned of all lines: the works that are scanned are looked up by hash."""
    scanned = cut_table(judged.where("scanned").select("wk").distinct())
    if scanned.count() * 16 <= BROADCAST_LIMIT:
        scanned = F.broadcast(scanned)
    return lines.where("text is not null").select("line_id", "text", F.xxhash64("work_id").alias("wk")).join(scanned.withColumn("s", F.lit(True)), "wk", "left").select("line_id", "text", F.coalesce("s", F.lit(False)).alias("scanned"))


def _whole() -> Column:
    return F.concat(F.regexp_replace("tail", BREAK, ""), F.col("after"))


def broken_lines(judged: DataFrame) -> DataFrame:
    """What split words and corrections need of the lines that end in a broken word."""
    return cut_table(judged.where("broken").select("line_id", "scanned", "hyphen", "tail", "after", "n_id"))


def _misread(lines: DataFrame, judged: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """line_id, raw and the line it is misread at, of the misread words of body text, broken ones as a whole; and the corrections.

    The misread words are looked for where the lines are read, by a bitmap of bounded size, and what it
    lets through is joined to them: the same way however many there are.
    """
    texts = _texts(lines, judged)
    whole = broken.where("scanned").select("line_id", _whole().alias("text"), "scanned")
    fixed = cut_table(corrections(texts.select("text", "scanned").union(whole.select("text", "scanned"))))
    # A broken word is misread where its right form leaves the one that was read.
    meant = fixed.groupBy("raw").agg(F.max_by("meant", "chance").alias("meant"))
    known = lines.sparkSession.sparkContext.broadcast(bitmap(fixed.select("raw").mapInArrow(_hashed, "hash bigint")))
    # Signs at both ends keep the whole of a broken word from counting as half of one.
    seen = texts.where("scanned").select("line_id", "text").union(whole.select("line_id", F.concat(F.lit("\0 "), F.col("text"), F.lit(" \0"))))
    kind = dict(lines.dtypes)["line_id"]
    hits = seen.mapInArrow(lambda it: _holding(known.value)(it), f"line_id {kind}, raw string, first boolean, last boolean").join(meant, "raw")
    # Halves of broken words are no words.
    ends = broken.select("line_id", F.lit(True).alias("broken"), F.regexp_replace("tail", BREAK, "").alias("head"), F.col("after").alias("rest"), "n_id")
    found = hits.join(judged.where("scanned and body").select("line_id", "continues"), "line_id").join(ends, "line_id", "left").withColumn("broken", F.coalesce("broken", F.lit(False))).where("not (first and continues) and not (last and broken)")
    whole = F.col("broken") & ~F.col("first") & ~F.col("last") & F.col("rest").isNotNull() & (F.concat("head", F.col("rest")).startswith(F.col("raw")))
    in_head = F.when(F.col("meant").isNotNull(), ~F.lower("meant").startswith(F.lower("head"))).otherwise(F.col("head").rlike(r"[0-9|!]"))
    return found.select("line_id", "raw", F.when(whole & ~in_head, F.col("n_id")).otherwise(F.col("line_id")).alias("at")), fixed


def defects(lines: DataFrame, labels: DataFrame, works: DataFrame) -> DataFrame:
    """line_id and defect: split_word, misread, running_head, page_number or wrong_join.

    Lines without a label count as prose at level 0 and are never wrong joins while they end a
    paragraph; null texts are empty lines; a line labelled twice has its greatest label. Lines of
    unknown works have no title to repeat. An empty table gives no rows.
    """
    judged = cut_table(judged_lines(lines, labels, works))
    broken = broken_lines(judged)
    misread, _ = _misread(lines, judged, broken)
    own = F.array(
        F.when(F.col("running_head"), F.lit("running_head")), F.when(F.col("is_number"), F.lit("page_number")),
        F.when(F.col("body") & (F.coalesce("join_next", F.lit(False)) != F.col("goes_on")), F.lit("wrong_join")),
    )
    out = judged.select("line_id", F.explode(F.array_compact(own)).alias("defect"))
    split = split_words(lines, broken).select("line_id", F.lit("split_word").alias("defect"))
    return out.unionByName(split).unionByName(misread.select(F.col("at").alias("line_id"), F.lit("misread").alias("defect")).distinct())


def split_words(lines: DataFrame, broken: DataFrame) -> DataFrame:
    """Lines whose last word is broken: all that end in another sign than a hyphen, and those with a
    hyphen where the text doesn't know the compound. In works that aren't scanned only compounds are parted."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}-]+", ""))
    head = clean(F.regexp_replace("tail", BREAK, ""))
    asked = cut_table(broken.select("line_id", "scanned", "hyphen", F.concat(head, F.lit("-"), clean(F.col("after"))).alias("compound")))
    compounds = asked.where("hyphen and scanned").select("compound").distinct()
    inner = r"\p{L}+(?:-\p{L}+)+"
    known = lines.where(F.col("text").contains("-") & F.col("text").rlike(r"\p{L}-\p{L}")).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(inner), F.lit(0))).alias("compound")).groupBy("compound").agg(F.count(F.lit(1)).alias("n")).join(compounds, "compound", "left_semi")
    return asked.join(known, "compound", "left").where(~F.col("hyphen") | (F.col("scanned") & (F.coalesce("n", F.lit(0)) < 2))).select("line_id")


def paragraphs(lines: DataFrame, labels: DataFrame, works: DataFrame) -> DataFrame:
    """work_id, paragraph and text: each work's body text in whole paragraphs, without furniture, its words mended.

    Paragraphs are numbered in order of the lines they begin with. Works without body text have none.
    """
    judged = cut_table(judged_lines(lines, labels, works))
    broken = broken_lines(judged)
    misread, fixed = _misread(lines, judged, broken)
    meant = fixed.where("meant is not null").groupBy("raw").agg(F.max_by("meant", "chance").alias("meant"))
    words = misread.join(meant, "raw").groupBy("line_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("raw", "meant")))).alias("meant"))
    split = split_words(lines, broken).select("line_id", F.lit(True).alias("split"))
    x = judged.where("body").join(lines.select("line_id", "work_id", F.coalesce("text", F.lit("")).alias("text")), "line_id").join(split, "line_id", "left").join(words, "line_id", "left")
    t = F.when(F.col("continues"), F.regexp_replace("text", r"^\S+\s*", "")).otherwise(F.col("text"))
    whole = F.when(F.col("split").isNull(), F.concat("tail", F.col("after"))).otherwise(_whole())
    inner = F.when(F.col("broken"), F.concat(F.regexp_replace(t, r"\S+$", ""), whole)).otherwise(t)
    parts = r"[^\s,.;:?\x{201C}\x{201D}\"\x{AB}\x{BB}()\[\]\x{2014}\x{2013}\x{2026}'\x{2019}\x{2018}-]+|[\s,.;:?\x{201C}\x{201D}\"\x{AB}\x{BB}()\[\]\x{2014}\x{2013}\x{2026}'\x{2019}\x{2018}-]+"

    def mend(p: Column) -> Column:
        new = F.try_element_at("meant", p)
        capital = (F.lower(F.left(p, F.lit(1))) != F.left(p, F.lit(1))) & new.isNotNull()
        return F.when(capital, F.concat(F.upper(F.left(new, F.lit(1))), F.substr(new, F.lit(2)))).otherwise(F.coalesce(new, p))

    mended = F.when(F.col("meant").isNull(), F.col("inner")).otherwise(F.array_join(F.transform(F.regexp_extract_all("inner", F.lit(parts), F.lit(0)), mend), ""))
    w = Window.partitionBy("wk").orderBy("line_index", "line_id")
    number = F.sum((~F.coalesce(F.lag("goes_on").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    done = x.withColumn("inner", inner).withColumn("mended", mended).withColumn("paragraph", number)
    pieces = F.array_sort(F.collect_list(F.struct("line_index", "line_id", F.trim("mended").alias("t"))))
    return done.groupBy("work_id", "paragraph").agg(F.array_join(F.filter(F.transform(pieces, lambda s: s["t"]), lambda s: s != ""), " ").alias("text")).where("text <> ''")
