"""Spellings of one name (problem 3): a metric join of names by their tokens.

Names are taken apart into tokens without accents, case, titles and marks of the typist. Two names
can only be the same when they share an anchor, one of their tokens or, for titles and bodies, all
of them joined, up to one edit of the Damerau-Levenshtein metric; however many names have a token,
it stays an anchor, and its names are parted by their other words or the initials of those. That radius join is a partition of the metric space: the pivots of a
token are the strings that it reaches by leaving out at most RADIUS letters, and tokens within
RADIUS edits of each other have a pivot in common, so a token belongs to the cells of its pivots,
as many as it has letters and one, however many tokens there are. Inside a cell the true metric
decides. Names whose tokens meet are then compared as a whole: given names by equality, initial,
nickname or one edit, bodies and titles token by token with abbreviations. Two spellings that both
match a third are compared again with twice the radius.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm.tables import cut_table
from quiremill.session import shuffled

RADIUS = 1
#: Stands before the joined words of a title or body, which are a token of their own.
JOINED = "==="

# Short forms of given names.
NICKNAMES = {
    "al": "alexander", "alec": "alexander", "alex": "alexander", "sandy": "alexander", "gus": "augustus", "lottie": "charlotte", "charlie": "charlotte", "dolly": "dorothea", "dora": "dorothea", "dot": "dorothea",
    "ned": "edward", "ed": "edward", "eddie": "edward", "betty": "elizabeth", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "tienot": "etienne", "steve": "etienne",
    "fritz": "frederick", "fred": "frederick", "freddy": "frederick", "hettie": "henrietta", "etta": "henrietta", "hetty": "henrietta", "inge": "ingrid", "bella": "isabella", "belle": "isabella", "izzy": "isabella", "jo": "joachim josephine",
    "josie": "josephine", "kitty": "katherine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "leo": "leopold", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "greta": "margaret",
    "mela": "melanie", "mel": "melanie", "nat": "nathaniel", "nate": "nathaniel", "ozzie": "oswald", "oz": "oswald", "bob": "robert", "rob": "robert", "bobby": "robert", "robin": "robert", "ted": "theodore", "theo": "theodore", "teddy": "theodore",
    "ursie": "ursula", "uschi": "ursula", "vicky": "victoria", "vic": "victoria", "tori": "victoria", "bill": "william", "will": "william", "willy": "william", "liam": "william", "vonnie": "yvonne", "evie": "yvonne", "zack": "zachary", "zach": "zachary",
}
TITLES = {"dr", "prof", "professor", "rev", "reverend", "sir", "mr", "mrs", "miss", "ms", "fr", "st", "dame", "lord", "lady", "mme", "mlle", "m"}
BODY_WORDS = ("society", "institute", "press", "collective", "committee", "mission", "board", "letters", "fathers", "translation", "editorial", "academy", "university", "college", "association", "club", "company", "library", "guild", "council", "commission", "foundation", "bureau", "league", "union", "group", "text")
ARTICLES = {"the", "a", "an", "ye", "le", "la", "les", "l", "un", "une", "and", "et", "of", "in", "de", "d", "du", "des", "xu", "の"}
MARKS = {"reprint", "reprinted", "complete", "illustrated", "unabridged", "annotated", "revised", "edition", "ed", "new", "vol", "facsimile"}
SAME_SPELLING = (("our", "or"), ("ise", "ize"), ("centre", "center"), ("theatre", "theater"))
_PART = re.compile(r"[,;:.(\[]?\s*\b(?:part|volume|vol|book|bk|tome|tap|quyen|phan|livre|partie)\b\.?\s*([ivxlcdm]+|\d+)\b[)\]]?|第\s*(\d+)\s*[巻部]")
_EDITOR = re.compile(r"\((?:[^()]*\b(?:trans|tr|eds?|translators?|editors?)\b\.?[^()]*)\)|^\s*(?:tr|trans|transl|ed|translated|edited)\.?\s+by\s+|,\s*(?:trans|tr|eds?)\.\s*$")
_TOKEN = re.compile(r"[ァ-ヺー]+|[一-鿿々]+|[ぁ-ん]+|(?:(?![ァ-ヺー一-鿿々ぁ-ん])[^\W\d_])+\.?|\d+")


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s)).lower().replace("đ", "d").replace("œ", "oe").replace("æ", "ae").replace("’", "'")
    kept = "".join(c for c in s if not unicodedata.combining(c) or c in "゙゚")
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", kept)).strip()


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance with any transpositions, a metric; most + 1 stands for anything greater."""
    if a == b:
        return 0
    # Most pairs are told apart by length, by letters that only one has, or by what is left without common ends.
    if abs(len(a) - len(b)) > most or (len(a) > 2 and (len(set(a).difference(b)) > most or len(set(b).difference(a)) > most)):
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if most == 1:
        return 1 if len(a) <= 1 and len(b) <= 1 or len(a) == len(b) == 2 and a == b[::-1] else 2
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    big = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return min(d[len(a) + 1][len(b) + 1], most + 1)


@lru_cache(1 << 17)
def parse(field: str, value: str) -> tuple[str, str, tuple[tuple[str, ...], ...]]:
    """Kind (title, body or people), part, and the tokens of each person or of the whole; a dot stays on abbreviations."""
    s = fold(value)
    part = ""
    if field == "work":
        m = _PART.search(s)
        if m:
            part, s = (m[1] or m[2]), s[: m.start()] + " " + s[m.end() :]
            part = str(_roman(part)) if not part.isdigit() else str(int(part))
        tokens = [t for t in _TOKEN.findall(s) if t.rstrip(".") not in ARTICLES]
        kept = [t for t in tokens if t.rstrip(".") not in MARKS] or tokens
        return "title", part, (tuple(_spelling(t) for t in kept),)
    bare = _EDITOR.sub(" ", s)
    tokens = _TOKEN.findall(bare)
    if not tokens:
        tokens, bare = _TOKEN.findall(s), s
    if _is_body(tokens):
        return "body", "", (tuple(t for t in tokens if t.rstrip(".") not in ARTICLES and t != "f."),)
    people = []
    for one in re.split(r";|\s&\s|\s(?:and|et|und|y)\s", bare):
        last, comma, first = one.partition(",")
        words = _TOKEN.findall(first) + _TOKEN.findall(last) if comma else _TOKEN.findall(one)
        words = [w for w in words if w.rstrip(".") not in TITLES or len(w.rstrip(".")) == 1] or words
        if words:
            people.append(tuple(words))
    return "people", "", tuple(people)


def _is_body(tokens: list[str]) -> bool:
    if not {"of", "for"}.isdisjoint(tokens):
        return True
    for t in tokens:
        w = t.rstrip(".")
        if w in BODY_WORDS or (t.endswith(".") and len(w) > 2 and any(b.startswith(w) for b in BODY_WORDS) and w not in TITLES):
            return True
        if len(w) > 5 and any(abs(len(w) - len(b)) < 2 and distance(w, b, 1) < 2 for b in BODY_WORDS):
            return True
    return False


def _spelling(t: str) -> str:
    for a, b in SAME_SPELLING:
        if len(t) > 5 and t.endswith(a):
            return t[: -len(a)] + b
    return t


def _roman(s: str) -> int:
    v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n = [v[c] for c in s]
    return sum(-x if x < max(n[i:]) else x for i, x in enumerate(n))


def _short(t: str) -> bool:
    return len(t.rstrip(".")) == 1


def _stands_for(short: str, word: str) -> bool:
    """An abbreviation with its dot: the word's head, or its first letter and others of it in order."""
    s = short.rstrip(".")
    if not short.endswith(".") or not s or not word.startswith(s[0]) or len(s) >= len(word.rstrip(".")):
        return False
    rest = iter(word)
    return all(c in rest for c in s)


def _words_cost(a: str, b: str, most: int) -> int:
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y or _stands_for(a, y) or _stands_for(b, x):
        return 0
    return distance(x, y, most) if min(len(x), len(y)) >= 4 else most + 1


def _all_cost(a: tuple[str, ...], b: tuple[str, ...], most: int) -> int:
    """Edits between two lists of words in any order, of which none may be missing."""
    if len(a) != len(b):
        # One word typed as two, or two as one.
        x, y = "".join(sorted("".join(a))), "".join(sorted("".join(b)))
        return distance("".join(a), "".join(b), most) if x == y or abs(len(a) - len(b)) == 1 else most + 1
    left, total = list(b), 0
    for w in a:
        costs = [(_words_cost(w, v, most), i) for i, v in enumerate(left)]
        cost, i = min(costs)
        total += cost
        if total > most:
            return most + 1
        left.pop(i)
    return total


@lru_cache(1 << 17)
def _given(w: str) -> frozenset[str]:
    """The given names that a word can be: itself, the full name of a nickname, a known name with one typo."""
    w = w.rstrip(".")
    known = {n for full in NICKNAMES.values() for n in full.split()}
    full = NICKNAMES.get(w, "").split() or ([n for n in known if distance(w, n, 1) == 1] if len(w) >= 5 and w not in known else [])
    return frozenset({w, *full})


def _given_cost(a: str, b: str, most: int) -> int:
    x, y = _given(a), _given(b)
    if x & y:
        return 0
    if _short(a) or _short(b):
        return 0 if {w[0] for w in x} & {w[0] for w in y} else most + 1
    return min(distance(v, w, most) if min(len(v), len(w)) >= 4 else most + 1 for v in x for w in y)


def _person_cost(a: tuple[str, ...], b: tuple[str, ...], most: int, lone: bool) -> int:
    best = most + 1
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if _short(x) or _short(y) or min(len(x), len(y)) < 4:
                continue
            cost = distance(x.rstrip("."), y.rstrip("."), most)
            if cost > most:
                continue
            p, q = [w for k, w in enumerate(a) if k != i], [w for k, w in enumerate(b) if k != j]
            if not p or not q:
                best = min(best, cost if not lone or p == q else most + 1)
                continue
            p.sort(key=_short), q.sort(key=_short)  # the given name before initials
            cost += _given_cost(p[0], q[0], most)
            if len(p) > 1 and len(q) > 1 and not {w[0] for w in p[1:]} & {w[0] for w in q[1:]}:
                cost = most + 1
            best = min(best, cost)
    return best


def same(field: str, a: str, b: str, most: int = RADIUS) -> bool:
    """Whether two spellings name the same thing, with at most `most` edits in all words together."""
    ka, pa, xa = parse(field, a)
    kb, pb, xb = parse(field, b)
    if ka != kb or pa != pb or len(xa) != len(xb) or not xa or not xa[0]:
        return False
    if ka != "people":
        return _all_cost(xa[0], xb[0], most) <= most
    orders = [xb, xb[::-1]] if len(xb) > 1 else [xb]
    return any(sum(_person_cost(p, q, most, len(xa) == 1) for p, q in zip(xa, o)) <= most for o in orders)


def pivots(token: str, radius: int = RADIUS) -> set[str]:
    """The strings that a token reaches by leaving out at most `radius` letters, none for tokens of less than four."""
    found = level = {token}
    if len(token) >= 4 or (len(token) >= 3 and token[0] > "぀"):
        for _ in range(radius):
            level = {s[:i] + s[i + 1 :] for s in level for i in range(len(s))}
            found = found | level
    return found


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for field, value in zip(b["field_name"], b["name"]):
            kind, part, people = parse(field, value)
            head = f"{kind}/{len(people)}/{part}/"
            for p in people:
                long = [(i, w.rstrip(".")) for i, w in enumerate(p) if not _short(w)]
                for i, w in long:
                    others = [v for k, v in enumerate(p) if k != i]
                    if kind != "people":
                        # A word that costs an edit is an anchor, so the others are equal or, where one has a dot, begin alike.
                        dotted = any(v.endswith(".") for v in others)
                        rows.append((field, value, w, head + "=" + " ".join(sorted(v.rstrip(".") for v in others)), True))
                        rows.append((field, value, w, head + "".join(sorted(v[0] for v in others)), dotted))
                        continue
                    # Names of people are kept apart by the initials that the given name can have.
                    rows.extend((field, value, w, head + o, True) for o in ({g[0] for v in others for g in _given(v)} or {""}))
                    if len(people) > 1:
                        rows.append((field, value, w, head + "*", True))
                if kind != "people" and p:
                    rows.append((field, value, JOINED + "".join(p), head, True))  # one word typed as two
                elif not long and p:
                    rows.append((field, value, "".join(p), head, True))
        yield pd.DataFrame(rows, columns=["field_name", "name", "token", "sort", "asks"])


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, t, p) for f, t in zip(b["field_name"], b["token"]) for p in pivots(t)]
        yield pd.DataFrame(rows, columns=["field_name", "token", "pivot"])


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[[distance(x, y, RADIUS) <= RADIUS for x, y in zip(b["token"], b["other"])]]


def _same(most: int):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[same(f, x, y, most) for f, x, y in zip(b["field_name"], b["name_a"], b["name_b"])]]

    return over


def token_pairs(tokens: DataFrame) -> DataFrame:
    """field_name, token and other of all pairs of tokens within RADIUS, each both ways and with itself."""
    cells = tokens.mapInPandas(_cells, "field_name string, token string, pivot string").withColumn("cell", F.xxhash64("field_name", "pivot")).drop("pivot")
    pairs = cells.alias("a").join(cells.alias("b"), (F.col("a.cell") == F.col("b.cell")) & (F.col("a.token") < F.col("b.token")) & (F.col("a.field_name") == F.col("b.field_name"))).select("a.field_name", "a.token", F.col("b.token").alias("other")).distinct()
    # The cheap distance in the JVM first: a transposition is two of its edits.
    near = pairs.where(F.levenshtein("token", "other") <= 2 * RADIUS).mapInPandas(_near, "field_name string, token string, other string")
    return near.union(near.select("field_name", "other", "token")).union(tokens.select("field_name", "token", F.col("token").alias("other")))


def linked_names(names: DataFrame) -> DataFrame:
    """field_name, name_a and name_b of all pairs of different spellings of the same name, name_a smaller by code points.

    names: field_name (`translator` for people and bodies, `work` for titles) and name. Nulls, blanks
    and names without a letter or digit match nothing; equal names count once.
    """
    distinct = names.select("field_name", "name").where(F.col("name").rlike(r"[\p{L}\p{N}]")).distinct()
    anchors = cut_table(shuffled(distinct).mapInPandas(_tokens, "field_name string, name string, token string, sort string, asks boolean").withColumn("sort", F.xxhash64("sort")).distinct())
    near = token_pairs(anchors.select("field_name", "token").distinct())
    # Either name may be the one that asks.
    left = anchors.where("asks").join(near, ["field_name", "token"]).select("field_name", F.col("name").alias("x"), F.col("other").alias("token"), "sort")
    right = anchors.select("field_name", F.col("name").alias("y"), "token", "sort")
    candidates = left.join(right, ["field_name", "token", "sort"]).where("x <> y").select("field_name", F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b")).distinct()
    shape = "field_name string, name_a string, name_b string"
    direct = cut_table(shuffled(candidates).mapInPandas(_same(RADIUS), shape))
    both = direct.union(direct.select("field_name", F.col("name_b"), F.col("name_a")))
    by_third = both.alias("x").join(both.alias("y"), (F.col("x.field_name") == F.col("y.field_name")) & (F.col("x.name_b") == F.col("y.name_a")) & (F.col("x.name_a") < F.col("y.name_b"))).select("x.field_name", "x.name_a", F.col("y.name_b").alias("name_b")).distinct()
    more = by_third.join(direct, ["field_name", "name_a", "name_b"], "left_anti").mapInPandas(_same(2 * RADIUS), shape)
    return direct.union(more)
