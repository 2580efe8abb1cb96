"""Texts as arrays of code points: classes, lines and words of a whole batch at once."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from quiremill.llm.words import mix

SIZE = 1 << 16
SPACE, TAB, NEWLINE, LATIN, HIRAGANA, KATAKANA, HAN, OTHER_LETTER, DIGIT, STOP, COMMA, QUOTE, DASH, PIPE, SEMICOLON, SYMBOL = range(16)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = np.uint64(pow(_P, -1, 1 << 64))


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point of the BMP; those above count as symbols or Han by clipping."""
    kind, low = np.full(SIZE, SYMBOL, np.uint8), np.arange(SIZE, dtype=np.uint32)
    for i in range(SIZE):
        c = chr(i)
        g = unicodedata.category(c)
        if g[0] == "L":
            name = unicodedata.name(c, "")
            kind[i] = LATIN if name.startswith("LATIN") else HIRAGANA if "HIRAGANA" in name and c != "ー" else KATAKANA if "KATAKANA" in name or c == "ー" else HAN if name.startswith("CJK") else OTHER_LETTER
            if len(c.lower()) == 1:
                low[i] = min(ord(c.lower()), SIZE - 1)
        elif g[0] == "M":
            kind[i] = LATIN
        elif g[0] == "N":
            kind[i] = DIGIT
        elif g == "Zs":
            kind[i] = SPACE
    kind[[ord(c) for c in ".!?…。！？．"]] = STOP
    kind[[ord(c) for c in ",、，:："]] = COMMA
    kind[[ord(c) for c in "'\"“”‘’«»「」『』()（）[]"]] = QUOTE
    kind[[ord(c) for c in "-–—‐‑"]] = DASH
    kind[ord("\t")], kind[ord("\n")], kind[ord("|")], kind[ord(";")] = TAB, NEWLINE, PIPE, SEMICOLON
    return kind, low


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a newline, and where each text begins, with the end."""
    whole = "\n".join(texts) + "\n" if texts else ""
    codes = np.frombuffer(whole.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    return codes, starts


#: Code points that are worked on at a time; a longer text is a piece of its own.
PIECE = 1 << 20


def pieces(texts: list[str], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Slices of the texts of about `limit` code points and at most 16,384 texts."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > limit or i - begin >= 1 << 14):
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def classes(codes: np.ndarray) -> np.ndarray:
    return tables()[0][np.minimum(codes, SIZE - 1)]


def lowered(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < SIZE, tables()[1][np.minimum(codes, SIZE - 1)], codes)


def word_bounds(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one position of each run of letters of one script."""
    letter = (kinds >= LATIN) & (kinds <= OTHER_LETTER)
    change = np.flatnonzero(np.diff(np.where(letter, kinds, 0).astype(np.int8), prepend=0, append=0))
    starts, ends = change[:-1], change[1:]
    real = letter[starts] if len(starts) else np.empty(0, bool)
    return starts[real], ends[real]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each run, by prefix sums of a polynomial."""
    with np.errstate(over="ignore"):
        power = _powers(len(codes))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power)])
        back = _inverse_powers(len(codes))
        return mix((prefix[ends] - prefix[starts]) * back[starts])


_cache: dict[str, np.ndarray] = {}


def _chain(name: str, base: int, n: int) -> np.ndarray:
    have = _cache.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            out = np.full(size, np.uint64(base))
            out[0] = np.uint64(1)
            have = _cache[name] = np.multiply.accumulate(out)
    return have[:n]


def _powers(n: int) -> np.ndarray:
    return _chain("p", _P, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _chain("q", int(_P_INVERSE), n)
