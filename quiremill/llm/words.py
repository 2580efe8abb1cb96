"""Words and their hashes, by the batch: Arrow's kernels split, numpy hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: What isn't a word: words are runs of letters and digits.
NO_WORD = r"[^\p{L}\p{N}]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: an even spread over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of the texts laid end to end, and the text of each."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=NO_WORD)
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), parent[real.to_numpy(zero_copy_only=False)]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(words):
        return np.empty(0, np.uint64)
    codes = words.dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    known = pd.util.hash_array(np.asarray(codes.dictionary.to_pylist(), dtype=object), categorize=False)
    return mix(known.astype(np.uint64))[codes.indices.to_numpy(zero_copy_only=False)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A 64-bit hash of each word, the text it is in, and the words."""
    flat, parent = split_words(texts)
    return hash_words(flat), parent.astype(np.int64), flat


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive hashes, order counting."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _STEP + hashes[k : k + n]
        return mix(out)
