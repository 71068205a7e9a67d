"""Hashed character n-grams of every word of a batch, as arrays over its bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from typeloom.llm import bytewords as bw


def stream_and_bytes(col: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `stream`, and the bytes themselves, with a newline before each row."""
    texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.fill_null(col.cast(pa.large_string()), ""), pa.scalar("\n", pa.large_string()))
    data, offsets = bw.texts_of(texts)
    s, e, row = bw.words_of(data, offsets, separators)
    out = np.zeros(len(data) + 8, np.uint8)
    out[: len(data)] = np.where(separators[data], 0, bw.LOWER[data])
    return out, s, e, row, data


def stream(col: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with 0 at each separator, one before each row; then start, end and row of each word."""
    return stream_and_bytes(col, separators)[:4]


def ngrams(stream_: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte; 0 where it would cross a word's edge.

    A word's edge is itself a character, so that affixes differ from the same letters inside.
    """
    size = len(stream_) - 8
    wide = stream_.astype(np.uint32)
    h = wide[:size] + np.uint32(1)
    whole = np.ones(size, bool)
    for k in range(1, n):
        h = h * np.uint32(0x01000193) ^ wide[k : k + size] + np.uint32(0x9E37)
        if k < n - 1:
            whole &= stream_[k : k + size] != 0
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B + 2 * n)
    bucket = h >> np.uint32(32 - bits)
    whole &= (stream_[:size] != 0) | (stream_[n - 1 : n - 1 + size] != 0)
    return np.where(whole, np.maximum(bucket, 1), 0)


def per_word(values: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Sums of per-byte values over each word, its left edge included; n-grams outside of words must be 0."""
    return np.add.reduceat(values, s - 1, axis=0) if len(s) else np.zeros((0, *values.shape[1:]), values.dtype)
