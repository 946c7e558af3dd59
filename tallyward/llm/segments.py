"""Distinct words of a batch of texts, so that work on words is done once for each of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows of a batch that are worked on at a time are cut at this many bytes of text.
SLICE_BYTES = 16 << 20


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(from, to) of consecutive runs of rows with at most ``limit`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield a, b
        a = b


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's pieces between single spaces, the pieces as codes, and the distinct pieces."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(lengths))), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The same, the distinct pieces as a list."""
    offsets, codes, words = coded_words(texts)
    return offsets, codes, words.to_pylist()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; empty runs give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]
