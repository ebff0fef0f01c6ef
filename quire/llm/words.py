"""Words of texts, column-wise: Arrow kernels split and number them, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one step holds; batches are cut into such steps, at document ends only.
STEP_BYTES = 6 << 20


def steps(ids: pa.Array, texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of whole documents of at most ``most`` bytes (one longer document is a run alone)."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    total, start = np.cumsum(size), 0
    while start < len(texts):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
        yield ids.slice(start, end - start), texts.slice(start, end - start)
        start = end


def plain(texts: pa.Array) -> pa.Array:
    """Texts as a large-string array of its own, nulls as empty texts.

    A slice is copied first: the library's ASCII kernels misread a slice that was cast.
    """
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")


def split(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """Words (runs without ASCII white space) of all texts in order, and each text's end in them.

    A null text has no words. ``lower`` folds A-Z only.
    """
    x = plain(texts)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(x) if lower else x)
    flat = parts.flatten()
    lengths = np.asarray(pc.list_value_length(parts)).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0).cast(pa.uint8())).astype(bool) if len(flat) else np.zeros(0, bool)
    seen = np.concatenate([[0], np.cumsum(full)])
    ends = seen[np.cumsum(lengths)]
    return (flat if full.all() else flat.filter(pa.array(full))), ends


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's number in the array of distinct words, and that array."""
    d = words.dictionary_encode()
    return np.asarray(d.indices).astype(np.int64), d.dictionary


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, as unsigned integers."""
    h = xxhash.xxh3_64_intdigest
    data = distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(h, data), np.uint64, len(data))


def starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)
