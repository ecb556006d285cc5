"""Word shingles of Arrow text columns, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Texts are taken in runs of about so many bytes.
RUN_BYTES = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (wraps by design)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) so that a slice holds about ``most`` bytes (RUN_BYTES), one text at least."""
    most = RUN_BYTES if most is None else most
    sizes = np.nan_to_num(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    start = 0
    while start < len(texts):
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most, side="right")))
        yield start, texts.slice(start, end - start)
        start = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (one more than texts).

    Words are what white space ``[\\x20\\x09-\\x0D]`` separates, A-Z in lower case.
    """
    # Lower case first: Arrow's kernel misreads a slice that was cast to large strings.
    plain = pc.ascii_lower(texts.fill_null("")).cast(pa.large_string())
    parts = pc.ascii_split_whitespace(plain)
    flat, ends = parts.values, parts.offsets.to_numpy()
    codes = flat.dictionary_encode()
    table = codes.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in table), dtype=np.uint64, count=len(table))
    index = codes.indices.to_numpy(zero_copy_only=False)
    full = np.array([w != b"" for w in table], dtype=bool)[index] if len(table) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(full)])
    return hashes[index[full]] if len(table) else np.zeros(0, np.uint64), before[ends]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``width`` words; a shorter
    text is one shingle, a text without words none."""
    words, ends = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        rolled = rolled * _MULTIPLIER
        rolled[: max(n - i, 0)] += words[i:]
    rolled = mixed(rolled)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            whole = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * _MULTIPLIER + w
                whole = whole * _MULTIPLIER + np.uint64(b - a)
            yield mixed(np.array([whole], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)
