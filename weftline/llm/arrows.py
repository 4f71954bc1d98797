"""Helpers for work on Arrow batches inside tasks: bounded slices, flat word lists and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of column ``text``, or of one row where a text is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            # copied, as ascii_lower and its like read past the offset of a sliced array of large strings
            whole = stop - start == batch.num_rows
            yield batch if whole else batch.take(pa.array(np.arange(start, stop)))
            start = stop
    # workers outlive their tasks, and so would what they have freed
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of a column of texts, and the n + 1 offsets at which each text's words start.

    Words are what ASCII white space separates; A-Z are lower-cased. A null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts) if lower else texts))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    names = coded.dictionary.to_pylist()
    known = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), dtype=np.uint64, count=len(names))
    codes = coded.indices.to_numpy().astype(np.int64)
    if "" in names:  # from blank texts
        keep = codes != names.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return known[codes], offsets


def shingle_sets(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``size`` words, flat, and their offsets.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    counts = np.diff(offsets)
    docs = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, (counts > 0).astype(np.int64)))
    firsts = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    begins = np.cumsum(firsts) - firsts
    at = np.arange(len(docs)) - begins[docs] + offsets[:-1][docs]
    length = np.minimum(counts, size)[docs]
    with np.errstate(over="ignore"):
        sums = mixed(length.astype(np.uint64) * MIX)
        for k in range(size):
            inside = length > k
            step = mixed(sums * MIX + words[np.where(inside, at + k, 0)]) if len(words) else sums
            sums = np.where(inside, step, sums)
    order = np.lexsort((sums, docs))
    docs, sums = docs[order], sums[order]
    new = np.ones(len(sums), dtype=bool)
    new[1:] = (sums[1:] != sums[:-1]) | (docs[1:] != docs[:-1])
    return sums[new], np.concatenate([[0], np.cumsum(np.bincount(docs[new], minlength=len(counts)))]).astype(np.int64)
