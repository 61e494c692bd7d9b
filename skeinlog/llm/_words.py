"""Words of many texts as 64-bit hashes, computed on whole Arrow batches.

A word is a run of bytes other than space and \\x09-\\x0D. Each 8 bytes of it are mixed with their place in the word,
and the sum of these is mixed with its length, so equal words have equal hashes in every task and no arrangement of
bytes cancels out, as it can in a polynomial. Two different words share a hash with a chance of about 2^-64; where
more is needed, a second hash of the same words, with other factors, makes it 2^-128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: What is kept of 8 bytes of which only the first k belong to a word.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: For each of the two hashes: the step from one place in a word to the next, and the factors of the mixing.
_FAMILIES = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def mix(h: np.ndarray, first: int = _FAMILIES[0][1], second: int = _FAMILIES[0][2]) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(first)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(second)
    return h ^ (h >> np.uint64(31))


def hashes(buffer: np.ndarray, starts: np.ndarray, stops: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of the words that stand from ``starts`` to ``stops`` in a block's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    step, *factors = _FAMILIES[family]
    padded = np.zeros(len(buffer) + 8, np.uint8)
    padded[: len(buffer)] = buffer
    eights = np.ndarray((len(buffer) + 1,), "<u8", padded, 0, (1,))  # the 8 bytes from each byte on
    lengths = stops - starts
    chunks = (lengths + 7) >> 3
    begin = np.cumsum(chunks) - chunks
    word = np.repeat(np.arange(len(starts)), chunks)
    place = np.arange(len(word)) - begin[word]
    value = eights[starts[word] + 8 * place] & _FIRST_BYTES[np.minimum(lengths[word] - 8 * place, 8)]
    mixed = mix(value + (place + 1).astype(np.uint64) * np.uint64(step), *factors)
    return mix(np.add.reduceat(mixed, begin) + lengths.astype(np.uint64), *factors)


def _block(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: the text of each word, and its start and end bytes."""
    n = len(buffer)
    space = _SPACE[buffer]
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    inner = ends[(ends > 0) & (ends < n)]  # a text's end also ends its word
    if len(inner):
        first[inner] = ~space[inner]
        last[inner - 1] = ~space[inner - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(ends, starts, side="right"), starts, stops


def blocks(texts: pa.Array, lower: bool, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, word hashes, offsets): offsets has one more entry than the block has texts. Null texts are empty."""
    for a, b, h, offsets, *_ in blocks_with_bytes(texts, lower, block_bytes):
        yield a, b, h, offsets


def blocks_with_bytes(texts: pa.Array, lower: bool, block_bytes: int = BLOCK_BYTES, fold: np.ndarray | None = None):
    """As blocks(), with the block's bytes (in lower case where wanted, or as ``fold`` maps each byte) and each word's start and end in them."""
    fold = _LOWER if lower and fold is None else fold
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and len(texts.buffers()[2]) else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + block_bytes, side="right")) - 1)
        own = data[bounds[a] : bounds[b]]
        ends = (bounds[a + 1 : b + 1] - bounds[a]).astype(np.int64)
        own = own if fold is None else fold[own]
        text, starts, stops = _block(own, ends)
        yield a, b, hashes(own, starts, stops), np.searchsorted(text, np.arange(b - a + 1)), own, starts, stops
        a = b


def runs(h: np.ndarray, n: int, factor: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hashes of all runs of n consecutive entries, in order; other (odd) factors give other hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out ^= out >> np.uint64(29)  # no arrangement of entries cancels out
        out *= np.uint64(factor)
        out += h[j : len(h) - n + 1 + j]
    return mix(out + np.uint64(n))
