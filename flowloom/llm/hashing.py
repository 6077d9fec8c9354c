"""Hashes of words and word sequences, vectorised over the texts of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes hashed at once; a word is never cut.
BLOCK = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(count: int, base: np.uint64 = ODD) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text); words end at white space and at text ends."""
    word = ~SPACE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[offsets] = True
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[1:] = word
    after = np.zeros(len(raw) + 1, dtype=bool)
    after[:-1] = word
    starts = np.flatnonzero(after & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~after))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the number of words at the end)."""
    raw, offsets = joined_bytes(texts)
    starts, ends, firsts = word_bounds(raw, offsets)
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK)))
        begin, end = int(starts[a]), int(ends[b - 1])
        piece = raw[begin:end]
        if lower:
            piece = np.where((piece >= 65) & (piece <= 90), piece + 32, piece)
        first = starts[a:b] - begin
        spans = np.diff(np.append(first, end - begin))
        place = np.arange(end - begin, dtype=np.int64) - np.repeat(first, spans)
        lengths = ends[a:b] - starts[a:b]
        # Bytes after a word's end, white space, count nothing.
        inside = place < np.repeat(lengths, spans)
        table = powers(int(spans.max()))
        values = (piece.astype(np.uint64) + np.uint64(1)) * table[place] * inside
        sums = np.add.reduceat(values, first)
        out[a:b] = mix(sums + mix(lengths.astype(np.uint64)))
        a = b
    return out, firsts


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = powers(width + 1, np.uint64(0xD6E8FEB86659FD93))[1:]
    total = np.full(count, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        total += words[j : j + count] * factors[j]
    return mix(total)
