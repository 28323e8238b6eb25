"""Vectorised word and shingle hashing over Arrow string columns.

Words are the runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased. A word's 64-bit hash is a polynomial over its
bytes modulo 2**64 with random byte values, passed through a mixer; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at once. Longer texts are cut at white space, which ends a word anyway.
BLOCK = 256 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_fold = np.arange(256)
_fold[65:91] += 32
BYTE = mix((_fold + 1).astype(U) * U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                step = np.full(size, base, U)
                step[0] = 1
                _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _block(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block, and each row's first word."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    blank = SPACE[data]
    before, after = np.empty_like(blank), np.empty_like(blank)
    before[0] = after[-1] = True
    before[1:], after[:-1] = blank[:-1], blank[1:]
    full = at[:-1] < at[1:]
    before[at[:-1][full]] = True
    after[at[1:][full] - 1] = True
    start = np.flatnonzero(~blank & before)
    end = np.flatnonzero(~blank & after) + 1
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
    return hashes, np.searchsorted(start, at)


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, end row, word hashes, offsets of the rows in them)."""
    data, at = arrow_bytes(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1, row + 1)
        if at[end] - at[row] <= BLOCK:
            yield row, end, *_block(data[at[row] : at[end]], at[row : end + 1] - at[row])
        else:
            parts, pos, stop = [], int(at[row]), int(at[row + 1])
            while pos < stop:
                cut = min(pos + BLOCK, stop)
                while cut < stop:
                    gap = np.flatnonzero(SPACE[data[cut : min(cut + BLOCK, stop)]])
                    if len(gap):
                        cut += int(gap[0])
                        break
                    cut = min(cut + BLOCK, stop)
                parts.append(_block(data[pos:cut], np.array([0, cut - pos]))[0])
                pos = cut
            found = np.concatenate(parts)
            yield row, row + 1, found, np.array([0, len(found)])
        row = end


def _fold_words(parts: list[np.ndarray], size: int) -> np.ndarray:
    x = parts[0] ^ U(size)
    for part in parts[1:]:
        x = ((x << U(23)) | (x >> U(41))) * U(0x9FB21C651E98DF25) + part
    return mix(x)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles.

    A text with fewer words than ``size`` has its whole word sequence as the one shingle; a text without
    words has none.
    """
    for first, end, hashes, at in words(column):
        if len(hashes) >= size:
            grams = _fold_words([hashes[k : len(hashes) - size + 1 + k] for k in range(size)], size)
        for row in range(end - first):
            a, b = int(at[row]), int(at[row + 1])
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield _fold_words([hashes[k : k + 1] for k in range(a, b)], b - a)
            else:
                yield np.zeros(0, U)
