"""Words and shingles of many texts at once, as numpy arrays over Arrow buffers.

A text is read as UTF-8 bytes. Words are runs of word bytes, A-Z lower-cased; the
hash of a word is a polynomial over its bytes, taken from prefix sums, so that no
Python code runs per word. Long texts are read in pieces cut between words: memory
follows the number of words, never a multiple of the bytes of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes hashed at once, and bytes of text handed to an operator at once.
PIECE = 1 << 20
BLOCK = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32
# "space": words are what stands between ASCII white space; "alnum": letters and digits.
WORD_BYTES = {"space": ~_SPACE, "alnum": _ALNUM}


class Words(NamedTuple):
    """hash, first and end byte of each word; ``first[i]:first[i + 1]`` are row i's."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits of the input."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or one row."""
    _, at = utf8(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def words(data: np.ndarray, at: np.ndarray, kind: str = "space") -> Words:
    """The words of all rows whose bytes are ``data[at[i]:at[i + 1]]``."""
    table = WORD_BYTES[kind]
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, lo = len(data), 0
    while lo < size:
        hi = min(lo + PIECE, size)
        while hi < size:  # cut after a byte that is in no word
            gap = np.flatnonzero(~table[data[hi : hi + 4096]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(hi + 4096, size)
        parts.append(_piece(data[lo:hi], at, lo, table))
        lo = hi
    if parts:
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        hashes, starts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Words(hashes, starts, ends, np.searchsorted(starts, at))


def _piece(data: np.ndarray, at: np.ndarray, lo: int, table: np.ndarray) -> tuple:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    row = np.zeros(n + 1, bool)  # a row starts here
    rows = at[np.searchsorted(at, lo) : np.searchsorted(at, lo + n, "right")] - lo
    row[rows] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | row[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | row[1:])) + 1
    size = max(PIECE + 4096, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * _powers(_BASE, size)[:n], out=sums[1:])
    back = _powers(pow(_BASE, -1, 1 << 64), size)
    raw = (sums[ends] - sums[starts]) * back[starts]
    return mix(raw + (ends - starts).astype(np.uint64)), starts + lo, ends + lo


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of each window of k words, by position of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + hashes[j : j + n]
    return mix(out)


def shingle_sets(found: Words, k: int) -> list[np.ndarray]:
    """Per row its distinct shingles of k words, sorted; the whole row as one if shorter."""
    every = windows(found.hashes, k)
    out = []
    for lo, hi in zip(found.first[:-1], found.first[1:], strict=True):
        n = hi - lo
        if n >= k:
            found_here = np.sort(every[lo : hi - k + 1])
            fresh = np.ones(len(found_here), bool)
            np.not_equal(found_here[1:], found_here[:-1], out=fresh[1:])
            out.append(found_here[fresh])
        elif n:
            out.append(windows(found.hashes[lo:hi], n) + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))


def spans(data: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` bytes from each begin, equal to the hash of such a word."""
    out = np.zeros(len(begin), np.uint64)
    power = _powers(_BASE, PIECE + 4096)
    for j in range(size):
        out += (_LOWER[data[begin + j]] + np.uint64(1)) * power[j]
    return mix(out + np.uint64(size))


def sequences(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """One hash for each run of words ``start:stop``; runs of the same words agree."""
    n = len(hashes)
    base = _BASE ^ 0x5851F42D4C957F2C
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
