"""Vectorised words `[^\\x20\\x09-\\x0D]+` of Arrow text columns: spans, 64-bit hashes and hashes of word runs.

Texts are worked on as UTF-8 bytes in blocks of about `BLOCK` bytes, so memory depends on the block (or on the one
longest text), not on the batch. Null texts count as empty. Hashes are the same on every machine.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20
U = np.uint64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them) for runs of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, at, raw = texts.buffers()
    off = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        own = data[off[lo] : off[hi]]
        yield lo, hi, _LOWER[own] if lower else own, off[lo : hi + 1] - off[lo]
        lo = hi


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never crosses a row's end."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = (data != 32) & (data - np.uint8(9) > 4)
    start, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    whole = off[inside[off] & inside[off + 1]]  # a row's end inside a run of other bytes
    start[whole] = end[whole] = True
    start, end = np.flatnonzero(start), np.flatnonzero(end)
    return start, end, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def pieces(view: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
    """By eight bytes of the spans: which spans reach so far, and those bytes of them."""
    yield slice(None), view[start] & _MASK[np.minimum(size, 8)]
    own, j = np.flatnonzero(size > 8), 8
    while len(own):
        yield own, view[start[own] + j] & _MASK[np.minimum(size[own] - j, 8)]
        j += 8
        own = own[size[own] > j]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; spans of up to eight bytes and one size never collide."""
    size = end - start
    h = (size.astype(U) + U(seed << 48)) * U(0x9E3779B97F4A7C15)
    long = np.flatnonzero(size > _LONG)
    for at, piece in pieces(eights(data), start, np.where(size > _LONG, 0, size) if len(long) else size):
        h[at] = mix(h[at] ^ piece)
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of h (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def row_runs(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words at which a run of k words of one row starts, and the runs' hashes."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(row[: len(h) - k + 1] == row[k - 1 :])
    return at, runs(h, k)[at]
