"""BagMinHash signatures of weighted sets, and the exact weighted Jaccard similarity of multisets of word shingles.

The weight axis is cut at 1, 2, 4, 8, ... Over each of these intervals every element has a Poisson process of its own, of
points with a time, a register and a place on the axis. A set sees the points at places below its element's weight, and a
register is the time of the first point seen. Two sets agree in a register with probability sum(min) / sum(max) of their
weights. A weight w costs about log2(w) processes, and a process stops once its time is beyond all registers.
"""
from __future__ import annotations

import numpy as np

from . import words

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def bags(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, elements and counts of each row's distinct elements, by row and element."""
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """(rows, m) registers; a row without elements has infinity throughout."""
    out = np.full(rows * m, np.inf)
    total = np.bincount(row, weight, rows)
    level = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    n = level + 1
    which = np.repeat(np.arange(len(row)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    low = np.where(k == 0, 0, np.exp2(np.maximum(k - 1, 0)))
    rate = np.where(k == 0, 1.0, low)
    owner, seen = row[which], weight[which]
    seed = words.mix(element[which] + _STEP * (k + 1).astype(_U))
    time = np.zeros(len(which))
    turn = np.zeros(len(which), np.int64)
    # A register stays empty with probability exp(-limit * total / m): few rows need a second pass.
    limit = (np.log(m) + 1.7) * m / np.maximum(total, 1e-9)
    live = np.arange(len(which))
    ahead = np.zeros(len(which))  # time of the next point, where it is drawn already
    while len(live):
        own, late = live, []
        while len(own):
            bits = words.mix(seed[own] + _STEP * turn[own].astype(_U))
            due = ahead[own]
            fresh = due == 0
            due = np.where(fresh, time[own] - np.log(((bits >> _U(11)).astype(float) + 1) / 2.0**53) / rate[own], due)
            stay = due <= limit[owner[own]]
            ahead[own[~stay]] = due[~stay]
            late.append(own[~stay])
            own, bits, due = own[stay], bits[stay], due[stay]
            more = words.mix(bits ^ _U(0xD6E8FEB86659FD93))
            place = low[own] + rate[own] * ((more >> _U(11)).astype(float) / 2.0**53)
            register = (more & _U(2047) | (bits & _U(2047)) << _U(11)).astype(np.int64) * m >> 22
            ok = place < seen[own]
            np.minimum.at(out, owner[own[ok]] * m + register[ok], due[ok])
            time[own], ahead[own] = due, 0
            turn[own] += 1
        open_ = np.isinf(out.reshape(rows, m)).any(1) & (total > 0)
        live = np.concatenate(late)
        live = live[open_[owner[live]]]
        limit = np.where(open_, limit * 1.6, limit)
    return out.reshape(rows, m)


def bands(registers: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key for each run of `size` registers of each row."""
    rows, m = registers.shape
    bits = registers.view(_U).reshape(rows, m // size, size)
    key = np.zeros((rows, m // size), _U) + np.arange(m // size).astype(_U)
    for j in range(size):
        key = words.mix(key * _STEP + bits[:, :, j])
    return key


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows of all words, then of all shingles of k words."""
    start, end, row = words.spans(data, off)
    h = words.hashes(data, start, end)
    at, g = words.row_runs(h, row, k)
    return h, row, g, row[at]
