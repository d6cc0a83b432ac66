"""Tokenising large batches of texts by encoding each distinct chunk of them once."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import words

#: Entries and ids that one worker remembers. Beyond them it starts afresh, which costs time only.
ENTRIES, IDS = 250_000, 2_000_000
BLOCK = 2 << 20
_SPACE, _STOP, _ALNUM = np.zeros((3, 256), bool)
_SPACE[[10, 32]] = True
_STOP[[44, 46]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _parted(data: np.ndarray, start: np.ndarray, size: np.ndarray, some: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """some and which, where spans whose bytes differ from those of the span that stands for them stand for themselves."""
    first = some[which]
    equal = size == size[first]
    view, there, most = words.eights(data), start[first], np.where(equal, size, 0)
    for (at, piece), (_, other) in zip(words.pieces(view, start, most), words.pieces(view, there, most)):
        equal[at] &= piece == other
    odd = np.flatnonzero(~equal)
    which[odd] = len(some) + np.arange(len(odd))
    return np.concatenate([some, odd]), which


class Memo:
    """Encodes texts with `ids`, which gives each string's ids and cuts pre-tokens as byte-level BPE patterns do.

    Such a pattern starts a pre-token at every single space or line feed between two characters that are not white
    space, and at a point or comma after an ASCII letter or digit, and looks no further back. So what stands between two
    such places has the same ids wherever it stands: it is encoded once and remembered. A text with a space or line feed
    beside other white space is encoded whole.
    """

    def __init__(self, ids: Callable[[list[str]], list[list[int]]]):
        self.ids = ids
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}  # a chunk with the space before it -> its entry
        self.size = np.zeros(ENTRIES, np.int32)  # -1: white space touches its end, so it isn't cut off
        self.start = np.zeros(ENTRIES, np.int64)
        self.flat = np.zeros(IDS, np.uint32)
        self.used = 0

    def _learn(self, new: list[bytes]) -> None:
        texts = [b.decode() for b in new]
        inner = [t[1:] if t[:1] in (" ", "\n") else t for t in texts]
        good = [bool(t) and not t[0].isspace() and not t[-1].isspace() for t in inner]
        got = iter(self.ids([t for t, g in zip(texts, good) if g]))
        own = [next(got) if g else None for g in good]
        need = sum(len(x) for x in own if x)
        n = len(self.at)
        if n + len(new) > len(self.size):
            self.size, self.start = (np.concatenate([x, np.zeros(len(new), x.dtype)]) for x in (self.size, self.start))
        if self.used + need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, np.uint32)])
        self.at.update(zip(new, range(n, n + len(new))))
        size = np.array([-1 if x is None else len(x) for x in own], np.int32)
        self.size[n : n + len(new)] = size
        size = np.maximum(size, 0)
        self.start[n : n + len(new)] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + need] = [i for x in own if x for i in x]
        self.used += need

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another, and the offsets of the rows in them."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        flat, sizes = [], [np.zeros(1, np.int64)]
        for _, _, data, off in words.blocks(texts, size=BLOCK):
            ids, n = self._block(data, off)
            flat.append(ids)
            sizes.append(n)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.cumsum(np.concatenate(sizes))

    def _block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(off) - 1
        cut = _SPACE[data]
        cut[1:] |= _STOP[data[1:]] & _ALNUM[data[:-1]]
        cut[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        row = np.searchsorted(off, start, "right") - 1
        _, some, which = np.unique(words.hashes(data, start, end), return_index=True, return_inverse=True)
        some, which = _parted(data, start, end - start, some, which)
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())]
        if len(self.at) > ENTRIES - len(keys) or self.used > IDS // 2:
            self._forget()
        if new := [k for k in keys if k not in self.at]:
            self._learn(new)
        entry = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))[which]
        whole = np.zeros(rows, bool)
        whole[row[self.size[entry] < 0]] = True
        if whole.any():
            keep = ~whole[row]
            entry, row = entry[keep], row[keep]
        size = self.size[entry]
        ends = np.cumsum(size)
        n = np.bincount(row, size, rows).astype(np.int64)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[entry] - ends + size, size)]
        if not whole.any():
            return ids, n
        parts, at = np.split(ids, np.cumsum(n)[:-1]), np.flatnonzero(whole)
        for i, own in zip(at, self.ids([raw[off[i] : off[i + 1]].decode() for i in at])):
            parts[i] = np.array(own, np.uint32)
            n[i] = len(own)
        return np.concatenate(parts), n
