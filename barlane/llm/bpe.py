"""Byte-level BPE on a sentencepiece model that is serialised straight from a rank file; nothing is trained.

Every rank's bytes become one piece of printable characters (a fixed byte map) with score -rank, under identity
normalisation, so sentencepiece's best-score-first merges are the rank order. Texts are cut into pre-tokens by the
pattern and each pre-token is encoded by itself; ids are ranks. Decoding maps ids back to bytes.

Defined results: a null text is encoded as the empty text (no ids); repeated rows are encoded each; extra columns are
carried along; columns named like the added ones are replaced.
"""
from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow
from .memo import Memo


def byte_map() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each rank, in rank order, of a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    return out


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def model(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: rank r at id r with score -r, <unk> after the last."""
    to = byte_map()
    body = [_field(1, _field(1, "".join(to[b] for b in p).encode()) + _field(2, -float(r)) + _field(3, 1)) for r, p in enumerate(pieces)]
    body.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(n, 2**64 - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(body) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with one rank file; made once in each worker."""

    _made: dict[tuple[str, str], Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        return cls._made.setdefault((path, pattern), None) or cls._made.update({(path, pattern): cls(path, pattern)}) or cls._made[path, pattern]

    def __init__(self, path: str, pattern: str):
        self.pieces = read_ranks(path)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model(self.pieces))
        self.split = regex.compile(pattern).findall
        self.map = dict(enumerate(byte_map()))
        self.whole = {t: r for r, p in enumerate(self.pieces) if (t := p.decode(errors="replace")).encode() == p}
        self.encode = Memo(self.ids).encode
        size = np.array([len(p) for p in self.pieces])
        self.size, self.start, self.bytes = size, np.cumsum(size) - size, np.frombuffer(b"".join(self.pieces), np.uint8)

    def _tokens(self, text: str) -> list[str]:
        """Pre-tokens; a plain word needs no pattern."""
        word = text[1:] if text[:1] == " " else text
        return [text] if word.isalpha() and max(word) < "\u0250" else self.split(text)

    def _shown(self, token: str) -> str:
        """A pre-token in the model's characters."""
        return token.replace(" ", self.map[32]) if token.isascii() and token.isprintable() else token.encode().decode("latin-1").translate(self.map)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, pre-token by pre-token; sentencepiece is called once."""
        tokens = list(map(self._tokens, texts))
        got = iter(self.sp.encode(list(map(self._shown, chain.from_iterable(tokens))), num_threads=1))
        whole = self.whole
        ids = [[[whole[t]] if t in whole else x for t, x in zip(own, got)] for own in tokens]
        return [own[0] if len(own) == 1 else [i for x in own for i in x] for own in ids]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)].tobytes()


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, of: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with the column `out`, in place of one of that name; `of` gives a batch of it from one of `column`."""
    at, keep = df.columns.index(column), [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), of(batch.column(at))], names=[*keep, out])

    return arrow.over(df, run, T.StructType([*(df.schema[c] for c in keep), T.StructField(out, kind)]))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df and the ids of each text as array<int>."""

    def of(texts: pa.Array) -> pa.Array:
        flat, off = Codec.of(path, pattern).encode(texts)
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.view(np.int32)))

    return _mapped(df, text, out, T.ArrayType(T.IntegerType()), of)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df and the bytes that each row's ids stand for; null ids give no bytes."""

    def of(lists: pa.Array) -> pa.Array:
        codec = Codec.of(path, pattern)
        flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return pa.array([codec.decode(flat[a:b]) if b > a else b"" for a, b in zip(off[:-1], off[1:])], pa.binary())

    return _mapped(df, ids, out, T.BinaryType(), of)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each document the number of ids, and digests of its ids and of the bytes they decode to."""
    coded = decode(encode(docs.select("doc_id", "text"), path, pattern).select("doc_id", "ids"), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
