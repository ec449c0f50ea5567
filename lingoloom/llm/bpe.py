"""Byte-level BPE as a monoid: encode halves, join neighbours by re-encoding a window at the seam.

A text's encoding is an element of a monoid whose product is ``join``. A leaf is a short slice that the
tokenizer library encodes; a node joins the encodings of its two halves. The halves are cut anywhere, so the
tokens at the seam can be wrong. The window around the seam grows on both sides until it ends at *sync points*:
places where a non-space character is followed by white space. No match of the split pattern contains such a
place, so what lies outside the window is split, and merged, the same whether or not the halves are joined; those
tokens are provably final and are kept. Decoding concatenates bytes up the same tree.

Defined results: a null text counts as empty; an empty text has no tokens; a text without any sync point is
re-encoded as a whole at its last join. Rows are independent: ties, repeats and further columns do not matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import filled, lean, tidied

#: Characters of a leaf, and of the first window on either side of a seam.
LEAF, WINDOW = 4096, 48

_SYNC = re.compile(r"(?<=\S)[ \n\t]")
_TYPES = {
    "tokens": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())), "decoded": (T.BinaryType(), pa.binary()),
    "n_tokens": (T.LongType(), pa.int64()), "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string()),
}


class Codec:
    """Encodes and decodes by a rank file and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        return self._node(text, 0, len(text))

    def _node(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF:
            return self.library.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._node(text, lo, mid), self._node(text, mid, hi)
        return self.join(text, lo, mid, hi, left, right)

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a, b = self._sync_before(text, lo, mid), self._sync_after(text, mid, hi)
        keep = self._drop(reversed(left), len(text[a:mid].encode()))
        skip = self._drop(iter(right), len(text[mid:b].encode()))
        window = self.library.encode_ordinary(text[a:b])
        del left[len(left) - keep :]
        left += window
        left += right[skip:]
        return left

    def _drop(self, ids: Iterator[int], size: int) -> int:
        """How many of the ids cover exactly ``size`` bytes."""
        n = 0
        while size > 0:
            size -= int(self.length[next(ids)])
            n += 1
        if size:
            raise AssertionError("a sync point fell inside a token")
        return n

    @staticmethod
    def _sync_before(text: str, lo: int, mid: int) -> int:
        wide = WINDOW
        while True:
            at = max(lo, mid - wide)
            found = [m.start() for m in _SYNC.finditer(text, at, mid)]
            if found or at == lo:
                return found[-1] if found else lo
            wide *= 2

    @staticmethod
    def _sync_after(text: str, mid: int, hi: int) -> int:
        wide = WINDOW
        while True:
            to = min(hi, mid + wide)
            # mid itself counts only if the character before it belongs to the joined text
            if m := _SYNC.search(text, mid + 1, to):
                return m.start()
            if to == hi:
                return hi
            wide *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return self.library.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker. ``path``: a rank file that every machine has."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return Codec(ranks, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = ("tokens",), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add encodings of a text column.

    outputs: any of tokens, decoded (bytes decoded from the tokens), n_tokens, ids_sha256 (of the tokens as
    little-endian unsigned 32-bit integers) and decoded_sha256. keep: columns to carry, all by default; a carried
    column that has an output's name gives way to it. One narrow pass: no shuffle, memory of one Arrow batch.
    """
    lean(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    source = df.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(c, _TYPES[c][0]) for c in outputs])
    digests = any("decoded" in c for c in outputs)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            made: dict[str, list] = {c: [] for c in outputs}
            for x in filled(batch.column(text)):
                ids = own.encode(x.as_py())
                raw = own.decode(ids) if digests else b""
                for c, out in made.items():
                    if c == "tokens":
                        out.append(np.asarray(ids, np.int32))
                    elif c == "n_tokens":
                        out.append(len(ids))
                    elif c == "decoded":
                        out.append(raw)
                    elif c == "ids_sha256":
                        out.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                    else:
                        out.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(made[c], _TYPES[c][1]) for c in outputs], names=[*kept, *outputs])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, tokens: str = "tokens", output: str = "decoded") -> DataFrame:
    """Add the bytes that a column of token arrays stands for (null: no bytes)."""
    kept = [c for c in df.columns if c != output]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(output, T.BinaryType())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = [own.decode(x.as_py() or []) for x in batch.column(tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(raw, pa.binary())], names=[*kept, output])

    return df.mapInArrow(run, schema)
