"""Word-level diff of a draft and its correction, as labelled spans.

Stretches that both have are found as the classic sequence matcher does, without its junk heuristic: the longest common stretch (of some
the first one in the draft, then in the correction), then the same before and behind it. Its usual form looks at every pair of equal words. Here
words are numbered, and all common stretches of some words are found once by the hashes of short ones, so that the longest in a range is
one of a short list. Where that list has none, small ranges are compared word by word, and in others the longest length is searched for by
hashes of all stretches of a length. A pair of texts takes about n log n steps.

Workers get small Arrow batches (``lean``), take one pair after the other and keep arrays of what comes out, so that a batch needs little more than
its texts, however many rows a task has.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\S+\s*")
#: Ranges of up to so many pairs of words are compared word by word.
SMALL = 6000
#: Words of the shortest stretches that are listed: first, and at most.
SHORT, LONG = 4, 128
#: Words that are compared at once, and characters of spans that are kept as Python strings.
AT_ONCE = 1 << 20
#: The most rows and bytes of an Arrow batch of pairs; a worker holds a batch or two.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def tokens(text: str) -> list[str]:
    """Words with the white space after them."""
    return _TOKEN.findall(text)


class _Side:
    """One text's words as numbers, with sums that give the hash of any stretch."""

    def __init__(self, numbers: np.ndarray, powers: np.ndarray):
        self.numbers, self.powers = numbers, powers
        self.sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum((numbers.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0x5851F42D4C957F2D)) * powers[: len(numbers)], out=self.sums[1:])

    def hashes(self, low: int, high: int, n: int) -> np.ndarray:
        """Of the stretches of n words that begin in [low, high - n]: shifted to one power, so that equal stretches have equal ones."""
        count = high - low - n + 1
        own = self.sums[low + n : high + 1] - self.sums[low : low + count]
        return own * self.powers[::-1][low : low + count]


def _small(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    best = (alo, blo, 0)
    where: dict[int, list[int]] = {}
    for j in range(blo, bhi):
        where.setdefault(b[j], []).append(j)
    ending: dict[int, int] = {}
    for i in range(alo, ahi):
        now: dict[int, int] = {}
        for j in where.get(a[i], ()):
            now[j] = n = ending.get(j - 1, 0) + 1
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
        ending = now
    return best


def _longest(a: _Side, b: _Side, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest common stretch of two ranges: (begin in a, begin in b, length); the first in a, then in b."""

    def common(n: int) -> tuple[int, int] | None:
        if n > min(ahi - alo, bhi - blo):
            return None
        x, y = a.hashes(alo, ahi, n), b.hashes(blo, bhi, n)
        hit = np.flatnonzero(np.isin(x, y))
        for i in hit:  # the first one, but for a clash of hashes
            for j in np.flatnonzero(y == x[i]):
                if (a.numbers[alo + i : alo + i + n] == b.numbers[blo + j : blo + j + n]).all():
                    return alo + int(i), blo + int(j)
        return None

    # what stands at equal distances from the ranges' begins, or ends, is a first guess
    least = 0
    size = min(ahi - alo, bhi - blo)
    for x, y in ((a.numbers[alo : alo + size], b.numbers[blo : blo + size]), (a.numbers[ahi - size : ahi], b.numbers[bhi - size : bhi])):
        breaks = np.flatnonzero(np.concatenate([[True], x != y, [True]]))
        least = max(least, int(np.diff(breaks).max()) - 1)
    found, step = (common(least), 1) if least else (None, 1)
    low, high = least, None  # common at low, not at high
    while high is None or high - low > 1:
        n = low + step if high is None else (low + high) // 2
        got = common(n)
        if got is None:
            high = n
        else:
            low, found, step = n, got, 2 * step
    return (*found, low) if found is not None and low else (alo, blo, 0)


def _listed(a: _Side, b: _Side, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All common stretches of n words or more that can't be longer: (begin in a, begin in b, length). None if too many stretches of n words meet."""
    if min(len(a.numbers), len(b.numbers)) < n:
        return None
    x, y = a.hashes(0, len(a.numbers), n), b.hashes(0, len(b.numbers), n)
    order = np.argsort(y, kind="stable")
    y = y[order]
    low = np.searchsorted(y, x, "left")
    count = np.searchsorted(y, x, "right") - low
    if not 0 < count.sum() <= 4 * (len(x) + len(y)):
        return None
    i = np.repeat(np.arange(len(x)), count)
    j = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(i))]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    size = np.diff(np.append(first, len(i))) + n - 1
    i, j = i[first], j[first]
    ends = np.cumsum(size)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], AT_ONCE)), len(i)))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        own = size[low:high]
        at = np.repeat(i[low:high] - np.cumsum(own) + own, own) + np.arange(own.sum())
        if (a.numbers[at] != b.numbers[at - np.repeat(i[low:high] - j[low:high], own)]).any():  # a clash of hashes
            return None
    return i, j, size


def blocks(old: list[str], new: list[str]) -> list[tuple[int, int, int]]:
    """The common stretches in order, as (begin in old, begin in new, length), neighbours merged; last one of length 0 at the ends."""
    known: dict[str, int] = {}
    x, y = ([known.setdefault(t, len(known)) for t in side] for side in (old, new))
    most = max(len(x), len(y), 1)
    powers = np.full(most, _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    a, b = (_Side(np.array(side, np.int64), powers) for side in (x, y))
    a.powers = b.powers = powers
    least = SHORT
    while (runs := _listed(a, b, least)) is None and least < LONG:
        least *= 2
    open_, out = [(0, len(x), 0, len(y))], []
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        if alo == ahi or blo == bhi:
            continue
        n = 0
        if runs is not None and min(ahi - alo, bhi - blo) >= least:
            begin, apart, size = runs[0], runs[0] - runs[1], runs[2]
            low = np.maximum(np.maximum(begin, alo), blo + apart)
            size = np.minimum(np.minimum(begin + size, ahi), bhi + apart) - low
            best = size.max()
            if best >= least:
                own = np.flatnonzero(size == best)
                pick = own[np.lexsort((low[own] - apart[own], low[own]))[0]] if len(own) > 1 else own[0]
                i, j, n = int(low[pick]), int(low[pick] - apart[pick]), int(best)
        if not n:
            i, j, n = _small(x, y, alo, ahi, blo, bhi) if (ahi - alo) * (bhi - blo) <= SMALL else _longest(a, b, alo, ahi, blo, bhi)
        if n:
            out.append((i, j, n))
            open_ += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
    merged: list[tuple[int, int, int]] = []
    for i, j, n in sorted(out):
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
        else:
            merged.append((i, j, n))
    return [*merged, (len(x), len(y), 0)]


def changes(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """The stretches that differ: old[a:b] gave way to new[c:d]."""
    out, i, j = [], 0, 0
    for a, b, n in blocks(old, new):
        if i < a or j < b:
            out.append((i, a, j, b))
        i, j = a + n, b + n
    return out


def spans(before: str, after: str) -> list[str]:
    """The changed stretches: added, removed, a phrase (some words on either side) or a term (one word on both)."""
    old, new = tokens(before), tokens(after)
    out = []
    for a, b, c, d in changes(old, new):
        was, now = "".join(old[a:b]).strip(), "".join(new[c:d]).strip()
        if not was:
            out.append(f"[added] {now}")
        elif not now:
            out.append(f"[removed] {was}")
        else:
            label = "[term]" if len(was.split()) == len(now.split()) == 1 else "[phrase]"
            out.append(f"{label} {was} → {now}")
    return out


def lean(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes; a smaller limit that is set stays."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        own = int(re.sub(r"\D", "", spark.conf.get(key)))  # in rows, or in bytes with a unit "b"
        if not 0 < own <= most:
            spark.conf.set(key, most)


def _pairs(before: pa.Array, after: pa.Array) -> Iterator[tuple[str, str]]:
    """The texts of one row after the other (null: empty)."""
    return ((was.as_py() or "", now.as_py() or "") for was, now in zip(before, after, strict=True))


@F.arrow_udf(T.ArrayType(T.StringType()))
def diff(before: pa.Array, after: pa.Array) -> pa.Array:
    """Spans of each pair (a null counts as empty)."""
    ends, done, own, held = array("i", [0]), [pa.array([], pa.string())], [], 0
    for was, now in _pairs(before, after):
        found = spans(was, now)
        own += found
        held += sum(map(len, found))
        ends.append(ends[-1] + len(found))
        if held > AT_ONCE:
            done.append(pa.array(own, pa.string()))
            own, held = [], 0
    done.append(pa.array(own, pa.string()))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.concat_arrays(done))


_PIECE = T.ArrayType(T.StructType([T.StructField("kept", T.BooleanType()), T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())]))


@F.arrow_udf(_PIECE)
def pieces(before: pa.Array, after: pa.Array) -> pa.Array:
    """How the correction is made up: stretches of words of the draft that stay, and of its own, in order. ``first`` counts from 1."""
    ends, kept, first, size = array("i", [0]), array("b"), array("i"), array("i")

    def add(stays: bool, begin: int, n: int) -> None:
        kept.append(stays)
        first.append(begin + 1)
        size.append(n)

    for was, now in _pairs(before, after):
        at = 0
        for a, b, n in blocks(tokens(was), tokens(now)):
            if at < b:
                add(False, at, b - at)
            if n:
                add(True, a, n)
            at = b + n
        ends.append(len(kept))
    flat = pa.StructArray.from_arrays([pa.array(np.array(kept, bool)), pa.array(np.array(first, np.int32)), pa.array(np.array(size, np.int32))], names=["kept", "first", "n"])
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), flat)
