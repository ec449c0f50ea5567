"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that also starts anywhere else.

The LENGTH-byte suffix prefixes ("windows") of all texts are sorted bucket by bucket, and long ties are resolved by
ranks of a cover sample that are computed before. The sample is a difference cover in the text's own coordinates:

* *Anchors.* Each window's anchor is its K-byte string of least hash, leftmost of equals. Equal windows have equal
  anchors at equal distances, so windows are put into buckets by their anchor's hash, and buckets are independent.
  Consecutive windows of one anchor form a run.
* *Pruning.* A bucket of one run has no duplicate; in a bucket whose runs all have the same text, every window of them
  is one. Neither needs sorting. What remains are the edges of repeats.
* *Blocks.* Those buckets' distinct run texts are laid out in blocks of bounded size with every anchor at a multiple
  of V bytes. So equal windows have equal phases, and the positions at multiples of V are a cover: within V bytes of
  any window's start lies one, at the same distance for equal windows. V-byte pieces at cover positions are ranked, then
  4 V bytes by the ranks of their pieces. Windows are sorted by the rank at their first cover position; only ties are
  compared on the V bytes that the rank doesn't hold.

A positional cover would sample more than a tenth of all positions and give each pair of suffixes another distance;
anchors sample one in about 65 and give all equal ones the same.

* *Large buckets.* A bucket of more than ``most`` distinct runs would make one task long. Its windows are dealt into bands
  of WIDTHS[0] neighbouring distances to the anchor. All windows of a band hold the same LENGTH - WIDTHS[0] + 1 bytes
  around the anchor, so equal windows agree in the hash of these, and the parts of runs in a band with one such hash are a
  bucket of their own, pruned and sorted like any other. What is still too large is divided again into narrower bands.
  The narrowest has one distance: there the shared bytes are the window, and a bucket is one distinct window.

Texts are moved twice, compressed, and copies of a text never: everything is computed for distinct texts.

Defined results: a null text counts as empty; texts shorter than LENGTH lose nothing; matches never cross rows; repeated
rows are copies of each other (so all bytes of a text of LENGTH or more that has a copy go).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, buffers, filled, lean, mix, staged, tidied, unclashed

LENGTH, K, V = 200, 32, 40
SPAN = LENGTH - K + 1
BLOCK = 1 << 20
#: Bytes of one long text that are worked on at once.
SEGMENT = 2 << 20
#: Distinct runs of a bucket that one task sorts (about 300 bytes each, so a quarter of a block).
MOST = 1024
#: Distances in the bands of a larger bucket, from the first division to the last.
WIDTHS = (56, 14, 1)
_C = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's hash) of each run of a block of at most 16 MB; positions in the block."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty.view(np.uint64)
    h = mix(data.astype(np.uint64) + np.uint64(1))
    s = 1
    while s < K:
        h = mix(h[: n - 2 * s + 1] * _C + h[s : n - s + 1])
        s *= 2
    order = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    count = len(h) - SPAN + 1
    rows = np.concatenate([order, np.full(-len(h) % SPAN, ~np.uint64(0))]).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(rows, 1).ravel()[SPAN - 1 : SPAN - 1 + count]
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()[:count]
    anchor = (np.minimum(ahead, behind) & _LOW).astype(np.int64)
    edge = np.zeros(count + 1, np.int32)
    a, b = starts[:-1], starts[1:] - LENGTH + 1
    long = b > a
    np.add.at(edge, a[long], 1)
    np.add.at(edge, b[long], -1)
    inside = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(inside):
        return empty, empty, empty, empty.view(np.uint64)
    anchor = anchor[inside]
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(inside) != 1))
    first, last = inside[np.concatenate([[0], cut + 1])], inside[np.concatenate([cut, [len(inside) - 1]])]
    at = anchor[np.concatenate([[0], cut + 1])]
    # two documents' adjacent windows can't share an anchor: it lies inside its window
    return first, last, at, h[at]


def _described(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block: row, first window (in its text), windows, anchor's distance, hash and digest of each run."""
    offsets, data = buffers(texts)
    with np.errstate(over="ignore"):
        for a, b in blocks(texts, BLOCK):
            lo, hi = int(offsets[a]), int(offsets[b])
            step = hi - lo if hi - lo <= SEGMENT else SEGMENT - LENGTH + 1
            for at in range(lo, max(hi - LENGTH + 1, lo + 1), max(step, 1)):
                part = data[at : min(hi, at + (step if step == hi - lo else SEGMENT))]
                starts = offsets[a : b + 1] - lo if step == hi - lo else np.array([0, len(part)])
                first, last, anchor, h = runs(part, starts)
                raw = part.tobytes()
                digest = b"".join(hashlib.blake2b(raw[x : y + LENGTH], digest_size=8).digest() for x, y in zip(first.tolist(), last.tolist(), strict=True))
                row = np.searchsorted(starts, first, "right") - 1
                yield a + row, first - starts[row] + (at - lo), last - first + 1, anchor - first, h.view(np.int64), np.frombuffer(digest, np.int64)


def _runs(docs: DataFrame) -> DataFrame:
    """(k, h, digest, at) of all runs of (k, text); at packs first window, anchor's distance and windows - 1."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for row, first, count, anchor, h, digest in _described(filled(batch.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[row], h, digest, first << 16 | anchor << 8 | (count - 1))], names=["k", "h", "digest", "at"])

    return docs.select("k", "text").mapInArrow(run, "k long, h long, digest long, at long")


def ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows, by the columns from first to last."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated(bucket: np.ndarray, texts: list[bytes], anchor: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (run, number) that equal another run's window of the same bucket. texts: distinct within a bucket."""
    # layout: anchors at multiples of V
    sizes = np.array([len(t) for t in texts])
    room = -(-(sizes + 2 * V) // V) * V
    base = np.cumsum(room) - room
    anchors = base + -(-anchor // V) * V
    buf = np.zeros(int(room.sum()) + LENGTH + V, np.uint8)
    begin = anchors - anchor
    for x, t in zip(begin.tolist(), texts, strict=True):
        buf[x : x + len(t)] = np.frombuffer(t, np.uint8)
    # ranks of the cover sample: pieces of V bytes, then of 4 V
    whole = len(buf) // V * V
    words = buf[:whole].reshape(-1, V).view(">u8")
    piece = ranks(*words.T)
    four = ranks(*(piece[j : len(piece) - 3 + j] for j in range(4)))
    # windows
    run = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    i = begin[run] + number
    away = anchors[run] - i
    phase = away % V
    cover = four[(i + phase) // V]
    # windows of one bucket, at one distance from the anchor, with one rank
    key = ranks(bucket[run] * LENGTH + away, cover)
    tied = np.bincount(key)[key] > 1
    run, number, i, phase, key = (x[tied] for x in (run, number, i, phase, key))
    rest = np.empty((len(i), V), np.uint8)
    for t in range(V):
        rest[:, t] = buf[i + t + 4 * V * (t >= phase)]
    key = ranks(key, *rest.view(">u8").T)
    same = np.bincount(key, minlength=1)[key] > 1 if len(key) else np.zeros(0, bool)
    return run[same], number[same]


def _intervals(run: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, last) of stretches of consecutive numbers; input sorted by run, then number."""
    cut = np.flatnonzero((np.diff(run) != 0) | (np.diff(number) != 1))
    a, b = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(run) - 1]])
    return run[a], number[a], number[b]


_FOUND = "h long, digest long, low int, high int"


def _sorted_blocks(pieces: DataFrame) -> DataFrame:
    """repeated() for all buckets of (h, digest, anchor, count, text), which come sorted by h; about BLOCK bytes at once."""

    def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        h, digest = t["h"].to_numpy(), t["digest"].to_numpy()
        bucket = np.cumsum(np.concatenate([[0], np.diff(h) != 0]))
        run, number = repeated(bucket, t["text"].to_pylist(), t["anchor"].to_numpy(), t["count"].to_numpy())
        if len(run):
            order = np.lexsort((number, run))
            own, low, high = _intervals(run[order], number[order])
            yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(digest[own]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["h", "digest", "low", "high"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            h = batch.column(0).to_numpy()
            new = np.concatenate([[not held or held[-1].column(0)[-1].as_py() != h[0]], np.diff(h) != 0])
            heads = np.flatnonzero(new).tolist()
            weight = np.concatenate([[0], np.cumsum([len(x) for x in batch.column(4).to_pylist()])])
            at = 0
            for head in heads:
                if size + weight[head] - weight[at] >= BLOCK:
                    if head > at:
                        held.append(batch.slice(at, head - at))
                    yield from work(held)
                    held, size, at = [], 0, head
            if at < len(h):
                held.append(batch.slice(at))
                size += int(weight[-1] - weight[at])
        if held:
            yield from work(held)

    return pieces.select("h", "digest", "anchor", "count", "text").mapInArrow(run, _FOUND)


def _divided(pieces: DataFrame, width: int) -> DataFrame:
    """(parent, whole, base, h, digest, anchor, count, text): the runs (parent, whole) of large buckets in parts, one for each
    band of so many distances. base is the part's first window in its run; h hashes the band and the bytes its windows share."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, digest, anchor, count, text in zip(*(batch.column(c).to_pylist() for c in ("h", "digest", "anchor", "count", "text")), strict=True):
                for band in range((anchor - count + 1) // width, anchor // width + 1):
                    nearest = anchor - band * width
                    a, b = max(0, nearest - width + 1), min(count - 1, nearest)
                    part, shared = text[a : b + LENGTH], text[nearest : nearest - width + 1 + LENGTH]
                    own = hashlib.blake2b(shared, digest_size=8, salt=h.to_bytes(8, "little", signed=True), person=band.to_bytes(8, "little"))
                    rows.append((h, digest, a, int.from_bytes(own.digest(), "little", signed=True), int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True), anchor - a, b - a + 1, part))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["parent", "whole", "base", "h", "digest", "anchor", "count", "text"])

    return pieces.select("h", "digest", "anchor", "count", "text").mapInArrow(run, "parent long, whole long, base int, h long, digest long, anchor int, count int, text binary")


def _settled(pieces: DataFrame, large: DataFrame, most: int, widths: tuple[int, ...]) -> DataFrame:
    """(h, digest, low, high): stretches of windows of the distinct runs (h, digest, anchor, count, text) that another run of their bucket
    holds too. large: the buckets of more than ``most`` runs, staged."""
    ordered = lambda df: df.repartition("h").sortWithinPartitions("h")
    if large.isEmpty():
        return _sorted_blocks(ordered(pieces))
    pieces = staged(pieces, "pieces")
    found = _sorted_blocks(ordered(pieces.join(large, "h", "left_anti")))
    parts = staged(_divided(pieces.join(large, "h", "left_semi"), widths[0]), "parts")
    # equal parts of a bucket are one kind, merged before the shuffle as well
    kinds = staged(parts.groupBy("h", "digest").agg(F.count("*").alias("n"), F.first(F.struct("anchor", "count", "text")).alias("one")), "part_kinds")
    sizes = staged(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "part_sizes")
    several = kinds.join(sizes, "h", "left_semi").select("h", "digest", "one.*")
    inner = _settled(several, sizes.where(F.col("kinds") > most).select("h"), most, widths[1:])
    inner = inner.union(kinds.where("n > 1").select("h", "digest", F.lit(0), F.col("one.count") - 1)).distinct()
    back = parts.join(inner, ["h", "digest"]).select(F.col("parent").alias("h"), F.col("whole").alias("digest"), (F.col("base") + F.col("low")).alias("low"), (F.col("base") + F.col("high")).alias("high"))
    return found.union(back)


def halves(text: Column) -> tuple[Column, Column]:
    """A text's name in 128 bits."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _packed(docs: DataFrame) -> DataFrame:
    """(k, z): each distinct text, compressed; copies are merged before and after the shuffle."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            offsets, data = buffers(filled(batch.column(2)))
            raw = memoryview(data)
            z = [own.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=["k", "k2", "z"])

    packed = docs.select("k", "k2", "text").mapInArrow(run, "k long, k2 long, z binary")
    return packed.groupBy("k").agg(F.first("z").alias("z"))


def _pieces(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, digest, anchor, count, text) of the wanted runs (k, h, digest, at)."""
    lists = wanted.groupBy("k").agg(F.collect_list(F.struct("h", "digest", "at")).alias("runs"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdDecompressor()
        for batch in batches:
            for z, x in zip(batch.column(0), batch.column(1), strict=True):
                text = own.decompress(z.as_py())
                h, digest, at = x.values.flatten()
                first, anchor, count = at.to_numpy() >> 16, (at.to_numpy() >> 8) & 255, (at.to_numpy() & 255) + 1
                cut = [text[a : a + n - 1 + LENGTH] for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([h, digest, pa.array(anchor.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(cut, pa.binary())], names=["h", "digest", "anchor", "count", "text"])

    return packed.join(lists, "k").select("z", "runs").mapInArrow(run, "h long, digest long, anchor int, count int, text binary")


def spans(docs: DataFrame, packed: DataFrame, most: int) -> DataFrame:
    """(k, first, n): stretches of n windows of the text of hash k that also start elsewhere. docs: k, text, with copies."""
    every = staged(_runs(docs), "described")
    buckets = every.groupBy("h").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1")
    # written first, so that the join is free to split a common bucket
    buckets = staged(buckets.select("h", (F.col("low") != F.col("high")).alias("mixed")), "buckets")
    shared = staged(every.join(buckets, "h"), "runs")
    kinds = shared.where("mixed").groupBy("h", "digest").agg(F.count("*").alias("n"), F.min(F.struct("k", "at")).alias("one"))
    kinds = staged(kinds, "kinds")
    pieces = _pieces(packed, kinds.select("one.k", "h", "digest", "one.at"))
    sizes = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most).select("h")
    large = staged(sizes, "large")
    found = _settled(pieces, large, most, WIDTHS)
    # a run that occurs twice as a whole is repeated as a whole
    found = found.union(kinds.where("n > 1").select("h", "digest", F.lit(0), (one_at(F.col("one.at")) - 1).cast("int"))).distinct()
    mixed = shared.where("mixed").select("k", "h", "digest", F.shiftright("at", 16).alias("at"))
    edges = mixed.join(found, ["h", "digest"]).select("k", (F.col("at") + F.col("low")).alias("first"), (F.col("high") - F.col("low") + 1).alias("n"))
    return shared.where("not mixed").select("k", F.shiftright("at", 16).alias("first"), one_at(F.col("at")).cast("int").alias("n")).union(edges)


def one_at(at: Column) -> Column:
    """Number of windows, from the packed column."""
    return at.bitwiseAND(F.lit(255)) + 1


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, kept: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes that stay)."""
    lean(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key).alias("key"), body.alias("text"), *(x.alias(n) for x, n in zip(halves(body), ("k", "k2"), strict=True)))
    own = unclashed(own, "k", "k2")
    packed = _packed(own)
    lists = spans(own, packed, most).groupBy("k").agg(F.collect_set(F.shiftleft("first", 24).bitwiseOR(F.col("n").cast("long"))).alias("spans"))
    more = ", kept binary" if kept else ""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for z, x in zip(batch.column(1), batch.column(2), strict=True):
                raw = own.decompress(z.as_py())
                cover = np.zeros(len(raw) + 1, np.int32)
                if x.is_valid:
                    at = x.values.to_numpy()
                    np.add.at(cover, at >> 24, 1)
                    np.add.at(cover, (at >> 24) + (at & 0xFFFFFF) - 1 + LENGTH, -1)
                gone = np.cumsum(cover)[:-1] > 0
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                row = (len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest(), left)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            made = [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made][: 6 if kept else 5], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if kept else 5])

    made = packed.join(lists, "k", "left").select("k", "z", "spans").mapInArrow(run, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)
    return own.select("key", "k").join(made, "k").drop("k").withColumnRenamed("key", key)
