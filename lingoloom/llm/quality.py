"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a 5-gram model over bytes, so it knows every script, case, digit and mark; START stands before a text.

1. *Blocks.* Texts are packed, compressed, into blocks of BLOCK bytes or a little more, those of over PIECE bytes in pieces; they are
   written once.
2. *Counts.* The 5-grams of trusted texts are counted in a shuffle by 5-gram. The count of a shorter one is the number of
   bytes that it follows (its continuations), by one more grouping for each order. The table grows with the trusted
   text; only the numbers of n-grams that occur once to four times, by order, come to the driver, for the discounts.
3. *Join.* The table is sharded by the hash of an n-gram's history, so that a shard has all it takes for the
   discounted probability of an n-gram and for the weight of its history. Each block asks every shard once for its
   distinct n-grams; a shard holds its part of the table, about SHARD n-grams, and answers block by block. For every LANE blocks
   there is another copy of the table, so that more text means more tasks, not larger ones.
4. *Scores.* Answers meet their block again, and log-probabilities are summed for each document.
5. *Thresholds.* One in FOLD trusted documents is kept out of the counts. A document is kept if its perplexity is at most
   the QUANTILE of those of its language; a language with fewer than ENOUGH of them uses that of all.

Defined results: a null or empty text has a null perplexity and is not kept; a null language is a language of its
own; with no trusted document at all, thresholds are null and every text that is not empty is kept; if none is kept out of the
counts, all trusted ones give the threshold. A perplexity at the threshold is kept. Rows are independent; repeated ids
with any trusted label are all trusted, and each such row counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, buffers, filled, lean, mix, staged, tidied

ORDER, START = 5, 255  # no byte of UTF-8 is 255
BLOCK, PIECE, SHARD, LEAST_SHARDS, LANE = 12 << 20, 1 << 20, 1 << 17, 16, 1024
QUANTILE, ENOUGH, FOLD = 0.995, 20, 5
#: No discount is less, so that every text has a probability.
LEAST = 0.1
#: Trusted ids up to this number (8 bytes each) are broadcast; more are shuffled.
BROADCAST_IDS = 500_000
#: Places of the order in an n-gram's number: above its bytes.
_TOP = 8 * ORDER
_TRAIN, _HELD = 1, 2


def codes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 5-gram that ends at each byte of a block, as a number; before a text's start stand STARTs."""
    n = len(data)
    own = data.astype(np.int64)
    out = own.copy()
    for back in range(1, ORDER):
        before = np.full(n, START, np.int64)
        before[back:] = own[: max(0, n - back)]
        for k in range(back):
            at = starts[:-1] + k
            before[at[at < starts[1:]]] = START
        out |= before << (8 * back)
    return out


def shorter(code: np.ndarray, order: int) -> np.ndarray:
    return code & ((1 << 8 * order) - 1)


def numbered(code: np.ndarray, order: int) -> np.ndarray:
    """The numbers of n-grams of an order among those of all orders."""
    return code | (order << _TOP)


def history(number: np.ndarray) -> np.ndarray:
    """The number of the bytes before the last one, among the histories of all orders."""
    return (number >> _TOP << _TOP) | (shorter(number, ORDER) >> 8)


def shard_of(number: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(history(number).astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int32)


def asked(five: np.ndarray) -> np.ndarray:
    """The distinct n-grams of all orders of distinct, sorted 5-grams, sorted by order and bytes."""
    found = [five]
    for k in range(ORDER - 1, 0, -1):
        found.append(np.unique(shorter(found[-1], k)))
    return np.concatenate([numbered(u, k) for k, u in zip(range(1, ORDER + 1), found[::-1], strict=True)])


def _pack(x: np.ndarray, level: int = 3) -> bytes:
    """Numbers, compressed: all first bytes, then all second ones, and so on."""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpack(z: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(z), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=0))


def _unpack_sorted(z: bytes) -> np.ndarray:
    return np.cumsum(_unpack(z, np.int64))


def _packed(docs: DataFrame, key: T.DataType, lang: T.DataType) -> DataFrame:
    """Rows of a block: block, lists (row, key, lang, use, skip, size) of its texts or pieces, z. docs: row, key, lang, use, text. A piece
    begins with ``skip`` bytes that belong to the piece before."""
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(n, T.ArrayType(t)) for n, t in (("row", T.LongType()), ("key", key), ("lang", lang), ("use", T.IntegerType()), ("skip", T.IntegerType()), ("size", T.IntegerType()))], T.StructField("z", T.BinaryType())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32  # the table is written once, so numbers never change
        held: list[tuple[list[pa.Array], bytes]] = []

        def flush() -> pa.RecordBatch:
            nonlocal block
            lists = [pa.concat_arrays([x[i] for x, _ in held]) for i in range(6)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            z = zstandard.ZstdCompressor(level=6).compress(b"".join(raw for _, raw in held))
            held.clear()
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([block - 1]), *lists, pa.array([z])], names=schema.names)

        for batch in batches:
            offsets, data = buffers(filled(batch.column(4)))
            raw = memoryview(data)
            rows, low, high, skip = np.arange(batch.num_rows), offsets[:-1], offsets[1:], np.zeros(batch.num_rows, np.int64)
            if (high - low > PIECE).any():
                cut = [(i, x, min(y, x + PIECE), x > a) for i, (a, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True)) for x in range(a, max(y, a + 1), PIECE)]
                rows, low, high, more = (np.array(x) for x in zip(*cut, strict=True))
                skip = np.where(more, ORDER - 1, 0)  # a piece is longer than that
                low = low - skip
            own = [batch.column(i).take(pa.array(rows)) for i in range(4)] + [pa.array(skip, pa.int32()), pa.array(high - low, pa.int32())]
            held.append((own, b"".join(raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True))))
            if sum(len(x) for _, x in held) >= BLOCK:
                yield flush()
        if held:
            yield flush()

    return docs.select("row", "key", "lang", "use", "text").mapInArrow(run, schema)


def _opened(z: pa.Scalar, skip: pa.Scalar, size: pa.Scalar) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For about PIECE bytes of a block at once: (first text, 5-grams, where each text's begin, whether each belongs to its text)."""
    skip, size = (x.values.to_numpy().astype(np.int64) for x in (skip, size))
    data = np.frombuffer(zstandard.decompress(z.as_py()), np.uint8) if size.sum() else np.zeros(0, np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, "right")) - 1)
        starts = at[first : last + 1] - at[first]
        own = np.ones(starts[-1], bool)
        for x, n in zip(starts[:-1], skip[first:last], strict=True):
            if n:
                own[x : x + n] = False
        yield first, codes(data[at[first] : at[last]], starts), starts, own
        first = last


def _distinct(z: pa.Scalar, skip: pa.Scalar, size: pa.Scalar) -> np.ndarray:
    """The distinct 5-grams of a block, sorted."""
    found = [np.unique(code[own]) for _, code, _, own in _opened(z, skip, size)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def ngram_counts(packed: DataFrame) -> list[DataFrame]:
    """(code, c) of the n-grams of ORDER bytes and fewer of the training texts: counts, then continuation counts."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, c = (np.concatenate(x) for x in zip(*held, strict=True))
            out, at = np.unique(code, return_inverse=True)
            return out, np.bincount(at, c).astype(np.int64)

        for batch in batches:
            for use, skip, sizes, z in zip(*(batch.column(c) for c in ("use", "skip", "size", "z")), strict=True):
                counted = use.values.to_numpy() == _TRAIN
                for first, code, starts, own in _opened(z, skip, sizes):
                    own &= np.repeat(counted[first : first + len(starts) - 1], np.diff(starts))
                    held.append(np.unique(code[own], return_counts=True))
                    size += len(held[-1][0])
                    if size > 1 << 21:
                        held = [merged()]
                        if len(held[0][0]) > 1 << 20:  # mostly different ones: their sums are left to the shuffle
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["code", "c"])
                        size = sum(len(x) for x, _ in held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["code", "c"])

    found = packed.select("use", "skip", "size", "z").where(F.array_contains("use", _TRAIN)).mapInArrow(run, "code long, c long")
    out = [staged(found.groupBy("code").agg(F.sum("c").alias("c")), "ngrams")]
    for k in range(ORDER - 1, 0, -1):
        out.append(staged(out[-1].groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).agg(F.count("*").alias("c")), "ngrams"))
    return out[::-1]


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """For n-grams that occur once, twice and more often, given how many occur once to four times."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return [max(LEAST, min(k, k - (k + 1) * y * b / a)) if a and b else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


class Shard:
    """A part of the table, with all n-grams of its histories."""

    def __init__(self, number: np.ndarray, c: np.ndarray):
        order = np.argsort(number)
        self.number, self.c = number[order], c[order]
        h = history(self.number)
        first = np.flatnonzero(np.concatenate([[True], np.diff(h) != 0])) if len(h) else np.zeros(0, np.int64)
        self.history = h[first]
        #: by history: how many n-grams there are, in all and of those that occur once, twice and more often
        kinds = [self.c, self.c == 1, self.c == 2, self.c > 2]
        self.sums = np.stack([np.add.reduceat(x.astype(np.int64), first) if len(h) else np.zeros(0, np.int64) for x in kinds])

    def answer(self, number: np.ndarray) -> np.ndarray:
        """Counts of the n-grams, then the four sums of each of their distinct histories; 0 for unknown ones."""
        found = []
        for known, values, own in ((self.number, self.c[None], number), (self.history, self.sums, histories(number))):
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            found.append(np.where(known[at] == own, values[:, at], 0).ravel() if len(known) else np.zeros(len(values) * len(own), np.int64))
        return np.concatenate(found)


def histories(number: np.ndarray) -> np.ndarray:
    """The distinct histories of sorted n-grams, in order."""
    h = history(number)
    return h[np.concatenate([[True], np.diff(h) != 0])] if len(h) else h


_ROWS = "shard int, kind int, block long, z binary, c binary"


def _requests(packed: DataFrame, shards: int, lanes: int) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, skip, sizes, z in zip(*(batch.column(c) for c in ("block", "skip", "size", "z")), strict=True):
                number = asked(_distinct(z, skip, sizes))
                shard = shard_of(number, shards)
                some = np.unique(shard)
                lane = int(mix(np.array([block.as_py()], np.uint64))[0]) % lanes
                yield pa.RecordBatch.from_arrays([pa.array(some + np.int32(lane * shards)), pa.array(np.ones(len(some), np.int32)), pa.array(np.full(len(some), block.as_py())), pa.array([_pack_sorted(number[shard == s]) for s in some], pa.binary()), pa.nulls(len(some), pa.binary())], names=["shard", "kind", "block", "z", "c"])

    return packed.select("block", "skip", "size", "z").mapInArrow(run, _ROWS)


def _dealt(grams: DataFrame, shards: int, lanes: int) -> DataFrame:
    """The table (number, c) as rows like those of requests, of kind 0, for each lane."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(number)
            number, c = number[order], c[order]
            shard = shard_of(number, shards)
            some = np.unique(shard)
            z = [(_pack_sorted(number[shard == s]), _pack(c[shard == s])) for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.zeros(len(some), np.int32)), pa.array(np.zeros(len(some), np.int64)), pa.array([x for x, _ in z], pa.binary()), pa.array([y for _, y in z], pa.binary())], names=["shard", "kind", "block", "z", "c"])

    made = grams.select("number", "c").mapInArrow(run, _ROWS)
    return made.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("shard", (F.col("shard") + F.col("lane") * shards).cast("int")).drop("lane")


def _answers(rows: DataFrame, shards: int) -> DataFrame:
    """(block, shard, z) for each request; rows come sorted by shard, the table's first."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for shard, kind, block, z, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if shard != now:
                    now, parts, table = shard, [], None
                if kind == 0:
                    parts.append((_unpack_sorted(z), _unpack(c, np.int64)))
                    continue
                if table is None:
                    table = Shard(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ([], []))))
                    parts = []
                out.append((block, shard % shards, _pack(table.answer(_unpack_sorted(z)))))
            if out:
                block, shard, z = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(shard, pa.int32()), pa.array(z, pa.binary())], names=["block", "shard", "z"])

    return rows.mapInArrow(run, "block long, shard int, z binary")


def log_probabilities(five: np.ndarray, answers: dict[int, np.ndarray], shards: int, discount: np.ndarray) -> np.ndarray:
    """log p of distinct, sorted 5-grams, interpolated from the uniform distribution up; answers: by shard; discount: by order and count."""
    number = asked(five)
    shard = shard_of(number, shards)
    order = number >> _TOP
    share, weight = np.zeros(len(number)), np.ones(len(number))
    for s, found in answers.items():
        own = np.flatnonzero(shard == s)
        c, sums = found[: len(own)], found[len(own) :].reshape(4, -1)
        h = history(number[own])
        place = np.cumsum(np.concatenate([[0], np.diff(h) != 0]))
        whole, *kinds = sums[:, place].astype(np.float64)
        less = discount[order[own]]
        known = whole > 0
        whole[~known] = 1
        share[own] = (c - less[np.arange(len(own)), np.minimum(c, 3)]) / whole * (c > 0)
        weight[own] = np.where(known, sum(x * less[:, j] for j, x in enumerate(kinds, 1)) / whole, 1.0)
    before, p = np.zeros(1, np.int64), np.full(1, 1 / 256)
    for k in range(1, ORDER + 1):
        own = np.flatnonzero(order == k)
        code = shorter(number[own], ORDER)
        p = share[own] + weight[own] * p[np.searchsorted(before, shorter(code, k - 1))]
        before = code
    return np.log(p)


def perplexities(packed: DataFrame, answers: DataFrame, shards: int, discount: np.ndarray) -> DataFrame:
    """(key, lang, use, perplexity) of each row; the perplexity is per byte, and null for no text."""
    lists = answers.groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("shard", "z")).alias("found"))
    both = packed.join(lists, F.col("block") == F.col("_block"), "left").select("row", "key", "lang", "use", "skip", "size", "z", "found")
    kind = lambda c: packed.schema[c].dataType.elementType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", kind("key")), T.StructField("lang", kind("lang")), T.StructField("use", T.IntegerType()), T.StructField("log", T.DoubleType()), T.StructField("n", T.LongType())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                skip, size, z, found = (batch.column(c)[i] for c in ("skip", "size", "z", "found"))
                five = _distinct(z, skip, size)
                told = {x["shard"]: _unpack(x["z"], np.int64) for x in found.as_py() or ()}
                log = log_probabilities(five, told, shards, discount) if len(five) else np.zeros(0)
                sums, n = np.zeros(len(size)), size.values.to_numpy() - skip.values.to_numpy()
                for first, code, starts, own in _opened(z, skip, size):
                    some, at = np.unique(code, return_inverse=True)
                    # the context of a piece is not asked for, and left out of the sum
                    value = np.append(log, 0.0)[np.searchsorted(five, some)][at] * own
                    total = np.concatenate([[0.0], np.cumsum(value)])
                    sums[first : first + len(starts) - 1] = total[starts[1:]] - total[starts[:-1]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i].values for c in ("row", "key", "lang", "use")), pa.array(sums), pa.array(n, pa.int64())], names=schema.names)

    found = both.mapInArrow(run, schema)
    found = found.groupBy("row").agg(*[F.any_value(c).alias(c) for c in ("key", "lang", "use")], F.sum("log").alias("log"), F.sum("n").alias("n"))
    return found.select("key", "lang", "use", F.when(F.col("n") > 0, F.exp(-F.col("log") / F.col("n"))).alias("perplexity"))


def classify(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """Per row: key, lang, perplexity, threshold and keep. trusted: the keys of trusted documents."""
    lean(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    ids = trusted.select(F.col(key).alias("_id")).where("_id is not null").distinct()
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % FOLD
    ids = ids.withColumn("use", F.when(fold == 0, _HELD).otherwise(_TRAIN))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    used = docs.join(ids, F.col("key") == F.col("_id"), "left").select(F.monotonically_increasing_id().alias("row"), "key", "lang", F.coalesce("use", F.lit(0)).alias("use"), "text")
    # blocks are written in buckets, so that answers come to them and they are never moved themselves
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed, forget = bucketed(_packed(used, docs.schema["key"].dataType, docs.schema["lang"].dataType), "blocks", "block", int(min(50_000, max(64, size // (4 * BLOCK)))))

    counts = ngram_counts(packed)
    grams = None
    for k, own in enumerate(counts, 1):
        own = own.select(F.col("code").bitwiseOR(F.lit(k << _TOP)).alias("number"), F.lit(k).alias("k"), "c")
        grams = own if grams is None else grams.unionByName(own)
    rare = {(r["k"], r["few"]): r["n"] for r in grams.groupBy("k", F.least("c", F.lit(5)).alias("few")).agg(F.count("*").alias("n")).collect()}
    discount = np.zeros((ORDER + 1, 4))
    for k in range(1, ORDER + 1):
        discount[k, 1:] = discounts(*(rare.get((k, j), 0) for j in range(1, 5)))
    shards = max(LEAST_SHARDS, sum(rare.values()) // SHARD)
    lanes = max(1, -(-packed.count() // LANE))
    rows = _dealt(grams, shards, lanes).unionByName(_requests(packed, shards, lanes))
    answers = _answers(rows.repartition("shard").sortWithinPartitions("shard", "kind"), shards)
    scored = staged(perplexities(packed, answers, shards, discount), "perplexity")
    forget()

    known = scored.where("use > 0 and perplexity is not null")
    place = lambda use: F.percentile_approx(F.when(F.col("use") >= use, F.col("perplexity")), F.lit(quantile), 10_000)
    every = known.agg(F.coalesce(place(_HELD), place(_TRAIN))).first()[0]  # one number; the languages' numbers are as few as languages
    own = known.where(F.col("use") == _HELD).groupBy(F.col("lang").alias("_lang")).agg(F.when(F.count("*") >= ENOUGH, place(_HELD)).alias("own"))
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.coalesce(F.col("own"), F.lit(every).cast("double"))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select(F.col("key").alias(key), F.col("lang").alias(lang), "perplexity", threshold.alias("threshold"), keep.alias("keep"))
