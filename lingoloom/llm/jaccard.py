"""N-gram Jaccard join: sets of word shingles, count vectors bound the overlap, survivors are verified exactly.

Two documents link when 100 * intersection >= 75 * union of their sets of 5-word shingles. The method:

1. *Sets.* Shingles are 64-bit hashes. Documents of equal sets are one class (a digest of the set); copies are never
   compared. A set's hashes are also counted in 128 groups: the class's count vector.
2. *Buckets.* Linked sets share one of the first n - ceil(0.75 n) + 1 shingles in any common order (prefix filter),
   so classes meet in buckets by those. Shingles of the same classes are one bucket with their number. The order puts shingles last
   that fall in crowded cells of a count sketch of the whole corpus, which grows with it; it decides speed only.
3. *Pivots.* Each class of a bucket is first paired with one pivot of the bucket only, the class whose shingles are most common, so a
   group of near copies costs about one comparison a class. Pairs that meet in as many shingles as a link needs, and pass the bound of
   their count vectors, are verified; their links give components.
4. *R-tree.* In buckets that still hold several components, the count vectors are packed into a tree whose nodes keep
   the largest counts and the least size below them; the sum of coordinate minima bounds the overlap from above. Pairs
   of different components that pass it, and meet in as many shingles as a link needs, are verified too. A pair inside
   one component can't change any component, so none that matters is left out. Large buckets are cut by set size before.

The tree stands inside a bucket, because a box tree over a corpus has no equi-join form; the bound is the same.

Buckets of crowded shingles are made by pre-aggregation and a join that adaptive execution can split; copies
are thinned before the shuffle. Everything is written to the shared folder between steps.

Defined results: words are runs of bytes other than ASCII white space, A-Z lowered; with fewer than five words, the
whole sequence is one shingle; a null or wordless text has an empty set, which links with nothing. Rows with equal
ids are separate documents; a null id is never the smallest of its component unless alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, buffers, filled, lean, mix, staged, tidied, unclashed, word_hashes
from .components import components

SHINGLE, GROUPS, LEAF = 5, 128, 16
#: Bytes of text to a cell of the sketch, the least and the most cells (as powers of 2), and cells moved together.
CELL_BYTES, CELL_BITS, PART = 512, (18, 22), 1 << 12
#: A count's largest value as stored; what lies above it is added to every bound.
TOP = 255
#: Classes of a bucket that are searched whole; larger ones are cut by set size, whose ratio for linked sets is at most 4 / 3.
LARGE, BAND = 1024, 1.34
#: Ids up to this number (8 bytes each) are broadcast to pick texts; more are shuffled.
BROADCAST_IDS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block (repeats included) and where each document's begin."""
    words, counts = word_hashes(data, starts)
    ends = np.cumsum(counts)
    n = max(0, len(words) - SHINGLE + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        acc *= _STEP
        acc += words[j : j + n]
    acc = mix(acc)
    full = np.maximum(counts - SHINGLE + 1, 0)
    made = np.where((counts > 0) & (full == 0), 1, full)
    at = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(at[-1], np.uint64)
    inside = np.zeros(n, bool)
    if n:
        crossing = np.concatenate([np.arange(e - SHINGLE + 1, e) for e in ends]) if len(ends) else np.zeros(0, np.int64)
        inside[:] = True
        inside[crossing[(crossing >= 0) & (crossing < n)]] = False
    short = np.flatnonzero((counts > 0) & (full == 0))
    place = np.ones(len(out), bool)
    place[at[short]] = False
    out[place] = acc[inside]
    for d in short:
        h = np.uint64(counts[d])
        for w in words[ends[d] - counts[d] : ends[d]]:
            h = h * _STEP + w
        out[at[d]] = mix(np.array([h]))[0]
    return out, at


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of each text of an Arrow array."""
    offsets, data = buffers(texts)
    with np.errstate(over="ignore"):
        for a, b in blocks(texts):
            own, at = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i in range(b - a):
                yield np.unique(own[at[i] : at[i + 1]])


def crowding(docs: DataFrame, text: str) -> np.ndarray:
    """A class for each cell of shingle hashes: 0, or larger the more the cell exceeds the mean.

    Each task counts all its shingles by cell; cells are summed in a shuffle, compressed in parts of PART. There is a cell for about
    CELL_BYTES of text, within the bounds CELL_BITS (at most 32 MB on the driver). A shingle in more than about 7 times the root of a
    cell's mean count makes its cell crowded, so that is the bound of an uncrowded shingle's documents.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(size / CELL_BYTES + 1)), *CELL_BITS))

    @tidied
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        held: list[np.ndarray] = []

        def add() -> None:
            total[:] += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
            held.clear()

        with np.errstate(over="ignore"):
            for batch in batches:
                texts = filled(batch.column(0))
                offsets, data = buffers(texts)
                for a, b in blocks(texts):
                    own, _ = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    held.append((own >> np.uint64(64 - bits)).astype(np.int64))
                    if sum(map(len, held)) >= 1 << 20:
                        add()
        if held:
            add()
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [(i, pack(x.tobytes())) for i, x in enumerate(total.reshape(-1, PART)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([z for _, z in parts], pa.binary())], names=["part", "z"])

    @tidied
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(unpack(z), np.uint32).astype(np.int64)
        pack = zstandard.ZstdCompressor().compress
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(x.tobytes()) for x in sums.values()], pa.binary())], names=["part", "n"])

    sums = docs.select(text).mapInArrow(counted, "part int, z binary").repartition("part").mapInArrow(added, "part int, n binary").toArrow()
    count = np.zeros((1 << bits) // PART * PART, np.float64).reshape(-1, PART)
    for i, n in zip(sums["part"].to_pylist(), sums["n"].to_pylist(), strict=True):
        count[i] = np.frombuffer(zstandard.decompress(n), np.int64)
    count = count.ravel()
    mean = count.mean()
    excess = count - mean - 6 * np.sqrt(mean) - 8
    return np.where(excess > 0, 1 + np.floor(np.log2(np.maximum(excess, 1))), 0).astype(np.uint8)


def described(docs: DataFrame, key: str, text: str, crowded: np.ndarray) -> DataFrame:
    """Per document: key, h (the text's hash), n (set size), c1 and c2 (the set's digest), counts, cold and hot (its first shingles in the common
    order, uncrowded and crowded ones); the last three are null for repeats of a set within one task."""
    kind = docs.schema[key].dataType.simpleString()
    rows = pa.list_(pa.int64())
    shift = np.uint64(65 - len(crowded).bit_length())

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            n, codes, counts, cold, hot = [], [], [], [], []
            for own in sets_of(filled(batch.column(1))):
                n.append(len(own))
                code = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                codes.append(code)
                if not len(own) or code in seen:
                    counts.append(None), cold.append(None), hot.append(None)
                    continue
                seen.add(code)
                most = len(own) - (3 * len(own) + 3) // 4 + 1
                level = crowded[own >> shift]
                first = own[:most] if not level.any() else own[np.lexsort((own, level))[:most]]
                few = int((level == 0).sum())
                counts.append(np.minimum(np.bincount(own & np.uint64(GROUPS - 1), minlength=GROUPS), TOP).astype(np.uint8).tobytes())
                cold.append(first[:few].view(np.int64)), hot.append(first[few:].view(np.int64))
            c = np.frombuffer(b"".join(codes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(counts, pa.binary()), pa.array(cold, rows), pa.array(hot, rows)], names=["key", "h", "n", "c1", "c2", "counts", "cold", "hot"])

    return docs.select(F.col(key).alias("key"), text, F.xxhash64(text).alias("h")).mapInArrow(run, f"key {kind}, h long, n long, c1 long, c2 long, counts binary, cold array<long>, hot array<long>")


def bound(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most shingles that sets of counts x and y and sizes n and m can share: the sum of coordinate minima, and what counts above
    TOP may add."""
    sums = [v.sum(-1, dtype=np.int64) for v in (x, y)]
    return np.minimum(x, y).sum(-1, dtype=np.int64) + np.minimum(n - sums[0], m - sums[1])


def vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def bounded(pairs: DataFrame) -> DataFrame:
    """The pairs of (a, b, na, nb, xa, xb) whose summed coordinate minima allow a link: 7 * overlap >= 3 * (na + nb)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = 7 * bound(vectors(batch.column(4)), vectors(batch.column(5)), n, m) >= 3 * (n + m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets. classes: c1, and key and h of one document each."""
    wanted = staged(pairs.select("a").union(pairs.select("b")).distinct().join(classes, F.col("a") == F.col("c1")).select("c1", F.col("key").alias("one"), F.col("h").alias("one_h")), "wanted")
    own = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.join(own, F.col(key).eqNullSafe(F.col("one")) & (F.xxhash64(text) == F.col("one_h"))).groupBy("c1").agg(F.first(text).alias("t"))
    left = pairs.join(texts.select(F.col("c1").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(texts.select(F.col("c1").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(sets_of(filled(batch.column(2))), sets_of(filled(batch.column(3))), strict=True):
                z = np.concatenate([x, y])
                z.sort()
                both = int((z[1:] == z[:-1]).sum())
                keep.append(7 * both >= 3 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many of their first shingles two linked sets of these sizes share at least.

    Up to the first list that ends, common shingles are in both lists; behind it at most the rest of that set is common.
    """
    return -(-3 * (n + m) // 7) - np.maximum((3 * n + 3) // 4, (3 * m + 3) // 4) + 1


def gathered(rows: DataFrame) -> DataFrame:
    """(sig, df, cls, many) of (token, cls), which come sorted by token: shingles of the same two or more classes are one bucket,
    named by a hash of its classes; ``many`` shingles of a task made it, and it holds ``df`` classes."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(token: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((cls, token))
            token, cls = token[order], cls[order]
            once = np.concatenate([[True], (np.diff(token) != 0) | (np.diff(cls) != 0)])
            token, cls = token[once], cls[once]
            start = np.flatnonzero(np.concatenate([[True], np.diff(token) != 0]))
            df = np.diff(np.concatenate([start, [len(token)]]))
            with np.errstate(over="ignore"):
                sig = mix(np.add.reduceat(mix(cls.view(np.uint64) + _STEP), start) + df.astype(np.uint64))
            some = np.flatnonzero(df > 1)
            sig, at, many = np.unique(sig[some], return_index=True, return_counts=True)
            start, df = start[some[at]], df[some[at]]
            place = np.repeat(start - (np.cumsum(df) - df), df) + np.arange(df.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(sig.view(np.int64), df)), pa.array(np.repeat(df, df)), pa.array(cls[place]), pa.array(np.repeat(many, df))], names=["sig", "df", "cls", "many"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= 1 << 18:
                token, cls = (np.concatenate(x) for x in zip(*held, strict=True))
                last = int(np.searchsorted(token, token[-1]))  # the last shingle may go on in the next batch
                if last:
                    yield made(token[:last], cls[:last])
                held, size = [(token[last:], cls[last:])], len(token) - last
        if size:
            yield made(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.select("token", "cls").mapInArrow(run, "sig long, df long, cls long, many long")


def tree_pairs(comp: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pairs (places) of a bucket's classes, of different components, whose bound allows a link; by a tree of count vectors.

    A node holds the largest counts, the largest excess over them and the least size of LEAF nodes below it. Pairs of nodes are
    gone down depth first, a few at a time, and left where their bound is too low or all below is of one component.
    """
    order = np.lexsort((*counts.T[:3], n))
    comp, n, counts = comp[order], n[order], counts[order]
    levels = [(counts, n, n - counts.sum(1, dtype=np.int64), comp, comp)]
    while len(levels[-1][0]) > LEAF:
        edges = np.arange(0, len(levels[-1][0]), LEAF)
        levels.append(tuple(f.reduceat(x, edges) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), levels[-1], strict=True)))
    i, j = np.triu_indices(len(levels[-1][0]))
    out = [np.zeros((0, 2), np.int64)]
    todo = [(len(levels) - 1, i, j)]
    step = np.arange(LEAF)
    while todo:
        level, i, j = todo.pop()
        if len(i) > 1 << 14:
            todo.append((level, i[1 << 14 :], j[1 << 14 :]))
            i, j = i[: 1 << 14], j[: 1 << 14]
        top, least, more, low, high = levels[level]
        some = (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
        if level == 0:
            some &= i != j
        i, j = i[some], j[some]
        some = 7 * (np.minimum(top[i], top[j]).sum(1, dtype=np.int64) + np.minimum(more[i], more[j])) >= 3 * (least[i] + least[j])
        i, j = i[some], j[some]
        if level == 0:
            out.append(np.stack([order[i], order[j]], 1))
            continue
        below = len(levels[level - 1][0])
        for at in range(0, len(i), 64):
            a = np.repeat(i[at : at + 64, None] * LEAF + step, LEAF, 1).ravel()
            b = np.tile(j[at : at + 64, None] * LEAF + step, LEAF).ravel()
            inside = (a <= b) & (b < below)
            todo.append((level - 1, a[inside], b[inside]))
    return np.concatenate(out)


def bucket_pairs(bucket: np.ndarray, comp: np.ndarray, n: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """The same for many buckets (rows sorted by bucket); those of one leaf are done together, by their size."""
    start = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
    size = np.diff(np.concatenate([start, [len(bucket)]]))
    for s in range(2, LEAF + 1):
        own = start[size == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, 20_000 // len(i))
        for at in range(0, len(own), step):
            x, y = ((own[at : at + step, None] + k).ravel() for k in (i, j))
            other = comp[x] != comp[y]
            x, y = x[other], y[other]
            ok = 7 * bound(counts[x], counts[y], n[x], n[y]) >= 3 * (n[x] + n[y])
            yield np.stack([x[ok], y[ok]], 1)
    for a, s in zip(start[size > LEAF], size[size > LEAF], strict=True):
        yield a + tree_pairs(comp[a : a + s], n[a : a + s], counts[a : a + s])


def _searched(rows: DataFrame) -> DataFrame:
    """bucket_pairs of (sig, band, cls, comp, n, many, guest, counts), which come sorted by sig and band: a row (a, b, needed, many) for
    each bucket of a pair. Two guests of a band meet in another."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            sig, band, cls, comp, n, many, guest, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = np.cumsum(np.concatenate([[0], (np.diff(sig) != 0) | (np.diff(band) != 0)]))
            for found in bucket_pairs(bucket, comp, n, counts):
                found = found[~(guest[found[:, 0]] & guest[found[:, 1]])]
                x, y = found.T
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y]), needed(n[x], n[y]), many[x])], names=["a", "b", "needed", "many"])

        for batch in batches:
            part = (*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]), vectors(batch.column(7)))
            new = np.flatnonzero((np.diff(part[0]) != 0) | (np.diff(part[1]) != 0))
            last = int(new[-1]) + 1 if len(new) else 0
            # the batch's last bucket may go on in the next one
            if held and (last or part[0][0] != held[-1][0][-1] or part[1][0] != held[-1][1][-1]):
                yield from flush([*held, tuple(x[:last] for x in part)] if last else held)
                held = []
            elif last:
                yield from flush([tuple(x[:last] for x in part)])
            held.append(tuple(x[last:] for x in part))
        if held:
            yield from flush(held)

    return rows.select("sig", "band", "cls", "comp", "n", "many", "guest", "counts").mapInArrow(run, "a long, b long, needed long, many long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: str | None = None) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key that it reaches by links).

    hashed: name of a column for the text's xxhash64, which with the key names a row where keys repeat.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    named, key, text = key, "key", "text"
    own = unclashed(staged(described(docs, key, text, crowding(docs, text)), "sets"), "c1", "c2")
    classes = own.where("n > 0").groupBy("c1").agg(F.min(F.struct(F.isnull("key").alias("none"), "key", "h")).alias("one"), F.min("n").alias("n"), F.first("counts", True).alias("counts"))
    classes = staged(classes.select("c1", F.col("one.key").alias("key"), F.col("one.h").alias("h"), "n", "counts"), "classes")

    ends = lambda by: own.select(F.explode(by).alias("token"), F.col("c1").alias("cls"))
    cold = gathered(ends("cold").repartition("token").sortWithinPartitions("token"))
    hot = ends("hot").distinct()
    peak = hot.groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("cls")).alias("x")).where("df > 1")
    hot = hot.join(peak, "token").select(F.xxhash64("x", "df").alias("sig"), "df", "cls", F.lit(1).alias("many"))
    buckets = cold.unionByName(hot).groupBy("sig", "cls").agg(F.max("df").alias("df"), F.sum("many").alias("many"))
    buckets = staged(buckets, "shared")
    # the class with most in common with others comes first in its buckets: of near copies, that nearest to their source
    middle = buckets.groupBy("cls").agg(F.round(F.sum(F.col("many") * F.log2("df")), 3).alias("score"))
    middle = middle.join(classes.select(F.col("c1").alias("cls"), "n"), "cls")
    buckets = staged(buckets.join(middle, "cls").select("sig", "cls", "many", "n", "score"), "buckets")
    pivots = buckets.groupBy("sig").agg(F.max(F.struct("score", "cls", "n")).alias("pivot")).select("sig", F.col("pivot.cls").alias("pivot"), F.col("pivot.n").alias("m"))
    pivots = staged(pivots, "pivots")

    vector = lambda c, x: classes.select(F.col("c1").alias(c), F.col("counts").alias(x))
    first_of = F.col("pivot") < F.col("cls")
    tried = buckets.join(pivots, "sig").where("cls <> pivot").groupBy(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b"), F.when(first_of, F.col("m")).otherwise(F.col("n")).alias("na"), F.when(first_of, F.col("n")).otherwise(F.col("m")).alias("nb")).agg(F.sum("many").alias("met"))
    na, nb = F.col("na"), F.col("nb")
    enough = F.col("met") >= F.ceil(3 * (na + nb) / 7) - F.greatest(F.ceil(0.75 * na), F.ceil(0.75 * nb)) + 1
    tried = tried.where(enough & (4 * na >= 3 * nb) & (4 * nb >= 3 * na))
    first = staged(bounded(tried.join(vector("a", "xa"), "a").join(vector("b", "xb"), "b")), "pairs")
    links = staged(verified(first, classes, docs, key, text), "links")
    comps = components(links)

    label = F.coalesce("component", "cls")
    rest = buckets.join(comps, F.col("cls") == F.col("node"), "left").select("sig", "cls", "many", "n", label.alias("comp"))
    mixed = rest.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low <> high").select("sig", "size")
    band = F.floor(F.ln("n") / math.log(BAND)).cast("int")
    place = lambda at, guest: F.struct(at.alias("band"), F.lit(guest).alias("guest"))
    cut = F.when(F.col("size") <= LARGE, F.array(place(F.lit(0), False))).otherwise(F.array(place(band, False), place(band + 1, True)))
    rest = rest.join(mixed, "sig").select("sig", "cls", "many", "n", "comp", F.explode(cut).alias("x")).select("*", "x.*").drop("x")
    rest = rest.join(classes.select(F.col("c1").alias("cls"), "counts"), "cls")
    met = _searched(rest.repartition("sig", "band").sortWithinPartitions("sig", "band")).groupBy("a", "b").agg(F.sum("many").alias("met"), F.first("needed").alias("needed"))
    second = staged(met.where("met >= needed").select("a", "b").join(first, ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        more = staged(verified(second, classes, docs, key, text), "links")
        if not more.isEmpty():
            comps = components(links.union(more))

    of_class = classes.join(comps, F.col("c1") == F.col("node"), "left").select("c1", "key", F.coalesce("component", "c1").alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("key").alias("component_id"))
    of_class = of_class.join(least, "comp").select("c1", "component_id")
    out = own.select("key", "h", "n", F.when(F.col("n") > 0, F.col("c1")).alias("c1")).join(of_class, "c1", "left")
    more = [F.col("h").alias(hashed)] if hashed else []
    return out.select(F.col("key").alias(named), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"), *more)


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without all but one of each component: that of the smallest key. Rows without words all stay,
    once for each key; rows that repeat key and text are one."""
    found = join(docs, key, text, "_h").withColumn("_none", F.isnull(key))
    name = "__text_hash"
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    one = found.where("n_shingles > 0").groupBy(group.alias("g")).agg(F.min(F.struct("_none", F.col(key).alias("__k"), F.col("_h").alias("__h"))).alias("one")).select("one.__k", "one.__h")
    empty = found.where("n_shingles = 0").select(F.col(key).alias("__k"), F.col("_h").alias("__h")).distinct()
    chosen = one.union(empty)
    kept = docs.withColumn(name, F.xxhash64(text)).join(chosen, F.col(key).eqNullSafe(F.col("__k")) & (F.col(name) == F.col("__h")), "left_semi")
    return kept.dropDuplicates([key, name]).drop(name)
