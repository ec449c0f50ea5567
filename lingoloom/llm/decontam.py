"""Benchmark decontamination: latent semantic retrieval of passages, then word-level checks.

1. *Statistics.* Word frequencies of the whole corpus, in a fixed number of hashed cells, give inverse document
   frequencies.
2. *Latent space.* The benchmark's items are TF-IDF rows; a distributed randomised SVD (range finder, one power step,
   Gram matrix of the projected rows) gives an orthonormal basis of at most RANK dimensions on the cells they use.
3. *Search.* Every document is cut into passages of WINDOW words, STEP apart, that cover it whole. A passage is folded
   into the latent space; its cosine with each item (whose part in the space is scaled to 1) makes candidates. Passages whose
   part in the space is too short to reach COSINE with any item are left out before. As RANK dimensions hold less of each item the more there are, and a long item is
   near no single passage, the exact cosine with each piece (WINDOW words, STEP apart) of each item makes candidates too: lists of
   the pieces with a cell are gone through for the rarer cells of a passage only, as the others can't reach the cosine together. A short item is a
   small part of a passage of other words, so every passage that holds a piece's rarest run of GRAM words is a candidate as well: no
   verbatim copy depends on a cosine.
4. *Checks.* A candidate's neighbourhood must hold a common subsequence of at least COVER of the item's words, and the
   item's answer (its last ANSWER of words) must be covered too, unless nearly all of the item is.

The items are a stated query set: they are worked off in blocks of at most BLOCK items and PIECES pieces (or one longer item), each
against all rows. One narrow pass per block; a block's data (about 4 kB an item) travel with the function.

Defined results: words are runs of letters and digits, case-folded for Latin letters; a null or wordless text has no
leak, and a null or wordless item finds none; repeated items are reported each; rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, buffers, filled, folded, lean, mix, tidied, word_hashes

CELL_BITS, RANK, EXTRA = 16, 192, 16
WINDOW, STEP = 32, 16
COSINE, GRAM = 0.25, 4
COVER, ANSWER, ANSWER_COVER, NEARLY_ALL = 0.7, 0.25, 0.5, 0.9
BLOCK, PIECES = 5_000, 1 << 16
#: Entries of lists worked off at once, and passages whose cells are counted at once; they bound a worker's memory.
ENTRIES, COUNTED = 1 << 20, 128
#: The share of the cosine that the cells left out of a search may make up together. Any below 1 gives the same results.
LEFT_OUT = 0.8
_SHIFT = np.uint64(64 - CELL_BITS)


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of rows [a, b): their words' hashes and where each row's begin."""
    offsets, data = buffers(texts)
    with np.errstate(over="ignore"):
        for a, b in blocks(texts):
            h, counts = word_hashes(folded(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], True)
            yield a, b, h, np.concatenate([[0], np.cumsum(counts)])


def frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse frequencies of the cells, from all words of all documents (a fixed 2 ** CELL_BITS numbers)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for _, _, h, _ in words_of(filled(batch.column(0))):
                total += np.bincount((h >> _SHIFT).astype(np.int64), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    sums = docs.select(text).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(1 << CELL_BITS)
    count[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    passages = max(1.0, count.sum() / WINDOW)
    return np.log1p(passages / (1 + np.minimum(count, passages))).astype(np.float32) - np.float32(np.log(1.5))


def _rows(texts: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, weights) of each text that has words: TF-IDF of length 1."""
    for _, _, h, at in words_of(texts):
        cell = (h >> _SHIFT).astype(np.int64)
        for x, y in zip(at[:-1], at[1:], strict=True):
            own, n = np.unique(cell[x:y], return_counts=True)
            w = n * np.maximum(idf[own], 0)
            if (norm := np.sqrt((w * w).sum())) > 0:
                yield own, w / norm


def basis(items: DataFrame, idf: np.ndarray, text: str, rank: int = RANK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(cells, basis): the leading right singular vectors of the items' TF-IDF matrix, by a randomised SVD.

    Each task adds up its rows' share of A' (A X) for the cells that its items use; shares meet by cell.
    """
    width = rank + EXTRA

    def drawn(own: np.ndarray) -> np.ndarray:
        """The cells' rows of the random test matrix, which is never made as a whole."""
        return np.array([np.random.default_rng([seed, c]).normal(size=width) for c in own.tolist()])

    def product(x: np.ndarray | None, cells: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for own, w in _rows(filled(batch.column(0)), idf):
                    y = w @ (drawn(own) if x is None else x[np.searchsorted(cells, own)])
                    for c, part in zip(own.tolist(), w, strict=True):
                        total[c] = total.get(c, 0) + part * y
            if total:
                rows = pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * width, np.concatenate(list(total.values())))
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), rows], names=["cell", "v"])

        parts = items.select(text).mapInArrow(run, "cell int, v array<double>")
        sums = parts.groupBy("cell").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("v")).orderBy("cell").toArrow()
        return sums["cell"].to_numpy(), np.concatenate([np.zeros(0), *(x.flatten().to_numpy() for x in sums["v"].chunks)]).reshape(-1, width)

    cells, y = product(None, None)
    if not len(cells):
        return cells, np.zeros((0, 0), np.float32)
    q, _ = np.linalg.qr(y)
    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    _, y = product(q, cells)  # A'A Q: its part inside Q is the Gram matrix of the projected rows
    value, vector = np.linalg.eigh(q.T @ y)
    best = np.argsort(-value)[:rank]
    best = best[value[best] > 1e-9]
    return cells, (q @ vector[:, best]).astype(np.float32)


@dataclass
class Items:
    """What a task needs of a block of items."""

    ids: list
    listed: list[list[int]]
    #: cell -> row of table (0 for cells that no item uses)
    row: np.ndarray
    table: np.ndarray
    latent: np.ndarray
    idf: np.ndarray
    #: item of each piece, and each item's first piece
    piece: np.ndarray
    first: np.ndarray
    #: row's range in (piece, weight), and its largest weight
    at: np.ndarray
    posted: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    #: the rows and weights of each piece, filled up with zeros
    rows: np.ndarray
    weights: np.ndarray
    #: the items' words of each length from 1 to GRAM that stand for them: (length, sorted hashes, items)
    grams: list[tuple[int, np.ndarray, np.ndarray]]


def pieces(words: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(item, words) of passages that cover each item, as documents are cut."""
    return [(i, w[x : x + WINDOW]) for i, w in enumerate(words) for x in range(0, max(1, len(w) - WINDOW + STEP), STEP) if len(w)]


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, by their first word."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out + h[k : k + size])
    return out


def rarest(cut: list[tuple[int, np.ndarray]], idf: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of each piece the run of GRAM words (all, if it has fewer) that fewest pieces have; of those, that of the rarest words."""
    own = [(i, min(GRAM, len(w)), runs(w, min(GRAM, len(w))), np.convolve(idf[(w >> _SHIFT).astype(np.int64)], np.ones(min(GRAM, len(w))), "valid")) for i, w in cut]
    seen, many = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(g) for _, _, g, _ in own)]), return_counts=True)
    chosen = {(n, g[np.lexsort((-v, many[np.searchsorted(seen, g)]))[0]].item(), i) for i, n, g, v in own}
    out = []
    for n in range(1, GRAM + 1):
        if some := sorted((g, i) for m, g, i in chosen if m == n):
            out.append((n, np.array([g for g, _ in some], np.uint64), np.array([i for _, i in some], np.int64)))
    return out


def inverted(cut: list[tuple[int, np.ndarray]], row: np.ndarray, rows: int, idf: np.ndarray, items: int) -> tuple[np.ndarray, ...]:
    """The fields of Items from piece to weights: each cell's idf times its weight in the pieces, scaled to length 1."""
    own_rows, own_weights = np.zeros((len(cut), WINDOW), np.int32), np.zeros((len(cut), WINDOW), np.float32)
    for j, (_, w) in enumerate(cut):
        own, n = np.unique((w >> _SHIFT).astype(np.int64), return_counts=True)
        value = n * np.maximum(idf[own], 0)
        if (norm := np.sqrt((value * value).sum())) > 0:
            used = np.flatnonzero((value > 0) & (row[own] > 0))
            own_rows[j, : len(used)], own_weights[j, : len(used)] = row[own[used]], idf[own[used]] * value[used] / norm
    j, column = np.nonzero(own_rows)
    r, v = own_rows[j, column], own_weights[j, column]
    order = np.argsort(r, kind="stable")
    most = np.zeros(rows, np.float32)
    np.maximum.at(most, r, v)
    at = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))])
    piece = np.array([i for i, _ in cut], np.int64)
    return piece, np.searchsorted(piece, np.arange(items + 1)), at, j[order].astype(np.int32), v[order], most, own_rows, own_weights


def indexed(rows: list[tuple], cells: np.ndarray, q: np.ndarray, idf: np.ndarray) -> Items:
    row = np.zeros(1 << CELL_BITS, np.int32)
    row[cells] = np.arange(1, len(cells) + 1)
    table = np.concatenate([np.zeros((1, q.shape[1]), np.float32), q * np.maximum(idf[cells], 0)[:, None]])
    texts = pa.array([t or "" for _, t in rows], pa.large_string())
    words = [h[x:y] for _, _, h, at in words_of(texts) for x, y in zip(at[:-1], at[1:], strict=True)]
    latent = np.array([table[row[(w >> _SHIFT).astype(np.int64)]].sum(0) for w in words], np.float32).reshape(len(words), q.shape[1])
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    cut = pieces(words)
    latent = np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 0)
    return Items([i for i, _ in rows], [w.tolist() for w in words], row, table, latent, idf, *inverted(cut, row, len(table), idf, len(words)), rarest(cut, idf))


def common(item: list[int], text: list[int]) -> list[int]:
    """Length of the longest common subsequence of the text with each of the item's ends: [all, answer]."""
    tail = item[len(item) - max(1, round(ANSWER * len(item))) :]
    return [_lcs(item, text), _lcs(tail, text)]


def _lcs(a: list[int], b: list[int]) -> int:
    """Bit-parallel: one step a word of b."""
    place: dict[int, int] = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := place.get(w, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def reaching(used: np.ndarray, total: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, piece, cosine) of the passages (rows of cells, 0: none; their squared norms) and all pieces that reach COSINE.

    Of a passage's cells the most common ones, whose largest weights add up to less than LEFT_OUT of what is needed, are left out of the
    search. A piece that what it shares of the others and that sum can't bring there is dropped; the rest are computed whole.
    """
    norm = np.sqrt(total + 1e-9)
    need = 0.9999 * COSINE * norm  # a little less, for sums of rounded numbers
    many = items.at[used + 1] - items.at[used]
    many[used == 0] = 0
    order = np.argsort(-many, axis=1, kind="stable")
    cells, many = np.take_along_axis(used, order, 1), np.take_along_axis(many, order, 1)
    sums = np.cumsum(items.most[cells], axis=1, dtype=np.float64)
    out = sums < LEFT_OUT * need[:, None]
    left = np.where(out, sums, 0).max(1)
    many[out] = 0
    last = np.cumsum(many.sum(1))
    a, width = 0, max(1, len(items.piece))
    while a < len(used):
        before = last[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(last, before + ENTRIES, "right")))
        p, column = np.nonzero(many[a:b])
        n = many[a:b][p, column]
        each = np.repeat(items.at[cells[a:b][p, column]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(p.astype(np.int64) * width, n) + items.posted[each]
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        if len(new):
            part = np.add.reduceat(items.weight[each[order]], new, dtype=np.float64)
            p, j = np.divmod(key[new], width)
            some = part + left[a + p] >= need[a + p]
            yield from _whole(used, norm, items, a + p[some], j[some])
        a = b


def _whole(used: np.ndarray, norm: np.ndarray, items: Items, p: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs (passage, piece; sorted by passage) that reach COSINE, with their cosines."""
    x = 0
    while x < len(p):
        y = min(int(np.searchsorted(p, p[x] + COUNTED)), x + ENTRIES // WINDOW)
        own = used[p[x] : p[y - 1] + 1]
        counts = np.zeros((len(own), len(items.most)), np.uint8)
        np.add.at(counts, (np.arange(len(own))[:, None], own), 1)
        cosine = (counts[p[x:y, None] - p[x], items.rows[j[x:y]]] * items.weights[j[x:y]]).sum(1, dtype=np.float64) / norm[p[x:y]]
        near = cosine >= COSINE
        yield p[x:y][near], j[x:y][near], cosine[near].astype(np.float32)
        x = y


def candidates(h: np.ndarray, at: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, item, cosine) of the passages of a block that come near an item."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STEP) + 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    first = at[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    last = np.minimum(first + WINDOW, at[owner + 1])
    cell = (h >> _SHIFT).astype(np.int32)
    weight = np.maximum(items.idf[cell], 0)
    weight *= weight
    row = items.row[cell]
    mass = np.concatenate([[0], np.cumsum(weight, dtype=np.float64)])
    shared = np.concatenate([[0], np.cumsum(row > 0)])
    total = mass[last] - mass[first]
    near = np.flatnonzero(shared[last] > shared[first])
    found = [none]
    for x in range(0, len(near), 4096):
        own = near[x : x + 4096]
        places = first[own, None] + np.arange(WINDOW)
        used = np.where(places < last[own, None], row[np.minimum(places, len(row) - 1)], 0)
        latent = np.zeros((len(own), items.table.shape[1]), np.float32)
        for j in range(WINDOW):
            some = np.flatnonzero(used[:, j])
            latent[some] += items.table[used[some, j]]
        # the passage's own norm counts its words outside the space too
        long = np.flatnonzero((latent * latent).sum(1) >= 0.999 * COSINE**2 * total[own])
        cosine = latent[long] @ items.latent.T
        cosine /= np.sqrt(total[own[long], None] + 1e-9).astype(np.float32)
        p, i = np.nonzero(cosine >= COSINE)
        found.append((own[long[p]], i, cosine[p, i]))
        found += [(own[p], items.piece[j], c) for p, j, c in reaching(used, total[own], items)]
    start = np.cumsum(count) - count
    for n, grams, whose in items.grams:
        g = runs(h, n)
        lo, hi = np.searchsorted(grams, g, "left"), np.searchsorted(grams, g, "right")
        place = np.flatnonzero(hi > lo)
        d = np.searchsorted(at, place, "right") - 1
        inside = place + n <= at[d + 1]
        place, d = place[inside], d[inside]
        many = hi[place] - lo[place]
        p = np.repeat(start[d] + np.minimum((place - at[d]) // STEP, count[d] - 1), many)
        each = np.repeat(lo[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        found.append((p, whose[each], np.zeros(len(p), np.float32)))
    p, i, c = (np.concatenate(x) for x in zip(*found, strict=True))
    key = p * max(1, len(items.latent)) + i
    order = np.lexsort((-c, key))
    order = order[np.diff(key[order], prepend=-1) != 0]  # the best of each passage and item
    return first[p[order]], i[order], c[order]


def near_cosine(passage: np.ndarray, item: int, items: Items) -> float:
    """The best exact cosine of a passage with the item's pieces."""
    cell = (passage >> _SHIFT).astype(np.int64)
    weight = np.maximum(items.idf[cell], 0).astype(np.float64)
    counts = np.bincount(items.row[cell], minlength=len(items.most))
    own = slice(items.first[item], items.first[item + 1])
    dot = (counts[items.rows[own]] * items.weights[own]).sum(1)
    return float(dot.max(initial=0) / np.sqrt((weight * weight).sum() + 1e-9))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", output: str = "leaks") -> DataFrame:
    """Add an array of (item, cover, cosine) to each row: the items that its text holds, sorted by item."""
    lean(docs.sparkSession)
    kept = [c for c in docs.columns if c != output]
    source = docs.select(*kept)
    idf = frequencies(docs, text)
    cells, q = basis(benchmark, idf, item_text)
    kind = benchmark.schema[item].dataType
    one = T.StructType([T.StructField("item", kind), T.StructField("cover", T.DoubleType()), T.StructField("cosine", T.DoubleType())])
    schema = T.StructType([*source.schema.fields, T.StructField(output, T.ArrayType(one))])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(schema[output].dataType)

    def pass_over(df: DataFrame, items: Items, carry: bool) -> DataFrame:
        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = filled(batch.column(text))
                found: list[list] = [list(x or ()) for x in batch.column(output).to_pylist()] if carry else [[] for _ in range(len(texts))]
                for a, _, h, at in words_of(texts):
                    if not len(h) or not len(items.latent) or not items.latent.shape[1]:
                        continue
                    seen: dict[tuple[int, int], tuple[float, float]] = {}
                    first, item_, cosine = candidates(h, at, items)
                    row = np.searchsorted(at, first, "right") - 1
                    order = np.lexsort((first, -cosine, item_, row))  # an item's passages of a row from the nearest on
                    for d, f, i, c in zip(*(x[order].tolist() for x in (row, first, item_, cosine)), strict=True):
                        best = seen.get((a + d, i), (0.0, 0.0))
                        if best[0] == 1 and best[1] >= COSINE:
                            continue  # found whole, and no further passage is nearer
                        own = items.listed[i]
                        lo, hi = max(int(at[d]), f - len(own)), min(int(at[d + 1]), f + WINDOW + len(own))
                        near = h[lo:hi].tolist()
                        some = set(near)
                        if sum(w in some for w in own) < max(COVER, best[0]) * len(own):
                            continue  # a bound on any common subsequence
                        whole, tail = common(own, near)
                        cover = whole / len(own)
                        if cover >= COVER and (cover >= NEARLY_ALL or tail >= ANSWER_COVER * max(1, round(ANSWER * len(own)))):
                            c = c or near_cosine(h[f : min(f + WINDOW, int(at[d + 1]))], i, items)
                            seen[a + d, i] = max(best, (cover, c))
                    for (d, i), (cover, c) in seen.items():
                        found[d].append({"item": items.ids[i], "cover": cover, "cosine": float(c)})
                rows = pa.array([sorted(x, key=lambda y: (y["item"] is None, y["item"])) for x in found], arrow)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), rows], names=[*kept, output])

        return df.mapInArrow(run, schema)

    out, carry = source, False
    block: list[tuple] = []
    size = 0
    for r in benchmark.select(item, item_text).orderBy(item, item_text).toLocalIterator():
        n = sum(len(pieces([h])) for _, _, h, _ in words_of(pa.array([r[1] or ""], pa.large_string())))
        if block and (len(block) == BLOCK or size + n > PIECES):
            out, carry, block, size = pass_over(out, indexed(block, cells, q, idf), carry), True, [], 0
        block.append((r[0], r[1]))
        size += n
    if block or not carry:
        out = pass_over(out, indexed(block, cells, q, idf), carry)
    return out
