"""Vector code compression: product quantisation in whole numbers, nearest entries by a kd-tree for each codebook.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook, which starts as that part of the rows with
the smallest ids. A round broadcasts a kd-tree for each codebook (of bounded size: parts x entries vectors). Tasks find each part's
nearest entry by branch and bound, many vectors at once: a node is left out for the vectors whose distance to its box is greater than
their best so far, so nodes at an equal distance are searched and of equally near entries the lowest index stays. Tasks sum the parts
of each entry in whole numbers, and Spark adds the tasks' sums; only the new codebooks come to the driver.

Defined results: rows with a null vector, or one with a null or non-finite component, are dropped. Shorter vectors count as padded with
zeros, to the longest one's length rounded up to a multiple of the parts; components beyond ``vectors.LIMIT`` count as it. Rows with
equal ids are separate rows, of which the codebooks start with the one whose numbers come first; rows without an id come last there.
With fewer rows than entries, codebooks have an entry for each row. A label's error is null where it doesn't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged, tidied
from .vectors import distances, matrix, whole

#: Entries of a leaf, and vectors that are searched at once.
LEAF, BLOCK = 16, 4096
_FAR = np.iinfo(np.int64).max


@dataclass
class Node:
    """A box around some entries: a leaf with their indexes in ascending order, or two nodes below."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    below: tuple[Node, Node] | None = None

    def gap(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of x's rows to the box: no entry of it is nearer."""
        out = np.maximum(self.low - x, 0)
        out += np.maximum(x - self.high, 0)
        return (out * out).sum(1)


def tree(points: np.ndarray, entries: np.ndarray | None = None) -> Node:
    entries = np.arange(len(points)) if entries is None else entries
    mine = points[entries]
    node = Node(mine.min(0), mine.max(0), entries)
    if len(entries) > LEAF and (node.low < node.high).any():
        wide = int((node.high - node.low).argmax())
        order = entries[np.argsort(mine[:, wide], kind="stable")]
        half = len(order) // 2
        node.below = tree(points, np.sort(order[:half])), tree(points, np.sort(order[half:]))
    return node


def nearest(points: np.ndarray, root: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest entry (of equally near ones the lowest index), and its squared distance."""
    best, entry = np.full(len(x), _FAR), np.full(len(x), len(points))

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.below is None:
            d = distances(x[rows], points[node.entries])
            at = d.argmin(1)  # the first of equal ones
            d, found = d[np.arange(len(rows)), at], node.entries[at]
            better = (d < best[rows]) | ((d == best[rows]) & (found < entry[rows]))
            best[rows[better]], entry[rows[better]] = d[better], found[better]
            return
        gaps = [child.gap(x[rows]) for child in node.below]
        left_first = gaps[0] <= gaps[1]
        for near, far, mine in ((0, 1, left_first), (1, 0, ~left_first)):
            for side in (near, far):
                visit(node.below[side], rows[mine][gaps[side][mine] <= best[rows[mine]]])

    visit(root, np.arange(len(x)))
    return entry, best


def _coded(column: pa.Array, books: list[tuple[np.ndarray, Node]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors cut into parts, entries, squared distances), some rows at a time."""
    for at in range(0, len(column), BLOCK):
        x = matrix(column.slice(at, BLOCK), width * len(books)).reshape(-1, len(books), width)
        found = [nearest(points, root, np.ascontiguousarray(x[:, p])) for p, (points, root) in enumerate(books)]
        yield x, np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)


def _summed(books: Broadcast, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums and numbers of the parts of each entry."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.value
        shape = len(trees), len(trees[0][0])
        total, count = np.zeros((*shape, width), np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            for x, entry, _ in _coded(batch.column("q"), trees, width):
                for p in range(len(trees)):
                    np.add.at(total[p], entry[:, p], x[:, p])
                    count[p] += np.bincount(entry[:, p], minlength=shape[1])
        part, entry = np.nonzero(count)
        if len(part):
            sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    return run


def _written(books: Broadcast, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's code and error."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.value
        for batch in batches:
            codes, errors = [], [np.zeros(0, np.int64)]
            for _, entry, d in _coded(batch.column("q"), trees, width):
                codes += ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
                errors.append(d.sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(codes, pa.string()), pa.array(np.concatenate(errors))], names=["key", "label", "code", "error"])

    return run


def codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """(part, entry, position): the entries after so many rounds, from vectors (key, q)."""
    spark = vectors.sparkSession
    longest = vectors.agg(F.max(F.size("q"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = vectors.select("key", "q").orderBy(F.asc_nulls_last("key"), "q").limit(entries).select("q").toArrow()
    books = matrix(first["q"], width * parts).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        shared = spark.sparkContext.broadcast([(points, tree(points)) for points in books])
        sums = vectors.select("q").mapInArrow(_summed(shared, width), "part long, entry long, n long, sums array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
        for row in sums.collect():  # parts x entries rows at most
            books[row.part, row.entry] = [s // row.n for s in row.sums]
        shared.destroy()
    return books


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """Per row: key, code (two hex digits for each part's entry), error (squared distances summed over parts), label_error (errors summed
    over equal labels, nulls together), codebooks_sha256. At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    spark = rows.sparkSession
    lean(spark)
    vectors = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), whole(F.col(vector), scale).alias("q")).where("q is not null")
    vectors = staged(vectors, "vectors")
    books = codebooks(vectors, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast([(points, tree(points)) for points in books] if books.shape[1] else [])
    kinds = vectors.schema
    schema = f"key {kinds['key'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long"
    coded = staged(vectors.mapInArrow(_written(shared, books.shape[2]), schema), "codes")
    shared.destroy()
    total = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    coded = coded.join(total, F.col("label").eqNullSafe(F.col("of")))
    return coded.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
