"""Hard-negative mining: a full score sort for each anchor, in runs of bounded size that are merged.

A row's score is its integer inner product with the anchor. For each anchor,

1. *Positives.* Rows of the anchor's label with the highest scores (ties: smaller id).
2. *Negatives.* All scores are sorted by score and id. A binary search finds where scores fall to a positive's upper limit; the rows of
   other labels from there on, down to the lower limit, are read until k are found.

Anchors are a stated query set and meet all rows: rows and anchors are dealt out to blocks by number, and each pair of blocks is one
cell, which sorts its scores some anchors at a time. Both sides are bounded, and so is a task's memory. A cell hands on at most as many
positives, and as many negatives of a positive, as the whole result may have; the best of these over all cells are the result, as the
first k of a sorted list are among the first k of its parts. No label is a key, so a label that holds most rows is no hot spot.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; shorter vectors count as
padded with zeros; components beyond ``vectors.LIMIT`` count as it. Rows with the anchor's id are neither its positives nor its
negatives. Repeated rows take part one by one, and a repeated anchor gives its result once for each. An anchor without positives, and a
positive without negatives, has no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, staged
from .vectors import matrix, products, whole

#: Rows and anchors of a cell at most, numbers of a block of rows, and scores that are sorted at once.
ROWS, ANCHORS, NUMBERS, SCORES = 1 << 16, 1 << 14, 1 << 22, 1 << 20
#: Blocks of rows that a table is cut into at least, where they have LEAST rows each.
BLOCKS, LEAST = 64, 512


class Ranked:
    """Rows of a block against anchors, some anchors at a time: positions of rows by score (high first) and id, and their scores."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, width: int):
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        self.rows, self.anchors = rows.take(pa.array(order)), anchors
        self.ids, self.own = self.rows["id"].to_numpy(), anchors["id"].to_numpy()
        codes = pc.dictionary_encode(pa.chunked_array([*self.rows["label"].chunks, *anchors["label"].chunks], self.rows["label"].type)).combine_chunks()
        codes = (pa.concat_arrays(codes.chunks) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        self.labels, self.label = codes[: len(order)], codes[len(order) :]
        self.x, self.a = matrix(self.rows["q"], width), matrix(anchors["q"], width)

    def __iter__(self):
        step = max(1, SCORES // max(1, len(self.ids)))
        for at in range(0, len(self.own), step):
            score = products(self.a[at : at + step], self.x)
            order = np.argsort(-score, axis=1, kind="stable")  # rows stand by id, so this sorts by score and id
            yield at, order, np.take_along_axis(score, order, 1)


def _positives(rows: pa.Table, anchors: pa.Table, width: int, most: int) -> pa.Table:
    """The best rows of an anchor's label."""
    ranked, found = Ranked(rows, anchors, width), []
    number = anchors["a"].to_numpy()
    for at, order, score in ranked:
        part = slice(at, at + len(order))
        good = (ranked.labels[order] == ranked.label[part, None]) & (ranked.ids[order] != ranked.own[part, None])
        good &= np.cumsum(good, 1) <= most
        i, j = np.nonzero(good)
        found.append((number[part][i], ranked.ids[order[i, j]], score[i, j]))
    return pa.table([np.concatenate([x[k] for x in found]) for k in range(3)], names=["a", "id", "score"])


def _negatives(rows: pa.Table, anchors: pa.Table, width: int, most: int, lower: int, upper: int) -> pa.Table:
    """The first rows of other labels between the limits of each positive."""
    ranked, found = Ranked(rows, anchors, width), []
    number, wanted = anchors["a"].to_numpy(), anchors["positives"].to_pylist()
    for at, order, score in ranked:
        for i in range(len(order)):
            other = np.flatnonzero((ranked.labels[order[i]] != ranked.label[at + i]) & (ranked.ids[order[i]] != ranked.own[at + i]))
            falling = -score[i][other]
            for p, x in enumerate(wanted[at + i]):
                high, low = upper * x["score"] // 100, -(-lower * x["score"] // 100)
                begin, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                if begin < end:
                    picked = other[begin : min(end, begin + most)]
                    one = np.ones(len(picked), np.int64)
                    found.append((number[at + i] * one, p * one, ranked.ids[order[i][picked]], score[i][picked]))
    none = np.zeros(0, np.int64)
    return pa.table([np.concatenate([none, *(x[k] for x in found)]) for k in range(4)], names=["a", "p", "id", "score"])


def _celled(rows: DataFrame, anchors: DataFrame, run, schema: str, blocks: int, parts: int) -> DataFrame:
    """run(rows, anchors) on each pair of a block of rows and a block of anchors. Rows get their blocks by their place in the staged
    table, whatever their ids are."""
    place = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", place(blocks)).withColumn("part", spread(parts))
    right = anchors.withColumn("part", place(parts)).withColumn("block", spread(blocks))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)


def _best(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the rows that ``anchors`` picks as anchors.

    Components become floor(scale * x); negatives' scores are from lower to upper per cent of the positive's.
    """
    lean(rows.sparkSession)
    picked = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), whole(F.col(vector), scale).alias("q"), anchors.alias("anchor"))
    picked = staged(picked.where("id is not null and label is not null and q is not null"), "vectors")
    size = picked.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("width")).first()
    width = max(1, size.width)
    one = max(1, min(ROWS, NUMBERS // width, max(LEAST, size.n // BLOCKS)))
    blocks, parts = max(1, -(-size.n // one)), max(1, -(-size.anchors // max(1, min(ANCHORS, NUMBERS // width))))
    chosen = staged(picked.where("anchor").select(F.monotonically_increasing_id().alias("a"), "id", "label", "q"), "anchors")
    table = picked.select("id", "label", "q")

    empty = lambda names: pa.table({x: pa.array([], pa.int64()) for x in names})
    found = _celled(table, chosen, lambda x, y: _positives(x, y, width, positives) if x.num_rows and y.num_rows else empty(["a", "id", "score"]), "a long, id long, score long", blocks, parts)
    best = _best(found, ["a"], positives).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    chosen = staged(chosen.join(best, "a"), "positives")
    found = _celled(table, chosen, lambda x, y: _negatives(x, y, width, negatives, lower, upper) if x.num_rows and y.num_rows else empty(["a", "p", "id", "score"]), "a long, p long, id long, score long", blocks, parts)
    out = _best(found, ["a", "p"], negatives).join(chosen.select("a", F.col("id").alias("anchor_id"), "positives"), "a")
    positive = F.element_at("positives", (F.col("p") + 1).cast("int"))
    return out.select("anchor_id", positive["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
