"""Many phrases found in texts in one pass: an Aho-Corasick automaton for each bounded shard of phrases.

A phrase stands in a text if it occurs with neither a letter nor a digit beside it; a token if neither a letter, a digit, an apostrophe nor a
hyphen is beside it. Texts are read once for each shard, whatever the phrases have in common, and are not taken apart.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of a shard: some 20 MB as an automaton.
SHARD = 20_000
PHRASE, TOKEN = 0, 1


def _part_of(kind: int, c: str) -> bool:
    return c.isalnum() or (kind == TOKEN and c in "'-")


def automaton(needles: list[tuple[str, int]]) -> ahocorasick.Automaton:
    """Needles (lowered text, kind) to their places in the list."""
    made = ahocorasick.Automaton()
    places: dict[str, list[tuple[int, int]]] = {}
    for i, (needle, kind) in enumerate(needles):
        places.setdefault(needle, []).append((i, kind))
    for needle, own in places.items():
        made.add_word(needle, (len(needle), own))
    made.make_automaton()
    return made


def standing(made: ahocorasick.Automaton, text: str) -> set[int]:
    """The needles that stand in a lowered text."""
    found: set[int] = set()
    for end, (n, own) in made.iter(text):
        before, after = text[end - n : end - n + 1] if end >= n else "", text[end + 1 : end + 2]
        for i, kind in own:
            if i not in found and not (before and _part_of(kind, before)) and not (after and _part_of(kind, after)):
                found.add(i)
    return found


@functools.lru_cache(maxsize=2)
def _built(number: int, needles: Broadcast) -> ahocorasick.Automaton:
    """A worker builds a shard's automaton once, and keeps two."""
    return automaton(needles.value)


def found(texts: DataFrame, needles: DataFrame, text: str = "text", shard: int = SHARD) -> DataFrame:
    """The texts' other columns with needle and kind, a row for each distinct needle (needle: lowered, not empty; kind) that stands in the
    text. Shards are cut by a hash, and one at a time is sent to the tasks."""
    keys = [c for c in texts.columns if c != text]
    every = needles.select("needle", "kind").where("needle <> ''").distinct()
    parts = max(1, -(-every.count() * 5 // (4 * shard)))
    spark, out = texts.sparkSession, None
    lowered = texts.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != text) + ", _place int"
    for part in range(parts):
        own = sorted(tuple(r) for r in every.where(F.pmod(F.xxhash64("needle", "kind"), F.lit(parts)) == part).collect())  # a shard
        if not own:
            continue
        sent = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], number: int = sent._jbroadcast.id(), sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            made = _built(number, sent)
            for batch in batches:
                rows, places = [], []
                for i, x in enumerate(batch.column(len(keys))):
                    hit = standing(made, x.as_py())
                    rows += [i] * len(hit)
                    places += hit
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(places, pa.int32())], names=[*keys, "_place"])

        names = spark.createDataFrame([(i, needle, kind) for i, (needle, kind) in enumerate(own)], "_place int, needle string, kind int")
        hits = lowered.select(*keys, text).mapInArrow(run, schema).join(F.broadcast(names), "_place").drop("_place")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else texts.select(*keys, F.lit("").alias("needle"), F.lit(0).alias("kind")).where("false")
