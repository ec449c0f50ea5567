"""SimHash near-dedup by multi-index hashing.

1. *Fingerprints.* A text's shingles of three words, repeats included, are hashed to 64 bits; a bit of the fingerprint is set where it
   is set in over half of the hashes. Copies of one fingerprint are one class from here on and are never compared.
2. *Tables.* A fingerprint is cut into two segments of 32 bits. Of two fingerprints with at most 3 differing bits, one segment differs
   in at most one bit. Each class is entered in both segments' tables, and looks up the ball of radius 1 around each segment. Where two
   segments differ in one bit, one of them has a 0 there, so it is enough that balls set one bit (17 lookups on average and not 33).
3. *Crowded entries.* Many classes may share a segment (texts made from one template). Entries with more than LARGE classes are cut
   again in the same way: the other segment differs in at most 3 bits, so that one of its halves of 16 bits differs in at most one. What
   then shares an entry is bounded by the 16 bits that are left, however large the corpus is.
4. *Verification* of whole distances happens in the join, so that only links leave it. Links give components.

All steps are equi-joins that adaptive execution can split; between them, rows are written to the shared folder.

Defined results: words are runs of bytes other than ASCII white space, A-Z lowered; with fewer than three words, the whole sequence is one
shingle; a null or wordless text has the fingerprint zero, which is linked like any other. Rows with equal ids are separate documents;
a null id is never the smallest of its component unless alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import BLOCK_BYTES, filled, lean, staged, tidied
from .components import components

WORDS, SEED, BITS = 3, 42, 3
#: Classes that one entry of a table holds before it is cut again.
LARGE = 256
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(text: bytes) -> Iterator[bytes]:
    """The shingles' hashes (8 bytes each, big-endian), some of the text at a time."""
    at, kept, some = 0, [], False
    while at < len(text):
        gap = _GAP.search(text, at + BLOCK_BYTES)
        end = gap.start() if gap else len(text)
        words = kept + text[at:end].lower().split()
        at = end
        found = [xxh64_digest(x, SEED) for x in map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))]
        kept = words[1 - WORDS :] if len(words) >= WORDS else words
        if found:
            some = True
            yield b"".join(found)
    if kept and not some:
        yield xxh64_digest(b" ".join(kept), SEED)


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint as a signed number."""
    count, n = np.zeros(64, np.int64), 0
    for found in _hashes(text):
        bits = np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big", signed=True)


@tidied
def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(x.as_buffer().to_pybytes()) for x in filled(batch.column(1)).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["key", "fp"])


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of each document."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return docs.mapInArrow(_described, f"key {docs.schema['key'].dataType.simpleString()}, fp long")


def _halves(x: Column, width: int) -> tuple[Column, Column]:
    return F.shiftrightunsigned(x, width), x.bitwiseAND((1 << width) - 1)


def _ball(x: Column, width: int, both: bool = False) -> Column:
    """x, and x with one bit set (or, with both, set or cleared) among so many."""
    bits = [F.lit(1 << i).cast("long") for i in range(width)]
    return F.array_distinct(F.array(x, *(x.bitwiseXOR(b) if both else x.bitwiseOR(b) for b in bits)))


def _met(lookups: DataFrame, table: DataFrame, by: list[str], bits: int) -> DataFrame:
    """Verified links of classes that meet in an entry."""
    a, b = F.col("l.fp"), F.col("t.fp")
    joined = lookups.alias("l").join(table.alias("t"), [F.col(f"l.{x}") == F.col(f"t.{x}") for x in by] + [(a != b) & (F.bit_count(a.bitwiseXOR(b)) <= bits)])
    return joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def links(classes: DataFrame, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints (column fp) with at most so many differing bits, up to 3."""
    if bits > BITS:
        raise ValueError(f"segments are cut for at most {BITS} differing bits")
    high, low = _halves(F.col("fp"), 32)
    sides = lambda f: F.explode(F.array(*(F.struct(F.lit(i).alias("side"), f(own).alias("at"), rest.alias("rest")) for i, (own, rest) in enumerate(((high, low), (low, high))))))
    flat = lambda df: df.select("fp", "x.*")
    table = flat(classes.select("fp", sides(lambda x: x).alias("x")))
    lookups = flat(classes.select("fp", sides(lambda x: _ball(x, 32)).alias("x"))).withColumn("at", F.explode("at"))
    crowded = staged(table.groupBy("side", "at").count().where(F.col("count") > large).select("side", "at"), "crowded")
    own = ["side", "at"]
    found = _met(lookups.join(crowded, own, "left_anti"), table.join(crowded, own, "left_anti"), own, bits)

    inner = lambda df, f: df.join(crowded, own).select("fp", *own, F.explode(F.array(*(F.struct(F.lit(i).alias("half"), f(x).alias("in")) for i, x in enumerate(_halves(F.col("rest"), 16))))).alias("x")).select("fp", *own, "x.*")
    deeper = _met(inner(lookups, lambda x: _ball(x, 16, both=True)).withColumn("in", F.explode("in")), inner(table, lambda x: x), [*own, "half", "in"], bits)
    return staged(found.union(deeper).distinct(), "links")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (the smallest key that it reaches by links)."""
    lean(docs.sparkSession)
    own = staged(fingerprinted(docs, key, text), "fingerprints")
    classes = staged(own.groupBy("fp").agg(F.min("key").alias("key")), "classes")
    found = components(links(classes, bits))
    of_class = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "key", F.coalesce("component", "fp").alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("key").alias("component_id"))
    of_class = staged(of_class.join(least, "comp").select("fp", "component_id"), "members")
    return own.join(of_class, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of docs that have the smallest key of their component, or no key."""
    chosen = join(docs, key, text, bits).where(F.col(key).isNull() | (F.col(key) == F.col("component_id"))).select(F.col(key).alias("__key")).distinct()
    return docs.join(chosen, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
