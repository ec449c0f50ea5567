"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph here is a line, or a sentence of it, and those longer than LONG are cut further after words, or pairs of code points, that
their own hash picks, whatever the script, so that an edit changes some of them only. Its SHA-256 gives a wide vector: eight 32-bit numbers, and a +1 or -1 in
one of 128 lanes. A document's fingerprint is the sum of its paragraphs' vectors, modulo 2 ** 32 and 2 ** 16. So it
does not depend on their order, equal documents have equal fingerprints, and a paragraph is inserted or deleted by
adding or subtracting its vector (``combine``). The lanes are a random projection of the multiset, so the cosine of
two documents' lanes estimates how many paragraphs they share; it is never below 0 here, and exactly 1 for equal ones.

Defined results: a null text counts as empty, and an empty text has no paragraph (an all-zero fingerprint); two such
have likeness 1, and one with any other 0. Ids are numbers, dates or strings; rows of equal id are ordered by text, and null ids come last.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE, LANES = 8, 128
#: Documents in one sorted bucket, on average, and the most buckets by id, whose bounds (8 bytes each) travel with the plan.
BUCKET, BUCKETS = 1024, 1 << 14
#: Characters of a string that tell its bucket.
CUT = 64
#: Lanes added up in one number, and the bits of each; a text would need 128 million paragraphs to fill them.
PACKED, BITS = 3, 21
#: Paragraphs of over LONG characters are cut after words whose MD5 starts so (a quarter of all), and words of over WORD characters (of scripts
#: without spaces, say) after pairs of code points whose MD5 starts so (a sixteenth). What is cut depends on no script or language.
LONG, ENDS = 120, "0123"
WORD, PAIR = 40, "0"


def _starts(x: Column, digits: str) -> Column:
    return F.substring(F.md5(x), 1, 1).isin(*digits)


def _cut_word(word: Column) -> Column:
    """A long word with line ends where its own pairs of code points say so."""
    chars = F.split(word, "")
    cut = F.zip_with(chars, F.concat(F.array(F.lit("")), chars), lambda c, before: F.concat(F.coalesce(c, F.lit("")), F.when((before != "") & c.isNotNull() & _starts(F.concat(before, c), PAIR), "\n").otherwise("")))
    return F.when(F.length(word) > WORD, F.array_join(cut, "")).otherwise(word)


def _cut(line: Column) -> Column:
    words = F.transform(F.split(line, " "), lambda w: F.concat(_cut_word(w), F.when(_starts(w, ENDS), "\n").otherwise(" ")))
    return F.split(F.array_join(words, ""), "\n")


def paragraphs(text: Column) -> Column:
    """Lines, cut after sentence ends, and long ones further; empty ones don't count."""
    lines = F.split(F.regexp_replace(text, "([.!?]) ", "$1\n"), "\n")
    parts = F.transform(lines, lambda x: F.when(F.length(x) > LONG, _cut(x)).otherwise(F.array(x)))
    return F.filter(F.flatten(parts), lambda x: x != "")


def _sums(digest: str) -> list[Column]:
    """The aggregates that add up the vectors of paragraphs, given a column of SHA-256 hex: WIDE numbers, then the lanes, PACKED in each
    number as sums of sign * 2 ** (BITS * place)."""
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    wide = [F.coalesce(F.sum(number(8 * i + 1, 8)), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"wide{i}") for i in range(WIDE)]
    lane, share = F.col("lane"), F.col("share")
    return wide + [F.coalesce(F.sum(F.when(lane == i, share)), F.lit(0)).alias(f"lane{i}") for i in range(-(-LANES // PACKED))]


def _lanes() -> Column:
    """The lanes as an array, from the packed sums: a field is read as a signed number, and what it borrowed is given back above."""
    half, full = 1 << (BITS - 1), 1 << BITS
    out = []
    for i in range(-(-LANES // PACKED)):
        rest: Column = F.col(f"lane{i}")
        for _ in range(min(PACKED, LANES - PACKED * i)):
            out.append((rest + half).bitwiseAND(F.lit(full - 1)) - half)
            rest = F.shiftright(rest + half, BITS)
    return F.array(*out)


def vectors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, wide (array of WIDE longs) and lanes (array of LANES longs) for each distinct value of the keys.

    Paragraphs are exploded and added up at once on the map side; a shuffle moves one vector a document at most, and
    none if df is already distributed by some of the keys.
    """
    cut = df.select(*keys, F.explode_outer(paragraphs(F.coalesce(F.col(text), F.lit("")))).alias("paragraph"))
    cut = cut.select(*keys, F.sha2("paragraph", 256).alias("digest"))
    first = F.conv(F.substring("digest", 1, 2), 16, 10).cast("int")
    place = first % LANES % PACKED
    unit = F.when(place == 0, F.lit(1)).when(place == 1, F.lit(1 << BITS)).otherwise(F.lit(1 << 2 * BITS)).cast("long")
    cut = cut.select(*keys, "digest", F.floor(first % LANES / PACKED).cast("int").alias("lane"), F.when(first >= 128, unit).otherwise(-unit).alias("share"))
    out = cut.groupBy(*keys).agg(*_sums("digest"))
    return out.select(*keys, F.array(*[f"wide{i}" for i in range(WIDE)]).alias("wide"), _lanes().alias("lanes"))


def combine(wide: Column, lanes: Column, other_wide: Column, other_lanes: Column, sign: int = 1) -> tuple[Column, Column]:
    """Insert (sign 1) or delete (sign -1) the paragraphs of another vector."""
    return F.zip_with(wide, other_wide, lambda a, b: (a + sign * b).bitwiseAND(F.lit(0xFFFFFFFF))), F.zip_with(lanes, other_lanes, lambda a, b: a + sign * b)


def text_form(wide: Column, lanes: Column) -> Column:
    """Lower-case hex, 256 + 2048 bits."""
    hexed = lambda a, digits, mask: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(mask)))), digits, "0")), "")
    return F.concat(hexed(wide, 8, 0xFFFFFFFF), hexed(lanes, 4, 0xFFFF))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Cosine of two lane vectors, not below 0; ``same``: whether the fingerprints are equal."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, p: s + p)
    norm = dot(a, a).cast("double") * dot(b, b).cast("double")
    return F.when(same, 1.0).when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(norm))))


def _scaled(column: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(a number, or a string's beginning, that never falls as the column's value rises, whether no other value has the same one)."""
    if isinstance(kind, T.StringType):
        return F.substring(column, 1, CUT), F.length(column) < CUT
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        column = F.unix_micros(column.cast("timestamp"))
    number = column.cast("double")
    whole = isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType))
    return number, (F.abs(number) < 2.0**53) if whole else F.lit(isinstance(kind, T.FractionalType))


def _bounds(df: DataFrame, value: Column, kind: T.DataType, n: int) -> list:
    """Quantiles of a column (repeated where a value is common), that cut its rows into n parts: of all numbers, or of 8 strings drawn for
    each part. They decide how even the parts are, and nothing else."""
    if n < 2:
        return []
    own = df.select(value.alias("x")).where("x is not null")
    if isinstance(kind, T.StringType):
        drawn = sorted((r[0] for r in own.orderBy(F.rand(5)).limit(8 * n).collect()), key=str.encode)
        return [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []
    shares = ", ".join(f"{i / n!r}D" for i in range(1, n))
    return own.agg(F.expr(f"percentile_approx(x, array({shares}), {max(10_000, 4 * n)})")).first()[0] or []


def _at(value: Column, bounds: list) -> Column:
    """How many of the distinct, sorted bounds are not above a value, by halving."""
    if not bounds:
        return F.lit(0)
    bits = len(bounds).bit_length()
    listed = F.from_json(F.lit(json.dumps(bounds + [None] * ((1 << bits) - 1 - len(bounds)))), "array<string>" if isinstance(bounds[0], str) else "array<double>")
    steps = F.array(*[F.lit(1 << i) for i in range(bits - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(listed, at + step) <= value, at + step).otherwise(at))


def _distinct(bounds: list) -> list:
    return [b for i, b in enumerate(bounds) if not i or b != bounds[i - 1]]


def dealt(df: DataFrame, key: str, text: str) -> Column:
    """A bucket's number for each row, such that rows by ascending (key, text) have ascending numbers, nulls last.

    Buckets of ids lie between quantiles of all ids. An id that is several quantiles, or null, has a bucket of its own, which is cut
    by quantiles of its rows' texts.
    """
    kind = df.schema[key].dataType
    n, empty = df.agg(F.count("*"), F.count_if(F.isnull(key))).first()
    value, exact = _scaled(F.col(key), kind)
    parts = max(1, min(BUCKETS, -(-n // BUCKET)))
    bounds = _bounds(df, value, kind, parts)
    own, common = _distinct(bounds), _distinct([b for i, b in enumerate(bounds[1:]) if b == bounds[i]])
    alone = F.isnull(key) | (exact & value.isin(common)) if common else F.isnull(key)
    place = F.when(F.isnull(key), 2 * len(own) + 2).otherwise(2 * _at(value, own) + F.when(alone, 0).otherwise(1)).cast("long") * (2 * BUCKETS)
    if not common and empty <= BUCKET:
        return place
    words, _ = _scaled(F.col(text), T.StringType())
    return place + F.when(alone, _at(words, _distinct(_bounds(df.where(alone), words, T.StringType(), parts)))).otherwise(0)


def with_next(df: DataFrame, key: str, text: str, output: str) -> tuple[DataFrame, DataFrame]:
    """(rows, heads): the rows with the text of the next row by ascending key (after the last: the first), without one task seeing all
    rows; and for each bucket the text of the next one's first row.

    Inside a bucket the next row is a window's lead. A bucket's last row takes the first of the next bucket that has rows, which
    is found among the bucket numbers alone, of which there are 4 * BUCKETS at most. The bucket column ``_b`` and the row's place in
    it ``_r`` stay, and ``_last`` marks a bucket's last row.
    """
    own = df.withColumn("_b", dealt(df, key, text))
    buckets = own.select("_b").distinct()
    order = Window.partitionBy("_b").orderBy(F.col(key).asc_nulls_last(), F.col(text).asc_nulls_first())
    own = own.withColumns({"_r": F.row_number().over(order), "_next": F.lead(text).over(order)})
    every = Window.orderBy("_b")
    round_ = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = buckets.select(F.col("_b").alias("_from"), F.coalesce(F.lead("_b").over(every), F.first("_b").over(round_)).alias("_b"))
    heads = own.where("_r = 1").select("_b", F.col(text).alias("_head"))
    heads = F.broadcast(follow).join(heads, "_b").select(F.col("_from").alias("_b"), "_head")
    rows = own.join(heads, "_b", "left").withColumns({output: F.coalesce("_next", "_head"), "_last": F.isnull("_next")}).drop("_next", "_head")
    return rows, heads


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last half of the code points replaced by as many of the next row's first. Each text's vector is made once; the
    next row's is a window's lead, or that of the next bucket's first text.
    """
    own = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own, heads = with_next(own, "_key", "_text", "_after")
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.length("_text") - half), F.substring(F.col("_after"), F.lit(1), half))
    own = own.select("_b", "_r", "_key", "_last", F.length("_text").cast("long").alias("n_chars"), "_text", edited.alias("_edited"))
    same = ["_b", "_r", "_key", "_last", "n_chars", "edited_sha256"]
    own = own.withColumn("edited_sha256", F.sha2("_edited", 256))
    kinds = own.select(*same, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in enumerate(("_text", "_edited"))])).alias("x"))
    kinds = kinds.select(*same, "x.kind", "x.text")
    made = vectors(kinds, [*same, "kind"], "text")
    pick = [F.max(F.when(F.col("kind") == k, F.struct("wide", "lanes"))).alias(n) for k, n in enumerate("ae")]
    made = made.groupBy(*same).agg(*pick)
    first = vectors(heads, ["_b"], "_head").select("_b", F.struct("wide", "lanes").alias("h"))
    made = made.withColumn("n", F.lead("a").over(Window.partitionBy("_b").orderBy("_r"))).join(first, "_b", "left")
    made = made.withColumn("n", F.when(F.col("_last"), F.col("h")).otherwise(F.col("n")))
    form = lambda n: text_form(F.col(f"{n}.wide"), F.col(f"{n}.lanes"))
    near = lambda n: likeness(F.col("a.lanes"), F.col(f"{n}.lanes"), F.col("a") == F.col(n))
    return made.select(F.col("_key").alias(key), "n_chars", "edited_sha256", form("a").alias("fingerprint"), form("e").alias("edited_fingerprint"), near("e").alias("near_edited"), near("n").alias("near_next"))


__all__ = ["combine", "dealt", "fingerprints", "likeness", "paragraphs", "text_form", "vectors", "with_next"]
