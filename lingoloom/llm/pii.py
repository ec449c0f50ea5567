"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

Base kinds, each found leftmost and without overlap, in the order of KINDS: email, ip (parts at most 255), card
(12 to 19 digits that pass Luhn) and phone (9 to 15 digits). A match that fails its validator is dropped and not tried
again. Two more kinds are added by the method: iban (mod-97) and localphone, a national number. Every span has a
score: its kind's prior, more if a context word stands in the WINDOW characters before it. Spans of the further kinds
are kept from a score of THRESHOLD on, and only if they overlap no base span; base spans are always kept.

All of it is built from Spark functions on the row itself: no shuffle, no Python. Patterns are possessive and start
only where a run starts (or the last match ended), so they take linear time and no stack on very long runs, with the
same matches as their plain forms.

Defined results: a null text counts as empty and has no spans; spans are sorted by start, then kind as listed;
positions are code points, the end is exclusive; rows are independent, and columns with the outputs' names give way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, THRESHOLD = 32, 0.6
#: Matches whose positions are added up in one step.
CHUNK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: a cheap test that any text with a match passes
    hint: str
    prior: float
    context: str


_DIGIT_RUN = r"(?:\G|(?<![0-9]))"
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 0.9, r"(?i)mail|contact|write"),
    Kind("ip", _DIGIT_RUN + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.8, r"(?i)\bip\b|address|host"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][ -]?[0-9][ -]?[0-9]", 0.8, r"(?i)card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.8, r"(?i)tel|phone|call|mobil|fax"),
]
EXTRA = [
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+\b", r"[A-Z]{2}[0-9]{2}", 0.8, r"(?i)iban|account|konto|compte|cuenta"),
    Kind("localphone", r"(?<![0-9])(?<![0-9+.()-][ ]?)\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}", 0.4, r"(?i)tel|phone|call|mobil|fax"),
]
ORDER = [k.name for k in KINDS + EXTRA]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda c, i: _doubled(c.cast("int"), i % 2 == 1))
    return F.aggregate(figures, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def _doubled(d: Column, double: Column) -> Column:
    return F.when(double, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end, A being 10."""
    x = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (F.when(c.between("0", "9"), rest * 10 + value(c)).otherwise(rest * 100 + value(c))) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern stands its validator."""
    number = digits(match)
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(9, 15)
    return mod97(match) if kind == "iban" else F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: what a lambda's body mentions is otherwise computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(pieces: Column, matches: Column) -> Column:
    """Array of (start, end, match): pieces are the stretches around the matches, one more than those.

    Positions are added up in chunks, then across chunks, so long lists cost little more than linear time.
    """
    unit = "array<struct<start:int,end:int,match:string>>"
    pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), m.alias("match")))
    step = lambda a, x: F.struct((a.at + x.gap + x.n).alias("at"), F.concat(a.out, F.array(F.struct((a.at + x.gap).alias("start"), (a.at + x.gap + x.n).alias("end"), x.match.alias("match")))).alias("out"))
    run = lambda ch, at: F.aggregate(ch, F.struct(at.alias("at"), F.array().cast(unit).alias("out")), step, lambda a: a.out)

    def whole(items: Column) -> Column:
        cut = lambda c: F.slice(items, c * CHUNK + 1, CHUNK)
        return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), cut), joined)

    def joined(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(0), lambda s, x: s + x.gap + x.n))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), run))

    return let(F.filter(pairs, lambda x: x.match.isNotNull()), whole)


def _scored(rank: int, kind: Kind) -> Column:
    """The kind's confirmed spans, with scores."""

    def row(x: Column) -> Column:
        before = F.substring(F.col("__pii_text"), F.greatest(x.start - WINDOW, F.lit(0)) + 1, F.least(x.start, F.lit(WINDOW)))
        score = F.lit(kind.prior) + F.when(before.rlike(kind.context), 0.2).otherwise(0.0)
        return F.struct(x.start.alias("start"), F.lit(rank).alias("rank"), x.end.alias("end"), F.lit(kind.name).alias("kind"), x.match.alias("match"), score.alias("score"), F.lit(rank < len(KINDS)).alias("base"))

    return F.transform(F.filter(F.col(f"__pii_p{rank}"), lambda x: valid(kind.name, x.match)), row)


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii``: array of (start, end, kind, match, score, base), sorted by start, then kind as listed."""
    kept = [c for c in df.columns if c != "pii"]
    out = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__pii_text"))
    kinds = KINDS + EXTRA
    out = out.select("*", *[F.when(F.col("__pii_text").rlike(k.hint), F.regexp_extract_all("__pii_text", F.lit(k.pattern), F.lit(0))).alias(f"__pii_m{i}") for i, k in enumerate(kinds)])
    out = out.select("*", *[F.when(F.size(f"__pii_m{i}") > 0, _placed(F.split("__pii_text", k.pattern, -1), F.col(f"__pii_m{i}"))).alias(f"__pii_p{i}") for i, k in enumerate(kinds)])
    spans = [_scored(i, k) for i, k in enumerate(kinds)]
    some = "array<struct<start:int,rank:int,end:int,kind:string,match:string,score:double,base:boolean>>"
    whole = lambda xs: F.flatten(F.array(*[F.coalesce(x, F.array().cast(some)) for x in xs]))
    n = len(KINDS)
    out = out.select(*kept, whole(spans[:n]).alias("__pii_base"), whole(spans[n:]).alias("__pii_more"))
    clear = lambda base: F.filter("__pii_more", lambda x: (x.score >= THRESHOLD) & ~F.exists(base, lambda y: (y.start < x.end) & (x.start < y.end)))
    return out.select(*kept, F.array_sort(F.when(F.size("__pii_more") > 0, F.concat("__pii_base", let(F.col("__pii_base"), clear))).otherwise(F.col("__pii_base"))).alias("pii"))


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of the base kinds, base_sha256, spans (kind:start:end, comma-joined) and scores."""
    found = find(df.select(key, text), text)
    base = F.filter("pii", lambda x: x.base)
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda name: F.size(F.filter("pii", lambda x: x.kind == name)).cast("long").alias(f"n_{name}")
    counts = [count(k.name) for k in KINDS]
    scores = F.array_join(F.transform("pii", lambda x: F.format_number(x.score, 1)), ",")
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), scores.alias("scores"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in angle brackets; of spans that overlap, the later start's rest goes too.

    A text without spans stays as it is, null included.
    """
    found = find(df, text)
    t = F.col(text)
    unit = "struct<at:int,out:array<string>>"
    step = lambda a, x: F.when(x.start >= a.at, F.struct(x.end.alias("at"), F.concat(a.out, F.array(F.substring(t, a.at + 1, x.start - a.at), F.concat(F.lit("<"), x.kind, F.lit(">")))).alias("out"))).otherwise(F.struct(F.greatest(a.at, x.end).alias("at"), a.out.alias("out")))
    built = F.aggregate("pii", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(unit), step, lambda a: F.concat(F.array_join(a.out, ""), F.substring(t, a.at + 1, F.length(t))))
    changed = F.when(F.size("pii") > 0, built).otherwise(t)
    return found.select(*[changed.alias(c) if c == text else F.col(c) for c in df.columns if c != "pii"])
