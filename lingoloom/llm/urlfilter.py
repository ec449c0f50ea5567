"""URL filters: host-suffix and path-prefix expressions, joined with the rules on short hash prefixes.

Each distinct (host, path) is expanded into those suffixes of its host and prefixes of its path whose lengths occur
among the rules, so no rule can be missed and the expansion is bounded by the rule list, not by the url. Expressions
meet rules in an equi-join on 32 bits of their digest; the full digest confirms. The longest fitting rule wins, then
the one with the longer host, then a block.

Defined results: a null url, or one without "://", has an empty host and path; an empty host fits no rule; rules
with a null host or path are ignored; of rules that differ only in their verdict, block wins; rows are neither
merged nor dropped, whatever their ids; columns with the names of the outputs give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between host and path in what is hashed; neither can hold it, so a rule that does fits nothing.
BORDER = "#"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules up to this number are broadcast (about 200 bytes each); more are shuffled.
BROADCAST_RULES = 50_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty if it is null or has no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def expressions(host: Column, path: Column, host_lengths: list[int], path_lengths: list[int]) -> Column:
    """Array of host suffix + BORDER + path prefix, for the given lengths; suffixes start at a label."""
    n = F.length(host)
    ints = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    fits = F.filter(ints(host_lengths), lambda k: (n > 0) & ((k == n) | ((k < n) & (F.substring(host, n - k, F.lit(1)) == "."))))
    suffixes = F.transform(fits, lambda k: F.substring(host, n - k + 1, k))
    prefixes = F.transform(F.filter(ints(path_lengths), lambda k: k <= F.length(path)), lambda k: F.substring(path, F.lit(1), k))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit(BORDER), p))))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (the winning rule's host + path, or null) and verdict to each row.

    rules: host, path, verdict (allow or block). default: the verdict where no rule fits.
    """
    own = rules.where("host is not null and path is not null").groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    # both lists are bounded by the longest host and path of a rule, however many rules there are
    n, hosts, paths = own.agg(F.count("*"), F.collect_set(F.length("rule_host")), F.collect_set(F.length("rule_path"))).first()
    host, path = host_path(F.col(url))
    out = urls.select(*[c for c in urls.columns if c not in ("host", "path", "rule", "verdict")], host.alias("host"), path.alias("path"))
    if not n:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    digest = F.sha2("rule_key", 256)
    own = own.withColumn("rule_key", F.concat("rule_host", F.lit(BORDER), "rule_path")).withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8))
    if n <= BROADCAST_RULES:
        own = F.broadcast(own)
    keys = out.select("host", "path").distinct()
    tried = keys.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), sorted(hosts), sorted(paths))).alias("tried"))
    tried = tried.withColumn("full", F.sha2("tried", 256)).withColumn("head", F.substring("full", 1, 8))
    hits = tried.join(own, (F.col("head") == F.col("short")) & (F.col("full") == F.col("digest")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule_key").alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"))).alias("__best"))
    return out.join(best, ["host", "path"], "left").select(*out.columns, F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
