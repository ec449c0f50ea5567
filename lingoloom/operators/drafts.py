"""Drafts: what is stored for a translated item, and how it takes its place beside its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoloom.functions import maps
from lingoloom.functions import text as tx
from lingoloom.sources import content_types as ct

from . import associations as asc


def drafts(items: DataFrame, made: DataFrame, content_type: str, language: str, source: str, associations: DataFrame, every: DataFrame, tags: DataFrame | None = None, custom: DataFrame | None = None, publish: bool = False) -> DataFrame:
    """One row for each item of a type and its translated strings.

    items: rows of the type; made: (id, translated); every: (content_type, id, language, state) of all items; tags: (id, tag_id);
    custom: (id, name, value, translatable) of custom fields. The result: source_id, id (of the item's translation if it has one, else
    0), language, the type's fields and copied ones, alias, articletext (for types with an intro), associated references and tags by
    their translations where there are any, com_fields, associations (language to id of the group, with the source), and state: that of the
    translation there is, else a draft's. Forced fields come last. A string without a translation stays as it is.
    """
    p = ct.properties(content_type)
    context = p["association_context"]
    links = associations.where(F.col("context") == context)
    own = every.where(F.col("content_type") == content_type).select("id", "language", "state")
    out = items.where(F.col("content_type") == content_type).withColumnRenamed("id", "source_id")
    out = out.join(made.select(F.col("id").alias("source_id"), "translated"), "source_id")
    none = F.create_map().cast("map<string,string>")
    out = out.withColumn("translated", F.coalesce("translated", none))

    group = asc.translations(links, own).groupBy(F.col("id").alias("source_id"), F.col("language").alias("_l")).agg(F.max_by(F.struct("member_id", "state"), "member_id").alias("_m"))
    ids = group.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("_l", F.col("_m.member_id")))).alias("_group"))
    there = group.where(F.col("_l") == language).select("source_id", F.col("_m.member_id").alias("_id"), F.col("_m.state").alias("_state"))
    out = out.join(ids, "source_id", "left").join(there, "source_id", "left")
    theirs = F.map_filter(F.coalesce("_group", F.create_map().cast("map<string,bigint>")), lambda k, _: k != F.col("_own"))
    out = out.withColumn("_own", F.col("language")).withColumn("_links", F.map_concat(theirs, F.create_map("_own", "source_id")))

    new = lambda c: F.coalesce(F.element_at("translated", F.lit(c)), F.col(c))
    fields = {c: new(c) for c in p["fields"] if c in items.columns}
    fields |= {c: maps.packed(F.col(c), F.col("translated"), f"{c}.") for c in p["json_fields"] if c in items.columns}
    copied = {c: F.col(c) for c in p["copy"] if c in items.columns and c not in fields}
    alias = tx.draft_alias(new("title"), F.col("alias") if "alias" in items.columns else F.lit(""), F.lit(language))
    more = {"articletext": tx.body(new("introtext"), new("fulltext"))} if "introtext" in p["fields"] else {}
    if menu := p.get("language_menu"):
        more[menu] = tx.language_menu(F.coalesce(menu, F.lit("")), source, F.lit(language)) if menu in items.columns else F.lit(f"-{language.lower()}")
    state = F.coalesce("_state", F.lit(int(publish)))
    columns = {"source_id": F.col("source_id"), "id": F.coalesce("_id", F.lit(0)).cast("bigint"), "language": F.lit(language), **fields, "alias": alias, **copied, "state": state, **more, "associations": F.col("_links")}
    columns |= {c: F.lit(v) for c, v in p.get("force", {}).items()}
    out = out.select(*[v.alias(c) for c, v in columns.items()], F.col("translated").alias("_translated"))

    for column, kind in p["associated"].items():
        if column in out.columns:
            other = ct.properties(kind)["association_context"]
            out = asc.remapped(out, column, associations.where(F.col("context") == other), every.where(F.col("content_type") == kind).select("id", "language", "state"), F.lit(language))
    for column, kind in p["many"].items():
        if tags is None:
            continue
        other = ct.properties(kind)["association_context"]
        found = asc.remapped(tags.select(F.col("id").alias("source_id"), F.col("tag_id").alias(column)), column, associations.where(F.col("context") == other), every.where(F.col("content_type") == kind).select("id", "language", "state"), F.lit(language))
        found = found.groupBy("source_id").agg(F.array_sort(F.collect_set(column)).alias(column))
        out = out.join(found, "source_id", "left").withColumn(column, F.coalesce(column, F.array().cast("array<bigint>")))
    if custom is not None:
        value = F.when(F.col("translatable"), F.coalesce(F.try_element_at("_translated", F.concat(F.lit(maps.CUSTOM), "name")), "value")).otherwise(F.col("value"))
        named = custom.join(out.select(F.col("source_id").alias("id"), "_translated"), "id").select("id", "name", value.alias("value"))
        named = named.groupBy(F.col("id").alias("source_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("com_fields"))
        out = out.join(named, "source_id", "left").withColumn("com_fields", F.coalesce("com_fields", none))
    return out.drop("_translated")


def linked(associations: DataFrame, stored: DataFrame, content_type: str) -> DataFrame:
    """The associations after drafts were stored under their ids (language, id, associations): each group with its new member, under one key."""
    own = stored.select(F.map_filter("associations", lambda k, _: k != F.col("language")).alias("m"), "language", "id")
    rows = own.select(F.xxhash64(F.array_sort(F.map_entries("m"))).alias("group"), "language", "id", "m")
    every = rows.select("group", F.explode(F.map_concat("m", F.create_map("language", "id"))).alias("language", "id")).distinct()
    return asc.regrouped(associations, every, ct.properties(content_type)["association_context"])


def snapshot(draft: DataFrame, content_type: str) -> DataFrame:
    """(source_id, language, machine_draft): a stored draft's translatable values as a JSON map, to be set against corrections later."""
    p = ct.properties(content_type)
    values = maps.flattened([c for c in p["fields"] if c in draft.columns], {c: k for c, k in p["json_fields"].items() if c in draft.columns})
    if "com_fields" in draft.columns:
        values = maps.union(values, maps.custom(F.col("com_fields")))
    return draft.select("source_id", "language", maps.snapshot(values).alias("machine_draft"))
