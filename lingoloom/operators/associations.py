"""Association groups: the language versions of an item, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoloom.sources import content_types as ct

from .queue import PUBLISHED, TRASHED


def members(associations: DataFrame, items: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, member_id, language, state) of the groups of each id (of ``ids``, or all); items: id, language and state."""
    own = associations.select("context", "key", "id")
    own = own.join(ids, "id", "left_semi") if ids is not None else own
    others = associations.select("context", "key", F.col("id").alias("member_id"))
    return own.join(others, ["context", "key"]).join(items.select(F.col("id").alias("member_id"), "language", "state"), "member_id").select("id", "member_id", "language", "state")


def translations(associations: DataFrame, items: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The other members of each id's group."""
    return members(associations, items, ids).where("member_id <> id")


def visibility(associations: DataFrame, items: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, language, live): whether the group's item in a language is published; the largest id wins."""
    return members(associations, items, ids).groupBy("id", "language").agg((F.max_by("state", "member_id") == PUBLISHED).alias("live"))


def source_queue(associations: DataFrame, queue: DataFrame, content_type: str) -> DataFrame:
    """(id, queue_id): the queue row of the item that an item translates; the smallest of some."""
    own = associations.select("context", "key", "id")
    others = associations.select("context", "key", F.col("id").alias("content_id"))
    q = queue.where(F.col("content_type") == content_type).select("content_id", F.col("id").alias("queue_id"))
    return own.join(others, ["context", "key"]).where("content_id <> id").join(q, "content_id").groupBy("id").agg(F.min("queue_id").alias("queue_id"))


def remapped(rows: DataFrame, column: str, associations: DataFrame, items: DataFrame, target: Column) -> DataFrame:
    """Replace a reference by its translation into the target language where there is one; 0 and null stay."""
    found = translations(associations, items).groupBy(F.col("id").alias("_ref"), F.col("language").alias("_lang")).agg(F.max("member_id").alias("_to"))
    out = rows.withColumn("_t", target).join(found, (F.col(column) == F.col("_ref")) & (F.col("_t") == F.col("_lang")), "left")
    return out.withColumn(column, F.when(F.coalesce(F.col(column), F.lit(0)) == 0, F.col(column)).otherwise(F.coalesce("_to", column))).drop("_t", "_ref", "_lang", "_to")


def translation_state(publish_state: Column) -> Column:
    """The state that a translation's publish state stands for; null for a trashed one."""
    return F.when(publish_state == TRASHED, None).when(publish_state == PUBLISHED, "published").otherwise("review")


def backfill(associations: DataFrame, items: DataFrame, source: str) -> DataFrame:
    """(source_id, language, state): each group's member in the source language, and the states of its translations.

    Of some members of one language the largest id counts; groups without an anchor or a target give nothing.
    """
    own = associations.select("context", "key", "id").join(items.select("id", "language", "state"), "id")
    anchor = own.where(F.col("language") == source).groupBy("context", "key").agg(F.max("id").alias("source_id"))
    usable = own.where((F.col("language") != source) & ~F.col("language").isin("", "*") & (F.col("state") != TRASHED))
    targets = usable.groupBy("context", "key", "language").agg(F.max_by("state", "id").alias("publish_state"))
    return anchor.join(targets, ["context", "key"]).select("source_id", "language", translation_state(F.col("publish_state")).alias("state"))


def removed(associations: DataFrame, gone: DataFrame, context: str) -> DataFrame:
    """The associations without the ids of ``gone``; a group of two or fewer goes as a whole."""
    ids = gone.select("id").distinct().withColumn("_gone", F.lit(1))
    marked = associations.join(ids, "id", "left").withColumn("_gone", F.when(F.col("context") == context, F.col("_gone")))
    groups = marked.groupBy("context", "key").agg(F.count("*").alias("_n"), F.max("_gone").alias("_hit"))
    out = marked.join(groups, ["context", "key"])
    return out.where("_gone is null and not (_hit is not null and _n <= 2)").select(associations.columns)


def regrouped(associations: DataFrame, groups: DataFrame, context: str) -> DataFrame:
    """Rewrite groups (rows of group, language, id) under one key each: the MD5 of its ids by language; under two ids nothing happens."""
    made = groups.groupBy("group").agg(F.array_sort(F.collect_set(F.struct("language", "id"))).alias("m")).where(F.size("m") >= 2)
    keyed = made.select(F.md5(F.to_json(F.map_from_entries("m"))).alias("key"), F.explode("m.id").alias("id"))
    kept = associations.join(keyed.select("id").withColumn("context", F.lit(context)), ["id", "context"], "left_anti").select(associations.columns)
    return kept.unionByName(keyed.select("id", F.lit(context).alias("context"), "key"))


def latest_versions(history: DataFrame, aliases: list[str]) -> DataFrame:
    """(alias, item_id, version_id): the newest version of each item of known aliases."""
    top = history.groupBy("item_id").agg(F.max("version_id").alias("version_id"))
    out = top.select(F.regexp_extract("item_id", r"^(.*)\.[^.]*$", 1).alias("alias"), F.substring_index("item_id", ".", -1).try_cast("bigint").alias("item_id"), "version_id")
    return out.where(F.col("alias").isin(aliases) & (F.col("item_id") > 0))


def item_versions(history: DataFrame) -> DataFrame:
    """(content_type, id, version_id): the newest version of each item of a managed type, by its type's alias; unknown ones are left out."""
    top = latest_versions(history, ct.version_aliases())
    kinds = F.create_map(*[F.lit(x) for name, p in ct.TYPES.items() if p.get("version_alias") for x in (p["version_alias"], name)])
    return top.select(F.element_at(kinds, F.col("alias")).alias("content_type"), F.col("item_id").alias("id"), "version_id")


def field_assignments(assigned: DataFrame, source: Column, draft: Column) -> DataFrame:
    """Field assignments of a source category that its draft lacks, as rows for the draft. assigned: field_id, category_id."""
    have = assigned.where(F.col("category_id") == draft).select("field_id")
    return assigned.where(F.col("category_id") == source).join(have, "field_id", "left_anti").select("field_id", draft.alias("category_id"))
