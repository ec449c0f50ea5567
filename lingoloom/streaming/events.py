"""All events of the change feed in one stream, in their order, on queue, states, items and associations together.

A micro-batch is folded by item: what an item's events come to depends on their order, on when the item went (by its own deletion, or with its
source's), and on what its group's members did. All of this is joins and aggregates over the batch and the rows that it touches; the changed rows of
all tables are one commit of a store. The result is that of going through the events one by one:

* ``save``: payload ``title`` is the item's new title; if it differs and the type has no versions, settled cells of the item's queue row go back to
  pending. Payload ``flag`` of an item in the source language is its opt-out flag; a missing queue row is made for 1 only.
* ``version``: settled cells made from an older version go back to pending; only for types with versions.
* ``state``: payload ``value`` is the item's publish state; if a queued item is trashed, so are the other members of its group.
* ``delete``: a queued item takes the other members of its group along, and each that goes its queue row and cells. Another item's
  cell of its source's row goes (of some sources that of the smallest row). Items of types that the engine associates itself leave their group; a
  group of two or fewer goes as a whole.

Events of unknown kinds, types and items, and of items that went before, do nothing. Events are ordered by ts, then seq. New queue rows are
numbered batch by batch, so that their ids, and nothing else, depend on how a stream is cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lingoloom.operators import queue as qu
from lingoloom.operators import states as st
from lingoloom.sources import content_types as ct
from lingoloom.sources.deltas import Store

from .feed import cells, subscribed

ITEM = ["content_type", "id"]


def kept(items: DataFrame, queue: DataFrame, states: DataFrame, associations: DataFrame) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """The tables of a store for this feed."""
    return {"items": (items, ITEM, ITEM), "queue": (queue, ["content_type", "content_id"], ["content_type", "content_id"]), "states": cells(states), "associations": (associations, ["context", "id"], ["context", "id"])}


def _typed(associations: DataFrame) -> DataFrame:
    """Associations with the type that their context is for."""
    kinds = F.create_map(*[F.lit(x) for n, p in ct.TYPES.items() for x in (p["association_context"], n)])
    return associations.withColumn("content_type", F.try_element_at(kinds, F.col("context")))


def _timed(events: DataFrame) -> DataFrame:
    """Events with their order (at) and what their payloads say."""
    own = subscribed(events).withColumnRenamed("item_id", "id")
    said = lambda key, kind: F.try_element_at("payload", F.lit(key)).try_cast(kind)
    return own.select(*ITEM, F.struct("ts", "seq").alias("at"), "event_type", "version_id", said("title", "string").alias("title"), said("flag", "int").alias("flag"), said("value", "int").alias("value"))


def folded(events: DataFrame, items: DataFrame, queue: DataFrame, associations: DataFrame, source: str, held: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(members, groups): a row for each item that the events may touch, with what they come to, and one for each of their groups.

    members: content_type, id, language, state, title, group, queue_id, and ends (when it went), flag (the last one) and made (whether
    a flag asks for a row), version, renamed, new_title, new_state. held: writes a step and reads it back, which keeps plans small.
    """
    own = held(_timed(events))
    links = _typed(associations).select(*ITEM, "key")
    touched = own.select(*ITEM).distinct()
    keys = links.join(touched, ITEM, "left_semi").select("content_type", "key").distinct()
    wanted = links.join(keys, ["content_type", "key"]).select(*ITEM, F.concat(F.lit("g"), "key").alias("group"))
    alone = touched.join(wanted, ITEM, "left_anti").select(*ITEM, F.concat(F.lit("i"), F.col("id").cast("string")).alias("group"))
    rows = queue.select("content_type", F.col("content_id").alias("id"), F.col("id").alias("queue_id"), "do_not_translate")
    member = held(wanted.unionByName(alone).join(items.select(*ITEM, "language", "state", "title"), ITEM).join(rows, ITEM, "left"))

    # when an item gets its row, and when it goes
    is_source = F.col("language") == source
    own = own.join(member.select(*ITEM, "group", "language", "queue_id", F.col("title").alias("old")), ITEM)
    first = own.groupBy(*ITEM, "group").agg(F.min(F.when((F.col("event_type") == "save") & (F.col("flag") == 1) & is_source & F.isnull("queue_id"), F.col("at"))).alias("row_at"), F.min(F.when(F.col("event_type") == "delete", F.col("at"))).alias("gone_at"), F.max("queue_id").alias("queue_id"))
    queued = F.isnotnull("queue_id") | (F.col("row_at") < F.col("gone_at"))
    ends = first.groupBy("content_type", "group").agg(F.min(F.when(queued, F.col("gone_at"))).alias("all_gone"))
    member = member.join(first.select(*ITEM, "row_at", "gone_at"), ITEM, "left").join(ends, ["content_type", "group"], "left")
    member = held(member.withColumn("ends", F.least("gone_at", "all_gone")))
    times = member.select(*ITEM, "ends", "row_at")
    own = own.join(times, ITEM).where("ends is null or at < ends")

    # what the events of the time before come to
    save = F.col("event_type") == "save"
    noted = lambda c, cond: F.max_by(c, F.when(cond & F.col(c).isNotNull(), F.col("at")))
    trash = (F.col("event_type") == "state") & (F.col("value") == qu.TRASHED) & (F.isnotnull("queue_id") | (F.col("row_at") < F.col("at")))
    did = own.where("event_type <> 'delete'").groupBy(*ITEM, "group").agg(
        noted("flag", save & is_source).alias("flag"), F.coalesce(F.max(save & is_source & (F.col("flag") == 1)), F.lit(False)).alias("made"),
        F.max(F.when((F.col("event_type") == "version") & F.col("content_type").isin(ct.versioned()), F.col("version_id"))).alias("version"),
        F.coalesce(F.max(save & F.col("title").isNotNull() & ~F.col("title").eqNullSafe(F.col("old")) & ~F.col("content_type").isin(ct.versioned())), F.lit(False)).alias("renamed"), noted("title", save).alias("new_title"),
        F.max(F.when((F.col("event_type") == "state") & F.col("value").isNotNull(), F.struct("at", "value"))).alias("own_state"), F.max(F.when(trash, F.col("at"))).alias("trashes"),
    )

    did = held(did)
    # the last trashing by another member: the group's last one, or the last one but its own
    top = did.where("trashes is not null").groupBy("content_type", "group").agg(F.max(F.struct("trashes", "id")).alias("one"))
    second = did.join(top, ["content_type", "group"]).where("id <> one.id").groupBy("content_type", "group").agg(F.max("trashes").alias("two"))
    member = member.join(did.drop("group"), ITEM, "left").join(top, ["content_type", "group"], "left").join(second, ["content_type", "group"], "left")
    others = F.when(F.col("one.id") == F.col("id"), F.col("two")).otherwise(F.col("one.trashes"))
    taken = F.when(others.isNotNull(), F.struct(others.alias("at"), F.lit(qu.TRASHED).alias("value")))
    member = member.withColumns({"new_state": F.greatest("own_state", taken)["value"], "made": F.coalesce("made", F.lit(False)), "renamed": F.coalesce("renamed", F.lit(False))})
    member = held(member.drop("one", "two", "own_state", "trashes", "all_gone"))
    groups = member.groupBy("content_type", "group").agg(F.min("queue_id").alias("first_row"), F.count_if(F.isnotnull("ends")).alias("n_gone"))
    return member, groups


def changed(events: DataFrame, store: Store, source: str) -> dict[str, tuple[DataFrame | None, DataFrame | None]]:
    """What a batch of events (feed.EVENT) changes, by table: rows that are new or other, and keys that go."""
    items, queue, associations = (store.read(t) for t in ("items", "queue", "associations"))
    member, groups = folded(events, items, queue, associations, source, store.held)
    alive, gone = member.where("ends is null"), member.where("ends is not null")

    new = lambda c, old: F.coalesce(F.col(c), F.col(old))
    other = alive.where("not new_state <=> state and new_state is not null or not new_title <=> title and new_title is not null")
    edits = items.drop("state", "title").join(other.select(*ITEM, new("new_state", "state").cast(items.schema["state"].dataType).alias("state"), new("new_title", "title").alias("title")), ITEM)

    flags = alive.where("flag is not null")
    set_ = flags.where("queue_id is not null and flag <> do_not_translate").select("content_type", F.col("id").alias("content_id"), F.col("flag").alias("_f"))
    set_ = queue.join(set_, ["content_type", "content_id"]).withColumn("do_not_translate", F.col("_f").cast(queue.schema["do_not_translate"].dataType))
    top = queue.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one number
    fresh = st.numbered(flags.where("queue_id is null and made").select("content_type", F.col("id").alias("content_id"), "flag"), "content_type", "content_id", int(top))
    blank = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    fresh = fresh.withColumnRenamed("flag", "do_not_translate").select(*[F.col(f.name).cast(f.dataType) if f.name in ("id", "content_type", "content_id", "do_not_translate") else blank(f) for f in queue.schema])

    rows_gone = gone.where("queue_id is not null")
    single = gone.where("queue_id is null and not (row_at is not null and row_at < ends)").join(groups.where("first_row is not null"), ["content_type", "group"])
    single = single.select(F.col("first_row").alias("queue_id"), F.col("language").alias("target_language"))
    stale = alive.where("queue_id is not null and (version is not null or renamed)").select("queue_id", F.when(~F.col("renamed"), F.col("version")).alias("version_id"))
    near = stale.select("queue_id").union(rows_gone.select("queue_id"))
    states = store.read("states", near)
    out = states.join(rows_gone.select("queue_id"), "queue_id", "left_semi").select("queue_id", "target_language").unionByName(single)
    back = st.invalidated(states.join(stale.select("queue_id"), "queue_id", "left_semi").withColumn("_was", F.col("translation_state")), stale)
    back = back.where("translation_state <> _was").drop("_was").join(out, ["queue_id", "target_language"], "left_anti")

    typed = _typed(associations).where(F.col("content_type").isin(ct.self_associated()))
    links = typed.join(gone.where(F.col("content_type").isin(ct.self_associated())).select("content_type", F.expr("substr(`group`, 2)").alias("key")).distinct(), ["content_type", "key"])
    sizes = links.groupBy("content_type", "key").agg(F.count("*").alias("n")).join(groups.select("content_type", F.expr("substr(`group`, 2)").alias("key"), "n_gone", "group").where("`group` like 'g%'"), ["content_type", "key"])
    marked = links.join(sizes.select("content_type", "key", (F.col("n") - F.col("n_gone") <= 1).alias("whole")), ["content_type", "key"]).join(gone.select(*ITEM, F.lit(True).alias("went")), ITEM, "left")
    unlinked = marked.where("whole or went").select("context", "id")
    left = rows_gone.select("content_type", F.col("id").alias("content_id"))
    return {"items": (edits, gone.select(*ITEM)), "queue": (set_.select(queue.columns).unionByName(fresh), left), "states": (back, out), "associations": (None, unlinked)}


def dispatching(events: DataFrame, store: Store, folder: str, source: str) -> StreamingQuery:
    """Run a stream of events (feed.EVENT) to its end, a commit a micro-batch. Started again with the same folder and store it goes on with what
    is new; a batch that failed half-way is written again."""

    def step(batch: DataFrame, number: int) -> None:
        if (last := store.last("events")) is None or last < number:
            store.commit("events", number, changed(batch, store, source))

    return events.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def at_once(events: DataFrame, store: Store, source: str, batch: int = 0) -> int:
    """A table of events as one batch."""
    return store.commit("events", batch, changed(events, store, source))


__all__ = ["at_once", "changed", "dispatching", "folded", "kept"]
