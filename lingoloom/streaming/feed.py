"""The change feed as a stream: versions, saves, switches and deletions of source items.

Invalidation compares versions with ``<``, so it can be repeated and reordered; it needs no watermark and keeps no state. What the feed
changes is kept as bases and deltas (sources/deltas.py): a micro-batch writes what it changes, and a feed that is started again in the
same folder goes on behind its last committed batch. All events as one feed are in streaming/events.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lingoloom.operators import associations as asc
from lingoloom.operators import states as st
from lingoloom.sources import content_types as ct
from lingoloom.sources.deltas import Store

#: The feed's columns, and the kinds of events that mean something here.
EVENT = "event_type string, content_type string, item_id bigint, version_id bigint, payload map<string,string>, ts timestamp, seq bigint"
KINDS = ("save", "version", "state", "delete", "new")


def changes(versions: DataFrame, queue: DataFrame) -> DataFrame:
    """(queue_id, version_id) of the newest versions of queued items; unknown aliases and ids of 0 are ignored."""
    own = asc.item_versions(versions).withColumnRenamed("id", "content_id")
    return own.join(queue.select("content_type", "content_id", F.col("id").alias("queue_id")), ["content_type", "content_id"]).select("queue_id", "version_id")


def cells(states: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """How states are kept in a store: by cell, dealt out by their queue rows."""
    return states, ["queue_id", "target_language"], ["queue_id"]


def invalidating(versions: DataFrame, queue: DataFrame, store: Store, folder: str) -> StreamingQuery:
    """Run a stream of versions (item_id, version_id) to its end; a batch commits the cells that it sets back, and reads only buckets that hold
    cells of its items."""

    def step(batch: DataFrame, number: int) -> None:
        own = changes(batch, queue).persist()
        old = store.read("states", own).join(own.select("queue_id"), "queue_id", "left_semi")
        new = st.invalidated(old.withColumn("_was", F.col("translation_state")), own).where("translation_state <> _was")
        store.commit("versions", number, {"states": (new, None)})
        own.unpersist()

    return versions.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def streamed(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A file or folder of Parquet files as a stream, so many files to a micro-batch."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())  # a stream reads folders


def run_invalidation(spark: SparkSession, path: str, prepare: Callable[[DataFrame], DataFrame], queue: DataFrame, states: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """The states after all versions in a file or folder of events have streamed through. Progress and states are kept under ``folder``: run
    again there, it goes on with what is new."""
    store = Store(spark, f"{folder}/store", {"states": cells(states)})
    invalidating(prepare(streamed(spark, path, files)), queue, store, folder).awaitTermination()
    return store.read("states")


def title_changes(saves: DataFrame) -> DataFrame:
    """Saves of unversioned types (item_id, seq, title) whose title differs from the save before."""
    from pyspark.sql import Window

    before = F.lag("title").over(Window.partitionBy("item_id").orderBy("seq"))
    return saves.withColumn("before", before).where("before is not null and before <> title")


def trash_cascade(events: DataFrame, associations: DataFrame, items: DataFrame) -> DataFrame:
    """Translations (id) of managed source items that were trashed (content_type, id, value)."""
    gone = events.where((F.col("value") == -2) & F.col("content_type").isin(list(ct.TYPES))).select("id").distinct()
    return asc.translations(associations, items, gone).select(F.col("member_id").alias("id")).distinct()


def default_language(items: DataFrame, source: str) -> DataFrame:
    """New items (no id) of managed types without a language get the source language."""
    managed = F.col("content_type").isin(list(ct.TYPES)) if "content_type" in items.columns else F.lit(True)
    return items.withColumn("language", F.when(managed & F.col("id").isNull() & (F.coalesce("language", F.lit("")) == ""), source).otherwise(F.col("language")))


def subscribed(events: DataFrame) -> DataFrame:
    """Events (EVENT) of known kinds on items of managed types; missing columns are null."""
    kinds = T._parse_datatype_string(EVENT)
    own = events.select(*[F.col(f.name).cast(f.dataType) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])
    return own.where(F.col("event_type").isin(*KINDS) & F.col("content_type").isin(list(ct.TYPES)))


def optouts(events: DataFrame, items: DataFrame, queue: DataFrame, source: str) -> DataFrame:
    """The queue after saves (EVENT): a save of an item in the source language that carries a flag stores it; others leave it. The last save counts."""
    saves = subscribed(events).where("event_type = 'save'").withColumn("flag", F.try_element_at("payload", F.lit("flag")).try_cast("int")).where("flag is not null")
    own = saves.groupBy("content_type", F.col("item_id").alias("id")).agg(F.max_by("flag", F.struct("ts", "version_id", "flag")).alias("flag"))
    own = own.join(items.where(F.col("language") == source).select("content_type", "id"), ["content_type", "id"], "left_semi")
    return st.flagged(queue, own.select("content_type", F.col("id").alias("content_id"), "flag"))


def deletions(events: DataFrame, items: DataFrame, queue: DataFrame, states: DataFrame, associations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, queue, states, associations) after deletions (EVENT), by what held before them.

    A queued item takes its translations and its queue row along; a translation takes its cell of its source's row. Types that
    are associated here lose their association as well.
    """
    gone = subscribed(events).where("event_type = 'delete'").select("content_type", F.col("item_id").alias("id")).distinct()
    keys = queue.select("content_type", F.col("content_id").alias("id"))
    sources, others = gone.join(keys, ["content_type", "id"], "left_semi"), gone.join(keys, ["content_type", "id"], "left_anti")
    out, rest, cells = items.join(gone, ["content_type", "id"], "left_anti"), associations, None
    for name, p in ct.TYPES.items():
        links = associations.where(F.col("context") == p["association_context"])
        own = items.where(F.col("content_type") == name).select("id", "language", "state")
        below = asc.translations(links, own, sources.where(F.col("content_type") == name).select("id")).select(F.lit(name).alias("content_type"), F.col("member_id").alias("id")).distinct()
        out = out.join(below, ["content_type", "id"], "left_anti")
        mine = others.where(F.col("content_type") == name).select("id").join(own, "id").join(asc.source_queue(links, queue, name), "id")
        mine = mine.select("queue_id", F.col("language").alias("target_language"))
        cells = mine if cells is None else cells.unionByName(mine)
        if p.get("self_associated"):
            rest = asc.removed(rest, gone.where(F.col("content_type") == name).select("id"), p["association_context"])
    left, states = st.without_items(queue, states, sources.select("content_type", F.col("id").alias("content_id")))
    return out.select(items.columns), left, st.without_cells(states, cells.distinct()), rest
