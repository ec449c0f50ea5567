"""Saves that change an item's title, with the last title of each item as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def title_stream(saves: DataFrame, idle: int | None = None) -> DataFrame:
    """A stream of saves (item_id, seq, title) to those whose title differs from the save before (with it: before).

    The state of an item is the number and title of its last save. Within a micro-batch an item's saves go by number; one that isn't above the last number is
    a repeat or came late, and is left out. idle: items without a save for so many milliseconds are forgotten, and their next save
    has none before it. A micro-batch holds what its trigger's limits let in, and so does a group.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, title = state.get if state.exists else (None, None)
        own = pd.concat([p[["seq", "title"]] for p in parts]).dropna(subset=["seq"]).drop_duplicates("seq").sort_values("seq")
        own = own[own["seq"] > number] if number is not None else own
        if len(own):
            before = own["title"].shift(1)
            before.iloc[0] = title
            state.update((int(own["seq"].iloc[-1]), own["title"].iloc[-1]))
            changed = before.notna() & own["title"].notna() & (before != own["title"])
            yield pd.DataFrame({"item_id": key[0], "seq": own["seq"].astype("int64"), "title": own["title"], "before": before})[changed]
        if idle:
            state.setTimeoutDuration(idle)

    kind = saves.schema["item_id"].dataType.simpleString()
    out = f"item_id {kind}, seq bigint, title string, before string"
    time = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return saves.select("item_id", "seq", "title").groupBy("item_id").applyInPandasWithState(run, out, "seq bigint, title string", "append", time)


def write_changes(changes: DataFrame, folder: str) -> StreamingQuery:
    """Run to the stream's end; a batch's changes replace what an earlier attempt of it left."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    # a time-out would ask for batches without data for ever; those forgotten go with the next data
    name, conf = "spark.sql.streaming.noDataMicroBatches.enabled", changes.sparkSession.conf
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return changes.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
