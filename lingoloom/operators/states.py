"""State tables as functions: old rows and changes in, new rows out. Write the result to a new path, never over the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, RANGES = 100_000, 100_000
SETTLED = ["review", "approved", "published"]


def numbered(rows: DataFrame, kind: str, number: str, start: int = 0, output: str = "id") -> DataFrame:
    """Number rows from start + 1 by kind and number, without one task seeing them all.

    Rows are ranked inside ranges of numbers; only the ranges' sizes are added up in one place. There are at most RANGES ranges of a
    kind, however sparse the numbers are, each of WIDTH numbers or more.
    """
    from pyspark.sql import Window

    low, high = rows.agg(F.min(number), F.max(number)).first()
    width = WIDTH if low is None else max(WIDTH, -(-(int(high) - int(low) + 1) // RANGES))
    dealt = rows.withColumn("_b", F.expr(f"{number} div {width}"))
    dealt = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(kind, "_b").orderBy(number)))
    sizes = rows.groupBy(kind, F.expr(f"{number} div {width}").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.orderBy(kind, "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select(kind, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.join(sizes, [kind, "_b"]).withColumn(output, (F.lit(start) + F.col("_before") + F.col("_r")).cast("bigint")).drop("_b", "_r", "_before")


def ensured(queue: DataFrame, wanted: DataFrame) -> DataFrame:
    """The queue with rows for all (content_type, content_id) of ``wanted``; new ids follow the largest."""
    new = wanted.select("content_type", "content_id").distinct().join(queue, ["content_type", "content_id"], "left_anti")
    top = queue.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one number
    new = numbered(new, "content_type", "content_id", int(top)).withColumn("do_not_translate", F.lit(0))
    return queue.unionByName(new.select(queue.columns))


def reviewed(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells (queue_id, target_language, source_version_id and, if states have it, machine_draft) set to review with that version and
    draft; of some changes of a cell that of the newest version counts (of one version the last draft in order). Missing cells are added, with ids that follow the largest."""
    set_ = [c for c in ("source_version_id", "machine_draft") if c in states.columns and c in changes.columns]
    newest = F.max_by(F.struct(*set_), F.struct(F.coalesce("source_version_id", F.lit(0)), *(F.col(c) for c in set_[1:])))
    own = changes.groupBy("queue_id", "target_language").agg(newest.alias("_new"))
    changed = F.col("_new").isNotNull()
    out = states.join(own, ["queue_id", "target_language"], "left")
    out = out.withColumns({"translation_state": F.when(changed, "review").otherwise(F.col("translation_state")), **{c: F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in set_}})
    new = own.join(states, ["queue_id", "target_language"], "left_anti").select("queue_id", "target_language", F.lit("review").alias("translation_state"), "_new.*")
    return out.select(states.columns).unionByName(_added(states, new))


def seeded(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cells (queue_id, target_language, translation_state) added where there is none."""
    new = wanted.groupBy("queue_id", "target_language").agg(F.max("translation_state").alias("translation_state")).join(states, ["queue_id", "target_language"], "left_anti")
    return states.unionByName(_added(states, new))


def _added(states: DataFrame, new: DataFrame) -> DataFrame:
    """New cells as rows of the states: ids follow the largest, no version is 0, and other columns are null."""
    top = states.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one number
    out = numbered(new, "target_language", "queue_id", int(top))
    blank = lambda f: F.lit(0 if f.name == "source_version_id" else None).cast(f.dataType).alias(f.name)
    return out.select(*[F.col(f.name).cast(f.dataType) if f.name in out.columns else blank(f) for f in states.schema])


def flagged(queue: DataFrame, flags: DataFrame) -> DataFrame:
    """Opt-out flags (content_type, content_id, flag) stored; a missing row is made for 1 only. Null flags change nothing."""
    own = flags.where("flag is not null").groupBy("content_type", "content_id").agg(F.max("flag").alias("flag"))
    out = queue.join(own, ["content_type", "content_id"], "left").withColumn("do_not_translate", F.coalesce("flag", "do_not_translate")).select(queue.columns)
    missing = own.where("flag = 1").join(queue, ["content_type", "content_id"], "left_anti")
    top = queue.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(missing.select("content_type", "content_id"), "content_type", "content_id", int(top)).withColumn("do_not_translate", F.lit(1))
    return out.unionByName(new.select(queue.columns))


def cleared(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Opt-out flags of queue ids taken back; ids without a row change nothing."""
    own = ids.select("id").distinct().withColumn("_c", F.lit(True))
    return queue.join(own, "id", "left").withColumn("do_not_translate", F.when(F.col("_c"), 0).otherwise(F.col("do_not_translate"))).select(queue.columns)


def invalidated(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Settled cells of changed items (queue_id, version_id) back to pending: of all of them where the version is null, else
    of those that were made from an older one. Repeats and late changes make no difference."""
    own = changes.groupBy("queue_id").agg(F.max("version_id").alias("_v"), F.max(F.isnull("version_id")).alias("_any"))
    stale = F.col("_any") | (F.col("source_version_id") < F.col("_v"))
    state = F.when(F.col("translation_state").isin(SETTLED) & F.coalesce(stale, F.lit(False)), "pending").otherwise(F.col("translation_state"))
    return states.join(own, "queue_id", "left").withColumn("translation_state", state).select(states.columns)


def decided(states: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells (queue_id, target_language, state) set to a state; cells that don't exist are not made."""
    own = cells.groupBy("queue_id", "target_language").agg(F.max("state").alias("_s"))
    return states.join(own, ["queue_id", "target_language"], "left").withColumn("translation_state", F.coalesce("_s", "translation_state")).select(states.columns)


def without_items(queue: DataFrame, states: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queue and states without the items (content_type, content_id) of ``gone``."""
    left = queue.join(gone, ["content_type", "content_id"], "left_anti")
    return left, states.join(left.select(F.col("id").alias("queue_id")), "queue_id", "left_semi")


def without_cells(states: DataFrame, cells: DataFrame) -> DataFrame:
    """States without some cells (queue_id, target_language)."""
    return states.join(cells, ["queue_id", "target_language"], "left_anti")


def trashed(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items of the ids set to trashed."""
    own = ids.select("id").distinct().withColumn("_t", F.lit(True))
    return items.join(own, "id", "left").withColumn("state", F.when(F.col("_t"), -2).otherwise(F.col("state"))).drop("_t")


def deleted(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items without those of the ids."""
    return items.join(ids.select("id").distinct(), "id", "left_anti").select(items.columns)


def processed(feedback: DataFrame, batch: DataFrame) -> DataFrame:
    """Feedback of the batch's ids marked as processed, with the batch's diff_data where it has some."""
    own = batch.select("id", F.col("diff_data").alias("_d") if "diff_data" in batch.columns else F.lit(None).cast("string").alias("_d"), F.lit(True).alias("_p"))
    return feedback.join(own, "id", "left").withColumns({"status": F.when(F.col("_p"), "processed").otherwise(F.col("status")), "diff_data": F.coalesce("_d", F.col("diff_data") if "diff_data" in feedback.columns else F.lit(None))}).drop("_d", "_p")


def stamped(rows: DataFrame, user: int | None = None, new: Column | bool = True, changed: Column | bool = True) -> DataFrame:
    """Audit columns: of changed rows the time and the user (0 without one) as modified ones, and of new rows as created ones where these are
    missing. new, changed: conditions on rows; other rows keep what they have."""
    now, who = F.current_timestamp(), F.lit(user or 0).cast("bigint")
    is_ = lambda c: F.lit(c) if isinstance(c, bool) else c
    blank = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    modified = {c: F.when(is_(changed), v).otherwise(blank(c, k)) for c, v, k in (("modified", now, "timestamp"), ("modified_by", who, "bigint"))}
    at, by = blank("created", "timestamp"), blank("created_by", "bigint")
    created = {"created": F.when(is_(new), F.coalesce(at, now)).otherwise(at), "created_by": F.when(is_(new) & (F.coalesce(by, F.lit(0)) == 0), who).otherwise(by)}
    return rows.withColumns(modified | created)
