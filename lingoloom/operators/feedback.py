"""Feedback: what reviewers changed, field by field, and batches of it for distilling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingoloom.functions import text as tx
from lingoloom.functions.diff import diff, lean


def pairs(snapshots: DataFrame, corrections: DataFrame, sources: DataFrame) -> DataFrame:
    """Preference pairs of cells in review: (queue_id, target_language, field, source_text, machine_draft, human_correction).

    snapshots: a row for each field of a cell's draft; corrections: the same with what the reviewer left; sources: (queue_id, field,
    source_text). Only fields count whose correction differs from the draft by more than blanks at the ends.
    """
    own = snapshots.where("translation_state = 'review'").join(corrections, ["queue_id", "target_language", "field"]).join(sources, ["queue_id", "field"], "left")
    changed = tx.trimmed(F.coalesce("correction", F.lit(""))) != tx.trimmed(F.coalesce("draft", F.lit("")))
    return own.where(changed).select("queue_id", "target_language", "field", F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("draft", F.lit("")).alias("machine_draft"), F.col("correction").alias("human_correction"))


def pending(feedback: DataFrame, size: int | None = None) -> DataFrame:
    """The oldest pending feedback, at most a batch."""
    own = feedback.where("status = 'pending'").orderBy("created_day", "id")
    return own if size is None else own.limit(size)


def with_diff(feedback: DataFrame) -> DataFrame:
    """Add diff_data: the labelled spans, one a line."""
    lean(feedback.sparkSession)
    return feedback.withColumn("diff_data", F.array_join(diff("machine_draft", "human_correction"), "\n"))


def haystacks(batch: DataFrame) -> DataFrame:
    """(item_id, target_language, text): all source texts of a batch's language as one, in order of id. The batch's size bounds them."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("id", "source_text"))), lambda x: x.source_text)
    return batch.groupBy("target_language").agg(F.array_join(parts, " ").alias("text")).select(F.lit(0).cast("bigint").alias("item_id"), "target_language", "text")


def batches(words: DataFrame, size: int = 200, most: int = 5, by: str = "language") -> DataFrame:
    """Number each language's (or text's) words (word, in order of ``at``) into batches of a size, at most so many.

    The limit on places comes first, so that each task sends no more words of a language than are wanted.
    """
    n = F.row_number().over(Window.partitionBy(by).orderBy("at", "word"))
    return words.withColumn("_n", n).where(F.col("_n") <= size * most).withColumn("batch_id", F.floor((F.col("_n") - 1) / size)).drop("_n")


def unknown_words(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Words (language, word) that have no standard form yet."""
    return words.join(forms, ["language", "word"], "left_anti")


def failure_runs(log: DataFrame, limit: int = 2) -> DataFrame:
    """The part of a run's log (run_id, seq, ok) that a driver would have gone through: it stops after so many failures on end."""
    order = Window.partitionBy("run_id").orderBy("seq")
    island = F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = log.withColumn("_i", island)
    streak = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("run_id", "_i").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumn("_s", streak)
    stop = F.min(F.when(F.col("_s") >= limit, F.col("seq"))).over(Window.partitionBy("run_id"))
    return own.withColumn("_stop", stop).where(F.coalesce(F.col("seq") <= F.col("_stop"), F.lit(True))).drop("_i", "_s", "_stop")
