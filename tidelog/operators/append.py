"""Appends checked as sets: expected heads, version sequences, targets and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidelog.functions.rules import append_outcome
from tidelog.operators.fold import BLOCK, numbered
from tidelog.sources.scratch import checkpointed

MOST = (1 << 63) - 1


def _placed(batch: DataFrame, key: str) -> DataFrame:
    """Adds the place of every event in its run, counted in blocks of ordinals, so that one task never sorts a long run.

    An ordinal is a whole number or a struct that begins with one.
    """
    kind = batch.schema["ordinal"].dataType
    number = F.col(f"ordinal.{kind.names[0]}") if isinstance(kind, StructType) else F.col("ordinal")
    return numbered(batch, key, ["ordinal"], F.floor(number / BLOCK), "_place")


def validate_sequence(batch: DataFrame, expected: Column | None = None) -> DataFrame:
    """(stream_id, events, first_bad, error) for each stream's run in a batch (stream_id, version, ordinal).

    The i-th event of a run must have version expected + i. ``expected`` is a column of the batch, 0 for a new
    stream. The first violation by order is reported; a version beyond the range is an overflow.
    """
    start = F.lit(0) if expected is None else F.coalesce(expected, F.lit(0))
    rows = _placed(batch, "stream_id").withColumn("_due", F.try_add(start.cast("long"), F.col("_place")))
    bad = F.when(F.col("_due").isNull(), "VersionOverflow").when(F.col("version") != F.col("_due"), "Conflict")
    return (
        rows.withColumn("_bad", bad)
        .groupBy("stream_id")
        .agg(
            F.count("*").alias("events"),
            F.min_by("version", F.when(F.col("_bad").isNotNull(), F.col("_place"))).alias("first_bad"),
            F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("_place"))).alias("error"),
        )
    )


def validate_appends(batch: DataFrame, heads: DataFrame) -> DataFrame:
    """(stream_id, outcome): append runs (stream_id, expected, version, ordinal) against the heads of a log.

    The rules apply in this order: the expected version must be the head (null for a new stream), no version
    may go beyond the range, and versions must follow on the head one by one.
    """
    rows = _placed(batch, "stream_id").join(heads, "stream_id", "left")
    due = F.try_add(F.coalesce("head", F.lit(0)).cast("long"), F.col("_place"))
    rows = rows.withColumn("_outcome", append_outcome(F.col("expected"), F.col("head"), F.col("version"), due))
    return rows.groupBy("stream_id").agg(
        F.coalesce(
            F.min_by("_outcome", F.when(F.col("_outcome") != "Accepted", F.col("_place"))), F.lit("Accepted")
        ).alias("outcome")
    )


def duplicate_targets(runs: DataFrame, target: str = "target", index: str = "run") -> DataFrame:
    """(first_index, duplicate_index) of the earliest run that names a target named before; empty if there is none."""
    first = runs.groupBy(target).agg(F.min(index).alias("first_index"))
    later = runs.join(first, target).where(F.col(index) > F.col("first_index"))
    return later.groupBy().agg(F.min(F.struct(F.col(index).alias("duplicate_index"), "first_index")).alias("s")).where("s is not null").select(
        "s.first_index", "s.duplicate_index"
    )


def whole_or_nothing(outcomes: DataFrame, index: str = "run") -> DataFrame:
    """(committed, first_offender) of a batch whose runs all land or none does."""
    refused = F.col("outcome") != "Accepted"
    return outcomes.agg(
        (F.count_if(refused) == 0).alias("committed"), F.min(F.when(refused, F.col(index))).alias("first_offender")
    )


def validate_runs(batch: DataFrame) -> DataFrame:
    """(valid, index, outcome, due, actual) of an atomic append's events (run, expected, version, ordinal).

    Every run starts behind its declared version ``expected``, null for a new stream, and goes on one by one. The
    first offence of the first offending run is reported: NonSequential, or VersionOverflow where no version is left.
    """
    due = F.try_add(F.coalesce("expected", F.lit(0)).cast("long"), F.col("_place"))
    rows = _placed(batch, "run").withColumn("due", due)
    outcome = F.when(F.col("due").isNull(), "VersionOverflow").when(F.col("version") != F.col("due"), "NonSequential")
    bad = rows.withColumn("outcome", outcome).where("outcome is not null")
    first = bad.agg(F.min(F.struct("run", "_place", "outcome", "due", "version")).alias("s"))
    return first.select(
        F.col("s").isNull().alias("valid"), F.col("s.run").alias("index"), "s.outcome", "s.due", F.col("s.version").alias("actual")
    )


def assign_positions(batch: DataFrame, base: int, order: list[str]) -> DataFrame:
    """Adds the position of every event of a batch: ``base`` plus its place in the batch's order.

    The places are counted in ranges of the order: each range is sorted by a task of its own, and only the
    sizes of the ranges are summed up, so no task sees the whole batch. The dealt rows are computed once and kept
    in the shared folder, so that the sizes are those of the very ranges that are numbered.
    """
    spark = batch.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = batch.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    marked = dealt.withColumn("_mark", F.monotonically_increasing_id())
    marked = marked.withColumn("_range", F.shiftright("_mark", 33)).withColumn("_row", F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)))
    marked = checkpointed(marked)
    sizes = marked.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    placed = marked.join(F.broadcast(starts), "_range")  # one row for each range
    return placed.withColumn("position", F.col("_start") + F.col("_row") + 1 + base).drop("_mark", "_range", "_row", "_start")
