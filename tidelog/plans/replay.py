"""Plans that shorten or resume a replay: snapshots, checkpoints and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.rules import every_n, snapshot_status
from tidelog.operators.fold import highest_before, running_sum


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The last committed snapshot of each stream from (stream_id, commit, version, schema_version, state)."""
    last = F.max_by(F.struct("version", "schema_version", "state"), "commit").alias("s")
    return snapshots.groupBy("stream_id").agg(last).select("stream_id", "s.*")


def with_snapshots(log: DataFrame, snapshots: DataFrame, schema: int) -> DataFrame:
    """The events that still have to be replayed, with the state to start from.

    Events up to a usable snapshot are dropped. A stale snapshot counts as none: its stream is replayed whole.
    Adds snapshot_version, snapshot_state (null for a whole replay) and status.
    """
    kept = snapshots.select(
        "stream_id",
        snapshot_status(F.col("version"), F.col("schema_version"), F.lit(schema)).alias("status"),
        F.when(F.col("schema_version") == schema, F.col("version")).alias("snapshot_version"),
        F.when(F.col("schema_version") == schema, F.col("state")).alias("snapshot_state"),
    )
    rows = log.join(kept, "stream_id", "left").withColumn("status", F.coalesce("status", F.lit("Absent")))
    return rows.where(F.col("version") > F.coalesce("snapshot_version", F.lit(0)))


def resumed_sum(log: DataFrame, snapshots: DataFrame, schema: int, value: Column) -> DataFrame:
    """(stream_id, head, total, replayed): a sum that goes on from snapshots.

    Streams whose events all lie behind their snapshot keep its version and state.
    """
    tail = with_snapshots(log, snapshots, schema)
    folded = tail.groupBy("stream_id").agg(F.max("version").alias("_head"), F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    usable = snapshots.where(F.col("schema_version") == schema).select("stream_id", F.col("version").alias("_from"), F.col("state").alias("_state"))
    return folded.join(usable, "stream_id", "full").select(
        "stream_id",
        F.coalesce("_head", "_from").alias("head"),
        (F.coalesce("_state", F.lit(0)) + F.coalesce("_sum", F.lit(0))).alias("total"),
        F.coalesce("_n", F.lit(0)).alias("replayed"),
    )


def trigger_points(log: DataFrame, n: int) -> DataFrame:
    """Events at which a stream's snapshot is due when one is taken every ``n`` versions."""
    rows = highest_before(log, "stream_id", "version", "version", "_before")
    return rows.where(every_n(F.col("_before"), F.col("version"), n)).drop("_before")


def guard_positions(deliveries: DataFrame) -> DataFrame:
    """Marks deliveries (consumer, delivery, position) that do not go beyond all positions before them.

    Such a delivery is refused and changes nothing, so the position to beat is the highest one so far.
    """
    rows = highest_before(deliveries, "consumer", "delivery", "position", "_seen")
    return rows.withColumn("status", F.when(F.col("position") <= F.col("_seen"), "NonIncreasingPosition").otherwise("Applied")).drop("_seen")


def projected(log: DataFrame, value: Column, floor: int, ceiling: int) -> DataFrame:
    """(stream_id, applied, failed_at, state): a checked running sum that fails at the first event which
    takes it out of floor..ceiling; the state is the last good one and later events are not applied."""
    rows = running_sum(log, value, "_sum")
    failed = rows.where(~F.col("_sum").between(floor, ceiling)).groupBy("stream_id").agg(F.min("version").alias("_failed"))
    good = F.col("_failed").isNull() | (F.col("version") < F.col("_failed"))
    return rows.join(failed, "stream_id", "left").groupBy("stream_id").agg(
        F.count_if(good).alias("applied"),
        F.min("_failed").alias("failed_at"),
        F.coalesce(F.max_by("_sum", F.when(good, F.col("version"))), F.lit(0)).alias("state"),
    )
