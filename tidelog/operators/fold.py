"""Ordered folds of streams into states.

A fold that is a sum, a count or a latest value is an aggregate and combines before the shuffle. A fold that
depends on all earlier events of a stream is a running window. Anything else is an ordered fold over the
stream's events gathered in version order, behind a bound on their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Events of a stream that are replayed at most, unless said otherwise.
REPLAY_LIMIT = 1_000_000
BLOCK = 1 << 16


def numbered(rows: DataFrame, key: str, order: list[str], block: Column, name: str = "version") -> DataFrame:
    """Adds the place of every row among those of its key, from 1 on, in the order of columns of which ``block`` is a rising function.

    Rows are numbered in blocks. The sizes of the blocks combine before the shuffle and are few, so a key that
    holds a large part of all rows is not sorted by one task: its blocks are.
    """
    rows = rows.withColumn("_block", block)
    sizes = rows.groupBy(key, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_inside", F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order)))
    return inside.join(starts, [key, "_block"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_block", "_inside", "_start")


def running_sum(log: DataFrame, value: Column, name: str = "running", block: int = BLOCK) -> DataFrame:
    """Adds the sum of ``value`` over a stream's events up to each one.

    A stream is summed in blocks of versions. Block totals combine before the shuffle and are few, so a
    stream that holds a large part of all events is not sorted by one task: its blocks are.
    """
    rows = log.withColumn("_value", value).withColumn("_block", F.floor(F.col("version") / block))
    totals = rows.groupBy("stream_id", "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy("stream_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("stream_id", "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("stream_id", "_block").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum("_value").over(inside))
    return summed.join(starts, ["stream_id", "_block"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_value", "_block", "_inside", "_start")


def highest_before(rows: DataFrame, key: str, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the highest ``value`` of a key's rows that come before each one by the whole number ``order``; null for the first.

    Like a running sum, it works in blocks whose maxima combine before the shuffle.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    tops = rows.groupBy(key, "_block").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.select(key, "_block", F.max("_top").over(earlier).alias("_start"))
    within = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.max(value).over(within))
    return inside.join(starts, [key, "_block"]).withColumn(name, F.greatest("_start", "_inside")).drop("_block", "_inside", "_start")


def sticky_balance(log: DataFrame, delta: Column) -> DataFrame:
    """(stream_id, head, poisoned_at, balance): the first version at which the balance would fall below zero
    latches the error for good; such a stream has no balance."""
    rows = running_sum(log.withColumn("_delta", delta), F.col("_delta"))
    states = rows.groupBy("stream_id").agg(
        F.max("version").alias("head"),
        F.min(F.when(F.col("running") < 0, F.col("version"))).alias("poisoned_at"),
        F.sum("_delta").alias("_net"),
    )
    return states.select("stream_id", "head", "poisoned_at", F.when(F.col("poisoned_at").isNull(), F.col("_net")).alias("balance"))


def ordered_fold(
    log: DataFrame,
    fields: list[str],
    initial: Column,
    apply: Callable[[Column, Column], Column],
    limit: int = REPLAY_LIMIT,
) -> DataFrame:
    """(stream_id, head, state): applies ``apply(state, event)`` to each stream's events in version order.

    For folds that no aggregate or window expresses. Streams of more than ``limit`` events are not gathered:
    their state is null and their error says so. The counts come from a separate aggregate.
    """
    sizes = log.groupBy("stream_id").agg(F.count("*").alias("events"), F.max("version").alias("head"))
    short = log.join(sizes.where(F.col("events") <= limit).select("stream_id"), "stream_id", "left_semi")
    gathered = short.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("version", *fields))).alias("_events"))
    folded = gathered.select("stream_id", F.aggregate("_events", initial, apply).alias("state"))
    error = F.when(F.col("events") > limit, F.lit("RehydrationLimitExceeded"))
    return sizes.join(folded, "stream_id", "left").select("stream_id", "head", "state", error.alias("error"))


def latest(log: DataFrame, value: str, by: str = "version") -> DataFrame:
    """(stream_id, head, latest): the value of each stream's last event."""
    return log.groupBy("stream_id").agg(F.max(by).alias("head"), F.max_by(value, by).alias("latest"))


def counter(log: DataFrame, up: str, down: str) -> DataFrame:
    """(stream_id, value): increments less decrements."""
    one = F.when(F.col("event_type") == up, 1).when(F.col("event_type") == down, -1).otherwise(0)
    return log.groupBy("stream_id").agg(F.sum(one).alias("value"))


def by_type(log: DataFrame, types: list[str]) -> DataFrame:
    """(stream_id, one count for each type)."""
    return log.groupBy("stream_id").agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types])


def decoded_fold(log: DataFrame, value: Column) -> DataFrame:
    """(stream_id, applied, total, failed_at): ``value`` of decoded events summed up to each stream's first ``error``."""
    first = log.where("error is not null").groupBy("stream_id").agg(F.min("version").alias("failed_at"))
    live = F.col("failed_at").isNull() | (F.col("version") < F.col("failed_at"))
    return log.join(first, "stream_id", "left").groupBy("stream_id").agg(
        F.count_if(live).alias("applied"), F.coalesce(F.sum(F.when(live, value)), F.lit(0)).alias("total"), F.min("failed_at").alias("failed_at")
    )


def replay_check(log: DataFrame, start: int = 0, budget: int = REPLAY_LIMIT) -> DataFrame:
    """(stream_id, replayed, failed_at, error): where replaying a stream stops, if it does.

    Each version must be the successor of the one before, the first one of ``start``; no more than ``budget``
    events may be replayed. A wrong version is reported before a used-up budget.
    """
    rows = numbered(log, "stream_id", ["version"], F.floor(F.col("version") / BLOCK), "_n")
    wrong = F.col("version") != F.col("_n") + start
    stops = rows.withColumn(
        "_error", F.when(wrong, "VersionMismatch").when(F.col("_n") > budget, "RehydrationLimitExceeded")
    )
    return stops.groupBy("stream_id").agg(
        F.coalesce(F.min(F.when(F.col("_error").isNotNull(), F.col("_n") - 1)), F.count("*")).alias("replayed"),
        F.min(F.when(F.col("_error").isNotNull(), F.col("version"))).alias("failed_at"),
        F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("_n"))).alias("error"),
    )
