"""The test tables seen as event logs.

A log has the columns position (total order over all streams), stream_id, version (gapless from 1 in each
stream), event_type and what the events carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.fold import BLOCK, numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for each user, in the order of event ids; cents is the value in hundredths."""
    rows = numbered(events_by_position(spark, sf_dir), "stream_id", ["position"], F.floor(F.col("position") / BLOCK))
    return rows.select("position", "stream_id", "version", "event_type", "cents", "payload")


def events_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log without versions, for scans in position order; nothing here needs a shuffle."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).cast("long").alias("position"),
        F.col("user_id").alias("stream_id"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.col("props").alias("payload"),
    )


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for each conversation; a turn is an event whose type is the speaker's role."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream_id"),
        (F.col("turn") + 1).cast("long").alias("version"),
        F.col("role").alias("event_type"),
        F.col("text").alias("payload"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for each customer, in the order of order date and key."""
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "stream_id")
    rows = numbered(rows, "stream_id", ["o_orderdate", "o_orderkey"], F.trunc("o_orderdate", "year"))
    return rows.select(
        "stream_id",
        "version",
        F.col("o_orderstatus").alias("event_type"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.col("o_orderkey").alias("order_id"),
    )


def lines_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a log with claimed versions. Many lines claim the same version: a corrupt log."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stream_id"),
        F.col("l_linenumber").cast("long").alias("version"),
        F.round(F.col("l_quantity") * 100).cast("long").alias("cents"),
        F.col("l_returnflag").alias("event_type"),
    )
