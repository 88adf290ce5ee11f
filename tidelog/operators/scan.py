"""Scans of a log in either of its orders, stream listings and bounded pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_stream(log: DataFrame, stream_id: object, from_version: int = 1) -> DataFrame:
    """Events of one stream from a version on, that version included. An unknown stream is empty."""
    return log.where((F.col("stream_id") == F.lit(stream_id)) & (F.col("version") >= from_version)).orderBy("version")


def resume_stream(log: DataFrame, stream_id: object, after_version: int | None) -> DataFrame:
    """Events of one stream strictly after the last delivered version."""
    found = log.where(F.col("stream_id") == F.lit(stream_id))
    return (found if after_version is None else found.where(F.col("version") > after_version)).orderBy("version")


def read_all(log: DataFrame, after: int | None = None) -> DataFrame:
    """Events of all streams strictly after a position; None reads from the beginning."""
    return (log if after is None else log.where(F.col("position") > after)).orderBy("position")


def read_all_composite(log: DataFrame, after: tuple[int, int] | None) -> DataFrame:
    """The same for positions of two parts (txid, seq), spelled out so that the filter reaches the files."""
    if after is None:
        return log.orderBy("txid", "seq")
    txid, seq = after
    return log.where((F.col("txid") > txid) | ((F.col("txid") == txid) & (F.col("seq") > seq))).orderBy("txid", "seq")


def stream_heads(log: DataFrame) -> DataFrame:
    """(stream_id, head): the last version of every stream, aggregated before the shuffle."""
    return log.groupBy("stream_id").agg(F.max("version").alias("head"))


def list_streams(log: DataFrame, after: object | None = None, limit: int | None = None) -> DataFrame:
    """Ids of the streams that have events; with a limit, the first ones after a given id, in order."""
    ids = log.select("stream_id").distinct()
    if after is not None:
        ids = ids.where(F.col("stream_id") > F.lit(after))
    return ids if limit is None else ids.orderBy("stream_id").limit(limit)


def list_known_streams(keys: DataFrame, log: DataFrame) -> DataFrame:
    """Catalogued keys that have at least one event in this view of the log."""
    return keys.join(log.select("stream_id"), "stream_id", "left_semi")


def list_page(keys: DataFrame, after: object | None, rows: int, budget: int) -> DataFrame:
    """The next keys (stream_id) in order with their sizes, which add up to at most ``budget``; the first one in any case.

    A key that alone is larger than the budget is listed without its value.
    """
    keys = keys.withColumn("position", F.col("stream_id")).withColumn("row_bytes", F.lit(32).cast("long") + F.octet_length("stream_id"))
    page = byte_page(keys, after, rows, budget, F.col("row_bytes"))
    return page.select(F.when(F.col("row_bytes") <= budget, F.col("stream_id")).alias("stream_id"), "row_bytes", "ordinal", "total")


def decoded(log: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """The log with ``event``, its JSON payload by a schema, and ``error``: Decode where the payload is no such JSON."""
    event = F.from_json(F.col(payload).cast("string"), f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = log.withColumn("event", event)
    broken = F.col(payload).isNull() | F.col("event").isNull() | F.col("event._broken").isNotNull()
    return rows.withColumn("error", F.when(broken, "Decode")).withColumn("event", F.when(~broken, F.col("event").dropFields("_broken")))


def frozen_scan(log: DataFrame, heads: DataFrame) -> DataFrame:
    """Events up to the heads taken when the scan opened; later ones are not seen."""
    return log.join(heads, "stream_id").where("version <= head").drop("head")


def _paged(log: DataFrame, after: int | None, rows: int, size: Column) -> DataFrame:
    first = (log if after is None else log.where(F.col("position") > after)).withColumn("row_bytes", size)
    # The limit leaves at most ``rows`` rows, so the window over them needs no more than one task.
    first = first.orderBy("position").limit(rows)
    order = Window.orderBy("position")
    return first.withColumn("ordinal", F.row_number().over(order).cast("long")).withColumn(
        "total", F.sum("row_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    )


def byte_page(log: DataFrame, after: int | None, rows: int, budget: int, size: Column) -> DataFrame:
    """The next rows whose sizes add up to at most ``budget``, the first one in any case."""
    return _paged(log, after, rows, size).where((F.col("total") <= budget) | (F.col("ordinal") == 1))


def crossing_page(log: DataFrame, after: int | None, rows: int, budget: int, size: Column) -> DataFrame:
    """The next rows up to the one that reaches ``budget``; that one may cross it."""
    return _paged(log, after, rows, size).where(F.col("total") - F.col("row_bytes") < budget)
