"""Checked import of exported sections: which run of each section can be appended, and what became of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.fold import BLOCK, numbered


def section_plan(blocks: DataFrame) -> DataFrame:
    """(section, first, reached, events, halt, got) for blocks (section, block, version, corrupt).

    A section's run is its longest gapless stretch from the first block on. It halts Complete at the end, at
    the first Corrupt block, or at a Gap, whose version is ``got``. Sections without blocks give no row.
    """
    rows = numbered(blocks, "section", ["block"], F.floor(F.col("block") / BLOCK), "_n")
    rows = rows.join(blocks.groupBy("section").agg(F.min_by("version", "block").alias("_first")), "section")
    stop = F.when(F.col("corrupt"), "Corrupt").when(F.col("version") != F.col("_first") + F.col("_n") - 1, "Gap")
    rows = rows.withColumn("_stop", stop)
    at = F.when(F.col("_stop").isNotNull(), F.col("_n"))
    plans = rows.groupBy("section").agg(
        F.count("*").alias("_all"),
        F.min(F.when(F.col("_n") == 1, F.col("_first"))).alias("_from"),
        F.min(at).alias("_at"),
        F.min_by("_stop", at).alias("_halt"),
        F.min_by("version", at).alias("_got"),
    )
    events = F.coalesce(F.col("_at") - 1, F.col("_all"))
    return plans.select(
        "section",
        F.when(events > 0, F.col("_from")).alias("first"),
        F.when(events > 0, F.col("_from") + events - 1).alias("reached"),
        events.cast("long").alias("events"),
        F.coalesce("_halt", F.lit("Complete")).alias("halt"),
        F.when(F.col("_halt") == "Gap", F.col("_got")).alias("got"),
    )


def import_report(plans: DataFrame, heads: DataFrame) -> DataFrame:
    """(section, outcome, reached, got) when each section is appended on its own.

    A run that does not follow on its stream's head is refused and reported as a Mismatch with the run's
    first version; an accepted run reports why its section halted.
    """
    rows = plans.join(heads.select(F.col("stream_id").alias("section"), "head"), "section", "left")
    refused = (F.col("events") > 0) & (F.coalesce("head", F.lit(0)) != F.col("first") - 1)
    return rows.select(
        "section",
        F.when(refused, "Mismatch").when(F.col("halt") == "Gap", "Mismatch").otherwise(F.col("halt")).alias("outcome"),
        F.when(~refused, F.col("reached")).alias("reached"),
        F.when(refused, F.col("first")).otherwise(F.col("got")).alias("got"),
    )


def import_whole(plans: DataFrame, heads: DataFrame) -> DataFrame:
    """(committed, offender, outcome, expected, got) when all sections land or none does.

    The first offender by section order is reported: a halt before its end, or a run that does not follow on
    its stream's head, with the version that was expected there.
    """
    rows = plans.join(heads.select(F.col("stream_id").alias("section"), "head"), "section", "left")
    refused = (F.col("events") > 0) & (F.coalesce("head", F.lit(0)) != F.col("first") - 1)
    outcome = F.when(F.col("halt") == "Corrupt", "Corrupt").when(F.col("halt") == "Gap", "Mismatch").when(refused, "Mismatch")
    expected = F.when(F.col("halt") == "Gap", F.col("reached") + 1).when(outcome == "Mismatch", F.coalesce("head", F.lit(0)) + 1)
    got = F.when(F.col("halt") == "Gap", F.col("got")).when(outcome == "Mismatch", F.col("first"))
    bad = rows.select("section", outcome.alias("outcome"), expected.alias("expected"), got.alias("got")).where("outcome is not null")
    first = bad.agg(F.min(F.struct("section", "outcome", "expected", "got")).alias("s"))
    return first.select(
        F.col("s").isNull().alias("committed"), F.col("s.section").alias("offender"), "s.outcome", "s.expected", "s.got"
    )


def unfinished(report: DataFrame) -> DataFrame:
    """The rows of an import's report that a later run must act on."""
    return report.where(F.col("outcome") != "Complete")


def all_complete(report: DataFrame) -> DataFrame:
    """(sections, unfinished, all_complete) of an import's report; an empty report is complete."""
    open_ = F.count_if(F.col("outcome") != "Complete")
    return report.agg(F.count("*").alias("sections"), open_.alias("unfinished"), (open_ == 0).alias("all_complete"))


def export_manifest(log: DataFrame, payload: str = "payload") -> DataFrame:
    """(sections, events, bytes): the completion record of an export."""
    return log.agg(
        F.countDistinct("stream_id").alias("sections"),
        F.count("*").alias("events"),
        F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).alias("bytes"),
    )
