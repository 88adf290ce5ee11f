"""Commands and reactions as set operations: decide events from states, derive intents, drop repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.fold import running_sum


def decide(commands: DataFrame, states: DataFrame, events: Column, error: Column | None = None, key: str = "stream_id") -> DataFrame:
    """Joins commands to the current states and evaluates a decision for each.

    ``events`` is an array expression: null or empty for a command that changes nothing. ``error`` refuses a
    command. Adds events and outcome: Rejected, Ignored or Executed.
    """
    rows = commands.join(states, key, "left").withColumn("error", F.lit(None).cast("string") if error is None else error)
    made = F.when(F.col("error").isNull(), events)
    rows = rows.withColumn("events", made)
    return rows.withColumn(
        "outcome",
        F.when(F.col("error").isNotNull(), "Rejected").when(F.coalesce(F.size("events"), F.lit(0)) <= 0, "Ignored").otherwise("Executed"),
    )


def produced(decisions: DataFrame, head: Column, key: str = "stream_id") -> DataFrame:
    """One row for each event of the decisions, with the version that it gets behind ``head``."""
    rows = decisions.where("outcome = 'Executed'").select(key, head.alias("_head"), F.posexplode("events").alias("_i", "event"))
    return rows.select(key, (F.coalesce("_head", F.lit(0)) + F.col("_i") + 1).cast("long").alias("version"), "event")


def correlate(upstream: DataFrame, saga_id: Column) -> DataFrame:
    """Routes upstream events to sagas; events without a key are not routed."""
    return upstream.withColumn("saga_id", saga_id).where("saga_id is not null")


def react(
    routed: DataFrame,
    fields: list[str],
    initial: Column,
    reaction: Callable[[Column, Column], tuple[Column, Column]],
    advance: Callable[[Column, Column, Column], Column],
    limit: int = 1_000_000,
) -> DataFrame:
    """(saga_id, position, outcome, error, events): each saga's reactions to its upstream events, in position order.

    ``reaction(state, event)`` gives an error and an array of own events; both may be null. An error refuses the
    event, null or no events ignore it; otherwise ``advance(state, event, events)`` is the state that the next
    event meets. A saga is folded by one task, so it may have at most ``limit`` events; a longer one gives one row
    with a null position and the error RehydrationLimitExceeded.
    """
    sizes = routed.groupBy("saga_id").agg(F.count("*").alias("n"))
    within = routed.join(sizes.where(F.col("n") <= limit).select("saga_id"), "saga_id", "left_semi")
    gathered = within.groupBy("saga_id").agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias("_in"))

    def result(state: Column, event: Column) -> Column:
        error, events = reaction(state, event)
        return F.struct(event["position"].alias("position"), error.alias("error"), F.when(error.isNull(), events).alias("events"))

    def step(total: Column, event: Column) -> Column:
        out = result(total["state"], event)
        acted = out["error"].isNull() & (F.coalesce(F.size(out["events"]), F.lit(0)) > 0)
        state = F.when(acted, advance(total["state"], event, out["events"])).otherwise(total["state"])
        return F.struct(state.alias("state"), F.concat(total["out"], F.array(out)).alias("out"))

    none = F.array().cast("array<struct<position:bigint,error:string,events:array<string>>>")
    folded = gathered.select("saga_id", F.aggregate("_in", F.struct(initial.alias("state"), none.alias("out")), step, lambda t: t["out"]).alias("out"))
    rows = folded.select("saga_id", F.explode("out").alias("o")).select("saga_id", "o.position", "o.error", "o.events")
    outcome = F.when(F.col("error").isNotNull(), "Rejected").when(F.coalesce(F.size("events"), F.lit(0)) <= 0, "Ignored").otherwise("Reacted")
    long = sizes.where(F.col("n") > limit).select(
        "saga_id", F.lit(None).cast("long").alias("position"), F.lit("RehydrationLimitExceeded").alias("error"), F.lit(None).cast("array<string>").alias("events")
    )
    return rows.unionByName(long).select("saga_id", "position", outcome.alias("outcome"), "error", "events")


def accepted_until(records: DataFrame, facts: Column, budget: int) -> DataFrame:
    """(stream_id, records, facts, corrupt_at): acceptance records (stream_id, version, request_id) up to the first bad one.

    A record is bad if its request id stands in an earlier record of the stream, or if it takes the number of facts
    beyond ``budget``; that latches, so nothing behind it counts.
    """
    rows = records.withColumn("_facts", facts.cast("long"))
    first = rows.groupBy("stream_id", "request_id").agg(F.min("version").alias("_first"))
    summed = running_sum(rows, F.col("_facts")).join(first, ["stream_id", "request_id"])
    bad = F.when((F.col("version") > F.col("_first")) | (F.col("running") > budget), F.col("version"))
    latch = summed.groupBy("stream_id").agg(F.min(bad).alias("corrupt_at"))
    kept = F.col("corrupt_at").isNull() | (F.col("version") < F.col("corrupt_at"))
    return summed.join(latch, "stream_id").groupBy("stream_id").agg(
        F.count_if(kept).alias("records"), F.coalesce(F.sum(F.when(kept, F.col("_facts"))), F.lit(0)).alias("facts"), F.min("corrupt_at").alias("corrupt_at")
    )


def intents(events: DataFrame, intent: Column) -> DataFrame:
    """Events that give rise to an intent, at their own versions; other events keep theirs but give no row."""
    return events.withColumn("intent", intent).where("intent is not null")


def deduplicated(messages: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key of a delivery that may repeat messages; the rows of a key are equal."""
    return messages.dropDuplicates(key)


def submit(requests: DataFrame, accepted: DataFrame, heads: DataFrame) -> DataFrame:
    """Outcomes of requests (stream_id, request_id, expected, command) against accepted ones and heads.

    A request id with other content is a Mismatch; with the same content it gets the stored receipt; else a
    wrong expected version is a Conflict; else the request is to be executed.
    """
    stored = accepted.select(
        "stream_id", "request_id", F.col("command").alias("_command"), F.col("expected").alias("_expected"), F.col("version").alias("receipt_version")
    )
    rows = requests.join(stored, ["stream_id", "request_id"], "left").join(heads, "stream_id", "left")
    same = F.col("_command").eqNullSafe(F.col("command")) & F.col("_expected").eqNullSafe(F.col("expected"))
    outcome = (
        F.when(F.col("receipt_version").isNotNull() & ~same, "Mismatch")
        .when(F.col("receipt_version").isNotNull(), "Receipt")
        .when(~F.col("expected").eqNullSafe(F.col("head")), "Conflict")
        .otherwise("Execute")
    )
    return rows.withColumn("outcome", outcome).drop("_command", "_expected")
