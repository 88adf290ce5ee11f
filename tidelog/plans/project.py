"""What an application runs against a log: executing decisions and bringing read models up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.decide import produced
from tidelog.sources.log import EventLog
from tidelog.sources.state import Checkpoint, CheckpointStore, InvalidRebuild, SchemaMismatch


def execute(log: EventLog, decisions: DataFrame, head: Column, schema: Column | None = None) -> tuple[str, int] | None:
    """Appends the events (event_type, payload) of all executed decisions, all or none.

    ``head`` is the version that each decision was made on, null for a new stream; if a stream has moved on
    since, the append is a Conflict. Returns the token of the last event, or None if nothing was decided.
    """
    based = decisions.where("outcome = 'Executed'").select("stream_id", head.cast("long").alias("expected"))
    runs = produced(decisions, head).join(based, "stream_id").select(
        "stream_id",
        "expected",
        "version",
        F.col("event.event_type").alias("event_type"),
        (F.lit(1) if schema is None else schema).cast("long").alias("schema_version"),
        F.col("event.payload").cast("binary").alias("payload"),
        F.lit(None).cast("binary").alias("metadata"),
    )
    return log.append(runs)


def catch_up(
    log: EventLog, store: CheckpointStore, name: str, schema: int, fold: Callable[[str | None, DataFrame], str], rebuild: bool = False
) -> Checkpoint | None:
    """Folds what was appended since a projection's checkpoint into its state and writes the next checkpoint.

    ``fold`` gets the stored state (None at the start) and the new events and returns the new state; it runs
    its own Spark job and returns a small summary. A stored state of another schema is a SchemaMismatch
    unless ``rebuild`` starts it anew, which keeps the revision; there must be something to rebuild. Without
    new events nothing is written.
    """
    now = store.load(name)
    if rebuild and (now is None or now.schema == schema):
        raise InvalidRebuild(name)
    if now and now.schema != schema and not rebuild:
        raise SchemaMismatch(name)
    start = 0 if now is None or rebuild else now.position
    view = log.view()
    if view.position <= start:
        return now
    state = fold(None if now is None or rebuild else now.state, view.read_all((log.history, start)))
    return store.commit(name, now.revision if now else None, schema, view.position, state, rebuild)
