"""Column rules: triggers, sizes and outcome tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a row is charged besides its variable parts. Fixed value.
ROW_BYTES = 32


def every_n(old: Column, new: Column, n: int) -> Column:
    """Fires when ``new`` lies in a later run of n than ``old``; an absent ``old`` counts as 0."""
    if n < 1:
        raise ValueError("n must be positive")
    bucket = lambda c: F.floor(c.cast("long") / n) if n == 1 else (c.cast("long") - F.pmod(c.cast("long"), F.lit(n))) / n
    return bucket(new) > bucket(F.coalesce(old, F.lit(0)))


def after_types(event_type: Column, types: list[str]) -> Column:
    return event_type.isin(*types)


def row_bytes(*variable: Column) -> Column:
    """Bytes charged for a row: a fixed part and its variable parts; an absent part costs nothing."""
    total = F.lit(ROW_BYTES)
    for part in variable:
        total = total + F.coalesce(F.octet_length(part), F.lit(0))
    return total.cast("long")


def append_outcome(expected: Column, head: Column, version: Column, running: Column, most: int = (1 << 63) - 1) -> Column:
    """The outcome of one event of an append, in the order in which the rules apply.

    ``expected`` and ``head`` are null for a stream without events. ``running`` is the version that the
    event must have; null where it would go beyond ``most``.
    """
    return (
        F.when(~expected.eqNullSafe(head), "Conflict")
        .when(running.isNull() | (running > most), "VersionOverflow")
        .when(version != running, "Conflict")
        .otherwise("Accepted")
    )


def checkpoint_outcome(
    expected: Column, revision: Column, stored_schema: Column, schema: Column, stored_position: Column, position: Column, rebuild: Column, most: int = (1 << 63) - 1
) -> Column:
    """The outcome of a checkpoint write. ``revision`` and what is stored are null if there is no record."""
    advance = ~rebuild
    return (
        F.when(~expected.eqNullSafe(revision), "Conflict")
        .when(advance & revision.isNotNull() & (stored_schema != schema), "SchemaMismatch")
        .when(advance & revision.isNotNull() & (position <= stored_position), "NonIncreasingPosition")
        .when(rebuild & (revision.isNull() | (stored_schema == schema)), "InvalidRebuild")
        .when(revision >= most, "RevisionOverflow")
        .otherwise("Committed")
    )


def open_outcome(revision: Column, stored_schema: Column, schema: Column, rebuild: Column) -> Column:
    """How a projection opens: from the initial state, from what is stored, or not at all."""
    return (
        F.when(revision.isNull(), F.when(rebuild, "InvalidRebuild").otherwise("Initial"))
        .when(stored_schema == schema, F.when(rebuild, "InvalidRebuild").otherwise("Stored"))
        .otherwise(F.when(rebuild, "Rebuild").otherwise("SchemaMismatch"))
    )


def snapshot_status(version: Column, stored_schema: Column, schema: Column) -> Column:
    return F.when(version.isNull(), "Absent").when(stored_schema != schema, "Stale").otherwise("Found")
