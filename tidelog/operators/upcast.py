"""Schema evolution on read: chains of payload changes, checked when they are declared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """From one schema version of an event type to the next, changing the payload and perhaps the type's name."""

    event_type: str
    schema: int
    change: Callable[[Column], Column]
    rename: str | None = None


class Upcaster:
    """A set of steps. Raises ValueError if a step repeats, a chain does not start at 1, or a chain has a gap."""

    def __init__(self, steps: list[Step]):
        self.steps = {}
        for s in steps:
            if s.schema < 1:
                raise ValueError(f"{s.event_type}: schema versions start at 1")
            if (s.event_type, s.schema) in self.steps:
                raise ValueError(f"{s.event_type}: two steps from schema {s.schema}")
            self.steps[s.event_type, s.schema] = s
        arrivals = {(s.rename or s.event_type, s.schema + 1) for s in steps}
        for name, schema in self.steps:
            if schema > 1 and (name, schema) not in arrivals and (name, schema - 1) not in self.steps:
                raise ValueError(f"{name}: no step leads to schema {schema}")
        self.current: dict[str, int] = {}
        for s in steps:
            self.current[s.event_type] = max(self.current.get(s.event_type, 1), s.schema if s.rename else s.schema + 1)
        for s in steps:
            if s.rename:
                self.current[s.rename] = max(self.current.get(s.rename, 1), s.schema + 1)
        for name, schema in arrivals:
            if schema < self.current[name] and (name, schema) not in self.steps:
                raise ValueError(f"{name}: the chain stops at schema {schema}, before {self.current[name]}")

    def current_version(self, event_type: str) -> int | None:
        return self.current.get(event_type)

    def schema_column(self, event_type: Column) -> Column:
        """The schema version to stamp on a new event: the current one of its type, or 1."""
        out = F.lit(1)
        for name, schema in self.current.items():
            out = F.when(event_type == name, schema).otherwise(out)
        return out.cast("long")

    def apply(self, log: DataFrame) -> DataFrame:
        """Brings events to their types' latest schemas.

        Adds upcast_type, upcast_schema, upcast_payload and upcast_error; the stored columns stay for
        verification. An unknown type passes unchanged; a known one at an undeclared schema is an
        UnsupportedSchema. Schemas rise with every step, so one pass over the schemas in order is enough.
        """
        name, schema, payload = F.col("event_type"), F.col("schema_version").cast("long"), F.col("payload")
        rows = log.withColumns({"upcast_type": name, "upcast_schema": schema, "upcast_payload": payload})
        for level in sorted({s.schema for s in self.steps.values()}):
            kind, at, body = F.col("upcast_type"), F.col("upcast_schema"), F.col("upcast_payload")
            new_kind, new_at, new_body = kind, at, body
            for s in (s for s in self.steps.values() if s.schema == level):
                here = (kind == s.event_type) & (at == level)
                new_kind = F.when(here, F.lit(s.rename or s.event_type)).otherwise(new_kind)
                new_at = F.when(here, F.lit(level + 1).cast("long")).otherwise(new_at)
                new_body = F.when(here, s.change(body)).otherwise(new_body)
            rows = rows.withColumns({"upcast_type": new_kind, "upcast_schema": new_at, "upcast_payload": new_body})
        wrong = F.lit(False)
        for known, latest in self.current.items():
            wrong = wrong | ((F.col("upcast_type") == known) & (F.col("upcast_schema") != latest) & ~self._retired(known))
        return rows.withColumn("upcast_error", F.when(wrong, "UnsupportedSchema"))

    def _retired(self, name: str) -> Column:
        """A type whose last step renames it keeps no events of its own at any declared schema."""
        return F.lit(False) if (name, self.current[name]) not in self.steps else F.col("upcast_schema") < 0
