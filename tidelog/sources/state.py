"""Checkpoints of projections: one record for each revision, written only if it is the next one."""

from __future__ import annotations

import json
from dataclasses import dataclass

from tidelog.functions.errors import Conflict, StoreError
from tidelog.sources.log import EventLog


class SchemaMismatch(StoreError):
    pass


class InvalidRebuild(StoreError):
    pass


class NonIncreasingPosition(StoreError):
    pass


@dataclass(frozen=True)
class Checkpoint:
    revision: int
    schema: int
    position: int
    state: str


class CheckpointStore:
    """Keeps the checkpoints of named projections beside a log, with the log's exclusive creation of files."""

    def __init__(self, log: EventLog):
        self._log = log

    def load(self, name: str) -> Checkpoint | None:
        folder = self._log._path(f"{self._log.path}/checkpoints/{name}")
        if not self._log._fs.exists(folder):
            return None
        names = sorted(f.getPath().getName() for f in self._log._fs.listStatus(folder) if not f.getPath().getName().startswith("."))
        return Checkpoint(**json.loads(self._log._read(f"checkpoints/{name}/{names[-1]}"))) if names else None

    def commit(self, name: str, expected: int | None, schema: int, position: int, state: str, rebuild: bool = False) -> Checkpoint:
        """Writes the next revision. The rules apply in the order of the raised errors below."""
        now = self.load(name)
        if expected != (now.revision if now else None):
            raise Conflict(name)
        if not rebuild and now and now.schema != schema:
            raise SchemaMismatch(name)
        if not rebuild and now and position <= now.position:
            raise NonIncreasingPosition(name)
        if rebuild and (now is None or now.schema == schema):
            raise InvalidRebuild(name)
        new = Checkpoint((now.revision if now else 0) + 1, schema, position, state)
        if not self._log._create(f"checkpoints/{name}/{new.revision:012d}", json.dumps(new.__dict__)):
            raise Conflict(name)
        return new
