"""A log kept as Parquet files and commit marks in one folder.

An append writes its events as files of their own and then publishes them by creating the next commit mark,
which must not exist. Of two writers only one creates it; the other one checks its expectations again on top
of what the first one added. A reader takes the commits that exist when it starts and reads exactly their
files, so what is appended later does not show.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.errors import Conflict, DuplicateTarget, Expired, HistoryMismatch, InvalidEnvelope, VersionOverflow
from tidelog.operators import append, scan

SCHEMA = "position long, stream_id binary, version long, event_type string, schema_version long, payload binary, metadata binary"
#: Longest event type in bytes. Fixed value.
TYPE_BYTES = 65_535


@dataclass(frozen=True)
class Commit:
    number: int
    base: int
    last: int
    folder: str
    token: str


class View:
    """The log as of one commit."""

    def __init__(self, log: EventLog, commits: list[Commit], lifetime: float | None = None):
        self._log, self.commits = log, commits
        self._until = None if lifetime is None else time.monotonic() + lifetime

    @property
    def frame(self) -> DataFrame:
        if self._until is not None and time.monotonic() > self._until:
            raise Expired
        reader = self._log.spark.read.schema(SCHEMA)
        folders = [f"{self._log.path}/events/{c.folder}" for c in self.commits]
        return reader.parquet(*folders) if folders else self._log.spark.createDataFrame([], SCHEMA)

    @property
    def position(self) -> int:
        return self.commits[-1].last if self.commits else 0

    def read_stream(self, stream_id: bytes, from_version: int = 1) -> DataFrame:
        return scan.read_stream(self.frame, stream_id, from_version)

    def read_all(self, after: tuple[str, int] | None = None) -> DataFrame:
        """Events after a token (history, position) of this log."""
        if after is not None and after[0] != self._log.history:
            raise HistoryMismatch
        return scan.read_all(self.frame, None if after is None else after[1])

    def heads(self) -> DataFrame:
        return scan.stream_heads(self.frame)


class EventLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._create("history", uuid.uuid4().hex)
        self.history = self._read("history")

    def _create(self, name: str, text: str) -> bool:
        """Creates a file that must not exist; whether this call created it.

        The text goes to a file of its own first. A link (on a local disk) or a rename that does not replace
        (elsewhere) publishes it, so of two writers one fails, and nobody reads half a mark.
        """
        target, draft = self._path(f"{self.path}/{name}"), self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        self._fs.mkdirs(draft.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() != "file":
                return self._fs.rename(draft, target)  # false where the target exists
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        except Exception:  # the outcome is unknown: the mark itself says whose it is
            if not self._fs.exists(target):
                raise
            return self._read(name) == text
        return True

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _commits(self) -> list[Commit]:
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(folder) if not f.getPath().getName().startswith("."))
        return [Commit(**json.loads(self._read(f"commits/{n}"))) for n in names]

    def view(self, lifetime: float | None = None) -> View:
        return View(self, self._commits(), lifetime)

    def _check_positions(self, folder: str, base: int, last: int) -> None:
        """Before events are published: their positions must be all those from ``base`` + 1 to ``last``, each once."""
        found = self.spark.read.schema(SCHEMA).parquet(folder).agg(
            F.count("*").alias("n"), F.count_distinct("position").alias("k"), F.min("position").alias("a"), F.max("position").alias("b")
        ).first()
        if (found.n, found.k, found.a, found.b) != (last - base, last - base, base + 1, last):
            raise InvalidEnvelope(f"positions of {folder}: {found}")

    def append(self, runs: DataFrame, attempts: int = 20) -> tuple[str, int] | None:
        """Appends runs (stream_id, expected, version, event_type, schema_version, payload, metadata), all or none.

        ``expected`` is the head that the caller knows, null for a new stream. Returns the token of the last
        event, or None for no events. Raises Conflict, VersionOverflow, DuplicateTarget or InvalidEnvelope;
        then nothing is added.
        """
        runs = runs.withColumn("ordinal", F.col("version") if "ordinal" not in runs.columns else F.col("ordinal"))
        checks = runs.agg(
            F.count("*").alias("n"),
            F.count_if(F.octet_length("event_type") > TYPE_BYTES).alias("types"),
            F.count_if(F.col("payload").isNull() | F.col("event_type").isNull() | F.col("stream_id").isNull()).alias("missing"),
            F.count_if(F.octet_length("metadata") == 0).alias("empty"),
            F.count_if(~F.col("schema_version").between(1, (1 << 32) - 1)).alias("schemas"),
        ).first()
        if not checks.n:
            return None
        if checks.types or checks.missing or checks.empty or checks.schemas:
            raise InvalidEnvelope(str(checks))
        if runs.groupBy("stream_id").agg(F.count_distinct(F.coalesce("expected", F.lit(0))).alias("k")).where("k > 1").limit(1).count():
            raise DuplicateTarget
        folder = uuid.uuid4().hex
        for attempt in range(attempts):
            view = self.view()
            own = view.frame.join(runs.select("stream_id").distinct(), "stream_id", "left_semi")
            refused = append.validate_appends(runs, scan.stream_heads(own)).where("outcome <> 'Accepted'").orderBy("outcome").take(1)
            if refused:
                raise (VersionOverflow if refused[0].outcome == "VersionOverflow" else Conflict)(bytes(refused[0].stream_id))
            placed = append.assign_positions(runs, view.position, ["stream_id", "version"])
            placed.select("position", "stream_id", "version", "event_type", "schema_version", "payload", "metadata").write.mode("overwrite").parquet(
                f"{self.path}/events/{folder}-{attempt}"
            )
            number, last = len(view.commits) + 1, view.position + checks.n
            self._check_positions(f"{self.path}/events/{folder}-{attempt}", view.position, last)
            commit = Commit(number, view.position, last, f"{folder}-{attempt}", uuid.uuid4().hex)
            if self._create(f"commits/{number:012d}", json.dumps(commit.__dict__)):
                return self.history, last
        raise Conflict("too many writers")
