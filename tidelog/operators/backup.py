"""Export of a log into checked chunks, and their decoding for import, as Spark jobs.

A stream's events are cut into parts by version, so that a chunk has a bounded size however long its stream
is; each part is encoded by the task that holds it. Chunks are rows of a table and can be written as any
Spark table. Decoding turns chunks back into blocks, which :mod:`tidelog.operators.restore` plans and checks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import chunk

PART = 10_000


def export_chunks(log: DataFrame, origin: bytes | None = None, part: int = PART) -> DataFrame:
    """(stream_id, part, chunk): complete chunks of at most ``part`` events each, in version order."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("version")
        blocks = [
            chunk.block(int(r.version), int(r.schema_version), r.event_type, bytes(r.payload), None if r.metadata is None else bytes(r.metadata))
            for r in rows.itertuples()
        ]
        stream = bytes(rows["stream_id"].iloc[0])
        return pd.DataFrame({"stream_id": [stream], "part": [rows["part"].iloc[0]], "chunk": [chunk.pack(iter([(stream, blocks)]), origin)]})

    rows = log.select("stream_id", "version", "schema_version", "event_type", "payload", "metadata").withColumn("part", F.floor((F.col("version") - 1) / part))
    return rows.groupBy("stream_id", "part").applyInPandas(pack, "stream_id binary, part long, chunk binary")


def decode_chunks(chunks: DataFrame, salvage: bool = False) -> DataFrame:
    """One row for each block: (section, part, block, version, schema_version, event_type, metadata, payload, corrupt).

    Without ``salvage`` an incomplete or damaged chunk fails the job. With it, torn items are left out and
    damaged blocks are marked corrupt.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part, data in zip(batch["part"], batch["chunk"]):
                for stream, events in (chunk.salvage if salvage else chunk.strict)(bytes(data)).sections:
                    for i, e in enumerate(events):
                        version, schema, event_type, metadata, payload = e or (None,) * 5
                        out.append((stream, part, i, version, schema, event_type, metadata, payload, e is None))
            columns = ["section", "part", "block", "version", "schema_version", "event_type", "metadata", "payload", "corrupt"]
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"version": "Int64", "schema_version": "Int64"})

    schema = "section binary, part long, block long, version long, schema_version long, event_type string, metadata binary, payload binary, corrupt boolean"
    return chunks.select("part", "chunk").mapInPandas(unpack, schema)
