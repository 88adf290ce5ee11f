"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing.

A fingerprint's bit is set when more than half of the shingles' XXH64 values have it set. Two
fingerprints link when at most two bits differ.

Search. The 64 bits are two segments of 32. Two fingerprints that differ in at most two bits differ in at most
one bit of at least one segment. So the table of each segment holds every distinct fingerprint under its segment's
value, and every fingerprint enumerates the ball of radius one around its own value: the value itself, and the
values with one zero bit set (of two values one bit apart, one has that bit zero, so one direction is enough). What
the tables give is verified on the complete fingerprints.

A value of a segment may belong to any number of fingerprints, as in a large group of near copies. Values of more
than BUCKET fingerprints are not looked up. The fingerprints that have them or would look them up enumerate the
balls of both segments instead, 65 complete fingerprints: if two are at most two bits apart, there is a point
between them that each reaches by changing at most one bit, so they meet in it. All entries of a point are within
two bits of each other, so a link from each to the least one carries every connection; a point has at most 65
entries, and the work is linear in the number of fingerprints, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import connected_components
from tidelog.llm.shared import written

SEED = 42
SEGMENTS, SEGMENT_BITS = 2, 32
#: Fingerprints that a value of a segment may have at most to be looked up.
BUCKET = 64
PIECE = 4 << 20


def _pieces(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece, so that a very long text needs little memory."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[start:end].split()
        start = end
    yield (text[start:] if start else text).split()


def fingerprint(text: str | None, shingle: int = 3, piece: int = PIECE) -> int:
    """The unsigned 64-bit fingerprint of one text; zero if it has no words."""
    total, ones, carry = 0, np.zeros(64, dtype=np.int64), []
    digest = xxhash.xxh64_intdigest
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    for found in _pieces(raw, piece):
        words = carry + found
        if len(words) < shingle:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), dtype="<u8", count=len(words) - shingle + 1)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        carry = words[len(words) - shingle + 1 :] if shingle > 1 else []
    if not total:
        return digest(b" ".join(carry), SEED) if carry else 0
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Returns (doc_id, fp) with a signed 64-bit ``fp`` for every row of ``docs``.

    Null and empty texts have fingerprint zero. Repeated rows stay repeated, other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, fp long")


def _bit(number: int) -> F.Column:
    return F.lit(1 << number if number < 63 else -(1 << 63)).cast("long")


def _segment(number: int, fp: str = "fp") -> F.Column:
    """One segment of a fingerprint, as a number."""
    return F.shiftrightunsigned(fp, number * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long"))


def segment_table(distinct: DataFrame) -> DataFrame:
    """(segment, value, fp): every fingerprint under the value of each of its segments."""
    entries = F.array(*(F.struct(F.lit(s).alias("segment"), _segment(s).alias("value")) for s in range(SEGMENTS)))
    return distinct.select(F.explode(entries).alias("e"), "fp").select("e.segment", "e.value", "fp")


def segment_balls(table: DataFrame) -> DataFrame:
    """(segment, value, fp): the points of the radius-one ball around each segment's value that no smaller value has in its own."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k))
    zeros = F.filter(steps, lambda b: F.col("value").bitwiseAND(b) == 0)
    points = F.concat(F.array("value"), F.transform(zeros, lambda b: F.col("value").bitwiseOR(b)))
    return table.select("segment", F.explode(points).alias("value"), "fp")


def ball_points(fp: str = "fp") -> F.Column:
    """The complete fingerprints of the radius-one balls in all segments, the fingerprint itself included once."""
    return F.array(F.col(fp), *(F.col(fp).bitwiseXOR(_bit(k)) for k in range(SEGMENTS * SEGMENT_BITS)))


def links_by_points(distinct: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints to the least one that has a point of their complete balls in common."""
    points = distinct.select("fp", F.explode(ball_points()).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    return points.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")


def near_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) which differ in at most two bits."""
    table = segment_table(distinct)
    counts = table.groupBy("segment", "value").agg(F.count("*").alias("n"))
    crowded = written(counts.where(F.col("n") > bucket).select("segment", "value"), "crowded")
    balls = segment_balls(table)
    if crowded.limit(1).count():
        some = balls.join(crowded, ["segment", "value"], "left_semi").select("fp")
        some = some.union(table.join(crowded, ["segment", "value"], "left_semi").select("fp")).distinct()
        among = links_by_points(written(some, "crowded-fingerprints"))
        balls, table = (x.join(crowded, ["segment", "value"], "left_anti") for x in (balls, table))
    else:
        among = None
    found = balls.join(table.select("segment", "value", F.col("fp").alias("b")), ["segment", "value"]).where("fp <> b")
    found = found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= 2).select(F.col("fp").alias("a"), "b")
    return found if among is None else found.union(among)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row a document: (doc_id, fp, component_id).

    ``component_id`` is the least document id reachable over links of at most two bits, the document's own
    included. Documents with equal fingerprints are one entry of the search, so a group of copies of any
    size costs no more than one document. Links are between fingerprints, so they also lead through documents
    without an id; a document without an id has a null component unless one with an id can be reached.
    Very long texts are hashed piece by piece. Other columns are dropped. Empty tables give empty results.
    """
    fps = written(fingerprints(docs, doc_id, text, shingle), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    roots = connected_components(near_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    linked = roots.join(distinct, "fp")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    classes = linked.join(least, "component").select("fp", "least")
    merged = distinct.join(classes, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return fps.join(merged, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
