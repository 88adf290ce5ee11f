"""Near copies by the Jaccard similarity of five-word shingles, found by bands of min-hashes and verified.

Texts with equal shingle sets are one entry of the search. Two sets of similarity 0.8 agree in one of the BANDS
bands of ROWS min-hashes with a probability of 0.9998. Each set first meets the least set of its bucket, or at most
PIVOTS sets of a bucket of more than PAIRED, which connects most of a group of near copies, of any size, without
pairing it with itself. Then all pairs of a bucket meet that are in different components, so no bucket hides a link
between two components; in a large one every set outside the largest component meets all sets of other components.
Pairs that their sizes and some bits of their shingles rule out for certain are left out, at first by BITS bits, then
by SKETCH bits for each shingle; every link is verified on the complete sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import connected_components
from tidelog.llm.decontaminate import small
from tidelog.llm.passages import shingles, word_hashes
from tidelog.llm.shared import dropped, written

SIMILARITY = 0.8
BANDS, ROWS = 12, 3
PAIRED = 16
#: Sets of a large bucket that all its sets meet first, and bits that tell of a set's shingles.
PIVOTS, BITS = 16, 512
#: Bits for each shingle, at least, by which pairs are ruled out before their sets are compared.
SKETCH = 8
#: Sets of a large bucket that one task compares with the whole bucket.
BLOCK = 1024
_FACTORS = np.random.default_rng(23).integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The different five-word shingles of a text, in order; none for fewer than five words."""
    return np.unique(shingles(word_hashes(text)))


def bands(values: np.ndarray) -> np.ndarray:
    """One hash for each band of min-hashes of a set that is not empty."""
    least = np.array([(values * f).min() for f in _FACTORS], dtype=np.uint64).reshape(BANDS, ROWS)
    out = np.zeros(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def signatures(rows: DataFrame) -> DataFrame:
    """(key, whole, size, bits, bands) of each row (key, text) with a shingle; ``whole`` is a hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, whole, sizes, bits, found = [], [], [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                values = shingle_set(text.as_py())
                if len(values):
                    keys.append(key.as_py())
                    sizes.append(len(values))
                    seen = np.zeros(BITS, dtype=bool)
                    seen[values >> np.uint64(20) & np.uint64(BITS - 1)] = True
                    bits.append(np.packbits(seen).view(np.int64))
                    mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    whole.append(int((mixed ^ (mixed >> np.uint64(29))).sum(dtype=np.uint64).view(np.int64)))
                    found.append(bands(values).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(whole, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))],
                ["key", "whole", "size", "bits", "bands"],
            )

    return rows.select("key", "text").mapInArrow(run, "key long, whole long, size long, bits array<long>, bands array<long>")


def buckets(sets: DataFrame) -> DataFrame:
    """(key, size, bits, band, value, n): the buckets that sets (key, size, bits, bands) share, and how many sets they have."""
    entries = sets.select("key", F.posexplode("bands").alias("band", "value"))
    sizes = entries.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    return entries.join(sizes, ["band", "value"]).join(sets.select("key", "size", "bits"), "key")


def may_be_similar(similarity: float = SIMILARITY) -> Column:
    """False only if the sets (size, bits) and (other_size, other_bits) are not similar: a bit of one alone is a shingle of one alone."""
    alone = lambda x, y: sum((F.bit_count(F.col(x)[k].bitwiseAND(F.bitwise_not(F.col(y)[k]))) for k in range(BITS // 64)), F.lit(0))
    common = F.least(F.col("size") - alone("bits", "other_bits"), F.col("other_size") - alone("other_bits", "bits"))
    return common >= similarity / (1 + similarity) * (F.col("size") + F.col("other_size")) - 1e-6


def _others(entries: DataFrame, *more: str) -> DataFrame:
    return entries.select("band", "value", *more, *(F.col(x).alias(f"other_{x}") for x in ("key", "size", "bits")))


def _pairs(met: DataFrame) -> DataFrame:
    return met.where(may_be_similar()).select(F.least("key", "other_key").alias("a"), F.greatest("key", "other_key").alias("b"))


def candidates(shared: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b), a < b: the sets of every bucket with its least set, and those of the large ones with its pivots."""
    cell = F.when(F.col("n") > paired, F.pmod(F.xxhash64("key"), F.lit(PIVOTS))).otherwise(0).alias("cell")
    pivots = shared.groupBy("band", "value", cell).agg(F.min(F.struct("key", "size", "bits")).alias("p")).select("band", "value", "p.*")
    return _pairs(shared.join(_others(pivots), ["band", "value"]).where("key <> other_key")).distinct()


def crossing(shared: DataFrame, links: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b), a < b: all pairs of a bucket that ``links`` (a, b) do not connect and that may be similar.

    The sets outside the largest component of a large bucket are dealt to blocks, each of which meets the whole bucket.
    """
    roots = connected_components(links).withColumnRenamed("node", "key")
    known = written(shared.join(roots, "key", "left").withColumn("component", F.coalesce("component", "key")), "known-buckets")
    parts = known.groupBy("band", "value", "component").agg(F.count("*").alias("m"))
    largest = parts.groupBy("band", "value").agg(F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("k")).where("k > 1")
    mixed = known.join(largest.select("band", "value", F.col("most.component").alias("largest")), ["band", "value"])
    mixed = written(mixed.withColumn("other_component", F.col("component")), "mixed-buckets")
    few = mixed.where(F.col("n") <= paired)
    few = few.drop("other_component").join(_others(few, "other_component"), ["band", "value"]).where("component <> other_component and key < other_key")
    many = mixed.where(F.col("n") > paired)
    blocks = F.expr(f"cast(n div {BLOCK} + 1 as int)")
    strays = many.drop("other_component").where("component <> largest").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    others = many.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = strays.join(_others(others, "block", "other_component"), ["band", "value", "block"])
    met = met.where("component <> other_component and (other_component = largest or key < other_key)")
    return _pairs(few).union(_pairs(met)).distinct()


def sketch(values: np.ndarray) -> np.ndarray:
    """A bit for every shingle of a set, in a power of two of at least SKETCH times as many bits and at least BITS."""
    size = 1 << max(BITS.bit_length() - 1, (SKETCH * len(values) - 1).bit_length())
    seen = np.zeros(size, dtype=bool)
    seen[values >> np.uint64(20) & np.uint64(size - 1)] = True
    return np.packbits(seen, bitorder="little").view(np.uint64)


def sketches_alike(x: np.ndarray, n: int, y: np.ndarray, m: int, similarity: float = SIMILARITY) -> bool:
    """False only if the sets of n and m shingles with these sketches are not similar; the larger sketch is folded to the smaller one."""
    least = min(len(x), len(y))
    x, y = (z if len(z) == least else np.bitwise_or.reduce(z.reshape(-1, least)) for z in (x, y))
    common = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return common >= similarity / (1 + similarity) * (n + m) - 1e-6


def hashed(rows: DataFrame) -> DataFrame:
    """(key, values, size, sketch) with the ordered shingle set of each row (key, text), eight bytes for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingle_set(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([f(v) for v in values], t) for f, t in ((np.ndarray.tobytes, pa.binary()), (len, pa.int64()), (lambda v: sketch(v).tobytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "values", "size", "sketch"])

    return rows.select("key", "text").mapInArrow(run, "key long, values binary, size long, sketch binary")


def may_match(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, size, sketch, other_size, other_sketch) that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(k).to_pylist() for k in (2, 4)]
            bits = [[np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in batch.column(k)] for k in (3, 5)]
            keep = [sketches_alike(x, n, y, m) for n, x, m, y in zip(sizes[0], bits[0], sizes[1], bits[1])]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "size", "sketch", "other_size", "other_sketch").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of the pairs (a, b, values, other_values) whose shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate((one, two))
                both.sort(kind="stable")  # merges the two runs
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(common >= similarity * (len(both) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "values", "other_values").mapInArrow(run, "a long, b long")


def _with(pairs: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    other = texts.select(F.col("key").alias("b"), *(F.col(x).alias(f"other_{x}") for x in columns))
    return pairs.join(other, "b").join(texts.select(F.col("key").alias("a"), *columns), "a")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def tested(rows: DataFrame, pairs: DataFrame, repeated: bool = True) -> DataFrame:
    """The pairs (a, b) of keys of rows (key, text) whose texts are similar; keys may be ``repeated``."""
    pairs = written(pairs, "near-pairs")
    used = written(_ends(pairs), "near-used")
    texts = hashed(rows.select("key", "text").join(small(used), "key", "left_semi"))
    texts = written(texts.dropDuplicates(["key"]) if repeated else texts, "near-shingles")
    left = written(may_match(_with(pairs, texts, "size", "sketch")), "near-left")
    needed = written(_ends(left), "near-needed")
    links = written(verified(_with(left, texts.join(small(needed), "key", "left_semi"), "values")), "near-links")
    dropped(pairs, used, texts, left, needed)
    return links


def similar_links(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between the keys of rows (key, text) that connect all near copies which have a band in common.

    Pairs that ``known`` links (a, b) connect need no link.
    """
    found = written(signatures(rows), "signatures")
    sets = found.groupBy("whole").agg(F.min("key").alias("key"), *(F.first(x).alias(x) for x in ("size", "bits", "bands")))
    sets = written(sets, "sets")
    repeated = bool(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
    shared = written(buckets(sets), "shared-bands")
    same = found.select("key", "whole").join(sets.select("whole", F.col("key").alias("a")), "whole").where("a <> key")
    same = written(same.select("a", F.col("key").alias("b")), "same")
    links = tested(rows, candidates(shared), repeated)
    linked = links.union(same) if known is None else links.union(same).union(known.select("a", "b"))
    rest = tested(rows, crossing(shared, linked), repeated)
    return links.union(rest).union(same)
