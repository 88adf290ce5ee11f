"""Document fingerprints: a Merkle tree over the paragraphs and sections of each text.

A paragraph is a line with its line feed; a longer line is several paragraphs of at most 32 code points. A
section is eight consecutive paragraphs. So small a paragraph still places an edit in a text of one line. A paragraph's node is the SHA-256 of its text, a section's that of
its paragraphs' nodes, and the root, which is the fingerprint, that of the sections' nodes. Equal roots mean
equal texts; where roots differ, differing sections and then paragraphs locate the edit. The likeness of two
trees is Dice's coefficient of their distinct paragraph nodes.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARAGRAPH = "[^\\n]{1,32}\\n?|\\n"
SECTION = 8
FIRST_KEY = -(1 << 63)


def paragraph_nodes(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.transform(found, lambda p: F.sha2(F.concat(F.lit("p:"), p), 256))


def section_nodes(paragraphs: Column) -> Column:
    starts = F.when(F.size(paragraphs) > 0, F.sequence(F.lit(1), F.size(paragraphs), F.lit(SECTION))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.sha2(F.concat(F.lit("s:"), F.array_join(F.slice(paragraphs, i, SECTION), "")), 256))


def root(sections: Column) -> Column:
    return F.sha2(F.concat(F.lit("r:"), F.array_join(sections, "")), 256)


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two lists of nodes; 1 for two empty lists."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / total)


def differing(a: Column, b: Column) -> Column:
    """The places, from 0, at which two lists of nodes differ; places beyond the shorter list differ too."""
    longest = F.greatest(F.size(a), F.size(b))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns (doc_id, fingerprint, sections, paragraphs) for every row; null texts count as empty ones."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("paragraphs", paragraph_nodes(F.col("text")))
    rows = rows.withColumn("sections", section_nodes(F.col("paragraphs")))
    return rows.select("doc_id", root(F.col("sections")).alias("fingerprint"), "sections", "paragraphs")


def _at_most(bounds: list[int], key: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda low, step: F.when(F.get(table, low + step - 1) <= key, low + step).otherwise(low),
    )


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> tuple[DataFrame, Window]:
    """Rows (doc_id, key, text, next_text, bucket, ghost) and the window that they are dealt and sorted by.

    ``next_text`` is the text of the next document by ascending id; after the last one comes the first. Null
    ids sort first; rows with the same id sort by text. The texts are shuffled once, by ranges of the id: the
    ranges' bounds are quantiles of the ids, as many as there are buckets, and the first rows of each range
    are also dealt to the range before it, as ghosts that sort last. Drop the ghosts after use.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST_KEY))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else []
    bounds = sorted(set(found or []))
    bucket = _at_most(bounds, key)
    least = sorted(tuple(r) for r in docs.groupBy(bucket.alias("b")).agg(F.min(key)).collect())
    mins, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, (b, low) in enumerate(least):
        mins[b], before[b] = low, least[i - 1][0]
    first = F.get(F.array(*[F.lit(x).cast("long") for x in mins]), F.col("bucket"))
    other = F.get(F.array(*map(F.lit, before)), F.col("bucket"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))
    ghost = F.struct(other.alias("bucket"), F.lit(1).alias("ghost"))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        key.alias("key"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        bucket.alias("bucket"),
    )
    rows = rows.withColumn("to", F.explode(F.when(F.col("key") == first, F.array(own, ghost)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "key", "text", "to.bucket", "to.ghost")
    order = Window.partitionBy("bucket").orderBy("ghost", "key", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)), order


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and of how alike they are to each other.

    In the edited form the last floor(n / 2) of a text's n code points are replaced by the first as many (or
    all) of the next document's. Returns (doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next). Null texts count as empty. A table of one row has itself as its next document;
    an empty table gives an empty result. Repeated rows stay repeated.
    """
    rows, order = with_next(docs, doc_id, text)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", "key", "text", "bucket", "ghost", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumns({"nodes": paragraph_nodes(F.col("text")), "edited_nodes": paragraph_nodes(F.col("edited"))})
    rows = rows.withColumn("next_nodes", F.lead("nodes").over(order)).where("ghost = 0")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        root(section_nodes(F.col("nodes"))).alias("fingerprint"),
        root(section_nodes(F.col("edited_nodes"))).alias("edited_fingerprint"),
        likeness(F.col("nodes"), F.col("edited_nodes")).alias("near_edited"),
        likeness(F.col("nodes"), F.col("next_nodes")).alias("near_next"),
    )


#: The same rows by DuckDB.
ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as t from documents),
n as (
  select doc_id, t, length(t) as n_chars,
         coalesce(lead(t) over (order by doc_id nulls first, t), first_value(t) over (order by doc_id nulls first, t)) as nx
  from d),
e as (
  select *, left(t, cast(n_chars - n_chars // 2 as bigint)) || left(nx, cast(n_chars // 2 as bigint)) as ed from n),
p as (
  select doc_id, n_chars, ed,
         list_transform(regexp_extract_all(t, '[^\n]{1,32}\n?|\n'), lambda x: sha256('p:' || x)) as a,
         list_transform(regexp_extract_all(ed, '[^\n]{1,32}\n?|\n'), lambda x: sha256('p:' || x)) as b,
         list_transform(regexp_extract_all(nx, '[^\n]{1,32}\n?|\n'), lambda x: sha256('p:' || x)) as c
  from e)
select doc_id, n_chars, sha256(ed) as edited_sha256,
       sha256('r:' || array_to_string(list_transform(range(0, len(a), 8), lambda i: sha256('s:' || array_to_string(a[i+1:i+8], ''))), '')) as fingerprint,
       sha256('r:' || array_to_string(list_transform(range(0, len(b), 8), lambda i: sha256('s:' || array_to_string(b[i+1:i+8], ''))), '')) as edited_fingerprint,
       case when len(a) + len(b) = 0 then 1.0::double
            else 2.0::double * len(list_intersect(a, b)) / (len(list_distinct(a)) + len(list_distinct(b))) end as near_edited,
       case when len(a) + len(c) = 0 then 1.0::double
            else 2.0::double * len(list_intersect(a, c)) / (len(list_distinct(a)) + len(list_distinct(c))) end as near_next
from p
"""
