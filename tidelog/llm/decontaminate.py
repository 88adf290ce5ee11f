"""Benchmark decontamination with a positional inverted index over the training texts.

The index is sharded by document: each task writes the postings (document, term, position) of the texts it
reads, for all terms that occur in a benchmark item, so building it needs no shuffle. It is a Parquet table
in the shared folder. A search counts the postings of each term, picks the two rarest terms of every window
of an item, and takes their postings only. Shifted by the terms' places in the item, postings of one
alignment of an item with a document share the same offset; offsets at which two rare terms of the item
meet are candidates. They are verified against the postings of all the item's terms: a phrase occurs where
enough consecutive words of the item are found at consecutive positions.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.shared import written

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows up to which a side of a join is sent to all executors; beyond it, both sides are shuffled.
BROADCAST_ROWS = 200_000


def words(text: str) -> Column:
    """The words of a text with A-Z lower-cased; none for null."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)
    low = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, WORD_BREAK, -1), "")


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast ``df`` if it has at most ``bound`` rows; ``df`` as it is if it has more."""
    return F.broadcast(df) if df.count() <= bound else df


@dataclass
class Items:
    """Benchmark items by distinct word sequence, and the terms they use."""

    sequences: DataFrame  # seq, n, item_ids
    places: DataFrame  # seq, n, item_pos, term_id
    terms: DataFrame  # term, term_id; id 0 is the mark at the end of a document


def benchmark_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Items:
    """Items with equal word sequences are searched once; items without words are left out."""
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("string").alias("item_id"), words(text).alias("words")).where("size(words) > 0")
    grouped = rows.groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    sequences = written(grouped.withColumn("seq", F.monotonically_increasing_id()), "items")
    used = sequences.select(F.explode("words").alias("term")).distinct()
    mark = spark.createDataFrame([("", 0)], "term string, term_id long")
    terms = written(used.withColumn("term_id", F.monotonically_increasing_id() + 1).unionByName(mark), "terms")
    places = sequences.select("seq", F.size("words").alias("n"), F.posexplode("words").alias("item_pos", "term"))
    places = written(places.join(small(terms), "term").select("seq", "n", "item_pos", "term_id"), "places")
    return Items(sequences.select("seq", F.size("words").alias("n"), "item_ids"), places, terms)


def positional_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (row, doc_id, term_id, pos) of all rows of ``docs`` for the given terms.

    ``row`` tells rows apart, also those that share an id. Term 0 closes every row: its position is the
    row's number of words, and it alone carries the document's id.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.array_append(words(text), "").alias("words"),
    )
    tokens = rows.select("row", "doc_id", F.posexplode("words").alias("pos", "term"))
    found = tokens.join(small(terms), "term")
    return written(
        found.select("row", F.when(F.col("term_id") == 0, F.col("doc_id")).alias("doc_id"), "term_id", "pos"), "postings"
    )


def rare_places(index: DataFrame, items: Items, window: int = WINDOW) -> DataFrame:
    """Places (seq, n, item_pos, term_id) of the two rarest terms of every window of every item."""
    counts = index.where("term_id > 0").groupBy("term_id").count()
    known = items.places.join(counts, "term_id", "left").withColumn("rarity", F.struct(F.coalesce("count", F.lit(0)), "item_pos"))
    ahead = Window.partitionBy("seq").orderBy("item_pos").rowsBetween(0, window - 1)
    picked = (
        known.withColumn("ahead", F.sort_array(F.collect_list("rarity").over(ahead)))
        .where(F.size("ahead") == F.least(F.lit(window), F.col("n")))
        .select("seq", F.explode(F.slice("ahead", 1, 2)).alias("rarity"))
        .select("seq", F.col("rarity.item_pos").alias("item_pos"))
        .distinct()
    )
    return items.places.join(picked, ["seq", "item_pos"])


def rare_postings(index: DataFrame, rare: DataFrame) -> DataFrame:
    """Postings of rare terms with the offset (shift) of the item that they stand for."""
    return (
        index.where("term_id > 0")
        .join(small(rare), "term_id")
        .select("row", "seq", "n", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"))
    )


def phrase_matches(index: DataFrame, items: Items, window: int = WINDOW) -> DataFrame:
    """Maximal exact matches (row, seq, first, after): document words first..after-1 occur in the item.

    A match has at least ``window`` words, or all words of a shorter item.
    """
    rare = written(rare_places(index, items, window), "rare")
    meets = rare_postings(index, rare).groupBy("row", "seq", "n", "shift").agg(F.min("item_pos").alias("p"), F.max("item_pos").alias("q"))
    candidates = written(meets.where("p < q or n = 1").select("row", "seq", "n", "shift"), "candidates")
    wanted = candidates.join(small(items.places.select("seq", "item_pos", "term_id")), "seq").select(
        "row", "seq", "n", "shift", "item_pos", "term_id", (F.col("shift") + F.col("item_pos")).alias("pos")
    )
    near = candidates.select("row").distinct()
    there = index.where("term_id > 0").join(small(near), "row", "left_semi").select("row", "term_id", "pos")
    found = wanted.join(there, ["row", "pos", "term_id"])
    along = Window.partitionBy("row", "seq", "shift").orderBy("item_pos")
    runs = (
        found.withColumn("run", F.col("item_pos") - F.row_number().over(along))
        .groupBy("row", "seq", "n", "shift", "run")
        .agg(F.min("pos").alias("first"), F.count("*").alias("size"))
        .where(F.col("size") >= F.least(F.lit(window), F.col("n")))
    )
    return runs.select("row", "seq", "first", (F.col("first") + F.col("size")).alias("after"))


def proximity_matches(index: DataFrame, items: Items, slop: int = 3, window: int = WINDOW) -> DataFrame:
    """Near matches (doc_id, item_id, first, last, moved): two neighbouring rare terms of an item that stand
    in a document at most ``slop`` words closer together or farther apart than in the item."""
    rare = written(rare_places(index, items, window), "rare")
    order = Window.partitionBy("row", "seq").orderBy(F.col("shift") + F.col("item_pos"), "item_pos")
    posts = rare_postings(index, rare).withColumn("pos", F.col("shift") + F.col("item_pos"))
    paired = posts.select(
        "row", "seq", "pos", "item_pos", "shift", F.lag("pos").over(order).alias("first"),
        F.lag("shift").over(order).alias("was"), F.lag("item_pos").over(order).alias("before"),
    ).where(F.col("before") < F.col("item_pos")).where(F.abs(F.col("shift") - F.col("was")) <= slop)
    named = paired.join(items.sequences, "seq").join(index.where("term_id = 0").select("row", "doc_id"), "row")
    return named.select(
        "doc_id", F.explode("item_ids").alias("item_id"), "first", F.col("pos").alias("last"), (F.col("shift") - F.col("was")).alias("moved")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_words, n_hit, item_ids).

    ``n_hit`` counts the words that lie inside an occurrence of any window of ``window`` consecutive words of
    an item (of all its words, if it has fewer); ``item_ids`` are the ids of those items as strings, sorted.
    Null texts have no words. Repeated rows, and rows that share an id, are kept apart. A null item id hits
    but is not listed. Without items, or without documents, nothing is hit.
    """
    items = benchmark_items(benchmark, item_id, item_text)
    index = positional_index(docs, items.terms, doc_id, text)
    matches = written(phrase_matches(index, items, window), "matches")
    before = Window.partitionBy("row").orderBy("first", "after").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        matches.select("row", "first", "after")
        .distinct()
        .withColumn("reached", F.max("after").over(before))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.lit(0), F.col("after") - F.greatest("first", F.coalesce("reached", "first")))).alias("n_hit"))
    )
    hit = matches.select("row", "seq").distinct().join(items.sequences.select("seq", "item_ids"), "seq")
    listed = hit.select("row", F.explode("item_ids").alias("item_id")).groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = index.where("term_id = 0").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return (
        rows.join(covered, "row", "left")
        .join(listed, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(F.col("n_hit").cast("long"), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )


#: The rows of the registered query by DuckDB.
ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from documents),
b as (
  select cast(item_id as varchar) as item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from benchmark),
windows as (
  select distinct item_id, unnest(list_transform(range(0, greatest(len(w) - 10, 0) + 1), lambda i: w[i + 1 : i + 10])) as win from b where len(w) > 0),
sizes as (select distinct len(win) as n from windows),
places as (
  select r, n, i, w[i + 1 : i + n] as win
  from (select r, w, n, unnest(range(0, len(w) - n + 1)) as i from d, sizes where len(w) >= n)),
hits as (select r, i, n, item_id from places join windows using (win)),
words as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) as pos from hits) group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""
