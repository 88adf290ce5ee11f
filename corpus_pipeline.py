"""A corpus pipeline of five stages, each over all documents that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, langid, nearcopies, pii, simhash
from tidelog.llm.components import connected_components
from tidelog.llm.shared import read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents are rejected whose language is unknown or less sure than this.
LEAST_SCORE = 0.5
PSEUDONYM_KEY = "tidelog demonstration key"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: What tells documents apart, also those that share an id or have none. Rows equal in id and text share its hash.
KEY = ("doc_id", "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled documents of this stage's input teach.

    Without any labelled document nothing can be learned, and only texts without letters go.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, model, keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.NO_LANGUAGE) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the least id, one without an id last.

    Groups are those of the SimHash contract, fingerprints of three-word shingles that link at two bits, joined
    where texts have a Jaccard similarity of 0.8 or more over shingles of five words.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*KEY).alias("key"))
    near = written(simhash.near_duplicates(rows, doc_id="key").select(F.col("doc_id").alias("key"), "component_id"), "near")
    links = near.select(F.col("key").alias("a"), F.col("component_id").alias("b")).where("a <> b")
    roots = connected_components(links.union(nearcopies.similar_links(rows, links))).withColumnRenamed("node", "key")
    groups = written(near.join(roots, "key", "left").select("key", F.coalesce("component", "key").alias("component_id")), "groups")
    once = groups.groupBy("key").agg(F.first("component_id").alias("component_id"), F.count("*").alias("copies"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("rank")
    first = once.join(rows.select("key", "doc_id"), "key").groupBy("component_id").agg(F.min(rank).alias("rank"))
    dropped = written(once.join(first, "component_id").where("key <> rank.key").select("key"), "dropped")
    kept = rows.join(decontaminate.small(dropped), "key", "left_anti")
    if once.where("copies > 1").limit(1).count():  # rows that are equal in id and text
        kept = kept.dropDuplicates(["key"])
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that share no ten consecutive words, and no whole shorter item, with the benchmark."""
    rows = docs.select(*COLUMNS, F.xxhash64(*KEY).alias("key"))
    found = decontaminate.contamination(rows, read_table(spark, sf_dir, "benchmark"), doc_id="key")
    hit = written(found.where("n_hit > 0").select(F.col("doc_id").alias("key")).distinct(), "hit")
    return rows.join(decontaminate.small(hit), "key", "left_anti").select(*COLUMNS)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; the number of characters follows the new text."""
    changed = pii.pseudonymize(docs.select(*COLUMNS), PSEUDONYM_KEY)
    return changed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that is left, with the text that they decode to."""
    coded = bpe.encode(docs, TOKENIZER, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", pseudonymize),
    ("BPE encoding and decoding", encode_and_decode),
]

#: SQL has neither the language network nor XXH64 fingerprints; the tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i + 1}")
    return docs
