"""Registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat, decontaminate, langid, lm, merkle, passages, pii, quality, simhash
from tidelog.llm.shared import read_table

#: The key of the registered query's pseudonyms. A real corpus takes its key from a secret store.
PSEUDONYM_KEY = "tidelog demonstration key"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    coded = bpe.encode(read_table(spark, sf_dir, "documents"), WORD_BPE, decoded=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it is kept."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every speaker's perspective; the mask as start-end pairs."""
    found = chat.rotations(read_table(spark, sf_dir, "conversations"))
    pairs = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return found.withColumn("mask", pairs)


def op8_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them."""
    return lm.pseudo_likelihoods(read_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a network that saw none of the held-out ones."""
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data pseudonymized, and how much of it there was."""
    found = pii.pseudonymize(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("pii").alias("n_found"), F.array_join(F.transform("pii", lambda x: x["kind"]), ",").alias("kinds"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that other documents share; the spans as first-after pairs of words."""
    found = passages.shared_passages(read_table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["after"])), ","))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited form, with likenesses."""
    found = merkle.edited_fingerprints(read_table(spark, sf_dir, "documents"))
    return found.withColumn("edited", F.sha2("edited", 256)).withColumnRenamed("edited", "edited_sha256")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is taken from benchmark items, and from how many."""
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_chat": op4_chat,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_passages": op7_passages,
    "op8_likelihood": op8_likelihood,
    "op9_merkle": op9_merkle,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE_SQL = {"op4_chat": chat.ORACLE, "op9_merkle": merkle.ORACLE, "op10_decontaminate": decontaminate.ORACLE}
