"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import checkpointed


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Returns (node, component) for every node of ``links``; component is its least reachable node.

    ``links`` has two integer columns. Repeated links, either direction and self links are fine; nodes
    without a link to another node, and links with a null end, do not appear in the result. An empty
    table gives an empty result.

    Each step keeps a table of links only, aggregates them before the shuffle, and joins them to one row
    a node, so the hub of a large component is a skewed join key that the adaptive plan splits, and
    never a group gathered into one task. Lineage is cut by a checkpoint in the shared folder.
    """
    links = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
        if {a, b} != {"u", "v"}
        else links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    links = checkpointed(links)
    before = _mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least_neighbour(large)
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        links = checkpointed(small)
        after = _mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
