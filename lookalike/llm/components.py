"""Connected components of a table of links, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), "m")
    return tied.union(least).distinct().select("a", F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), the component
    being its smallest node and left out of the rows itself.

    Large and small stars in turn until the links stay as they are. A round is
    stored in the shared folder; only two numbers reach the driver. Groupings
    combine before their shuffle, and a node with very many links is a skewed
    join key, which Spark splits. Links of a node to itself, repeated links
    and nulls are ignored; an empty table gives an empty one.
    """
    links = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    while True:
        mark = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == seen or not mark[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        links = cut_lineage(_small_star(_large_star(links)))
