"""Connected components of a graph of links, by stars that shrink in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node that links lead to, of each node with a link to another one.

    Rounds of two steps: each node hands its larger neighbours, then all its smaller ones, to the least of them (a star
    around it), until all are stars. A node with very many links is summed up before the shuffle and joined as a skewed
    key. Links with a null end and loops are left out. No link: no row.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = stored(edges.where(edges[2]).select("u", "v").distinct())
    while not stars(edges):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u")
        edges = stored(smaller.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u != v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", F.col("v").alias("label"))).distinct()


def stars(edges: DataFrame) -> bool:
    """Whether each node u has one v, and no v is a u: then v is the label."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups > 1 or (ups = 1 and downs = 1)").isEmpty()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b), whose components are sought among the labels only."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b", "left")
    joined = stored(components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))))
    known = labels.union(joined.select("node", F.col("node").alias("label"))).distinct()
    return known.join(joined.toDF("label", "least"), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
