"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.support import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of every node on the smallest of them.

    The minimum is an aggregation with partial sums and the neighbours meet it in a join, so a
    node with a large part of all edges is split like any skewed join.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            least.select("u", F.col("least").alias("v"))
        )
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``u, v`` edges; the component is its smallest node.

    Each round is written to the shared folder, so lineage stays short; rounds are logarithmic
    in the number of nodes and end when a round changes nothing.
    """
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = materialize(_stars(_stars(edges, large=True), large=False), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
