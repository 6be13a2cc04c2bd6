"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm._work import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one orderable type).

    The component is its smallest node. Each step replaces the edges of a node by
    edges to its smallest neighbour; the tables shrink to stars in O(log^2 n)
    rounds, as many as it takes. A node's smallest neighbour comes from an aggregate and
    a join, which Spark splits where one node has very many links. Edges live in
    shared Parquet between rounds, never on the driver. Null ends and self-loops are ignored; an empty table gives no rows.
    """

    def tidy(df: DataFrame) -> DataFrame:
        hi, lo = F.greatest("a", "b"), F.least("a", "b")
        return df.select(hi.alias("a"), lo.alias("b")).where("a <> b").distinct()

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def least(df: DataFrame) -> DataFrame:
        """``df`` with each a's smallest b as m."""
        return df.join(df.groupBy("a").agg(F.min("b").alias("m")), "a")

    current = materialize(tidy(edges.select("a", "b").dropna()), "edges")
    before = state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialize(large.distinct(), "edges")  # a > b: m is smaller than every neighbour, or a itself is
        small = least(large)
        small = small.select(F.col("a"), F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        current = materialize(small.distinct(), "edges")
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
