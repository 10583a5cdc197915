"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import saved


def _least(pairs: DataFrame) -> DataFrame:
    """The pairs with the least node around each u, u included. Sums are combined before they are dealt out; a node of
    very many pairs is a skewed side of a join, which Spark splits."""
    least = pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component: its least node) of the nodes of edges (u, v); longs. Loops and repeated edges are
    harmless; each round is a table in the shared folder, so that lineage stays short."""
    edges = saved(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        small = _least(down)
        star = small.select("v", "m").union(small.select(F.col("u").alias("v"), "m")).toDF("u", "v")
        edges = saved(star.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = now
    raise RuntimeError("the components didn't settle")
