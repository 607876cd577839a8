"""Connected components of an edge table by rounds of label exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the ends of ``a, b``; ``root`` is the smallest node of the component.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node
    near it (large star, small star), so paths shorten geometrically. A round is written to the
    shared folder; the loop ends when a round changes nothing.
    """
    now = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = stored(now, "edges"), None
    while True:
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("a", "b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        now = stored(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return roots.withColumnRenamed("a", "node").union(
        roots.select(F.col("root").alias("node"), "root").distinct())
