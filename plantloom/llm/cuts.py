"""Distributed weighted quantiles of many nodes at once, by narrowing digits of a 60-bit key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGIT, WIDTH = 12, 60


def longs(values: list[int]):
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>")


def weighted_cuts(rows: DataFrame, needs: list[int | None], slack: int) -> list[int]:
    """For each node the key at which the weights of smaller or equal keys sum to its need.

    ``rows`` has ``node`` (0 … len(needs) - 1), ``key`` (0 … 2^60 - 1) and ``weight``. Each pass
    sums the weights by the next 12 bits of the key, for all nodes in one job, and goes on inside
    the digit that holds the cut. A digit of at most ``slack`` weight is not divided: the cut goes
    to its nearer side. Rows with ``key <= cut`` are on the left. A need of None gives the largest
    key, 0 or less gives -1. Only one row per node reaches the driver.
    """
    top = (1 << WIDTH) - 1
    cuts = [top if n is None else -1 for n in needs]
    left = {i: n for i, n in enumerate(needs) if n is not None and n > 0}
    prefix = dict.fromkeys(left, 0)
    shift = WIDTH - DIGIT
    while left:
        at = F.element_at(longs([prefix.get(i, -1) for i in range(len(needs))]), F.col("node") + 1)
        goal = F.element_at(longs([left.get(i, 0) for i in range(len(needs))]), F.col("node") + 1)
        digit = F.shiftright("key", shift).bitwiseAND((1 << DIGIT) - 1)
        sums = (
            rows.where(F.shiftright("key", shift + DIGIT) == at)
            .groupBy("node", digit.alias("digit"))
            .agg(F.sum("weight").alias("w"))
            .withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("digit")))
        )
        last = F.max("upto").over(W.partitionBy("node"))
        hit = (
            sums.withColumn("last", last).withColumn("goal", goal)
            .where((F.col("upto") - F.col("w") < F.col("goal"))
                   & ((F.col("upto") >= F.col("goal")) | (F.col("upto") == F.col("last"))))
            .groupBy("node").agg(F.min(F.struct("digit", "w", "upto")).alias("s"))
            .select("node", "s.*").collect()
        )
        found = {r.node for r in hit}
        for i in [i for i in left if i not in found]:  # a node without rows
            del left[i]
        for r in hit:
            i = r.node
            below = r.upto - r.w
            prefix[i] = prefix[i] << DIGIT | r.digit
            if r.w <= slack or shift == 0:
                with_it = abs(r.upto - left[i]) <= abs(left[i] - below)
                cuts[i] = ((prefix[i] + (1 if with_it else 0)) << shift) - 1
                del left[i]
            else:
                left[i] -= below
        shift -= DIGIT
    return cuts
