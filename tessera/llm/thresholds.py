"""Nested budget thresholds on a hash, found from histograms instead of a sort.

Every item has a 24-bit hash bucket. Weights are summed by group and the upper 12 bits; only the bucket in which a
budget ends is refined by the lower 12 bits. Each window below runs over at most 4,096 pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

HALF = 4096
BUCKETS = HALF * HALF
MOST_BUDGETS = 100_000  # that may be broadcast


def bucket_of(key: Column, seed: int = 0) -> Column:
    """24-bit hash bucket of a key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(BUCKETS)).cast("int")


def nested_cuts(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """Cuts (grp, k, cut): items of the group with bucket < cut weigh as nearly the budget as the hash allows.

    ``items(grp, bucket, weight)``; ``budgets(grp, k, budget)``, several nested budgets ``k`` a group. A budget of
    0 or less gives cut 0; one of the whole group's weight or more gives ``BUCKETS``.
    """
    few = budgets.limit(MOST_BUDGETS + 1).count() <= MOST_BUDGETS  # then so are the buckets in which they end
    hint = F.broadcast if few else lambda d: d
    coarse = items.groupBy("grp", F.floor(F.col("bucket") / HALF).cast("int").alias("hi")).agg(F.sum("weight").alias("w"))
    w = W.partitionBy("grp").orderBy("hi")
    coarse = coarse.withColumn("upto", F.sum("w").over(w)).withColumn("before", F.col("upto") - F.col("w"))
    at = coarse.join(hint(budgets), "grp").filter((F.col("before") < F.col("budget")) & (F.col("budget") <= F.col("upto"))).select("grp", "k", "hi", "before", "budget")
    fine = items.withColumn("hi", F.floor(F.col("bucket") / HALF).cast("int")).join(hint(at), ["grp", "hi"]).groupBy("grp", "k", "bucket", "before", "budget").agg(F.sum("weight").alias("w"))
    w = W.partitionBy("grp", "k").orderBy("bucket")
    fine = fine.withColumn("upto", F.col("before") + F.sum("w").over(w))
    steps = fine.select("grp", "k", (F.col("bucket") + 1).alias("cut"), F.abs(F.col("upto") - F.col("budget")).alias("off")).unionByName(
        fine.select("grp", "k", F.col("bucket").alias("cut"), F.abs(F.col("upto") - F.col("w") - F.col("budget")).alias("off"))
    )
    found = steps.groupBy("grp", "k").agg(F.min_by("cut", F.struct("off", "cut")).alias("cut"))
    return budgets.join(found, ["grp", "k"], "left").select("grp", "k", F.when(F.col("budget") <= 0, 0).otherwise(F.coalesce("cut", F.lit(BUCKETS))).cast("int").alias("cut"))
