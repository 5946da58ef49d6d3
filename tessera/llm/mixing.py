"""Mixing of sources to target weights (problem 7).

Method: hash-threshold histograms. Token counts are summed by source and hash bucket; the bucket in which a source's
budget ends is refined, and rows are kept by comparing their hash with the cut, without a sort.

The budget: each source may give at most its stock times ``max_repeats``. Without ``total_tokens`` the total is the
largest at which every listed source that has stock still meets its share; with it, sources that run out give what
they can and the others divide the rest by weight. A source that isn't listed, or has no tokens, gives nothing.
Whole passes over a source count for all its rows, the last partial pass for rows below the cut.
Null and empty texts have no tokens and are never selected. An empty table gives an empty selection.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import fitting, materialize
from .bpe import count_tokens
from .thresholds import bucket_of, nested_cuts

SEED = 7
MOST_SOURCES = 100_000  # rows of a table of sources that may be broadcast


def budgets(stock: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to take of each source."""
    room = {s: stock[s] * r for s, (w, r) in targets.items() if stock.get(s, 0) > 0 and w > 0 and r > 0}
    if not room:
        return {}
    if total is None:
        total = min(room[s] / targets[s][0] for s in room) * sum(targets[s][0] for s in room)
    out, open_, rest = {}, set(room), float(total)
    while open_:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if room[s] <= rest * targets[s][0] / weight * (1 + 1e-12)}
        if not full:
            return out | {s: rest * targets[s][0] / weight for s in open_}
        out |= {s: float(room[s]) for s in full}
        rest -= sum(room[s] for s in full)
        open_ -= full
    return out


def sized(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", path: str | None = None) -> DataFrame:
    """Token counts (key, source, n_tokens), written once to the shared folder."""
    return materialize(count_tokens(documents, [key, source], text, path), "sizes")


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Selected rows (key, source, n_tokens, copies), copies >= 1.

    ``targets(source, target_share, max_repeats)`` is one small row a source.
    """
    spark = sizes.sparkSession
    want = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.filter("source is not null and target_share is not null and max_repeats is not null").collect()}
    listed = sizes.join(fitting(targets.select("source").distinct(), MOST_SOURCES), "source").filter("n_tokens > 0")
    stock = {r.source: r.t for r in listed.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    plan = []
    for s, b in budgets(stock, want, total_tokens).items():
        passes = min(math.floor(b / stock[s] + 1e-9), want[s][1])
        plan.append((s, passes, b - passes * stock[s] if passes < want[s][1] else 0.0))
    plan_df = fitting(spark.createDataFrame(plan, "source string, passes int, rest double"), MOST_SOURCES)
    items = listed.join(plan_df, "source").withColumn("bucket", bucket_of(F.col(key), seed))
    cuts = nested_cuts(items.select(F.col("source").alias("grp"), "bucket", F.col("n_tokens").cast("double").alias("weight")), plan_df.select(F.col("source").alias("grp"), F.lit(0).alias("k"), F.col("rest").alias("budget")))
    cuts = cuts.select(F.col("grp").alias("source"), "cut")
    return items.join(F.broadcast(cuts) if len(plan) <= MOST_SOURCES else cuts, "source").withColumn("copies", F.col("passes") + (F.col("bucket") < F.col("cut")).cast("int")).filter("copies > 0").select(key, "source", "n_tokens", "copies")


def mix_report(sizes: DataFrame, selected: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target_share, max_repeats, stock_tokens, taken_tokens, reached_share, times (mean passes)."""
    stock = sizes.groupBy("source").agg(F.sum("n_tokens").alias("stock_tokens"))
    taken = selected.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken_tokens"))
    every = targets.join(stock, "source", "left").join(taken, "source", "left").na.fill(0, ["stock_tokens", "taken_tokens"])
    total = taken.agg(F.sum("taken_tokens").alias("total")).first()[0] or 0
    return every.select(
        "source", "target_share", "max_repeats", "stock_tokens", "taken_tokens",
        F.round(F.col("taken_tokens") / F.lit(max(total, 1)), 6).alias("reached_share"),
        F.round(F.when(F.col("stock_tokens") > 0, F.col("taken_tokens") / F.col("stock_tokens")).otherwise(0.0), 6).alias("times"),
    )
