"""Joint decoding over (class, tag) pairs from two tiers of log probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from .labels import OTHER, top_index


def decode(t1: DataFrame, t2: DataFrame, lam: float | DataFrame = 1.0, other_bias: float = 0.0, key: str = "row_id") -> DataFrame:
    """Best pair of each document.

    ``t1(key, top, lp)``, ``t2(key, top, tag_idx, tag, lp)``. Score: lp(top) + lam * max lp(tag | top), for ``other``
    lp + other_bias; the earlier class wins ties, and the lower tag index. Classes without tags are skipped.
    ``lam`` may be a table (lam) of values tried at once. Result: [lam,] key, top, tag, score, top_confidence, tag_confidence.
    """
    best = t2.groupBy(key, "top").agg(F.max_by(F.struct("tag", "lp"), F.struct(F.col("lp"), -F.col("tag_idx"))).alias("b"))
    all_ = t1.join(best.select(key, "top", F.col("b.tag").alias("tag"), F.col("b.lp").alias("tag_lp")), [key, "top"], "left")
    all_ = all_.filter((F.col("top") == OTHER) | F.col("tag_lp").isNotNull())
    grid = isinstance(lam, DataFrame)
    if grid:
        values = [r.lam for r in lam.collect()]  # a parameter grid
        all_ = all_.withColumn("lam", F.explode(F.array(*[F.lit(float(v)) for v in values])))
        weight = F.col("lam")
    else:
        weight = F.lit(float(lam))
    score = F.when(F.col("top") == OTHER, F.col("lp") + other_bias).otherwise(F.col("lp") + weight * F.col("tag_lp"))
    all_ = all_.withColumn("score", score)
    by = (["lam"] if grid else []) + [key]
    win = all_.groupBy(*by).agg(F.max_by(F.struct("top", "tag", "score", "lp", "tag_lp"), F.struct(F.col("score"), -top_index("top"))).alias("w"))
    return win.select(*by, "w.top", "w.tag", "w.score", F.exp("w.lp").alias("top_confidence"), F.when(F.col("w.top") == OTHER, 1.0).otherwise(F.exp("w.tag_lp")).alias("tag_confidence"))


def top_k(t1: DataFrame, t2: DataFrame, k: int = 3, lam: float = 1.0, other_bias: float = 0.0, key: str = "row_id") -> DataFrame:
    """(key, rank, top, tag, score): the k best pairs of each document; ties by class order, then tag index."""
    pairs = t1.filter(F.col("top") != OTHER).join(t2.select(key, "top", "tag_idx", "tag", F.col("lp").alias("tag_lp")), [key, "top"]).select(key, "top", "tag_idx", "tag", (F.col("lp") + lam * F.col("tag_lp")).alias("score"))
    other = t1.filter(F.col("top") == OTHER).select(key, "top", F.lit(-1).alias("tag_idx"), F.lit(None).cast("string").alias("tag"), (F.col("lp") + other_bias).alias("score"))
    w = W.partitionBy(key).orderBy(F.desc("score"), top_index("top"), "tag_idx")
    return pairs.unionByName(other).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "rank", "top", "tag", "score")


def sweep_lambda(t1: DataFrame, t2: DataFrame, gold: DataFrame, lambdas: DataFrame, key: str = "row_id", other_bias: float = 0.0) -> DataFrame:
    """(lam, tier1, end_to_end, industry_exact) on gold rows ``(key, top, tag)``."""
    p = decode(t1, t2, lambdas, other_bias, key).select("lam", key, F.col("top").alias("p_top"), F.col("tag").alias("p_tag"))
    m = p.join(gold.select(key, "top", "tag"), key)
    top_ok = F.col("p_top") == F.col("top")
    both = top_ok & ((F.col("top") == OTHER) | F.col("p_tag").eqNullSafe(F.col("tag")))
    return m.groupBy("lam").agg(F.avg(top_ok.cast("double")).alias("tier1"), F.avg(both.cast("double")).alias("end_to_end"), F.avg(F.when(F.col("top") != OTHER, both.cast("double"))).alias("industry_exact"))


def best_lambda(sweep: DataFrame) -> float:
    """Best end-to-end accuracy, the smallest value on ties."""
    r = sweep.agg(F.min_by("lam", F.struct(-F.col("end_to_end"), "lam")).alias("lam")).first()
    return float(r.lam) if r and r.lam is not None else 0.0


def as_structs(decoded: DataFrame, t1: DataFrame, alternatives: DataFrame, key: str = "row_id") -> DataFrame:
    """Prediction records: industry, sub_tag, confidences to 4 digits, class probabilities as a map, alternatives as structs."""
    probs = t1.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("top", F.round(F.exp("lp"), 4).alias("p"))))).alias("industry_probabilities"))
    alts = alternatives.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "top", "tag", "score"))), lambda x: F.struct(x["top"].alias("industry"), x["tag"].alias("sub_tag"), F.round(x["score"], 4).alias("score"))).alias("alternatives"))
    d = decoded.select(key, F.col("top").alias("industry"), F.col("tag").alias("sub_tag"), F.round("top_confidence", 4).alias("industry_confidence"), F.when(F.col("top") != OTHER, F.round("tag_confidence", 4)).alias("sub_tag_confidence"))
    return d.join(probs, key).join(alts, key)
