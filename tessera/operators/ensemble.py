"""Ensemble arithmetic over long score tables (key, top, tag_idx, channels...)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..sources.tables import WEIGHTS

# The channels, the starts of the search and its tolerance.
CHANNELS = ("linear", "rocchio", "prototype", "heading", "verbatim")
STARTS = (0.0, 0.5, 0.25, 1.0)
TOLERANCE = 1e-6


def assemble(vocab: DataFrame, docs: DataFrame, scores: dict[str, DataFrame], key: str = "row_id", most: int = 100_000) -> DataFrame:
    """(key, top, tag_idx, one column a channel): every document against every tag of every industry; missing scores are 0.
    The tags are broadcast in blocks of about ``most``, each of which all documents meet.

    Only the scores there are get shuffled, once and by document; the full grid is laid out after it and stays
    partitioned by ``key``, so that windows and groups by document don't shuffle it either.
    """
    long = docs.select(key, F.lit(None).cast("string").alias("n"), F.lit(None).cast("string").alias("top"), F.lit(None).cast("int").alias("i"), F.lit(0.0).alias("s"))
    for name, s in scores.items():
        s = s.join(docs.select(key), key, "left_semi")
        long = long.unionByName(s.select(key, F.lit(name).alias("n"), "top", F.col("tag_idx").cast("int").alias("i"), F.col("score").cast("double").alias("s")))
    entry = lambda n: F.collect_list(F.when(F.col("n") == n, F.struct(F.struct("top", "i"), "s")))
    per = long.groupBy(key).agg(*[F.map_from_entries(entry(n)).alias(n) for n in scores])
    at = F.struct(F.col("p.top").alias("top"), F.col("p.tag_idx").cast("int").alias("i"))
    blocks = max(1, math.ceil(vocab.count() / most))
    out = None
    for k in range(blocks):
        listed = vocab.filter(F.pmod(F.xxhash64("top", "tag_idx"), F.lit(blocks)) == k).select(F.struct("top", "tag_idx").alias("p")).agg(F.collect_list("p").alias("ps"))
        grid = per.join(F.broadcast(listed)).select(key, F.explode("ps").alias("p"), *scores)
        one = grid.select(key, "p.top", "p.tag_idx", *[F.coalesce(F.try_element_at(n, at), F.lit(0.0)).alias(n) for n in scores])
        out = one if out is None else out.unionByName(one)
    return out


def zscores(df: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Each channel centred and scaled within a document's tags (population deviation, at least 1e-6)."""
    w = W.partitionBy(*by)
    return df.withColumns({n: (F.col(n) - F.avg(n).over(w)) / F.greatest(F.stddev_pop(n).over(w), F.lit(1e-6)) for n in names})


def mix(weights: dict[str, float]) -> Column:
    """Weighted sum; channels of weight 0 are left out of the plan."""
    out = F.lit(0.0)
    for n, w in weights.items():
        if w:
            out = out + F.lit(float(w)) * F.col(n)
    return out


def with_log_softmax(df: DataFrame, score: str, by: list[str], out: str = "lp", temperature: float = 1.0) -> DataFrame:
    """``df`` with log probabilities ``out`` of ``score / temperature`` within ``by``."""
    w = W.partitionBy(*by)
    d = df.withColumn("__s", F.col(score) / temperature)
    d = d.withColumn("__d", F.col("__s") - F.max("__s").over(w))
    return d.withColumn(out, F.col("__d") - F.log(F.sum(F.exp("__d")).over(w))).drop("__s", "__d")


def temperatures(low: float = 0.05, high: float = 20.0, points: int = 60) -> list[float]:
    """Geometric grid."""
    return [low * (high / low) ** (i / (points - 1)) for i in range(points)]


def temperature_losses(scores: DataFrame, gold: DataFrame, grid: list[float], key: str = "row_id", score: str = "score", label: str = "tag_idx", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, t, nll): mean negative log likelihood of the gold label at each temperature, of each group of ``by``.

    Two aggregations for the whole grid: per document and temperature the log-sum-exp, then the mean.
    """
    per = scores.groupBy(key, *by).agg(F.max(score).alias("m"), F.collect_list(score).alias("ss"))
    own = scores.join(gold.select(key, *by, F.col(label)), [key, *by, label]).select(key, *by, F.col(score).alias("g"))
    t = per.join(own, [key, *by]).withColumn("t", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    lse = F.log(F.aggregate(F.transform("ss", lambda s: F.exp((s - F.col("m")) / F.col("t"))), F.lit(0.0), lambda a, x: a + x))
    return t.groupBy(*by, "t").agg(F.avg(-((F.col("g") - F.col("m")) / F.col("t") - lse)).alias("nll"))


def best_temperature(losses: DataFrame) -> float:
    """Smallest loss, the lowest temperature on ties; 1 if there is none."""
    r = losses.agg(F.min_by("t", F.struct("nll", "t")).alias("t")).first()
    return 1.0 if r is None or r.t is None else float(r.t)


def _z(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, keepdims=True), 1e-6)


def _search(stacked: np.ndarray, gold: np.ndarray, names: list[str], grid: tuple[float, ...], passes: int) -> tuple[np.ndarray, float]:
    """Coordinate ascent on accuracy from four starts. ``stacked``: channels x documents x tags, z-scored."""
    lead = names.index("linear") if "linear" in names else 0

    def right(w: np.ndarray) -> float:
        return float((np.tensordot(w, stacked, 1).argmax(1) == gold).mean()) if len(gold) else 0.0

    best, top = None, -1.0
    for rest in STARTS:
        w = np.full(len(names), rest)
        w[lead] = 1.0
        at = right(w)
        for _ in range(passes):
            moved = False
            for k in range(len(names)):
                others = np.tensordot(np.delete(w, k), np.delete(stacked, k, 0), 1)
                for v in grid:
                    if v != w[k] and (s := float(((others + v * stacked[k]).argmax(1) == gold).mean())) > at + TOLERANCE:
                        at, w[k], moved = s, v, True
            if not moved:
                break
        if at > top:
            best, top = w.copy(), at
    if not best.any():
        best[lead] = 1.0
        top = right(best)
    return best, top


def search_weights(channels: DataFrame, gold: DataFrame, names: list[str] | None = None, key: str = "row_id", grid: tuple[float, ...] = WEIGHTS, passes: int = 5, most_docs: int = 50_000) -> DataFrame:
    """(top, channel, weight, accuracy): ensemble weights of each industry by multi-start coordinate ascent on the given (dev) rows.

    The search needs an industry's channels in one task; it uses at most ``most_docs`` documents an industry, those
    with the smallest key hash.
    """
    names = list(names or CHANNELS)
    g = gold.filter("tag_idx >= 0").select(key, "top", F.col("tag_idx").alias("gold"))
    w = W.partitionBy("top").orderBy(F.xxhash64(key), key)
    g = g.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most_docs).drop("__n")
    rows = channels.join(g, [key, "top"]).select(key, "top", "tag_idx", "gold", *names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "tag_idx"])
        n_tags = pdf["tag_idx"].nunique()
        docs = pdf[key].nunique()
        stacked = np.stack([_z(pdf[n].to_numpy(float).reshape(docs, n_tags)) for n in names])
        best, acc = _search(stacked, pdf["gold"].to_numpy().reshape(docs, n_tags)[:, 0], names, grid, passes)
        return pd.DataFrame({"top": pdf["top"].iloc[0], "channel": names, "weight": best, "accuracy": acc})

    return rows.groupBy("top").applyInPandas(run, "top string, channel string, weight double, accuracy double")
