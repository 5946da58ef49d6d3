"""Confusion-driven merging of labels under complete linkage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .labels import canonical


def affinity(gold_pred: DataFrame) -> DataFrame:
    """(top, tag_a, tag_b, affinity), tag_a < tag_b: (c_ab + c_ba) / (support_a + support_b) of confused pairs.

    ``gold_pred(top, gold, pred)``; pairs with a null label are ignored. Support is the number of gold rows.
    """
    c = gold_pred.filter("gold is not null and pred is not null").groupBy("top", "gold", "pred").agg(F.count("*").alias("n"))
    return affinity_of_counts(c)


def affinity_of_counts(c: DataFrame) -> DataFrame:
    """``affinity`` from counts (top, gold, pred, n)."""
    s = c.groupBy("top", F.col("gold").alias("tag")).agg(F.sum("n").alias("support"))
    und = c.filter(F.col("gold") != F.col("pred")).groupBy("top", F.least("gold", "pred").alias("tag_a"), F.greatest("gold", "pred").alias("tag_b")).agg(F.sum("n").alias("n"))
    j = und.join(s.withColumnsRenamed({"tag": "tag_a", "support": "sa"}), ["top", "tag_a"], "left").join(s.withColumnsRenamed({"tag": "tag_b", "support": "sb"}), ["top", "tag_b"], "left")
    return j.select("top", "tag_a", "tag_b", (F.col("n") / F.greatest(F.coalesce("sa", F.lit(0)) + F.coalesce("sb", F.lit(0)), F.lit(1))).alias("affinity"))


def support(gold_pred: DataFrame) -> DataFrame:
    return gold_pred.filter("gold is not null").groupBy("top", F.col("gold").alias("tag")).agg(F.count("*").alias("support"))


def merge(edges: DataFrame, tags: DataFrame, thresholds: list[float], ratio: float = 0.5, most: int = 8) -> DataFrame:
    """(threshold, top, tag, canonical, cluster_size) for every tag and threshold.

    Greedy over edges by falling affinity; two clusters join if the union has at most ``most`` members and their
    weakest cross pair reaches threshold * ratio. One task a (threshold, class): it holds that class's edges above the
    linkage bar, at most the square of the label space, whatever the number of documents. ``tags(top, tag, tag_idx, support)``.
    """
    low = min(thresholds) * ratio
    e = edges.filter(F.col("affinity") >= low).select("top", F.col("tag_a").alias("a"), F.col("tag_b").alias("b"), "affinity", F.lit(None).cast("int").alias("tag_idx"), F.lit(None).cast("bigint").alias("support"))
    t = tags.select("top", F.col("tag").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("affinity"), F.col("tag_idx").cast("int").alias("tag_idx"), F.coalesce("support", F.lit(0)).cast("bigint").alias("support"))
    both = e.unionByName(t).withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        limit = float(pdf["threshold"].iloc[0])
        nodes = pdf[pdf["b"].isna()].sort_values("tag_idx")
        order = {x: i for i, x in enumerate(nodes["a"])}
        sup = dict(zip(nodes["a"], nodes["support"]))
        link = {frozenset((x, y)): w for x, y, w in zip(pdf["a"], pdf["b"], pdf["affinity"]) if isinstance(y, str) and x in order and y in order}
        cluster = {x: [x] for x in order}
        strong = []
        for pair, w in link.items():
            if w >= limit and len(pair) == 2:
                x, y = sorted(pair, key=order.get)
                strong.append((w, order[x], order[y], x, y))
        for _, _, _, x, y in sorted(strong, reverse=True):
            p, q = cluster[x], cluster[y]
            if p is q or len(p) + len(q) > most:
                continue
            if min(link.get(frozenset((u, v)), 0.0) for u in p for v in q) < limit * ratio:
                continue
            joined = p + q
            for u in joined:
                cluster[u] = joined
        out = []
        for x, members in cluster.items():
            name = min(members, key=lambda u: (-sup[u], len(u), order[u]))
            out.append((limit, pdf["top"].iloc[0], x, name, len(members)))
        return pd.DataFrame(out, columns=["threshold", "top", "tag", "canonical", "cluster_size"])

    return both.groupBy("threshold", "top").applyInPandas(run, "threshold double, top string, tag string, canonical string, cluster_size bigint")


def aliases(merged: DataFrame) -> DataFrame:
    """(threshold, top, tag, canonical) of the tags that change."""
    return merged.filter(F.col("tag") != F.col("canonical")).select("threshold", "top", "tag", "canonical")


def aliased_accuracy(gold_pred: DataFrame, alias: DataFrame) -> DataFrame:
    """Share of rows whose gold and predicted tag fall into one cluster: (top, n_rows, raw, merged)."""
    d = gold_pred.select("top", F.col("gold"), F.col("pred"))
    d = canonical(canonical(d, alias, "gold", "g"), alias, "pred", "p")
    avg = lambda c: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 6)
    return d.groupBy("top").agg(F.count("*").alias("n_rows"), avg(F.col("gold") == F.col("pred")).alias("raw"), avg(F.col("g") == F.col("p")).alias("merged"))


def sweep(gold_pred: DataFrame, merged: DataFrame) -> DataFrame:
    """(threshold, tags_before, tags_after, accuracy) of each threshold."""
    m = merged.select("threshold", "top", "tag", "canonical")
    size = m.groupBy("threshold").agg(F.count("*").alias("tags_before"), F.count_distinct("top", "canonical").alias("tags_after"))
    grid = m.select("threshold").distinct()
    d = gold_pred.select("top", "gold", "pred").groupBy("top", "gold", "pred").agg(F.count("*").alias("n")).join(F.broadcast(grid))
    g = m.select("threshold", "top", F.col("tag").alias("gold"), F.col("canonical").alias("g"))
    p = m.select("threshold", "top", F.col("tag").alias("pred"), F.col("canonical").alias("p"))
    j = d.join(g, ["threshold", "top", "gold"], "left").join(p, ["threshold", "top", "pred"], "left")
    same = F.coalesce("g", "gold") == F.coalesce("p", "pred")
    acc = j.groupBy("threshold").agg((F.sum(F.when(same, F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("accuracy"))
    return size.join(acc, "threshold").select("threshold", "tags_before", "tags_after", F.round("accuracy", 6).alias("accuracy"))


def recommended(sweep_: DataFrame, raw: float, gain: float = 0.01) -> DataFrame:
    """The threshold of greatest accuracy among those that gain at least ``gain``; the lowest on ties; no row if none does."""
    best = sweep_.filter(F.col("accuracy") >= raw + gain).agg(F.max_by(F.struct("threshold", "tags_before", "tags_after", "accuracy"), F.struct("accuracy", -F.col("threshold"))).alias("b"))
    return best.filter("b is not null").select("b.*")
