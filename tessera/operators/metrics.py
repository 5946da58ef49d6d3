"""Evaluation over rows (key, gold_top, gold_tag, top, tag, score, top_confidence, domain, locale, document_format)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.runtime import materialize, ranked
from .labels import OTHER, TOPS


def compared(gold: DataFrame, predicted: DataFrame, key: str = "row_id") -> DataFrame:
    """Gold rows with their predictions, both tags null for ``other``."""
    null_other = lambda top, tag: F.when(F.col(top) != OTHER, F.col(tag))
    g = gold.select(key, F.col("top").alias("gold_top"), F.col("tag").alias("gold_tag"), *[c for c in ("domain", "locale", "document_format", "text") if c in gold.columns])
    p = predicted.select(key, *[c for c in ("top", "tag", "score", "top_confidence", "tag_confidence") if c in predicted.columns])
    return g.join(p, key).withColumn("gold_tag", null_other("gold_top", "gold_tag")).withColumn("tag", null_other("top", "tag"))


def top_ok() -> Column:
    return F.col("top").eqNullSafe(F.col("gold_top"))


def exact() -> Column:
    return top_ok() & ((F.col("gold_top") == OTHER) | F.col("tag").eqNullSafe(F.col("gold_tag")))


def _avg(c: Column) -> Column:
    return F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)


def confusion(df: DataFrame, labels: tuple[str, ...] = TOPS) -> DataFrame:
    """(gold_top, top, n) over the full grid of labels; pairs outside it are ignored."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "gold_top string, top string")
    return grid.join(df.groupBy("gold_top", "top").agg(F.count("*").alias("n")), ["gold_top", "top"], "left").select("gold_top", "top", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1), rounded to 5 digits."""
    tp = F.sum(F.when(F.col("gold_top") == F.col("top"), F.col("n")).otherwise(0))
    rows = conf.groupBy(F.col("gold_top").alias("label")).agg(F.sum("n").alias("support"), tp.alias("tp"))
    cols = conf.groupBy(F.col("top").alias("label")).agg(F.sum("n").alias("col"))
    one = lambda c: F.greatest(c, F.lit(1))
    return rows.join(cols, "label").select("label", "support", F.round(F.col("tp") / one(F.col("col")), 5).alias("precision"), F.round(F.col("tp") / one(F.col("support")), 5).alias("recall"), F.round(2 * F.col("tp") / one(F.col("support") + F.col("col")), 5).alias("f1"))


def macro_f1(classes: DataFrame) -> DataFrame:
    """Mean of the rounded F1 values."""
    return classes.agg(F.round(F.avg("f1"), 5).alias("macro_f1"))


def headline(df: DataFrame) -> DataFrame:
    """One row: rows, tier-1 accuracy, tag accuracy given the right industry, exact match of all and of industry rows."""
    industry = F.col("gold_top") != OTHER
    tag_ok = F.col("tag").eqNullSafe(F.col("gold_tag"))
    return df.agg(
        F.count("*").alias("n_rows"), _avg(top_ok()).alias("tier1_accuracy"), _avg(F.when(industry & top_ok(), tag_ok)).alias("tier2_given_top"), _avg(exact()).alias("exact_all"), _avg(F.when(industry, exact())).alias("exact_industry")
    )


def per_industry(df: DataFrame) -> DataFrame:
    """(gold_top, n_rows, tier1_recall, tier2_given_top, end_to_end, n_tags)."""
    d = df.filter(F.col("gold_top") != OTHER)
    tag_ok = F.col("tag").eqNullSafe(F.col("gold_tag"))
    return d.groupBy("gold_top").agg(F.count("*").alias("n_rows"), _avg(top_ok()).alias("tier1_recall"), _avg(F.when(top_ok(), tag_ok)).alias("tier2_given_top"), _avg(exact()).alias("end_to_end"), F.count_distinct("gold_tag").alias("n_tags"))


def slices(df: DataFrame, by: str) -> DataFrame:
    """(value, n_rows, tier1_accuracy, end_to_end) of a grouping column."""
    return df.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n_rows"), _avg(top_ok()).alias("tier1_accuracy"), _avg(exact()).alias("end_to_end"))


def coverage_curve(df: DataFrame, correct: Column, confidence: str, key: str, points: int = 19) -> DataFrame:
    """(point, coverage, accuracy, threshold): accuracy among the most confident rows.

    The order is total (confidence down, then key), and ranked by ranges that grow in number with the partitions.
    """
    spark = df.sparkSession
    d = df.filter(F.col(confidence).isNotNull()).select(F.col(confidence).alias("c"), F.col(key).alias("k"), correct.cast("int").alias("ok"))
    r = materialize(ranked(d, [F.desc("c"), F.col("k")]), "ranked")
    n = r.count()
    takes = [(i + 1, max(1, round((i + 1) / points * n))) for i in range(points)] if n else []
    # correct ones up to each point: one pass, a count a point
    hits = r.agg(*[F.sum(F.when(F.col("rank") <= t, F.col("ok")).otherwise(0)).alias(f"h{i}") for i, t in takes]).first() if n else None
    at = spark.createDataFrame([(i, t, hits[f"h{i}"]) for i, t in takes], "point int, take bigint, hits bigint")
    return r.join(F.broadcast(at), F.col("rank") == F.col("take")).select("point", F.round(F.col("take") / F.lit(n), 4).alias("coverage"), F.round(F.col("hits") / F.col("take"), 5).alias("accuracy"), F.round("c", 6).alias("threshold"))


def accuracy_at_target(curve: DataFrame, target: float) -> DataFrame:
    """The point of widest coverage whose accuracy clears the target; no row if none does."""
    best = curve.filter(F.col("accuracy") >= target).agg(F.max_by(F.struct("coverage", "accuracy", "threshold"), F.struct("coverage", -F.col("point"))).alias("b"))
    return best.filter("b is not null").select("b.*")


def errors_by_domain(df: DataFrame, most: int = 20) -> DataFrame:
    """(domain, n_errors, predicted): wrong classes by domain, the domains with most errors; ``predicted`` lists class:count."""
    wrong = df.filter(~top_ok()).groupBy("domain", "top").agg(F.count("*").alias("n"))
    per = wrong.groupBy("domain").agg(F.sum("n").alias("n_errors"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "n"))), lambda x: F.concat_ws(":", x["top"], x["n"].cast("string"))), ",").alias("predicted"))
    return per.orderBy(F.desc("n_errors"), F.asc_nulls_first("domain")).limit(most)


def error_samples(df: DataFrame, key: str = "row_id", most: int = 25) -> DataFrame:
    """The first wrong rows in key order with the first 240 characters of their text."""
    return df.filter(~top_ok()).orderBy(key).limit(most).select(key, "gold_top", "top", F.substring(F.coalesce("text", F.lit("")), 1, 240).alias("excerpt"))
