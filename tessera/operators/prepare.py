"""Splits without leakage, and the reports on the data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, Window as W

from ..functions import text as X
from ..plans.runtime import fitting
from .labels import INDUSTRIES, OTHER, with_top

SEED = 20240917
BUCKET = 20_000


def first_rows(df: DataFrame, key: str = "uid", order: str = "row_id") -> DataFrame:
    """First row of each key."""
    cols = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def stratified_split(df: DataFrame, fractions: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = SEED) -> DataFrame:
    """(uid, stratum, split): each stratum of top and format is shuffled by a keyed hash and cut by rounded counts.

    Half-even rounding; from three members on, every split gets at least one. Positions within a stratum come from
    bucketed counts: a bucket's rows are numbered in its own partition and offset by the counts of earlier buckets, so
    that no task sorts a whole stratum. Buckets have about ``BUCKET`` members.
    """
    one = first_rows(df.select("uid", "row_id", "top", "document_format"))
    digits = max(1, math.ceil(math.log(max(1, df.count()) / BUCKET, 16)))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("uid")))
    keyed = one.select("uid", F.concat_ws("|", "top", "document_format").alias("stratum"), h.alias("h"), F.substring(h, 1, digits).alias("b"))
    per = keyed.groupBy("stratum", "b").agg(F.count("*").alias("k"))
    w = W.partitionBy("stratum").orderBy("b")
    per = per.withColumn("before", F.sum("k").over(w) - F.col("k")).withColumn("n", F.sum("k").over(W.partitionBy("stratum")))
    at = keyed.withColumn("r", F.row_number().over(W.partitionBy("stratum", "b").orderBy("h", "uid"))).join(per, ["stratum", "b"])
    n = F.col("n")
    train, dev = F.rint(n * fractions[0]), F.rint(n * fractions[1])
    train = F.when(n >= 3, F.greatest(F.lit(1.0), F.least(train, n - 2))).otherwise(train)
    dev = F.when(n >= 3, F.greatest(F.lit(1.0), F.least(dev, n - train - 1))).otherwise(dev)
    i = F.col("before") + F.col("r")
    return at.select("uid", "stratum", F.when(i <= train, "train").when(i <= train + dev, "dev").otherwise("test").alias("split"))


def leaking(df: DataFrame, key: str = "uid") -> DataFrame:
    """Keys that lie in more than one split: (key, n_splits)."""
    return df.filter(F.col("split").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def describe(df: DataFrame) -> DataFrame:
    """Rows and distinct uids by split, split and class, split and locale, and class."""
    g = df.groupingSets([["split"], ["split", "top"], ["split", "locale"], ["top"]], "split", "top", "locale")
    return g.agg(F.grouping_id().alias("level"), F.count("*").alias("n_rows"), F.count_distinct("uid").alias("n_uids")).select(F.col("level").cast("int").alias("level"), "split", "top", "locale", "n_rows", "n_uids")


def label_space(df: DataFrame) -> DataFrame:
    """Per industry: tags, rows, uids, and the least, median and greatest number of uids a tag, and tags below ten."""
    rows = df.filter(F.col("top").isin(*INDUSTRIES) & (F.col("tag") != ""))
    per = rows.groupBy("top", "tag").agg(F.count("*").alias("rows"), F.count_distinct("uid").alias("s"))
    uids = rows.groupBy("top").agg(F.count_distinct("uid").alias("n_uids"))
    agg = per.groupBy("top").agg(F.count("*").alias("n_tags"), F.sum("rows").alias("n_rows"), F.min("s").alias("min_support"), F.median("s").cast("int").alias("median_support"), F.max("s").alias("max_support"), F.count_if(F.col("s") < 10).alias("under_10"))
    return agg.join(uids, "top")


def domain_report(df: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, top, is_hard_negative, n_rows) of every domain."""
    return with_top(df.groupBy("domain").agg(F.count("*").alias("n_rows")).filter("domain is not null"), domains).select("domain", "top", "is_hard_negative", "n_rows")


def sample_weights(df: DataFrame, domains: DataFrame, hard_weight: float = 1.5) -> DataFrame:
    """Balanced class weight a row, times ``hard_weight`` for ``other`` rows of hard-negative domains: (row_id, top, weight)."""
    rows = with_top(df, domains)
    per = rows.groupBy("top").agg(F.count("*").alias("c"))
    n = per.agg(F.sum("c")).first()[0] or 0
    base = per.withColumn("w", F.lit(float(n)) / (4 * F.col("c")))
    hard = F.when((F.col("top") == OTHER) & F.col("is_hard_negative"), F.lit(hard_weight)).otherwise(1.0)
    return rows.join(fitting(base, 10_000), "top").select("row_id", "top", (F.col("w") * hard).alias("weight"))


def descriptions_by_tag(df: DataFrame, most: int = 6) -> DataFrame:
    """(top, tag, k, description): the first descriptions of each tag in row order that differ in 80 characters."""
    d = df.filter(F.col("top").isin(*INDUSTRIES) & (F.col("tag") != "") & F.col("description").isNotNull())
    one = d.groupBy("top", "tag", X.truncate("description", 80).alias("head")).agg(F.min_by("description", "row_id").alias("description"), F.min("row_id").alias("first"))
    w = W.partitionBy("top", "tag").orderBy("first")
    return one.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("top", "tag", "k", "description")


def domain_named(df: DataFrame) -> DataFrame:
    """Share of rows whose description names the domain, ignoring case, by split."""
    rows = df.filter("description is not null and domain is not null")
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.round(F.avg(F.contains(F.lower("description"), F.lower("domain")).cast("double")), 6).alias("rate"))


def deterministic_sample(df: DataFrame, n: int, seed: int = 0, key: str = "row_id") -> DataFrame:
    """``n`` rows without replacement: those with the smallest keyed hash."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
