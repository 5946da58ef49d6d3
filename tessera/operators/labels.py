"""Label dimension operators: class lookup, hard negatives, encoding, vocabulary, aliases, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

OTHER = "other"
INDUSTRIES = ("healthcare", "finance", "government")
TOPS = (*INDUSTRIES, OTHER)


class LabelError(ValueError):
    """The label dimension and the data disagree."""


def check_domains(domains: DataFrame, industries: tuple[str, ...] = INDUSTRIES) -> None:
    """Raise unless ``domains(domain, top, hard_negative_of)`` is sound: each domain once, known classes, no industry domain marked as hard negative."""
    if OTHER in industries:
        raise LabelError("'other' can't be an industry")
    bad = domains.groupBy("domain").count().filter("count > 1").limit(1).collect()
    if bad:
        raise LabelError(f"domain listed twice: {bad[0].domain}")
    bad = domains.filter(~F.col("top").isin(*industries, OTHER)).limit(1).collect()
    if bad:
        raise LabelError(f"unknown class: {bad[0].top}")
    bad = domains.filter((F.col("top") != OTHER) & F.col("hard_negative_of").isNotNull()).limit(1).collect()
    if bad:
        raise LabelError(f"industry domain marked as hard negative: {bad[0].domain}")


def unknown_domains(df: DataFrame, domains: DataFrame) -> DataFrame:
    """Observed domains the dimension lacks, with their rows."""
    return df.filter("domain is not null").groupBy("domain").agg(F.count("*").alias("n_rows")).join(domains.select("domain"), "domain", "left_anti")


def require_known_domains(df: DataFrame, domains: DataFrame) -> None:
    bad = unknown_domains(df, domains).limit(5).collect()
    if bad:
        raise LabelError(f"unknown domains: {sorted(r.domain for r in bad)}")


def with_top(df: DataFrame, domains: DataFrame) -> DataFrame:
    """Class of the row's domain as ``top`` (``other`` if unknown) and ``is_hard_negative``."""
    d = domains.select("domain", F.col("top").alias("__top"), F.col("hard_negative_of").isNotNull().alias("__hard"))
    return df.drop("top").join(d, "domain", "left").withColumn("top", F.coalesce("__top", F.lit(OTHER))).withColumn("is_hard_negative", F.coalesce("__hard", F.lit(False))).drop("__top", "__hard")


def top_index(top: Column | str, tops: tuple[str, ...] = TOPS) -> Column:
    """Position of a class, industries first and ``other`` last; -1 for any other value."""
    c = F.col(top) if isinstance(top, str) else top
    return F.coalesce(F.array_position(F.array(*map(F.lit, tops)), c) - 1, F.lit(-1)).cast("int")


def with_tag_index(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``tag_idx`` of (top, tag); -1 for a tag the vocabulary lacks."""
    v = vocabulary.select("top", "tag", F.col("tag_idx").alias("__i"))
    return df.join(v, ["top", "tag"], "left").withColumn("tag_idx", F.coalesce("__i", F.lit(-1))).drop("__i")


def gold_tag(top: str = "top", tag: str = "tag") -> Column:
    """The tag, null for class ``other``."""
    return F.when(F.col(top) != OTHER, F.col(tag))


def vocabulary(df: DataFrame, industries: tuple[str, ...] = INDUSTRIES) -> DataFrame:
    """(top, tag_idx, tag): sorted distinct non-empty tags of each industry among the given rows."""
    tags = df.filter(F.col("top").isin(*industries) & F.col("tag").isNotNull() & (F.col("tag") != "")).select("top", "tag").distinct()
    return tags.withColumn("tag_idx", (F.row_number().over(W.partitionBy("top").orderBy("tag")) - 1).cast("int")).select("top", "tag_idx", "tag")


def unseen_tags(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows whose (top, tag) the vocabulary lacks."""
    return df.join(vocab.select("top", "tag"), ["top", "tag"], "left_anti")


def unseen_rate(df: DataFrame, vocab: DataFrame, by: str = "split", industries: tuple[str, ...] = INDUSTRIES) -> DataFrame:
    """(by, n_rows, n_unseen, rate): empty tags count as unseen."""
    rows = df.filter(F.col("top").isin(*industries)).withColumn("tag", F.coalesce("tag", F.lit("")))
    m = rows.join(vocab.select("top", "tag", F.lit(1).alias("seen")), ["top", "tag"], "left")
    n, miss = F.count("*"), F.count_if(F.col("seen").isNull())
    return m.groupBy(by).agg(n.alias("n_rows"), miss.alias("n_unseen"), F.round(miss / F.greatest(n, F.lit(1)), 4).alias("rate"))


def canonical(df: DataFrame, aliases: DataFrame, tag: str = "tag", out: str | None = None) -> DataFrame:
    """``tag`` replaced by its canonical name where ``aliases(top, tag, canonical)`` has one."""
    a = aliases.select("top", F.col("tag").alias(tag), F.col("canonical").alias("__c"))
    return df.join(a, ["top", tag], "left").withColumn(out or tag, F.coalesce("__c", F.col(tag))).drop("__c")


def coarser(vocab: DataFrame, aliases: DataFrame) -> DataFrame:
    """Vocabulary after merging: distinct canonical tags, indexed anew."""
    return vocabulary(canonical(vocab.select("top", "tag"), aliases), tuple(INDUSTRIES) + (OTHER,))


def pairs(vocab: DataFrame) -> DataFrame:
    """All valid (top, tag) pairs, ``other`` without tag last: (top_idx, tag_idx, top, tag)."""
    spark = vocab.sparkSession
    rows = vocab.filter(F.col("top") != OTHER).select(top_index("top").alias("top_idx"), "tag_idx", "top", "tag")
    return rows.unionByName(spark.range(1).select(F.lit(len(INDUSTRIES)).cast("int").alias("top_idx"), F.lit(-1).cast("int").alias("tag_idx"), F.lit(OTHER).alias("top"), F.lit(None).cast("string").alias("tag")))
