"""Lexical evidence: document frequencies, heading and verbatim channels, signal rates.

Every document is scored against the tags it shares a token with: tag tokens and document tokens are joined as an
inverted index, so that pairs without evidence (score 0) never exist.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..plans.runtime import materialize

FLOOR = 0.01
MOST_TOKENS = 20_000  # tokens of tags that may be broadcast


def document_frequency(df: DataFrame, chars: int = 2000) -> DataFrame:
    """(token, df): rows in which each token occurs."""
    return df.select(F.explode(F.array_distinct(X.tokenize(X.truncate("text", chars)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def idf(df: DataFrame, chars: int = 2000) -> DataFrame:
    """(token, idf) with ln(n / (1 + df)); the default of unseen tokens is ``ln(n)``, see ``default_idf``."""
    n = df.count()
    return document_frequency(df, chars).select("token", "df", (F.log(F.lit(float(max(n, 1)))) - F.log(1.0 + F.col("df"))).alias("idf"))


def default_idf(df: DataFrame) -> float:
    return math.log(max(df.count(), 1))


def tag_weights(vocab: DataFrame, idfs: DataFrame, default: float) -> DataFrame:
    """(top, tag_idx, tag, n_tokens, total, token, w): idf of each tag token, not below the floor."""
    tok = vocab.select("top", "tag_idx", "tag", F.explode(X.tag_tokens("tag")).alias("token"))
    w = tok.join(idfs.select("token", "idf"), "token", "left").withColumn("w", F.greatest(F.coalesce("idf", F.lit(default)), F.lit(FLOOR)))
    tot = w.groupBy("top", "tag_idx").agg(F.sum("w").alias("total"), F.count("*").alias("n_tokens"))
    return w.join(tot, ["top", "tag_idx"]).select("top", "tag_idx", "tag", "n_tokens", "total", "token", "w")


def prepared(df: DataFrame, key: str = "row_id", window: int = 400, body_chars: int = 2500) -> DataFrame:
    """(key, heads, norms, body): token sets of the first five titles, first six normalised titles, normalised body."""
    h = X.headings("text", window)
    return df.select(key, h.alias("h"), X.normalize_tag(X.truncate("text", body_chars)).alias("body")).select(
        key, F.transform(F.slice("h", 1, 5), lambda x: F.array_distinct(X.tokenize(x))).alias("heads"), F.transform(F.slice("h", 1, 6), X.normalize_tag).alias("norms"), "body"
    )


def channels(df: DataFrame, vocab: DataFrame, idfs: DataFrame, default: float, key: str = "row_id", window: int = 400, body_chars: int = 2500) -> DataFrame:
    """(key, top, tag_idx, tag, heading, verbatim) of every document and tag with a token in common."""
    tw = materialize(tag_weights(vocab, idfs, default), "tag-weights")
    d = prepared(df, key, window, body_chars)
    listed = tw.select("token").distinct()
    few = listed.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS
    if few:  # only tokens of tags go on
        d = d.join(F.broadcast(listed.agg(F.collect_list("token").alias("known"))))  # one row
        own = lambda c: F.array_intersect(c, "known")
    else:
        own = F.array_distinct
    d = materialize(d.select(key, "heads", "norms", "body", own(F.flatten("heads")).alias("ht"), own(F.split("body", " ")).alias("bt")), "prepared")
    flags = lambda c: F.transform(c, lambda t: F.struct(t.alias("token"), F.array_contains("ht", t).alias("in_head"), F.array_contains("bt", t).alias("in_body")))
    seen = d.select(key, F.explode(flags(F.array_union("ht", "bt"))).alias("t")).select(key, "t.*")
    tags = F.broadcast(tw) if few and tw.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS else tw
    hit = seen.join(tags, "token").groupBy(key, "top", "tag_idx", "tag", "n_tokens", "total").agg(F.sum(F.when(F.col("in_head"), 2 * F.col("w")).otherwise(F.col("w"))).alias("got"), F.count_if("in_body").alias("n_body"))
    d = d.select(key, "heads", "norms", "body")
    full = hit.join(d, key)
    own = X.tag_tokens("tag")
    boost = F.when(F.array_contains("norms", F.col("tag")), 1.0).when(F.exists("heads", lambda s: (F.size(s) > 0) & (F.size(F.array_except(own, s)) == 0)), 0.5).otherwise(0.0)
    pos = X.position(F.col("body"), F.col("tag"))
    verb = F.when((F.col("n_body") == F.col("n_tokens")) & (pos >= 0), 1.0 - 0.5 * pos / F.greatest(F.length("body"), F.lit(1))).otherwise(0.0)
    return full.select(key, "top", "tag_idx", "tag", (F.col("got") / (2.0 * F.col("total")) + boost).alias("heading"), verb.alias("verbatim"))


def verbatim_rate(df: DataFrame, chars: int = 3000) -> DataFrame:
    """Share of rows whose tag stands in the normalised text, by split."""
    rows = df.filter(F.col("tag") != "")
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.round(F.avg(F.contains(X.normalize_tag(X.truncate("text", chars)), F.col("tag")).cast("double")), 6).alias("rate"))


def heading_hit_rate(df: DataFrame, window: int = 400) -> DataFrame:
    """Share of rows whose tag is one of the normalised titles, by split."""
    rows = df.filter(F.col("tag") != "")
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.round(F.avg(F.array_contains(F.transform(X.headings("text", window), X.normalize_tag), F.col("tag")).cast("double")), 6).alias("rate"))


def best_tag(scores: DataFrame, by: list[str], score) -> DataFrame:
    """Highest-scoring tag a group, the lowest index on ties."""
    s = scores.withColumn("__s", score)
    return s.groupBy(*by).agg(F.max_by("tag", F.struct(F.col("__s"), -F.col("tag_idx"))).alias("tag"), F.max("__s").alias("score"))


def top1_rates(df: DataFrame, scores: DataFrame, key: str = "row_id") -> DataFrame:
    """Accuracy a class of the best tag given the true class, for heading, verbatim and heading + 0.5 verbatim.

    A document without any evidence has no best tag and counts as wrong.
    """
    own = scores.join(df.select(key, "top", F.col("tag").alias("gold")), [key, "top"])
    pick = lambda s: F.max_by("tag", F.struct(s, -F.col("tag_idx")))
    best = own.groupBy(key).agg(F.first("gold").alias("gold"), pick(F.col("heading")).alias("h"), pick(F.col("verbatim")).alias("v"), pick(F.col("heading") + 0.5 * F.col("verbatim")).alias("c"))
    rows = df.filter(F.col("tag") != "").join(best.drop("gold"), key, "left")
    rate = lambda c: F.round(F.avg(F.coalesce((F.col(c) == F.col("tag")).cast("double"), F.lit(0.0))), 6)
    return rows.groupBy("top").agg(F.count("*").alias("n_rows"), rate("h").alias("heading"), rate("v").alias("verbatim"), rate("c").alias("combined"))
