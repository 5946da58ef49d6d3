"""TF-IDF spaces, centroids and embeddings in long form: (key, term, w)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..plans.runtime import fitting, materialize

MOST_TERMS = 500_000  # rows of a term table that may be broadcast
MOST_CELLS = 3_000_000  # cells of the centroids that may be broadcast


def word_terms(text: str = "text", chars: int = 2500, two: bool = True) -> Column:
    """Words, and pairs of neighbouring words."""
    w = X.words(X.truncate(text, chars))
    return F.concat(w, X.bigrams(w)) if two else w


def char_terms(text: str = "text", chars: int = 1200) -> Column:
    return X.char_grams(X.truncate(text, chars))


def term_counts(df: DataFrame, terms: Column, key: str = "row_id") -> DataFrame:
    """(key, term, tf). The texts are shuffled once by key; their terms never are."""
    each = df.select(key, terms.alias("__t")).repartition(key)
    return each.select(key, F.explode("__t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit(tf: DataFrame, n_docs: int, min_df: int = 3, max_features: int = 300_000) -> DataFrame:
    """Term table (term, df, idf): terms of at least ``min_df`` documents, the most frequent ``max_features`` of them; smooth idf ln((1+n)/(1+df))+1.

    Ties go to the lower term. Where there are more terms, a histogram of frequencies finds where the limit falls, and
    only the terms of that bin are sorted.
    """
    return chosen(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), n_docs, min_df, max_features)


def chosen(per: DataFrame, n_docs: int, min_df: int, max_features: int) -> DataFrame:
    """``fit`` from the terms' frequencies (term, df, cf)."""
    t = per.filter(F.col("df") >= min_df)
    t = materialize(t.withColumn("bin", F.floor(F.log2("cf") * 64).cast("int")), "terms")
    above, cut, room = 0, None, max_features
    for b, n in sorted(((r.bin, r.n) for r in t.groupBy("bin").agg(F.count("*").alias("n")).collect()), reverse=True):  # 64 bins an octave
        if above + n > max_features:
            cut, room = b, max_features - above
            break
        above += n
    if cut is not None:
        t = t.filter(F.col("bin") > cut).unionByName(t.filter(F.col("bin") == cut).orderBy(F.desc("cf"), "term").limit(room))
    return t.select("term", "df", (F.log(F.lit(1.0 + n_docs)) - F.log(1.0 + F.col("df")) + 1.0).alias("idf"))


def transform(tf: DataFrame, terms: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, term, w): (1 + ln tf) * idf, L2-normalised a document.

    A term table under ``MOST_TERMS`` rows is broadcast, so that frequent terms gather in no task; a larger one is joined by term.
    """
    raw = tf.join(fitting(terms.select("term", "idf"), MOST_TERMS), "term").select(key, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("x"))
    per = raw.groupBy(key).agg(F.collect_list(F.struct("term", "x")).alias("xs"), F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(1e-9)).alias("norm"))
    return per.select(key, "norm", F.explode("xs").alias("t")).select(key, "t.term", (F.col("t.x") / F.col("norm")).alias("w"))


def stack(*blocks: tuple[str, DataFrame, float]) -> DataFrame:
    """Blocks (prefix, (key, term, w), scale) side by side: terms get their block's prefix, weights its scale."""
    out = None
    for prefix, df, scale in blocks:
        key = df.columns[0]
        b = df.select(key, F.concat(F.lit(prefix), F.col("term").cast("string")).alias("term"), (F.col("w") * scale).alias("w"))
        out = b if out is None else out.unionByName(b)
    return out


def dense_block(df: DataFrame, key: str, vec: str) -> DataFrame:
    """An array column as (key, term, w)."""
    return df.select(key, F.posexplode(vec).alias("term", "w")).select(key, "term", F.col("w").cast("double").alias("w"))


def centroids(weights: DataFrame, labels: DataFrame, key: str = "row_id", by: str = "label") -> DataFrame:
    """(label, term, c): mean of the class's documents, L2-normalised. ``labels(key, label)``."""
    n = labels.groupBy(by).agg(F.count("*").alias("n"))
    s = weights.join(labels, key).groupBy(by, "term").agg(F.sum("w").alias("s")).join(n, by).withColumn("m", F.col("s") / F.col("n"))
    norm = s.groupBy(by).agg(F.greatest(F.sqrt(F.sum(F.col("m") * F.col("m"))), F.lit(1e-9)).alias("norm"))
    return s.join(norm, by).select(by, "term", (F.col("m") / F.col("norm")).alias("c"))


def centroid_scores(weights: DataFrame, cents: DataFrame, key: str = "row_id", by: str = "label") -> DataFrame:
    """(key, label, score): dot product over common terms.

    Each term has one row with its labels. Up to ``MOST_TERMS`` terms of ``MOST_CELLS`` cells in all are broadcast; the
    products of a document are then summed where they arise.
    """
    per = cents.groupBy("term").agg(F.collect_list(F.struct(by, "c")).alias("cs"))
    if cents.limit(MOST_CELLS + 1).count() <= MOST_CELLS:
        per = F.broadcast(per)
    each = weights.join(per, "term").select(key, "w", F.explode("cs").alias("c"))
    return each.groupBy(key, F.col(f"c.{by}").alias(by)).agg(F.sum(F.col("w") * F.col("c.c")).alias("score"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two numeric arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column | str) -> Column:
    """Array scaled to length 1 (or left as it is if its length is 0)."""
    col = F.col(a) if isinstance(a, str) else a
    norm = F.greatest(F.sqrt(dot(col, col)), F.lit(1e-9))
    return F.transform(col, lambda x: x.cast("double") / norm)


def mean_vectors(df: DataFrame, by: str, vec: str) -> DataFrame:
    """(by, vector): component-wise mean, L2-normalised."""
    m = df.select(by, F.posexplode(vec).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = m.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    return v.select(by, normalized("v").alias("vector"))


def prototype_scores(docs: DataFrame, prototypes: DataFrame, key: str, vec: str, by: str, most: int = 100_000) -> DataFrame:
    """(key, by, score): every document against every prototype of the label space.

    The prototypes are one row a label; they are broadcast in blocks of about ``most``, each of which all documents meet.
    """
    blocks = max(1, math.ceil(prototypes.count() / most))
    out = None
    for k in range(blocks):
        part = prototypes.filter(F.pmod(F.xxhash64(by), F.lit(blocks)) == k)
        listed = part.select(F.struct(F.col(by).alias("by"), F.col("vector").alias("v")).alias("p")).agg(F.collect_list("p").alias("ps"))
        one = docs.select(key, vec).join(F.broadcast(listed)).select(key, vec, F.explode("ps").alias("p")).select(key, F.col("p.by").alias(by), dot(vec, "p.v").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def hashed_embedding(df: DataFrame, text: str = "text", size: int = 64, chars: int = 2000, key: str = "row_id") -> DataFrame:
    """(key, embedding): unit vector of hashed tokens with hashed signs; stands in for a sentence encoder."""
    tok = df.select(key, F.explode(X.tokenize(X.truncate(text, chars))).alias("t"))
    cell = tok.select(key, F.pmod(F.xxhash64("t"), F.lit(size)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"))
    per = cell.groupBy(key, "i").agg(F.sum("s").alias("x")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    full = per.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(0.0))).alias("v"))
    return full.select(key, normalized("v").alias("embedding"))


def pooled_embedding(df: DataFrame, encode, key: str = "row_id", text: str = "text", chars: int = 2000) -> DataFrame:
    """(key, embedding) by a pluggable encoder, made once a worker: ``encode()`` returns a function from a list of texts
    to pairs of arrays (token vectors, mask); vectors are mean-pooled over the mask and L2-normalised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        model = encode()
        for b in batches:
            vec, mask = model(b["t"].tolist())
            m = mask[..., None].astype(float)
            v = (vec * m).sum(1) / np.maximum(m.sum(1), 1e-9)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            yield pd.DataFrame({key: b[key], "embedding": list(v)})

    return df.select(key, X.truncate(text, chars).alias("t")).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<double>")


def space(terms: DataFrame) -> DataFrame:
    """(n_terms, min_df, max_df) of a fitted space."""
    return terms.agg(F.count("*").alias("n_terms"), F.min("df").alias("min_df"), F.max("df").alias("max_df"))
