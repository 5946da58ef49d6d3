"""Linear heads on hashed or counted term vectors, and their calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.runtime import fitting, materialize, ranked
from .features import MOST_TERMS
from .labels import TOPS

GRID = (0.5, 1.0, 2.0, 4.0, 8.0)


def vectors(weights: DataFrame, terms: DataFrame, key: str = "row_id", docs: DataFrame | None = None) -> DataFrame:
    """(key, features): sparse vectors of (key, term, w) over the term table, terms numbered in term order.

    With ``docs(key)``, documents without any term get the empty vector. Arrow batches only pack ready arrays.
    """
    return packed(weights, materialize(ranked(terms.select("term"), [F.col("term")], "i"), "numbered"), key, docs)


def packed(weights: DataFrame, idx: DataFrame, key: str = "row_id", docs: DataFrame | None = None) -> DataFrame:
    """``vectors`` for terms already numbered from 1: ``idx(term, i)``."""
    size = idx.count()
    long = weights.join(fitting(idx, MOST_TERMS), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.col("i") - 1).cast("int").alias("i"), F.col("w").cast("double").alias("w")))).alias("iw"))
    if docs is not None:
        long = docs.select(key).join(long, key, "left")
    iw = F.coalesce("iw", F.array().cast("array<struct<i:int,w:double>>"))
    flat = long.select(key, F.transform(iw, lambda x: x["i"]).alias("indices"), F.transform(iw, lambda x: x["w"]).alias("values"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            v = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), b.column(1), b.column(2)], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([b.column(0), v], names=[key, "features"])

    return flat.mapInArrow(pack, T.StructType([T.StructField(key, weights.schema[key].dataType), T.StructField("features", VectorUDT())]))


def fit_margins(train: DataFrame, c: float = 1.0, weight: str | None = None, kind: str = "svm"):
    """One-vs-rest linear SVM (hinge loss) or multinomial logistic regression on (features, label)."""
    n = max(train.count(), 1)
    reg = 1.0 / (c * n)
    if kind == "svm":
        base = LinearSVC(regParam=reg, maxIter=50, standardization=False)
        ovr = OneVsRest(classifier=base, labelCol="label", featuresCol="features")
        return (ovr.setWeightCol(weight) if weight else ovr).fit(train)
    lr = LogisticRegression(family="multinomial", regParam=reg, maxIter=50, standardization=False)
    return (lr.setWeightCol(weight) if weight else lr).fit(train)


def margins(model, df: DataFrame, key: str = "row_id", out: str = "margins") -> DataFrame:
    """(key, margins array<double>), one a class."""
    return model.transform(df).select(key, vector_to_array("rawPrediction").alias(out))


def platt(dev: DataFrame, label: str = "label", column: str = "margins"):
    """Multinomial logistic regression on margins; None if fewer than two classes occur."""
    if dev.select(label).distinct().limit(2).count() < 2:
        return None
    d = dev.select(array_to_vector(column).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", regParam=1.0 / max(d.count(), 1), maxIter=200, standardization=False).fit(d)


def calibrated(model, df: DataFrame, key: str = "row_id", column: str = "margins", tops: tuple[str, ...] = TOPS) -> DataFrame:
    """(key, top, lp): log probabilities; without a model the log-softmax of the margins. Absent classes get -1e4."""
    if model is None:
        e = F.transform(column, lambda x: F.exp(x - F.array_max(column)))
        p = df.select(key, F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)).alias("p"))
    else:
        p = model.transform(df.select(key, array_to_vector(column).alias("features"))).select(key, vector_to_array("probability").alias("p"))
    named = F.array(*[F.struct(F.lit(t).alias("top"), F.coalesce(F.try_element_at("p", F.lit(i + 1)), F.lit(0.0)).alias("p")) for i, t in enumerate(tops)])
    return p.select(key, F.explode(named).alias("x")).select(key, "x.top", F.greatest(F.log(F.greatest(F.col("x.p"), F.lit(1e-300))), F.lit(-1e4)).alias("lp"))


def select_c(train: DataFrame, dev: DataFrame, grid: tuple[float, ...] = GRID, weight: str | None = None, kind: str = "lr", key: str = "row_id"):
    """(model, c, accuracy) of the grid's best dev accuracy, the first on ties."""
    best = None
    for c in grid:
        m = fit_margins(train, c, weight, kind)
        r = m.transform(dev).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()
        a = r.a or 0.0
        if best is None or a > best[2]:
            best = (m, c, a)
    return best


def fit_head(train: DataFrame, dev: DataFrame, n_classes: int, grid: tuple[float, ...], key: str = "row_id"):
    """(model, {c: dev accuracy}, c): the linear head of one label space, the first of the best C on dev rows.

    One multinomial fit a value of C; its coefficients are classes x features, whatever the number of rows. Dev rows
    with a label out of the space (-1) count as wrong.
    """
    best, told = None, {}
    for c in grid:
        m = fit_margins(train, c, None, "lr")
        r = head_scores(m, dev, n_classes, key, ["label"]).withColumn("hit", (F.array_position("margins", F.array_max("margins")) - 1 == F.col("label")).cast("double")).agg(F.avg("hit").alias("a")).first()
        told[c] = float(r.a or 0.0)
        if best is None or told[c] > told[best[1]]:
            best = (m, c)
    return best[0], told, best[1]


def head_scores(model, df: DataFrame, n_classes: int, key: str = "row_id", keep: list[str] | None = None) -> DataFrame:
    """(key, *keep, margins): one margin a class; classes the head never saw get one below the least."""
    m = model.transform(df).select(key, *(keep or []), vector_to_array("rawPrediction").alias("m"))
    fill = F.array_repeat(F.array_min("m") - 1.0, F.greatest(F.lit(n_classes) - F.size("m"), F.lit(0)))
    return m.select(key, *(keep or []), F.slice(F.concat("m", fill), 1, n_classes).alias("margins"))
