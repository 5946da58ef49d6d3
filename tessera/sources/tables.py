"""Sources and sinks: pooled scans, the corpus view, split cache, artifact layout, vocabulary and alias files, text files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X

COLUMNS = ("uid", "domain", "document_type", "document_description", "document_format", "locale", "text")

# The grid of ensemble weights, the thresholds of label merging, and the grids of C of both tiers.
WEIGHTS = (0.0, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)
MERGE_THRESHOLDS = (0.5, 0.35, 0.25, 0.18, 0.12, 0.08)
C_TIER1 = (0.5, 1.0, 2.0, 4.0, 8.0)
C_TIER2 = (1.0, 2.0, 4.0, 8.0)


@dataclass
class Settings:
    """Parameters of a run; ``load`` reads a YAML file over the defaults."""

    seed: int = 20240917
    fractions: tuple[float, float, float] = (0.70, 0.15, 0.15)
    industries: tuple[str, ...] = ("healthcare", "finance", "government")
    other: str = "other"
    heading_window: int = 400
    body_chars: int = 2500
    idf_chars: int = 2000
    # tier 1: words and pairs; tier 2: also characters
    min_df: int = 3
    tier2_min_df: int = 2
    max_features: int = 300_000
    char_chars: int = 1200
    char_min_df: int = 3
    char_max_features: int = 300_000
    use_embeddings: bool = True
    embedding_size: int = 64
    embedding_chars: int = 2000
    embedding_scale: float = 0.6
    most_descriptions: int = 6
    ensemble_grid: tuple[float, ...] = WEIGHTS
    hard_negative_weight: float = 1.5
    c_grid: tuple[float, ...] = C_TIER1
    tier2_c_grid: tuple[float, ...] = C_TIER2
    lambdas: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5)
    merge_thresholds: tuple[float, ...] = MERGE_THRESHOLDS
    merge_ratio: float = 0.5
    max_cluster: int = 8
    artifacts: str = field(default_factory=lambda: os.environ.get("TESSERA_ARTIFACTS", "artifacts"))

    @classmethod
    def load(cls, path: str | None = None) -> Settings:
        if not path:
            return cls()
        import yaml

        raw = yaml.safe_load(Path(path).read_text()) or {}
        unknown = set(raw) - {f for f in cls.__dataclass_fields__}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    def path(self, kind: str, name: str = "") -> str:
        """Folder or file of an artifact kind: raw, data, cache, models, reports."""
        return os.path.join(self.artifacts, kind, name) if name else os.path.join(self.artifacts, kind)


def pooled(spark: SparkSession, *paths: str) -> DataFrame:
    """Only the seven raw columns of all given parquet tables, one after another."""
    parts = [spark.read.parquet(p).select(*COLUMNS) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fetch(spark: SparkSession, source: str, target: str, columns: tuple[str, ...] = COLUMNS, force: bool = False) -> DataFrame:
    """Copy the wanted columns of a table once; later calls read the copy."""
    if force or not _exists(spark, target):
        spark.read.parquet(source).select(*columns).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames table in the shape every operator takes: labels trimmed and lower-cased, uid in standard spelling."""
    f = spark.read.parquet(f"{sf_dir}/frames.parquet")
    low = lambda c: F.lower(F.trim(F.col(c)))
    return f.select("row_id", X.uid_key("uid").alias("uid"), "domain", low("top").alias("top"), X.normalize_tag("tag").alias("tag"), "description", low("document_format").alias("document_format"), low("locale").alias("locale"), "text", "source", F.col("split_name").alias("split"))


def write_splits(df: DataFrame, path: str) -> None:
    """Split cache, one folder a split, so that a reader of one split touches no other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, rebuild=None) -> DataFrame | None:
    """The split cache; if it is missing and ``rebuild`` is given, made by it and written first."""
    if not _exists(spark, path):
        if rebuild is None:
            return None
        write_splits(rebuild(), path)
    return spark.read.parquet(path)


def content_key(text: str = "text", limit: int = 2000, signature: str = ""):
    """Key of a text's vector: its first characters, and the signature of the model that makes it."""
    t = X.truncate(text, limit)
    return F.sha2(F.concat(F.lit(signature + "\x1f"), t) if signature else t, 256)


def cache_misses(df: DataFrame, cache: DataFrame, text: str = "text", limit: int = 2000, signature: str = "") -> DataFrame:
    """Distinct texts whose content key the cache lacks: (key, text)."""
    wanted = df.groupBy(content_key(text, limit, signature).alias("key")).agg(F.first(X.truncate(text, limit)).alias("text"))
    return wanted.join(cache.select("key"), "key", "left_anti")


def embed_cached(df: DataFrame, path: str, embed, text: str = "text", limit: int = 2000, signature: str = "") -> DataFrame:
    """(key, embedding) of every distinct text; only misses are embedded by ``embed(DataFrame(key, text))`` and appended."""
    spark = df.sparkSession
    cache = spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], "key string, embedding array<double>")
    embed(cache_misses(df, cache, text, limit, signature)).select("key", F.col("embedding").cast("array<double>").alias("embedding")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


class EmbeddingStore:
    """Vectors of documents from a cache folder; texts it lacks are embedded once, whatever rows have them."""

    def __init__(self, path: str, embed, signature: str, limit: int = 2000):
        self.path, self.embed, self.signature, self.limit = path, embed, signature, limit

    def get(self, df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
        """(key, embedding) of ``df(key, text)``."""
        cache = embed_cached(df, self.path, self.embed, text, self.limit, self.signature)
        keyed = df.select(key, content_key(text, self.limit, self.signature).alias("key"))
        return keyed.join(cache.dropDuplicates(["key"]), "key").select(key, "embedding")


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.write.mode("overwrite").parquet(path)


def vocabulary_json(vocabulary: DataFrame) -> DataFrame:
    """One JSON list of tags a class, in index order: (top, tags_json)."""
    return vocabulary.groupBy("top").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("tag_idx", "tag"))), lambda x: x["tag"])).alias("tags_json"))


def vocabulary_from_json(df: DataFrame) -> DataFrame:
    """(top, tag_idx, tag) of ``vocabulary_json``."""
    return df.select("top", F.posexplode(F.from_json("tags_json", "array<string>")).alias("tag_idx", "tag"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, None if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as JSON."""
    write_text(spark, path, json.dumps(report, indent=2, sort_keys=True, default=str))


def write_aliases(aliases: DataFrame, path: str, threshold: float) -> None:
    """The alias table (top, tag, canonical) of one threshold."""
    aliases.filter(F.col("threshold") == threshold).select("top", "tag", "canonical").write.mode("overwrite").parquet(path)


UNBOUNDED = ("domains", "leaks", "aliases")  # reports that grow with the data


def write_reports(reports: dict[str, DataFrame], folder: str, name: str, most: int = 10_000) -> None:
    """``name``.json with the rows of each bounded report; an unbounded one, or any of over ``most`` rows, is a table
    ``name``/report of the folder, for which the JSON has its path and number of rows."""
    out = {}
    for k, v in reports.items():
        rows = [] if k in UNBOUNDED else v.limit(most + 1).collect()
        if k in UNBOUNDED or len(rows) > most:
            path = os.path.join(folder, name, k)
            v.write.mode("overwrite").parquet(path)
            out[k] = {"table": path, "rows": v.sparkSession.read.schema(v.schema).parquet(path).count()}
        else:
            out[k] = [r.asDict(True) for r in rows]
    spark = next(iter(reports.values())).sparkSession
    write_report(spark, out, os.path.join(folder, f"{name}.json"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, text) a text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def fingerprint(df: DataFrame, most: int = 64) -> DataFrame:
    """16 hex digits a split that change with its size or its first uids: (split, n_rows, fingerprint).

    The smallest uids are found by a distributed top-k, not by collecting all of a split.
    """
    from pyspark.sql import Window as W

    n = df.groupBy("split").agg(F.count("*").alias("n_rows"))
    uids = df.select("split", "uid").filter("uid is not null").distinct()
    first = uids.withColumn("k", F.row_number().over(W.partitionBy("split").orderBy("uid"))).filter(F.col("k") <= most)
    listed = first.groupBy("split").agg(F.array_join(F.array_sort(F.collect_list("uid")), ",").alias("uids"))
    return n.join(listed, "split").select("split", "n_rows", F.substring(F.sha2(F.concat_ws("|", "split", "n_rows", "uids"), 256), 1, 16).alias("fingerprint"))
