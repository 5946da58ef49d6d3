"""Session, shared-folder and materialisation helpers used by every multi-step plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def session(app: str = "tessera", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the plans expect; existing sessions are reused."""
    b = SparkSession.builder
    if not SparkConf().contains("spark.master"):  # else as submitted
        b = b.master(f"local[{cores}]")
    b = (
        b.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local session without it gets a folder of its own; any other is refused."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder, under one folder a session."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete the session's intermediate tables; for the end of a session, as results read them."""
    delete(spark, f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str, partition_by: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor. ``clean`` deletes the session's tables.
    """
    path = scratch(df.sparkSession, name)
    w = df.write.option("compression", codec)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def fitting(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row in a total order.

    Rows are numbered inside ranges, as many as there are shuffle partitions, and offset by the ranges before: no task sorts all.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = materialize(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    offsets, upto = [], 0
    for p, n in sorted((r["__p"], r["n"]) for r in d.groupBy("__p").agg(F.count("*").alias("n")).collect()):  # one row a range
        offsets.append((p, upto))
        upto += n
    base = spark.createDataFrame(offsets, "__p int, __base bigint")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return d.join(F.broadcast(base), "__p").withColumn(out, own + F.col("__base")).drop("__p", "__base")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files (URI, bytes) of a table folder without partitions."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return [(str(f.getPath().toString()), int(f.getLen())) for f in found if not f.getPath().getName().startswith(("_", ".")) and f.getLen() > 0]


def local_view(path: str) -> tuple[object, str]:
    """pyarrow file system and path of a URI, for workers that read a bounded table of the shared folder."""
    from pyarrow import fs

    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Parquet tables of a data folder."""
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once a session, so that they needn't have it installed."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(out, "w") as z:
        for base, _, files in os.walk(os.path.join(root, "tessera")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(base, f), os.path.relpath(os.path.join(base, f), root))
    sc.addPyFile(out)
    sc._tessera_shipped = True
