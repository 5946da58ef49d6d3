"""Command line: prepare, warm-cache, train, evaluate, predict over a folder of parquet tables."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession, functions as F

from .operators import labels
from .plans import pipeline
from .plans.runtime import clean, session, ship
from .sources.tables import Settings, corpus, read_splits, whole_texts, write_aliases, write_report, write_reports, write_splits


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("prepare", "warm-cache", "train", "evaluate", "predict"):
        s = sub.add_parser(verb)
        s.add_argument("-c", "--config")
        s.add_argument("--data", default=os.environ.get("BENCH_SF_DIR", "."))
        if verb == "prepare":
            s.add_argument("--rebuild", action="store_true", help="make the split cache anew")
        if verb in ("warm-cache", "train"):
            s.add_argument("--skip-embeddings", action="store_true")
        if verb == "evaluate":
            s.add_argument("--split", default="test")
        if verb == "predict":
            s.add_argument("--text")
            s.add_argument("--file")
            s.add_argument("--top-k", type=int, default=3)
            s.add_argument("--out", help="folder for the records; without it they are printed, as for a single text")
    a = p.parse_args(argv)
    spark = session()
    try:
        return run(spark, a)
    finally:
        clean(spark)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    ship(spark)
    st = Settings.load(a.config)
    if getattr(a, "skip_embeddings", False):
        st.use_embeddings = False
    if a.verb == "predict":
        # one row a file, numbered by its path
        docs = whole_texts(spark, a.file).select(F.xxhash64("path").alias("row_id"), "text", "path") if a.file else spark.createDataFrame([(0, a.text or "", "")], "row_id bigint, text string, path string")
        got = pipeline.Bundle.load(spark, st.path("models")).predict(docs, a.top_k).join(docs.select("row_id", "path"), "row_id")
        if a.out:
            got.write.mode("overwrite").json(a.out)
            return 0
        for r in got.toJSON().toLocalIterator():
            print(r)
        return 0
    domains = spark.read.parquet(f"{a.data}/domain_list.parquet")
    cache = st.path("cache", "splits")
    cached = None if getattr(a, "rebuild", False) else read_splits(spark, cache)
    if cached is None or a.verb == "prepare":
        rows, vocab, reports = pipeline.run_prepare(corpus(spark, a.data).filter("uid is not null"), domains, st)
        if cached is None:
            write_splits(rows, cache)
        if a.verb == "prepare":
            write_reports(reports, st.path("reports"), "prepare")
            return 0
    else:
        rows, vocab = cached, labels.vocabulary(cached.filter("split = 'train'"))
    store = lambda spark, st: pipeline.hashed_store(spark, st, st.path("cache", "embeddings"))
    if a.verb == "warm-cache":
        if st.use_embeddings:
            print(store(spark, st).get(rows).count(), "vectors")
    elif a.verb == "train":
        b = pipeline.run_train(rows, vocab, domains, st, store=store)
        b.save(st.path("models"))
        write_report(spark, b.report, st.path("reports", "training.json"))
    else:
        out = pipeline.run_evaluate(pipeline.Bundle.load(spark, st.path("models")), rows, a.split)
        write_reports(out, st.path("reports"), f"evaluation_{a.split}")
        best = out["recommended"].first()
        if best is not None:
            write_aliases(out["aliases"], st.path("models", "aliases"), best.threshold)
            print(json.dumps({"recommended_threshold": best.threshold}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
