"""Frequency of every distinct value or term (problem 4).

Method: a global integer dictionary is built (distinct terms, numbered by hash partition with offsets); each task
first counts the terms of its own rows, both occurrences and rows; those partial counts are encoded by a join with
the dictionary and added into count arrays of identifier ranges, which are summed range by range. A hot term costs
one partial row a task, so no key is skewed.

Defined results: null and blank values give no term; a term occurring twice in a row counts as two occurrences and
one row; ``mark`` is ``rare`` below ``rare_below`` rows, ``common`` above ``common_over`` of all rows (rare first
where both hold), else null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.runtime import materialize

BLOCK = 1 << 16  # identifiers a count array
KEPT = 500_000  # distinct terms a task holds before it hands on what it has
BLANK = r"^[\s\p{Z}\p{Cc}]*$"


def value_terms(c: str) -> Column:
    """The value itself as the only term; none if null or blank."""
    return F.when(F.col(c).isNotNull() & ~F.col(c).rlike(BLANK), F.array(F.col(c))).otherwise(F.array().cast("array<string>"))


def word_terms(c: str) -> Column:
    """Maximal runs of a-z and 0-9 in the lower-cased value."""
    return F.coalesce(F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def _partial(fields: list[str]):
    """Counts of each task's own rows: (field, term, occurrences, rows)."""

    def flush(held: list[dict[str, list[int]]]) -> Iterator[pa.RecordBatch]:
        for name, d in zip(fields, held):
            terms = list(d)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part, pa.string()), pa.array([d[t][0] for t in part], pa.int64()), pa.array([d[t][1] for t in part], pa.int64())], names=["field_name", "term", "occ", "n_rows"])
            d.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, list[int]]] = [{} for _ in fields]
        n_rows = 0
        for b in batches:
            n_rows += b.num_rows
            for k, d in enumerate(held):
                col = b.column(k)
                flat, owner = col.flatten(), pc.list_parent_indices(col)
                if not len(flat):
                    continue
                enc = flat.dictionary_encode()
                code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                n = len(enc.dictionary)
                occ = np.bincount(code, minlength=n)
                # one per row and term
                pair = np.unique(owner.to_numpy(zero_copy_only=False).astype(np.int64) * n + code)
                rows = np.bincount(pair % n, minlength=n)
                for t, o, r in zip(enc.dictionary.to_pylist(), occ.tolist(), rows.tolist()):
                    if (x := d.get(t)) is None:
                        d[t] = [o, r]
                    else:
                        x[0] += o
                        x[1] += r
            if sum(map(len, held)) > KEPT:
                yield from flush(held)
        yield from flush(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([n_rows], pa.int64()), pa.array([n_rows], pa.int64())], names=["field_name", "term", "occ", "n_rows"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], names=["field_name", "term", "part", "at"])
        at += n


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds partial counts into arrays of one identifier range after another."""
    blocks: dict[int, np.ndarray] = {}
    for b in batches:
        ident = b.column(0).to_numpy(zero_copy_only=False)
        which = ident // BLOCK
        occ, rows = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        for k in np.unique(which):
            here = which == k
            a = blocks.setdefault(int(k), np.zeros((2, BLOCK), dtype=np.int64))
            np.add.at(a[0], ident[here] - k * BLOCK, occ[here])
            np.add.at(a[1], ident[here] - k * BLOCK, rows[here])
    for k, a in blocks.items():
        used = np.flatnonzero(a[0])
        yield pa.RecordBatch.from_arrays([pa.array(used + k * BLOCK), pa.array(a[0][used]), pa.array(a[1][used])], names=["id", "n_occurrences", "n_rows"])


def term_counts(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field_name, term, id, n_occurrences, n_rows) of every distinct term of ``fields`` (name -> array of terms)."""
    return _counted(df, fields)[0]


def _counted(df: DataFrame, fields: dict[str, Column]) -> tuple[DataFrame, int]:
    """``term_counts`` and the number of all rows, from one pass over ``df``."""
    part = df.select(*[c.alias(f"f{i}") for i, c in enumerate(fields.values())]).mapInArrow(_partial(list(fields)), "field_name string, term string, occ bigint, n_rows bigint")
    part = materialize(part, "partial")
    total = part.filter("field_name is null").agg(F.sum("n_rows")).first()[0] or 0
    part = part.filter("field_name is not null")
    dic = materialize(part.select("field_name", "term").distinct().mapInArrow(_numbered, "field_name string, term string, part int, at bigint"), "dictionary")
    sizes = sorted((r.part, r.n) for r in dic.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    offsets, upto = [], 0
    for p, n in sizes:
        offsets.append((p, upto))
        upto += n
    off = df.sparkSession.createDataFrame(offsets, "part int, base bigint")
    dic = dic.join(F.broadcast(off), "part").select("field_name", "term", (F.col("base") + F.col("at")).alias("id"))
    coded = part.join(dic, ["field_name", "term"]).select("id", "occ", "n_rows", F.floor(F.col("id") / BLOCK).alias("block"))
    ranges = max(1, min(upto // BLOCK + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sums = coded.repartition(ranges, "block").select("id", "occ", "n_rows").mapInArrow(_block_sums, "id bigint, n_occurrences bigint, n_rows bigint")
    return dic.join(sums, "id").select("field_name", "term", "id", "n_occurrences", "n_rows"), total


def marked(df: DataFrame, fields: dict[str, Column], rare_below: int = 3, common_over: float = 0.05) -> DataFrame:
    """``term_counts`` with ``mark``."""
    counts, total = _counted(df, fields)
    mark = F.when(F.col("n_rows") < rare_below, "rare").when(F.col("n_rows") > F.lit(total * common_over), "common")
    return counts.withColumn("mark", mark)
