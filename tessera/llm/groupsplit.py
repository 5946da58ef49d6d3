"""Splits that keep related records together (problem 2).

Method: iterative minimum-label propagation over the bipartite record-entity graph finds the groups; groups are then
assigned so that the label distributions of the splits deviate least. Every group is placed, in order of falling size,
where the squared deviation of its whole label histogram from the splits' targets grows least. Groups of more than one
in ``MOST_BIG`` rows (hence at most so many) are placed first, against the targets of all rows; all others in blocks,
each against the targets that are left, in proportion. A block has the groups with the same rarest label (so that rare
labels are balanced exactly) and at most about ``BLOCK_CELLS`` cells of histograms; larger ones are divided by a hash.

Defined results: a record without any entity is a group of its own; null and blank labels form the label ``?``; labels
of under one in ``MOST_STRATA`` rows are balanced together; an empty table gives an empty result; repeated rows stay with
their group; ties go to the earlier split.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import uid_key as standard_uid  # noqa: F401
from ..plans.runtime import delete, materialize

MOST_BIG = 200  # groups placed one by one
MOST_STRATA = 2_000  # labels told apart
BLOCK_CELLS = 20_000
SPLITS = (("train", 0.70), ("dev", 0.15), ("test", 0.15))
SEED = 20240917


def standard_label(c: str) -> Column:
    """A hand-typed label, trimmed and lower-cased; ``?`` if null or blank."""
    t = F.lower(F.regexp_replace(F.col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(F.length(t) > 0, t).otherwise(F.lit("?"))


def entity_labels(df: DataFrame, entities: dict[str, Column]) -> DataFrame:
    """Group label (node, label) of each entity by minimum-label propagation.

    ``entities``: kind -> column expression. Records with the same entities are one node of the graph, so that hot
    entities cost one row each. Each round takes the minimum over both sides and follows labels of labels; rounds
    are written to the shared folder.
    """
    spark = df.sparkSession
    if len(entities) == 1:
        kind, col = next(iter(entities.items()))
        nodes = F.array_compact(F.array(F.when(col.isNotNull(), F.concat(F.lit(kind + "\x1f"), col))))
    else:
        nodes = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(k + "\x1f"), c)) for k, c in entities.items()]))))
    sigs = df.select(nodes.alias("nodes")).filter(F.size("nodes") > 0).groupBy("nodes").agg(F.count("*").alias("n"))
    edges = materialize(sigs.select(F.explode("nodes").alias("node"), F.array_join("nodes", "\x1e").alias("sig")), "edges")
    labels = materialize(edges.groupBy("node").agg(F.min("node").alias("label")), "labels")
    while True:
        sig_label = edges.join(labels, "node").groupBy("sig").agg(F.min("label").alias("low"))
        node_label = edges.join(sig_label, "sig").groupBy("node").agg(F.min("low").alias("low"))
        step = labels.join(node_label, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = materialize(new, "labels")
        old, changed = labels._tessera_path, not new.filter("was <> label").isEmpty()
        labels = new.select("node", "label")
        labels._tessera_path = new._tessera_path
        delete(spark, old)
        if not changed:
            return labels


def cross_split_groups(df: DataFrame, kind: str, entity: Column, split_col: str) -> DataFrame:
    """Groups (entity, splits) whose rows lie in more than one delivered split; null splits don't count."""
    rows = df.withColumn("__e", entity).filter(F.col("__e").isNotNull())
    seen = rows.filter(F.col(split_col).isNotNull()).groupBy("__e", F.col(split_col).alias("__s")).agg(F.count("*").alias("n"))
    labels = entity_labels(rows, {kind: F.col("__e")})
    by = seen.join(labels.withColumn("__e", F.substring_index("node", "\x1f", -1)), "__e")
    return by.groupBy("label").agg(F.array_sort(F.collect_set("__s")).alias("splits")).filter(F.size("splits") > 1).select(F.substring_index("label", "\x1f", -1).alias("entity"), "splits")


def join_hot(rows: DataFrame, right: DataFrame, on: str, most: int = MOST_BIG) -> DataFrame:
    """Left join in which keys of more than one in ``most`` rows (at most so many) don't meet in one task.

    ``right`` has one row a key. Those of the hot keys are broadcast, being ``most`` rows at most; all others are shuffled.
    """
    n = rows.count()
    hot = materialize(rows.groupBy(on).agg(F.count("*").alias("__n")).filter(F.col("__n") > F.lit(n / most)).select(on, F.lit(True).alias("__hot")), "hot")
    few = materialize(right.join(F.broadcast(hot), on), "hot-rows")
    marked = rows.join(F.broadcast(hot), on, "left")
    return marked.filter("__hot").drop("__hot").join(F.broadcast(few.drop("__hot")), on, "left").unionByName(marked.filter("__hot is null").drop("__hot").join(right, on, "left"))


def least_deviation(groups: list[tuple[str, list[tuple[int, int]]]], target: dict[tuple[int, int], float], n_splits: int) -> list[int]:
    """Split of each group (name, [(label, rows)]), placed in order of falling size; ``target``: rows left by (label, split), updated."""
    out = [0] * len(groups)
    for i in sorted(range(len(groups)), key=lambda i: (-sum(n for _, n in groups[i][1]), groups[i][0])):
        hist = groups[i][1]
        # the square of (target - rows) less that of the target
        worse = [sum(n * n - 2 * n * target[s, x] for s, n in hist) for x in range(n_splits)]
        out[i] = to = worse.index(min(worse))
        for s, n in hist:
            target[s, to] -= n
    return out


def _dither(seed: int, block: str, s: int, x: int) -> float:
    """Below half a row either way, so that what rounds off in one block doesn't in all."""
    return hashlib.blake2b(f"{seed}|{block}|{s}|{x}".encode(), digest_size=2).digest()[0] / 256 - 0.5


def assign_splits(df: DataFrame, key: str, entities: dict[str, Column], labels: list[Column], splits=SPLITS, seed: int = SEED) -> DataFrame:
    """Split of each row: (key, grp, split). All rows of a connected group get the same one."""
    spark = df.sparkSession
    if len(entities) == 1:
        (kind, col), = entities.items()
        first = F.when(col.isNotNull(), F.concat(F.lit(kind + "\x1f"), col))
    else:
        first = F.coalesce(*[F.when(c.isNotNull(), F.concat(F.lit(k + "\x1f"), c)) for k, c in entities.items()])
    own = F.concat(F.lit("row\x1f"), F.col(key).cast("string"))  # also keeps null entities off a single join key
    rows = materialize(df.select(F.col(key).alias("key"), F.coalesce(first, own).alias("node"), F.concat_ws("|", *labels).alias("label_")), "rows")
    found = entity_labels(df, entities)
    rows = join_hot(rows, found, "node").select("key", F.coalesce("label", "node").alias("grp"), "label_")
    rows = materialize(rows, "grouped")
    counts = materialize(rows.groupBy("grp", "label_").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    per = counts.groupBy("label_").agg(F.sum("n").alias("rows"))
    known = [r.label_ for r in per.filter(F.col("rows") >= total / MOST_STRATA).orderBy("rows", "label_").collect()]  # at most MOST_STRATA
    ids = spark.createDataFrame([(x, i) for i, x in enumerate(known)], "label_ string, s int")
    cells = counts.join(F.broadcast(ids), "label_", "left").groupBy("grp", F.coalesce("s", F.lit(-1)).alias("s")).agg(F.sum("n").alias("n"))
    groups = materialize(cells.groupBy("grp").agg(F.sum("n").alias("size"), F.min("s").alias("rarest"), F.array_sort(F.collect_list(F.struct("s", "n"))).alias("hist")), "groups")
    stock = {r.s: r.n for r in groups.select(F.explode("hist").alias("h")).groupBy("h.s").agg(F.sum("h.n").alias("n")).collect()}  # a row a label
    names = [x for x, _ in splits]
    left = {(s, x): n * r for s, n in stock.items() for x, (_, r) in enumerate(splits)}
    is_big = F.col("size") > total / MOST_BIG
    big = [(r.grp, [(h.s, h.n) for h in r.hist]) for r in groups.filter(is_big).collect()]  # at most MOST_BIG
    placed = [(g, names[x]) for (g, _), x in zip(big, least_deviation(big, left, len(names)))]
    for _, hist in big:
        for s, n in hist:
            stock[s] -= n
    # what is left of each label, as shares of the rows not yet placed
    room = {s: [max(0.0, left[s, x]) for x in range(len(names))] for s in stock}
    shares = {s: [v / sum(r) for v in r] if sum(r) else [q for _, q in splits] for s, r in room.items()}
    small = groups.filter(~is_big)
    width = small.groupBy("rarest").agg(F.ceil(F.sum(F.size("hist")) / BLOCK_CELLS).alias("k"))  # a row a label
    blocks = small.join(F.broadcast(width), "rarest").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "grp"), F.col("k")))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = [(g, [(h["s"], h["n"]) for h in hist]) for g, hist in zip(pdf["grp"], pdf["hist"])]
        n: dict[int, int] = defaultdict(int)
        for _, hist in mine:
            for s, k in hist:
                n[s] += k
        name = f"{pdf['rarest'].iloc[0]}|{pdf['part'].iloc[0]}"
        target = {(s, x): k * shares[s][x] + _dither(seed, name, s, x) for s, k in n.items() for x in range(len(names))}
        return pd.DataFrame({"grp": pdf["grp"], "split": [names[x] for x in least_deviation(mine, target, len(names))]})

    rest = materialize(blocks.groupBy("rarest", "part").applyInPandas(place, "grp string, split string"), "placed")
    chosen = spark.createDataFrame(placed, "grp string, split string")
    marked = rows.join(F.broadcast(chosen), "grp", "left")  # at most MOST_BIG rows
    done = marked.filter("split is not null").unionByName(marked.filter("split is null").drop("split").join(rest, "grp"))
    return done.select(F.col("key").alias(key), F.regexp_replace("grp", "^[^\x1f]*\x1f", "").alias("grp"), "split")


def split_report(df: DataFrame, assigned: DataFrame, key: str, labels: dict[str, Column]) -> DataFrame:
    """Rows by split and label value with the share of the label's rows: (label, value, split, n_rows, share)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), c.alias("value")) for k, c in labels.items()]))
    cells = df.select(key, pairs.alias("p")).join(assigned.select(key, "split"), key).groupBy("p.label", "p.value", "split").agg(F.count("*").alias("n_rows"))
    tot = cells.groupBy("label", "value").agg(F.sum("n_rows").alias("t"))
    return cells.join(tot, ["label", "value"]).select("label", "value", "split", "n_rows", F.round(F.col("n_rows") / F.col("t"), 6).alias("share"))
