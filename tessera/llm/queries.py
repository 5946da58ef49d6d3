"""Queries of the training-data problems: pN_... (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.runtime import materialize, tables
from . import bpe, canonical, groupsplit, mixing, overlap, pii, sentences, surrogates, termcounts


def _lists(spark: SparkSession, d: str) -> dict:
    domains, tags = tables(spark, d, "domain_list", "tag_list")
    return {"domain": (domains, "domain_ref", "domain"), "tag": (tags, "tag_ref", "tag")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    (frames,) = tables(spark, d, "frames")
    return canonical.map_fields(frames, "row_id", _lists(spark, d))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that mean no entry, with their rows."""
    (frames,) = tables(spark, d, "frames")
    return canonical.unmatched(frames, _lists(spark, d))


def p1_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per field: rows mapped, whether every reference is an entry of the field's list or none, and whether the unmatched values have as many rows as are mapped to none."""
    lists = _lists(spark, d)
    found = materialize(p1_found(spark, d), "found")
    known = None
    for name, (ref, ref_id, _) in lists.items():
        one = ref.select(F.lit(name).alias("field_name"), F.col(ref_id).alias("ref_id"))
        known = one if known is None else known.unionByName(one)
    at = found.join(known.withColumn("known", F.lit(True)), ["field_name", "ref_id"], "left")
    per = at.groupBy("field_name").agg(F.count("*").alias("n_rows"), F.bool_and(F.coalesce("known", F.lit(False)) | (F.col("ref_id") == canonical.NONE)).alias("refs_known"), F.count_if(F.col("ref_id") == canonical.NONE).alias("none"))
    left = p1_unmatched(spark, d).groupBy("field_name").agg(F.sum("n_rows").alias("left"))
    return per.join(left, "field_name", "left").select("field_name", "n_rows", "refs_known", (F.col("none") == F.coalesce("left", F.lit(0))).alias("unmatched_agree"))


def _uid() -> dict:
    return {"uid": groupsplit.standard_uid("uid")}


def _strata() -> dict:
    return {"top": groupsplit.standard_label("top"), "document_format": groupsplit.standard_label("document_format")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    (frames,) = tables(spark, d, "frames")
    return groupsplit.cross_split_groups(frames, "uid", groupsplit.standard_uid("uid"), "split_name").select(F.col("entity").alias("uid"))


def p2_assign(spark: SparkSession, d: str) -> DataFrame:
    (frames,) = tables(spark, d, "frames")
    return groupsplit.assign_splits(frames, "row_id", _uid(), list(_strata().values()))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    (frames,) = tables(spark, d, "frames")
    done = groupsplit.assign_splits(frames, "row_id", _uid(), list(_strata().values()))
    return groupsplit.split_report(frames, done, "row_id", _strata())


def _text_key():
    """Words of a text of 20 words or more; null for others."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.when(F.size(words) >= 20, F.sha2(F.array_join(words, " "), 256))


def p2_linked(spark: SparkSession, d: str) -> DataFrame:
    """Splits in which neither a uid nor a text lies in two: rows are linked by both, over any number of steps."""
    (frames,) = tables(spark, d, "frames")
    return groupsplit.assign_splits(frames, "row_id", {**_uid(), "text": _text_key()}, list(_strata().values()))


def p2_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of both assignments: (what, value)."""
    (frames,) = tables(spark, d, "frames")
    keys = frames.select("row_id", groupsplit.standard_uid("uid").alias("uid"), _text_key().alias("text_key"))
    out = None
    for name, done in (("uid", p2_assign(spark, d)), ("linked", p2_linked(spark, d))):
        done = materialize(done, "assigned")
        at = materialize(keys.join(done, "row_id"), "assigned-keys")
        twice = lambda c: at.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("v"))  # noqa: E731, B023
        share = at.groupBy("split").agg(F.count("*").alias("n")).join(at.agg(F.count("*").alias("all")))
        near = share.agg(F.count_if(F.abs(F.col("n") / F.col("all") - F.when(F.col("split") == "train", 0.7).otherwise(0.15)) < 0.02).alias("v"))
        parts = [("rows", done.agg(F.count("*").alias("v"))), ("uids in two splits", twice("uid")), ("splits near their share", near)]
        parts += [("texts in two splits", twice("text_key"))] if name == "linked" else [("groups", done.agg(F.count_distinct("grp").alias("v")))]
        report = groupsplit.split_report(frames, done, "row_id", _strata())
        rows = [v.select(F.lit(f"{name}: {k}").alias("what"), F.col("v").cast("bigint").alias("value")) for k, v in parts]
        rows.append(report.groupBy(F.concat_ws("=", "label", "value").alias("w")).agg(F.sum("n_rows").alias("value")).select(F.concat(F.lit(f"{name}: "), "w").alias("what"), "value"))
        for r in rows:
            out = r if out is None else out.unionByName(r)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    (frames,) = tables(spark, d, "frames")
    rows, pairs = overlap.overlaps(frames)
    return overlap.row_pairs(rows, pairs).select("row_id_a", "row_id_b")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    (frames,) = tables(spark, d, "frames")
    rows, pairs = overlap.overlaps(frames, keep=("source",), cover=True)
    return overlap.overlap_report(rows, pairs, ["split_name", "source"])


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation record's share of words that stand in passages of any training text."""
    (frames,) = tables(spark, d, "frames")
    rows, _ = overlap.overlaps(frames, keep=("source",), cover=True)
    return rows.filter("not is_train").select("row_id", "split_name", "source", F.round("covered", 6).alias("coverage"))


def _fields() -> dict:
    return {"tag": termcounts.value_terms("tag"), "domain": termcounts.value_terms("domain"), "tag_term": termcounts.word_terms("tag")}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    (frames,) = tables(spark, d, "frames")
    return termcounts.marked(frames, _fields()).filter("mark is not null").select("field_name", "term", "mark")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    (frames,) = tables(spark, d, "frames")
    return termcounts.marked(frames, _fields()).select("field_name", "term", "n_occurrences", "n_rows", "mark")


SECRET = "tessera"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every mention that the surrogate generation replaces."""
    frames, parts = tables(spark, d, "frames", "name_parts")
    return surrogates.replacements(frames, pii.collect_model(parts), SECRET).select("row_id", "start_pos", "end_pos", "kind")


def p5_placeholders(spark: SparkSession, d: str) -> DataFrame:
    frames, parts = tables(spark, d, "frames", "name_parts")
    return pii.redact(frames, pii.collect_model(parts))


def p5_surrogates(spark: SparkSession, d: str) -> DataFrame:
    frames, parts = tables(spark, d, "frames", "name_parts")
    return surrogates.pseudonymize(frames, pii.collect_model(parts), SECRET)


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: that no mention keeps its value, and that values other than names and their replacements are one to one."""
    frames, parts = tables(spark, d, "frames", "name_parts")
    r = surrogates.replacements(frames, pii.collect_model(parts), SECRET)
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    r = materialize(r.select("kind", plain("value").alias("v"), plain("replacement").alias("s")), "pairs").distinct()
    per = r.groupBy("kind", "v").agg(F.count_distinct("s").alias("n")).groupBy("kind").agg((F.max("n") == 1).alias("coreferent"))
    back = r.groupBy("kind", "s").agg(F.count_distinct("v").alias("n")).groupBy("kind").agg((F.max("n") == 1).alias("distinct"))
    same = r.groupBy("kind").agg((F.count_if(F.col("v") == F.col("s")) == 0).alias("replaced"))
    return same.join(per, "kind").join(back, "kind").select("kind", "replaced", "coreferent", "distinct")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    (documents,) = tables(spark, d, "documents")
    return bpe.encode_ids(documents)


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = tables(spark, d, "documents", "mix_targets")
    return mixing.mix(mixing.sized(documents), targets)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = tables(spark, d, "documents", "mix_targets")
    sizes = mixing.sized(documents)
    return mixing.mix_report(sizes, mixing.mix(sizes, targets), targets)


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source: whether it is repeated within its limit, and its share is reached as nearly as its longest text allows."""
    documents, targets = tables(spark, d, "documents", "mix_targets")
    sizes = mixing.sized(documents)
    done = materialize(mixing.mix(sizes, targets), "selection")
    report = mixing.mix_report(sizes, done, targets)
    most = done.groupBy("source").agg(F.max("copies").alias("copies"))
    longest = sizes.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    r = report.join(most, "source", "left").join(longest, "source", "left").join(report.filter("stock_tokens > 0").agg(F.sum("target_share").alias("all_shares"), F.sum("taken_tokens").alias("all_taken")))
    want = F.when(F.col("stock_tokens") > 0, F.col("target_share") / F.col("all_shares")).otherwise(0.0)
    off = F.abs(F.col("taken_tokens") - want * F.col("all_taken"))
    return r.select("source", "target_share", "max_repeats", (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (off <= F.coalesce("longest", F.lit(0)) + 1).alias("share_reached"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    (documents,) = tables(spark, d, "documents")
    return sentences.split_sentences(documents)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL
