import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import decode, ensemble, features, labels, merging, metrics, prepare


def frame(spark, n, tops=("finance", "other"), uids=None):
    rows = [(i, f"u{(uids or n) and i % (uids or n):09d}", tops[i % (uids or n) % len(tops)], "structured", f"tag {i % 3}", "us") for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, uid string, top string, document_format string, tag string, locale string")


# splits
def test_split_sizes_and_coverage(spark):
    df = frame(spark, 400, uids=200)
    s = prepare.stratified_split(df)
    assert s.count() == 200 and s.select("uid").distinct().count() == 200
    got = {(r.stratum, r.split): r["count"] for r in s.groupBy("stratum", "split").count().collect()}
    assert got["finance|structured", "train"] == 70 and got["finance|structured", "dev"] == 15 and got["finance|structured", "test"] == 15


@pytest.mark.parametrize("n, want", [(3, (1, 1, 1)), (4, (2, 1, 1)), (1, (1, 0, 0)), (2, (1, 0, 1))])
def test_small_strata(spark, n, want):
    s = prepare.stratified_split(frame(spark, n, ("finance",)))
    got = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "dev", "test")) == want


def test_split_depends_on_seed_only(spark):
    df = frame(spark, 60)
    a, b, c = (sorted(map(tuple, prepare.stratified_split(df, seed=x).collect())) for x in (1, 1, 2))
    assert a == b != c


def test_leaks(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "dev"), ("b", "train"), (None, "dev"), (None, "train"), ("b", None)], "uid string, split string")
    assert [tuple(r) for r in prepare.leaking(df).collect()] == [("a", 2)]


# labels
def domains(spark, rows):
    return spark.createDataFrame(rows, "domain string, top string, hard_negative_of string")


@pytest.mark.parametrize("rows", [[("A", "finance", None), ("A", "other", None)], [("A", "retail", None)], [("A", "finance", "finance")]])
def test_unsound_domains(spark, rows):
    with pytest.raises(labels.LabelError):
        labels.check_domains(domains(spark, rows))


def test_unknown_domain_raises(spark):
    d = domains(spark, [("A", "finance", None)])
    labels.check_domains(d)
    labels.require_known_domains(spark.createDataFrame([("A",), (None,)], "domain string"), d)
    with pytest.raises(labels.LabelError):
        labels.require_known_domains(spark.createDataFrame([("B",)], "domain string"), d)


def test_vocabulary_and_aliases(spark):
    df = spark.createDataFrame([("finance", "b"), ("finance", "a"), ("finance", ""), ("other", "z"), ("finance", None)], "top string, tag string")
    v = labels.vocabulary(df)
    assert sorted(map(tuple, v.collect())) == [("finance", 0, "a"), ("finance", 1, "b")]
    al = spark.createDataFrame([("finance", "b", "a")], "top string, tag string, canonical string")
    assert [tuple(r) for r in labels.coarser(v, al).collect()] == [("finance", 0, "a")]
    assert labels.pairs(v).count() == 3
    assert {r.tag_idx for r in labels.with_tag_index(df.filter("tag = 'z' or tag = 'a'"), v).collect()} == {0, -1}


# decoding
def tiers(spark):
    t1 = [(1, "healthcare", math.log(0.5)), (1, "finance", math.log(0.3)), (1, "government", math.log(0.15)), (1, "other", math.log(0.05)), (2, "healthcare", math.log(0.1)), (2, "finance", math.log(0.1)), (2, "government", math.log(0.1)), (2, "other", math.log(0.7))]
    t2 = [(d, top, i, f"{top} {i}", math.log(p)) for d in (1, 2) for top, ps in (("healthcare", (0.5, 0.5)), ("finance", (0.01, 0.99)), ("government", (0.6, 0.4))) for i, p in enumerate(ps)]
    return spark.createDataFrame(t1, "row_id bigint, top string, lp double"), spark.createDataFrame(t2, "row_id bigint, top string, tag_idx int, tag string, lp double")


def test_decode(spark):
    t1, t2 = tiers(spark)
    gated = {r.row_id: (r.top, r.tag) for r in decode.decode(t1, t2, 0.0).collect()}
    assert gated == {1: ("healthcare", "healthcare 0"), 2: ("other", None)}
    joint = {r.row_id: r for r in decode.decode(t1, t2, 1.0).collect()}
    assert joint[1].top == "finance" and joint[1].tag_confidence == pytest.approx(0.99) and joint[2].tag_confidence == 1.0
    assert decode.decode(t1, t2, 1.0, other_bias=10.0).filter("top = 'other'").count() == 2
    top = decode.top_k(t1, t2, 7, 1.0).filter("row_id = 1").orderBy("rank").collect()
    assert len(top) == 7 and [r.score for r in top] == sorted((r.score for r in top), reverse=True)
    grid = spark.createDataFrame([(0.0,), (1.0,)], "lam double")
    gold = spark.createDataFrame([(1, "finance", "finance 1"), (2, "other", None)], "row_id bigint, top string, tag string")
    assert decode.best_lambda(decode.sweep_lambda(t1, t2, gold, grid)) == 1.0


# ensemble
def test_temperature_prefers_sharp_when_right(spark):
    s = spark.createDataFrame([(1, 0, 2.0), (1, 1, 0.0), (2, 0, 0.0), (2, 1, 2.0)], "row_id bigint, tag_idx int, score double")
    g = spark.createDataFrame([(1, 0), (2, 1)], "row_id bigint, tag_idx int")
    assert ensemble.best_temperature(ensemble.temperature_losses(s, g, ensemble.temperatures())) == pytest.approx(0.05)
    assert ensemble.best_temperature(ensemble.temperature_losses(s, g.filter("false"), [1.0, 2.0])) == 1.0


def test_weight_search_finds_the_useful_channel(spark):
    rows = [(d, "finance", t, float(d % 3 == t), float((d * 7 + t * 3) % 5)) for d in range(30) for t in range(3)]
    ch = spark.createDataFrame(rows, "row_id bigint, top string, tag_idx int, good double, noise double")
    gold = spark.createDataFrame([(d, "finance", d % 3) for d in range(30)], "row_id bigint, top string, tag_idx int")
    w = {r.channel: r for r in ensemble.search_weights(ch, gold, ["good", "noise"]).collect()}
    assert w["good"].accuracy == 1.0 and w["good"].weight > 0


# merging
def graph(spark, edges, n=5):
    e = spark.createDataFrame([("finance", a, b, w) for a, b, w in edges], "top string, tag_a string, tag_b string, affinity double")
    t = spark.createDataFrame([("finance", chr(97 + i), i, 10 - i) for i in range(n)], "top string, tag string, tag_idx int, support bigint")
    return e, t


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.canonical, set()).add(r.tag)
    return sorted(map(sorted, out.values()))


def test_no_chaining(spark):
    e, t = graph(spark, [("a", "b", 0.5), ("b", "c", 0.4)], 3)
    assert clusters(merging.merge(e, t, [0.1])) == [["a", "b"], ["c"]]


def test_size_cap_and_monotone(spark):
    all_ = [(chr(97 + i), chr(97 + j), 0.5) for i in range(5) for j in range(i + 1, 5)]
    e, t = graph(spark, all_)
    assert max(map(len, clusters(merging.merge(e, t, [0.1], most=3)))) == 3
    sizes = {r.threshold: r.n for r in merging.merge(e, t, [0.1, 0.6]).groupBy("threshold").agg(F.count_distinct("canonical").alias("n")).collect()}
    assert sizes[0.1] == 1 and sizes[0.6] == 5


def test_affinity(spark):
    gp = spark.createDataFrame([("finance", "a", "b"), ("finance", "a", "a"), ("finance", "b", "a"), ("finance", "b", None)], "top string, gold string, pred string")
    assert merging.affinity(gp).first().affinity == pytest.approx(2 / 3)


# metrics
def test_none_is_a_hit(spark):
    g = spark.createDataFrame([(1, "other", None), (2, "finance", "a"), (3, "finance", "a")], "row_id bigint, top string, tag string")
    p = spark.createDataFrame([(1, "other", "x", 0.9), (2, "finance", "b", 0.8), (3, "other", None, 0.7)], "row_id bigint, top string, tag string, top_confidence double")
    c = metrics.compared(g, p)
    h = metrics.headline(c).first()
    assert (h.tier1_accuracy, h.tier2_given_top, h.exact_all, h.exact_industry) == (0.666667, 0.0, 0.333333, 0.0)
    curve = metrics.coverage_curve(c, metrics.top_ok(), "top_confidence", "row_id")
    assert curve.count() == 19 and curve.orderBy("point").collect()[-1].accuracy == 0.66667
    assert metrics.accuracy_at_target(curve, 0.99).first().coverage == 0.6667
    assert metrics.accuracy_at_target(curve, 1.1).count() == 0
    assert metrics.headline(c.filter("false")).first().exact_all == 0.0


def test_blocks_of_labels_change_nothing(spark):
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "row_id bigint, v array<double>")
    protos = spark.createDataFrame([(f"l{i}", [1.0, float(i)]) for i in range(7)], "label string, vector array<double>")
    one, many = (sorted(map(tuple, features.prototype_scores(docs, protos, "row_id", "v", "label", n).collect())) for n in (100, 2))
    assert one == many and len(one) == 35
    vocab = spark.createDataFrame([("finance", i, f"t{i}") for i in range(6)], "top string, tag_idx int, tag string")
    score = {"heading": spark.createDataFrame([(1, "finance", 3, 0.5)], "row_id bigint, top string, tag_idx int, score double")}
    one, many = (sorted(map(tuple, ensemble.assemble(vocab, docs, score, most=n).collect())) for n in (100, 2))
    assert one == many and len(one) == 30 and sum(r[3] for r in one) == 0.5


def test_mean_pooling(spark):
    def encode():
        import numpy as np

        def model(texts):
            n = max(map(len, texts), default=1) or 1
            vec, mask = np.zeros((len(texts), n, 2)), np.zeros((len(texts), n))
            for i, t in enumerate(texts):
                for j, c in enumerate(t):
                    vec[i, j], mask[i, j] = (1.0, 0.0) if c == "a" else (0.0, 1.0), 1
            return vec, mask

        return model

    df = spark.createDataFrame([(1, "ab"), (2, "aaaa"), (3, ""), (4, None)], "row_id bigint, text string")
    got = {r.row_id: r.embedding for r in features.pooled_embedding(df, encode).collect()}
    assert got[1] == pytest.approx([0.5**0.5, 0.5**0.5]) and got[2] == [1.0, 0.0] and got[3] == got[4] == [0.0, 0.0]


def test_ranks_over_ranges(spark):
    from tessera.plans.runtime import ranked

    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "k bigint, c int")
    got = [(r.c, r.k, r["rank"]) for r in ranked(df, [F.desc("c"), F.col("k")]).collect()]
    assert sorted(got, key=lambda x: x[2]) == [(c, k, i + 1) for i, (c, k) in enumerate(sorted(((i % 3, i) for i in range(50)), key=lambda x: (-x[0], x[1])))]
    assert ranked(df.filter("false"), [F.col("k")]).count() == 0


def test_features_beyond_the_limit(spark):
    tf = spark.createDataFrame([(d, t, n) for d in range(4) for t, n in (("a", 9), ("b", 5), ("c", 5), ("d", 5), ("e", 1))], "row_id bigint, term string, tf bigint")
    assert sorted(r.term for r in features.fit(tf, 4, 1, 3).collect()) == ["a", "b", "c"] and features.fit(tf, 4, 1, 9).count() == 5
