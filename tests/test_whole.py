"""Queries do the whole job: every row, tag and term counts, whatever evidence or length it has."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import ensemble
from tessera.plans.oracle import C, LEX, SQL, V
from tessera.plans.queries import Q

# every document against every tag, zeros included
DENSE = f"""dx AS (SELECT c.row_id, v.top, v.tag_idx, v.tag, coalesce(lx.heading,0.0::DOUBLE) AS heading, coalesce(lx.verbatim,0.0::DOUBLE) AS verbatim
 FROM c CROSS JOIN v LEFT JOIN lx ON lx.row_id=c.row_id AND lx.top=v.top AND lx.tag_idx=v.tag_idx)"""


def test_temperatures_of_every_industry(spark, data, duck):
    got = {(r.top, r.t): r.nll for r in Q["temperature_grid"](spark, data).collect()}
    sql = f"WITH {LEX}, {DENSE} SELECT c.top, dx.row_id, list(heading+0.5::DOUBLE*verbatim ORDER BY dx.tag_idx) AS s, any_value(g.tag_idx) AS g FROM dx JOIN c USING (row_id) JOIN v g ON g.top=c.top AND g.tag=c.tag WHERE c.split='dev' AND dx.top=c.top GROUP BY 1,2"
    import numpy as np

    rows = duck.sql(sql).fetchall()
    n = duck.sql(f"WITH {C}, {V} SELECT count(*) FROM c JOIN v USING (top, tag) WHERE split='dev'").fetchall()[0][0]
    assert len(rows) == n > 0
    want = {}
    for top in {r[0] for r in rows}:
        mine = [(np.array(r[2]), r[3]) for r in rows if r[0] == top]
        for t in ensemble.temperatures():
            want[top, t] = np.mean([np.log(np.exp(s / t - (s / t).max()).sum()) + (s / t).max() - s[g] / t for s, g in mine])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1.1e-5) for k in want)


# features ---------------------------------------------------------------------------------------------------------------
def grams(text):
    """Character n-grams of 3 to 5 inside padded words."""
    out = Counter()
    for w in (text or "")[:1200].lower().split():
        w = f" {w} "
        for n in range(3, min(5, len(w)) + 1):
            out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


def test_char_ngrams_of_texts(spark, data):
    docs = {r.row_id: grams(r.text) for r in spark.read.parquet(f"{data}/frames.parquet").select("row_id", "text").collect()}
    n, df = Counter(), Counter()
    for g in docs.values():
        n.update(g)
        df.update(g.keys())
    assert {r.g: (r.n, r.n_rows) for r in Q["char_ngrams"](spark, data).collect()} == {g: (n[g], df[g]) for g in n}
    kept = {g: math.log((1 + len(docs)) / (1 + k)) + 1 for g, k in df.items() if k >= 3}
    assert len(kept) < 300_000
    want = {}
    for i, g in docs.items():
        x = [(1 + math.log(k)) * kept[t] for t, k in g.items() if t in kept]
        if x:
            want[i] = (len(x), pytest.approx(sum(x) / math.sqrt(sum(v * v for v in x)), abs=1e-4))
    assert {r.row_id: (r.n_terms, r.w) for r in Q["tfidf_char"](spark, data).collect()} == want


def test_whole_bigram_space(same, spark, data):
    same(Q["tfidf_bigram_space"], SQL["tfidf_bigram_space"])
    assert Q["tfidf_bigram_space"](spark, data).count() > 1000


def test_bigrams_of_whole_texts(spark, tmp_path):
    text = " ".join(f"word{i % 700}" for i in range(900))
    cols = ("uid", "domain", "top", "tag", "description", "document_format", "locale", "text", "source", "split_name")
    rows = [(1, *[None] * 7, text, "a", "train"), (2, *[None] * 7, None, "b", "train"), (3, *[None] * 7, "one two", "b", None)]
    spark.createDataFrame(rows, "row_id bigint, " + ", ".join(f"{c} string" for c in cols)).write.parquet(str(tmp_path / "frames.parquet"))
    assert sorted(map(tuple, Q["word_bigrams"](spark, str(tmp_path)).select("source", "n", "n_distinct").collect())) == [("a", 899, 700), ("b", 1, 1)]


# reports ----------------------------------------------------------------------------------------------------------------
def test_no_report_row_is_lost(spark, data, tmp_path, monkeypatch):
    from tessera import cli

    n = 10_003
    few, many = spark.range(3).toDF("k"), spark.range(n).toDF("k")
    monkeypatch.setenv("TESSERA_ARTIFACTS", str(tmp_path))
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(cli, "write_splits", lambda *a: None)
    monkeypatch.setattr(cli.pipeline, "run_prepare", lambda *a: (few, few, {"splits": few, "domains": many, "leaks": few, "label_space": many}))
    assert cli.main(["prepare", "--data", data]) == 0
    said = json.loads((tmp_path / "reports" / "prepare.json").read_text())
    assert said["splits"] == [{"k": i} for i in range(3)]
    for k, rows in (("domains", n), ("leaks", 3), ("label_space", n)):
        assert said[k]["rows"] == rows and spark.read.parquet(said[k]["table"]).distinct().count() == rows


def test_c_is_selected_on_dev(spark, monkeypatch):
    from tessera.operators import linear
    from tessera.plans import pipeline
    from tessera.sources.tables import Settings

    class Seen(Exception):
        pass

    def select_c(train, dev, grid, *a):
        raise Seen(grid)

    monkeypatch.setattr(linear, "select_c", select_c)
    rows = spark.createDataFrame([(i, f"u{i}", "Bank", "finance", "loan", "a b loan text", s) for i, s in enumerate(("train", "dev"))], "row_id bigint, uid string, domain string, top string, tag string, text string, split string")
    domains = spark.createDataFrame([("Bank", "finance", None)], "domain string, top string, hard_negative_of string")
    vocab = spark.createDataFrame([("finance", 0, "loan")], "top string, tag_idx int, tag string")
    for st, want in ((Settings(min_df=1), linear.GRID), (Settings(min_df=1, c_grid=(3.0,)), (3.0,))):
        with pytest.raises(Seen) as e:
            pipeline.run_train(rows, vocab, domains, st)
        assert e.value.args[0] == want
