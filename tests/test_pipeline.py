"""Train and evaluate on an invented corpus whose labels can be learned; stream the scorer."""

import pytest

from tessera.plans import pipeline
from tessera.sources import tables as S
from tessera.streaming.scorer import score_stream, stream_documents

KINDS = [
    ("Clinic", "healthcare", "blood report", "haemoglobin platelet sample laboratory fasting"),
    ("Clinic", "healthcare", "referral letter", "specialist appointment symptoms physician opinion"),
    ("Bank", "finance", "loan contract", "borrower interest repayment collateral schedule"),
    ("Bank", "finance", "account statement", "balance deposit withdrawal ledger period"),
    ("Council", "government", "parking permit", "resident vehicle zone street bay"),
    ("Council", "government", "tax notice", "assessment levy payable arrears year"),
    ("Bakery", "other", "recipe card", "flour butter oven sugar knead"),
    ("Garage", "other", "repair order", "brake engine tyre mileage mechanic"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for k, (domain, top, tag, words) in enumerate(KINDS):
        w = words.split()
        for u in range(14):
            for loc in ("us", "intl"):
                text = f"**{tag.title()}**\n\n{' '.join(w[: 2 + u % 3])} was filed on day {u}. {' '.join(w)}" + (" (overseas copy)" if loc == "intl" else "")
                rows.append((len(rows), f"u{k * 100 + u:09d}", domain, top, tag, f"A {tag} of {domain}", "structured" if u % 2 else "unstructured", loc, text, "s"))
    df = spark.createDataFrame(rows, "row_id bigint, uid string, domain string, top string, tag string, description string, document_format string, locale string, text string, source string")
    dom = spark.createDataFrame([("Clinic", "healthcare", None), ("Bank", "finance", None), ("Council", "government", None), ("Bakery", "other", None), ("Garage", "other", "finance")], "domain string, top string, hard_negative_of string")
    return df.cache(), dom


@pytest.fixture(scope="module")
def trained(spark, corpus):
    df, dom = corpus
    s = S.Settings(min_df=1, tier2_min_df=1, char_min_df=1, c_grid=(1.0,), tier2_c_grid=(1.0, 4.0))
    rows, vocab, reports = pipeline.run_prepare(df, dom, s)
    rows = rows.cache()
    return rows, vocab, reports, dom, pipeline.run_train(rows, vocab, dom, s)


def test_end_to_end(spark, trained, tmp_path):
    rows, vocab, reports, dom, b = trained
    assert reports["leaks"].count() == 0 and vocab.count() == 6 and reports["lexical_top1"].first().heading > 0.9
    for top in ("healthcare", "finance", "government"):
        told = b.report["tier2"][top]
        assert set(told["single"]) == set(pipeline.CHANNELS) and told["single"]["linear"] > 0.9 and told["single"]["prototype"] > 0.5 and told["ensemble_accuracy"] >= max(told["single"].values()) - 1e-9
        assert set(told["c_grid"]) == {1.0, 4.0} and told["selected_c"] in told["c_grid"]
    one, two = (x.describe() for x in b.spaces.values())
    assert one["char_features"] == 0 < two["char_features"] and one["embedding_dim"] == 64 and two["dimension"] == sum(two[k] for k in ("word_features", "char_features", "embedding_dim"))
    out = pipeline.run_evaluate(b, rows)
    h = out["headline"].first()
    assert h.tier1_accuracy > 0.95 and h.exact_all > 0.95 and out["recommended"].count() == 0
    b.save(str(tmp_path / "m"))
    again = pipeline.Bundle.load(spark, str(tmp_path / "m"))
    d = rows.filter("split = 'test'").limit(6)
    one = {r.row_id: (r.industry, r.sub_tag) for r in b.predict(d).collect()}
    two = {r.row_id: (r.industry, r.sub_tag) for r in again.predict(d).collect()}
    assert one == two and all((t is None) == (i == "other") for i, t in one.values())
    got = pipeline.Predictor(spark, str(tmp_path / "m")).predict_batch(["**Loan Contract**\n\nborrower interest repayment", "", "flour butter oven sugar"], 2)
    assert got[0]["sub_tag"] == "loan contract" and len(got) == 3 and len(got[0]["alternatives"]) == 2 and got[2]["industry"] == "other"
    with pytest.raises(FileNotFoundError):
        pipeline.Bundle.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        pipeline.Bundle.load(spark, str(tmp_path / "m"), S.EmbeddingStore(str(tmp_path / "e"), None, "another model"))


def test_without_embeddings(spark, trained):
    rows, vocab, _, dom, _ = trained
    s = S.Settings(min_df=1, tier2_min_df=1, char_chars=0, c_grid=(1.0,), tier2_c_grid=(1.0,), use_embeddings=False)
    b = pipeline.run_train(rows, vocab, dom, s)
    assert b.store is None and b.spaces["tier1"].describe()["embedding_dim"] == 0 and b.tables["protos"].count() == 0
    assert b.report["tier2"]["finance"]["ensemble_accuracy"] > 0.9


def test_scorer_on_a_stream(spark, trained, tmp_path):
    rows, *_, b = trained
    src = str(tmp_path / "in")
    rows.filter("split = 'test'").select("row_id", "text").limit(5).write.parquet(src)
    q = score_stream(stream_documents(spark, src, "row_id bigint, text string"), lambda d: b.predict(d).select("row_id", "industry", "sub_tag"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_stream(spark, corpus, tmp_path):
    df, _ = corpus
    src = str(tmp_path / "in")
    df.select("row_id", "text").limit(20).write.parquet(src)
    q = score_stream(stream_documents(spark, src, "row_id bigint, text string"), lambda b: b.selectExpr("row_id", "length(text) AS n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_split_cache_and_embedding_cache(spark, corpus, tmp_path):
    df, _ = corpus
    from tessera.operators import features

    calls = []

    def embed(missing):
        calls.append(missing.count())
        return features.hashed_embedding(missing, key="key")

    p = str(tmp_path / "emb")
    n = S.embed_cached(df, p, embed).count()
    assert S.embed_cached(df, p, embed).count() == n and calls == [n, 0]
    assert S.embed_cached(df, p, embed, signature="b").count() == 2 * n and calls == [n, 0, n]  # another model meets no stale vector
    assert S.read_splits(spark, str(tmp_path / "none")) is None


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / "c.yaml"
    f.write_text("min_df: 1\nlambdas: [0.0, 1.0]\n")
    s = S.Settings.load(str(f))
    assert s.min_df == 1 and s.lambdas == (0.0, 1.0)
    f.write_text("colour: red\n")
    with pytest.raises(ValueError):
        S.Settings.load(str(f))
    monkeypatch.setenv("TESSERA_ARTIFACTS", "/x")
    assert S.Settings().path("models", "a") == "/x/models/a"


def test_text_files_are_told_apart(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(f"text {i}\nof two lines")
    rows = S.whole_texts(spark, str(tmp_path)).collect()
    assert len({r.path for r in rows}) == 3 and {r.text for r in rows} == {f"text {i}\nof two lines" for i in range(3)}
    S.write_text(spark, str(tmp_path / "x" / "a.json"), "é")
    assert S.read_text(spark, str(tmp_path / "x" / "a.json")) == "é" and S.read_text(spark, str(tmp_path / "none")) is None


def test_shared_folder_is_asked_for():
    from types import SimpleNamespace

    from tessera.plans import runtime

    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getConf=lambda: conf, master="yarn")
    with pytest.raises(RuntimeError):
        runtime.shared_dir(SimpleNamespace(sparkContext=sc, conf=conf))
