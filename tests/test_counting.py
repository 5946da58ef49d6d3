"""Terms counted in batches: no table of the documents' terms, whatever the alphabet, repeated keys and sizes."""

import math
import os
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.functions import text as X
from tessera.operators import counting as CO, features as FE
from tessera.plans.queries import Q
from tessera.plans.runtime import shared_dir

TEXTS = ["a tab of tabs", None, "", "ab \n" + "".join(map(chr, range(0x4E00, 0x4E00 + 7000))), "ärger 東京都 x " * 3, "z😀z tabs"]


def grams(text):
    out = Counter()
    for w in (text or "").lower().split():
        w = f" {w} "
        out.update(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))
    return out


def tables(spark):
    """Rows of every intermediate table of the session."""
    root = shared_dir(spark).removeprefix("file://")
    out = defaultdict(int)
    for base, _, files in os.walk(os.path.join(root, "tessera", spark.sparkContext.applicationId)):
        for f in files:
            if f.endswith(".parquet"):
                out[base] += pq.read_metadata(os.path.join(base, f)).num_rows
    return dict(out)


def written(spark, fn):
    before = tables(spark)
    fn()
    return {k: n for k, n in tables(spark).items() if k not in before}


def test_tfidf_char_writes_no_terms_of_documents(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/frames.parquet").select("text").collect()]
    terms = len(set().union(*(grams(t) for t in texts)))
    new = written(spark, lambda: Q["tfidf_char"](spark, data).count())
    assert new and max(new.values()) <= max(len(texts), terms)


def test_grams_of_any_alphabet():
    words = [w for t in TEXTS for w in (t or "").lower().split()]
    distinct = list(dict.fromkeys(words))
    col = pa.array([[*(t or "").lower().split(), None] for t in TEXTS], pa.list_(pa.string()))
    doc, term, tf, named = CO.counted(CO.grams, col)
    got = defaultdict(dict)
    for d, t, n in zip(doc.tolist(), term.tolist(), tf.tolist()):
        got[d][named[t]] = n
    assert len(named) == len(set(named)) and len(distinct) > 5
    assert {i: dict(grams(t)) for i, t in enumerate(TEXTS) if grams(t)} == got


@pytest.mark.parametrize("held", [1, 1_000_000])
def test_frequencies_are_passed_on_in_parts(monkeypatch, held):
    monkeypatch.setattr(CO, "HELD_TERMS", held)
    monkeypatch.setattr(CO, "SLICE_WORDS", 3)
    col = pa.array([[*(t or "").lower().split(), None] for t in TEXTS], pa.list_(pa.string()))
    df, cf = Counter(), Counter()
    for b in CO._frequencies(CO.grams)(iter([pa.RecordBatch.from_arrays([col], names=["words"])] * 2)):
        for t, d, c in zip(*(x.to_pylist() for x in b.columns)):
            df[t] += d
            cf[t] += c
    want = [grams(t) for t in TEXTS] * 2
    assert df == sum((Counter(g.keys()) for g in want), Counter()) and cf == sum(want, Counter())


def test_sums_of_repeated_keys_and_empty_tables(spark):
    schema = "row_id bigint, text string"
    rows = [(1, TEXTS[0]), (1, TEXTS[5]), (2, None), (3, ""), (None, "tabs"), (4, TEXTS[4])]
    docs = CO.documents(spark.createDataFrame(rows, schema), CO.runs, 1200)
    per = {1: grams(TEXTS[0]) + grams(TEXTS[5]), None: grams("tabs"), 4: grams(TEXTS[4])}
    df = Counter(t for g in per.values() for t in g)
    idf = {t: math.log(7 / (1 + n)) + 1 for t, n in df.items()}
    want = {}
    for k, g in per.items():
        x = [(1 + math.log(n)) * idf[t] for t, n in g.items()]
        want[k] = (len(x), pytest.approx(sum(x) / math.sqrt(sum(v * v for v in x))))
    got = CO.summed(docs, CO.grams, CO.fit(docs, CO.grams, len(rows), min_df=1))
    assert {r.row_id: (r.n_terms, r.w) for r in got.collect()} == want
    none = CO.documents(spark.createDataFrame([], schema), CO.runs, 1200)
    assert CO.summed(none, CO.grams, CO.fit(none, CO.grams, 0)).count() == 0


def test_pairs_stop_at_the_end_of_a_text(spark):
    docs = CO.documents(spark.createDataFrame([(1, "one two"), (1, "two three"), (2, "one two")], "row_id bigint, text string"), X.words, 2500)
    got = {r.term: r.df for r in CO.fit(docs, CO.pairs, 3, min_df=1).collect()}
    assert got == {"one": 2, "two": 2, "three": 1, "one two": 2, "two three": 1}


def test_rocchio_writes_no_terms_of_documents(spark, data):
    frames = spark.read.parquet(f"{data}/frames.parquet")
    n = FE.term_counts(frames, FE.word_terms()).count()
    new = written(spark, lambda: Q["rocchio_scores"](spark, data).count())
    assert new and max(new.values()) < n / 2


@pytest.mark.parametrize("cells", [1, 24_000_000])
def test_scores_in_blocks_of_labels(spark, monkeypatch, cells):
    monkeypatch.setattr(CO, "DENSE_CELLS", cells)
    rows = [(1, "one two three", [0]), (1, "two four", [1, 1]), (2, "one two", None), (3, "", [2]), (None, "two", [1]), (5, "three two one", [1]), (6, "unlike", None)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, own array<int>")
    docs = CO.documents(df, X.words, 2500, labels="own")
    got = CO.Centroids(docs, CO.pairs, CO.fit(docs, CO.pairs, len(rows), min_df=1), 4)
    tf = FE.term_counts(df, FE.word_terms())
    w = FE.transform(tf, FE.fit(tf, len(rows), min_df=1))
    cents = FE.centroids(w, df.selectExpr("row_id", "explode(own) AS label"))
    near = lambda t, k: {tuple(r)[:2]: pytest.approx(r[2]) for r in t.select("label" if k else "row_id", "term" if k else "label", "c" if k else "score").collect()}
    assert near(got.table().withColumnRenamed("label_id", "label"), True) == {k: v.expected for k, v in near(cents, True).items()}
    assert near(got.scores().withColumnRenamed("label_id", "label"), False) == {k: v.expected for k, v in near(FE.centroid_scores(w, cents), False).items()}
