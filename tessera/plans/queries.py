"""One query per operator of the inventory: name -> (spark, sf_dir) -> DataFrame, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import counting as CO, decode as D, ensemble as E, features as FE, labels as L, lexical as LX, merging as M, metrics as ME, prepare as P
from ..sources import tables as S
from .runtime import materialize, scratch, tables

Q: dict = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def _c(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus(spark, d)


def _domains(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "domain_list")[0]


def _tags(spark: SparkSession, d: str) -> DataFrame:
    """The clean tag list as vocabulary of the industries."""
    return tables(spark, d, "tag_list")[0].filter(F.col("top") != L.OTHER).select("top", "tag_idx", X.normalize_tag("tag").alias("tag"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    p = tables(spark, d, "predictions")[0].distinct()
    return p.select("row_id", F.lower(F.trim("top")).alias("top"), X.normalize_tag("tag").alias("tag"), "score", "top_confidence", "tag_confidence")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return ME.compared(_c(spark, d), _predicted(spark, d))


# sources and sinks ------------------------------------------------------------------------------------------------------
@query
def pool_scan(spark, d):
    """Pooled scan of two raw tables, seven columns each."""
    raw = f"{d}/raw_records.parquet"
    out = scratch(spark, "frames-raw")
    f = spark.read.parquet(f"{d}/frames.parquet")
    f.select("uid", "domain", F.col("tag").alias("document_type"), F.col("description").alias("document_description"), "document_format", "locale", "text").write.parquet(out)
    return S.pooled(spark, raw, out)


@query
def fetch_columns(spark, d):
    """Copy with column projection, then read from the copy."""
    return S.fetch(spark, f"{d}/raw_records.parquet", scratch(spark, "raw"), force=True)


@query
def split_cache(spark, d):
    """Split cache written by split and read back."""
    path = scratch(spark, "splits")
    got = S.read_splits(spark, path, lambda: _c(spark, d).filter("split is not null").select("row_id", "uid", "top", "split"))
    return got.select("row_id", "uid", "top", "split")


@query
def embedding_cache_misses(spark, d):
    """Content keys of dev and test texts that a cache of the training texts lacks."""
    c = _c(spark, d)
    cache = c.filter("split = 'train'").select(S.content_key().alias("key")).distinct()
    return S.cache_misses(c.filter("split in ('dev', 'test')"), cache).select("key", F.length("text").alias("n_chars"))


@query
def vocabulary_json(spark, d):
    return S.vocabulary_json(_tags(spark, d))


@query
def vocabulary_from_json(spark, d):
    return S.vocabulary_from_json(S.vocabulary_json(_tags(spark, d)))


@query
def split_fingerprint(spark, d):
    return S.fingerprint(_c(spark, d).filter("split is not null"))


# projections, filters ---------------------------------------------------------------------------------------------------
@query
def mask_select(spark, d):
    return _c(spark, d).filter("text is not null and locale = 'us' and length(text) > 100").select("row_id", "uid")


@query
def class_filter(spark, d):
    return _c(spark, d).filter(F.col("top") == "finance").select("row_id", "top", "tag")


@query
def domain_to_top(spark, d):
    return L.with_top(_c(spark, d), _domains(spark, d)).select("row_id", "domain", "top")


@query
def hard_negative_flag(spark, d):
    return L.with_top(_c(spark, d), _domains(spark, d)).select("row_id", "is_hard_negative")


@query
def encode_top(spark, d):
    return _c(spark, d).select("row_id", L.top_index("top").alias("top_idx"))


@query
def encode_tag(spark, d):
    return L.with_tag_index(_c(spark, d), _tags(spark, d)).select("row_id", "tag_idx")


@query
def null_other_tag(spark, d):
    return _c(spark, d).select("row_id", L.gold_tag().alias("gold_tag"))


@query
def industry_rows(spark, d):
    return _c(spark, d).filter(F.col("top").isin(*L.INDUSTRIES)).select("row_id", "top")


@query
def drop_unencodable(spark, d):
    return L.with_tag_index(_c(spark, d), _tags(spark, d)).filter("tag_idx >= 0").select("row_id", "top", "tag_idx")


@query
def domain_in_description(spark, d):
    return P.domain_named(_c(spark, d))


@query
def truncate_text(spark, d):
    return _c(spark, d).select("row_id", F.md5(X.truncate("text", 400)).alias("head_md5"), F.length(X.truncate("text", 1200)).alias("n_chars"))


@query
def scaled_concat(spark, d):
    """Two dense blocks side by side, the second one scaled."""
    e = tables(spark, d, "embeddings")[0]
    a = FE.dense_block(e, "vec_id", "embedding")
    s = FE.stack(("a:", a, 1.0), ("e:", a, 0.6))
    return s.groupBy("vec_id").agg(F.count("*").alias("n_terms"), F.round(F.sum(F.col("w") * F.col("w")), 5).alias("square"))


# joins ------------------------------------------------------------------------------------------------------------------
@query
def unknown_domains(spark, d):
    return L.unknown_domains(_c(spark, d), _domains(spark, d))


@query
def uid_assignment(spark, d):
    """Rows with the split of their uid."""
    c = _c(spark, d).drop("split")
    return c.join(P.stratified_split(c), "uid").select("row_id", "uid", "split")


@query
def leakage_check(spark, d):
    return P.leaking(_c(spark, d))


@query
def split_intersection(spark, d):
    """uids that train shares with the other splits, by set intersection."""
    c = _c(spark, d)
    return c.filter("split = 'train'").select("uid").intersect(c.filter("split in ('dev', 'test')").select("uid")).filter("uid is not null")


@query
def unseen_tag_rows(spark, d):
    c = _c(spark, d).filter(F.col("top").isin(*L.INDUSTRIES))
    return L.unseen_tags(c.filter("split <> 'train'"), L.vocabulary(c.filter("split = 'train'"))).select("row_id", "top", "tag")


# reports ----------------------------------------------------------------------------------------------------------------
@query
def stratified_split(spark, d):
    return P.stratified_split(_c(spark, d))


@query
def first_row_per_uid(spark, d):
    return P.first_rows(_c(spark, d).select("uid", "row_id", "top", "document_format"))


@query
def split_describe(spark, d):
    return P.describe(_c(spark, d))


@query
def label_space_stats(spark, d):
    return P.label_space(_c(spark, d).filter("split = 'train'"))


@query
def domain_report(spark, d):
    return P.domain_report(_c(spark, d), _domains(spark, d))


@query
def unseen_tag_rate(spark, d):
    c = _c(spark, d)
    return L.unseen_rate(c.filter("split is not null"), L.vocabulary(c.filter("split = 'train'")))


@query
def vocabulary(spark, d):
    return L.vocabulary(_c(spark, d).filter("split = 'train'"))


@query
def sample_weights(spark, d):
    return P.sample_weights(_c(spark, d), _domains(spark, d)).select("row_id", "top", F.round("weight", 6).alias("weight"))


@query
def descriptions_by_tag(spark, d):
    return P.descriptions_by_tag(_c(spark, d))


@query
def deterministic_sample(spark, d):
    return P.deterministic_sample(_c(spark, d).filter("split = 'dev'"), 100).select("row_id")


@query
def pair_enumeration(spark, d):
    return L.pairs(_tags(spark, d))


# text functions ---------------------------------------------------------------------------------------------------------
@query
def normalize_tag(spark, d):
    return tables(spark, d, "frames")[0].select("row_id", X.normalize_tag("tag").alias("tag"))


@query
def normalize_type(spark, d):
    return tables(spark, d, "raw_records")[0].select("rec_id", X.normalize_tag("document_type").alias("tag"))


@query
def singularize(spark, d):
    w = tables(spark, d, "documents")[0].select(F.explode(X.tokenize("text")).alias("w")).distinct()
    return w.select("w", X.singularize("w").alias("singular"))


@query
def tag_tokens(spark, d):
    return _c(spark, d).select("row_id", F.array_join(X.tag_tokens("tag"), ",").alias("tokens"))


@query
def tokenize_counts(spark, d):
    return _c(spark, d).select("row_id", F.size(X.tokenize("text")).alias("n_tokens"))


@query
def word_bigrams(spark, d):
    b = _c(spark, d).select("source", F.explode(X.bigrams(X.tokenize("text"))).alias("bigram"))
    return b.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("bigram").alias("n_distinct"))


@query
def char_ngrams(spark, d):
    """Every n-gram of the texts with its occurrences and rows."""
    tf = FE.term_counts(_c(spark, d), FE.char_terms())
    return tf.groupBy(F.col("term").alias("g")).agg(F.sum("tf").alias("n"), F.count("*").alias("n_rows"))


@query
def strip_accents(spark, d):
    return tables(spark, d, "name_parts")[0].select("name_part", X.strip_accents("name_part").alias("plain"))


@query
def extract_headings(spark, d):
    return _c(spark, d).select("row_id", F.array_join(X.headings("text"), "¦").alias("headings"))


@query
def substring_position(spark, d):
    return _c(spark, d).select("row_id", X.position(X.normalize_tag(X.truncate("text", 2500)), F.col("tag")).cast("int").alias("pos")).filter("pos >= 0")


@query
def dedupe_headings(spark, d):
    """Order-preserving deduplication, ignoring case, of an array of lines."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    return _c(spark, d).select("row_id", F.size(X.dedupe_ignoring_case(lines)).alias("n_lines"))


# lexical channels -------------------------------------------------------------------------------------------------------
def _lexical(spark, d):
    c = _c(spark, d)
    train = c.filter("split = 'train'")
    return c, LX.channels(c, _tags(spark, d), LX.idf(train), LX.default_idf(train))


@query
def idf_table(spark, d):
    return LX.idf(_c(spark, d).filter("split = 'train'")).select("token", "df", F.round("idf", 6).alias("idf"))


@query
def heading_channel(spark, d):
    return _lexical(spark, d)[1].select("row_id", "top", "tag_idx", F.round("heading", 6).alias("heading"))


@query
def verbatim_channel(spark, d):
    return _lexical(spark, d)[1].filter("verbatim > 0").select("row_id", "top", "tag_idx", F.round("verbatim", 6).alias("verbatim"))


@query
def verbatim_rate(spark, d):
    return LX.verbatim_rate(_c(spark, d).filter(F.col("top").isin(*L.INDUSTRIES)))


@query
def heading_hit_rate(spark, d):
    return LX.heading_hit_rate(_c(spark, d).filter(F.col("top").isin(*L.INDUSTRIES)))


@query
def lexical_top1(spark, d):
    c, s = _lexical(spark, d)
    return LX.top1_rates(c.filter(F.col("top").isin(*L.INDUSTRIES)), s)


# features ---------------------------------------------------------------------------------------------------------------
def _space(spark, d, terms, min_df=3, cap=300_000):
    c = _c(spark, d)
    tf = materialize(FE.term_counts(c, terms), "term-counts")
    return c, tf, FE.fit(tf, c.count(), min_df, cap)


@query
def tfidf_word(spark, d):
    c, tf, t = _space(spark, d, FE.word_terms())
    w = FE.transform(tf, t).join(c.select("row_id", "source"), "row_id")
    return w.groupBy("source", "term").agg(F.round(F.sum("w"), 5).alias("w"))


@query
def tfidf_bigram_space(spark, d):
    """The word and word-pair space."""
    _, _, t = _space(spark, d, FE.word_terms())
    return t.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def tfidf_char(spark, d):
    c = _c(spark, d)
    docs = CO.documents(c, CO.runs, 1200)
    return CO.summed(docs, CO.grams, CO.fit(docs, CO.grams, c.count())).select("row_id", "n_terms", F.round("w", 5).alias("w"))


@query
def feature_space_size(spark, d):
    return FE.space(_space(spark, d, FE.word_terms())[2])


def _rocchio(spark, d):
    """Tags of every industry by number, and their centroids in the space of words and word pairs."""
    c, tags = _c(spark, d), _tags(spark, d).filter("top is not null").groupBy("top", "tag").agg(F.count("*").cast("int").alias("n"))
    listed = spark.createDataFrame([(i, *r) for i, r in enumerate(tags.orderBy("top", "tag").collect())], "label_id int, top string, tag string, n int")
    own = F.when(F.col("split") == "train", F.array_repeat("label_id", F.col("n")))
    rows = c.join(F.broadcast(listed), ["top", "tag"], "left").select("row_id", "text", F.when(F.col("label_id").isNotNull(), own).alias("own"))
    docs = CO.documents(rows, X.words, 2500, labels="own")
    return listed.drop("n"), CO.Centroids(docs, CO.pairs, CO.fit(docs, CO.pairs, c.count()), listed.count())


@query
def rocchio_centroids(spark, d):
    labels, cents = _rocchio(spark, d)
    return cents.table().join(F.broadcast(labels), "label_id").select("top", "tag", "term", F.round("c", 6).alias("c"))


@query
def rocchio_scores(spark, d):
    labels, cents = _rocchio(spark, d)
    return cents.scores().join(F.broadcast(labels), "label_id").select("row_id", "top", "tag", F.round("score", 5).alias("score"))


def _prototypes(spark, d):
    e = tables(spark, d, "embeddings")[0]
    return e, FE.mean_vectors(e, "label", "embedding")


@query
def prototype_scores(spark, d):
    e, p = _prototypes(spark, d)
    return FE.prototype_scores(e.select("vec_id", "embedding"), p, "vec_id", "embedding", "label").select("vec_id", "label", F.round("score", 4).alias("score"))


@query
def l2_normalize(spark, d):
    e = tables(spark, d, "embeddings")[0]
    return e.select("vec_id", F.round(FE.dot(FE.normalized("embedding"), FE.normalized("embedding")), 6).alias("square"))


# ensemble and decoding --------------------------------------------------------------------------------------------------
def _scores(spark, d, where="true"):
    """The rows of ``where`` against every tag of every industry; a tag without evidence scores 0."""
    c = _c(spark, d)
    train, docs, v = c.filter("split = 'train'"), c.filter(where), _tags(spark, d)
    s = materialize(LX.channels(docs, v, LX.idf(train), LX.default_idf(train)), "lexical")
    a = E.assemble(v, docs, {n: s.withColumn("score", F.col(n)) for n in ("heading", "verbatim")})
    return docs, a.join(F.broadcast(v), ["top", "tag_idx"]).select("row_id", "top", "tag_idx", "tag", "heading", "verbatim")


@query
def zscore_mix(spark, d):
    _, s = _scores(spark, d)
    z = E.zscores(s, ["heading", "verbatim"], ["row_id", "top"])
    return z.select("row_id", "top", "tag_idx", F.round(E.mix({"heading": 1.0, "verbatim": 0.5}), 5).alias("mixed"))


def _tiers(spark, d, where="true"):
    """Log probabilities of both tiers from lexical evidence alone; ``other`` scores a constant."""
    c, s = _scores(spark, d, where)
    s = s.withColumn("score", F.col("heading") + 0.5 * F.col("verbatim"))
    t2 = E.with_log_softmax(s, "score", ["row_id", "top"]).select("row_id", "top", "tag_idx", "tag", "lp")
    best = s.groupBy("row_id", "top").agg(F.max("score").alias("score"))
    t1 = E.with_log_softmax(best.unionByName(c.select("row_id", F.lit(L.OTHER).alias("top"), F.lit(0.75).alias("score"))), "score", ["row_id"]).select("row_id", "top", "lp")
    return c, s, t1, t2


@query
def log_softmax(spark, d):
    return _tiers(spark, d)[3].select("row_id", "top", "tag_idx", F.round("lp", 5).alias("lp"))


@query
def temperature_grid(spark, d):
    """Loss of every industry's dev rows at every temperature of the grid; rows whose tag the list lacks have no target."""
    c, s, _, _ = _tiers(spark, d, "split = 'dev'")
    g = L.with_tag_index(c.filter(F.col("top").isin(*L.INDUSTRIES)), _tags(spark, d)).filter("tag_idx >= 0")
    return E.temperature_losses(s, g, E.temperatures(), by=("top",)).select("top", "t", F.round("nll", 5).alias("nll"))


@query
def joint_decode(spark, d):
    _, _, t1, t2 = _tiers(spark, d)
    r = D.decode(t1, t2, 0.5)
    return r.select("row_id", "top", "tag", *[F.round(x, 5).alias(x) for x in ("score", "top_confidence", "tag_confidence")])


@query
def lambda_sweep(spark, d):
    c, _, t1, t2 = _tiers(spark, d, "split = 'dev'")
    grid = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5)], "lam double")
    s = D.sweep_lambda(t1, t2, c, grid)
    return s.select("lam", *[F.round(x, 5).alias(x) for x in ("tier1", "end_to_end", "industry_exact")])


@query
def top_k_pairs(spark, d):
    _, _, t1, t2 = _tiers(spark, d)
    return D.top_k(t1, t2, 3, 0.5).select("row_id", "rank", "top", "tag", F.round("score", 5).alias("score"))


@query
def predict_struct(spark, d):
    """Prediction records; the map of class probabilities and the alternatives as text, in ten-thousandths."""
    _, _, t1, t2 = _tiers(spark, d)
    r = D.as_structs(D.decode(t1, t2, 0.5), t1, D.top_k(t1, t2, 3, 0.5))
    n = lambda x: F.round(x * 10000).cast("bigint").cast("string")
    probs = F.array_join(F.array_sort(F.transform(F.map_entries("industry_probabilities"), lambda e: F.concat(e["key"], F.lit("="), n(e["value"])))), ",")
    alts = F.array_join(F.transform("alternatives", lambda x: F.concat(x["industry"], F.lit("/"), F.coalesce(x["sub_tag"], F.lit("")), F.lit("="), n(x["score"]))), ",")
    return r.select("row_id", "industry", "sub_tag", "industry_confidence", "sub_tag_confidence", probs.alias("probabilities"), alts.alias("alternatives"))


@query
def weight_search(spark, d):
    dev, s = _scores(spark, d, "split = 'dev'")
    return E.search_weights(s, L.with_tag_index(dev, _tags(spark, d)), ["heading", "verbatim"])


# metrics ----------------------------------------------------------------------------------------------------------------
@query
def tier1_confusion(spark, d):
    return ME.confusion(_compared(spark, d))


@query
def class_metrics(spark, d):
    return ME.per_class(ME.confusion(_compared(spark, d)))


@query
def macro_f1(spark, d):
    return ME.macro_f1(ME.per_class(ME.confusion(_compared(spark, d))))


@query
def headline_metrics(spark, d):
    return ME.headline(_compared(spark, d))


@query
def per_industry_metrics(spark, d):
    return ME.per_industry(_compared(spark, d))


@query
def slice_locale(spark, d):
    return ME.slices(_compared(spark, d), "locale")


@query
def slice_format(spark, d):
    return ME.slices(_compared(spark, d), "document_format")


@query
def coverage_curve(spark, d):
    return ME.coverage_curve(_compared(spark, d), ME.top_ok(), "top_confidence", "row_id")


@query
def accuracy_at_target(spark, d):
    return ME.accuracy_at_target(coverage_curve(spark, d), 0.9)


@query
def errors_by_domain(spark, d):
    return ME.errors_by_domain(_compared(spark, d))


@query
def error_samples(spark, d):
    return ME.error_samples(_compared(spark, d))


# label merging ----------------------------------------------------------------------------------------------------------
def _gold_pred(spark, d):
    g = _c(spark, d).filter(F.col("top").isin(*L.INDUSTRIES)).select("row_id", "top", F.col("tag").alias("gold"))
    p = _predicted(spark, d).filter("tag <> ''").select("row_id", F.col("top").alias("p_top"), F.col("tag").alias("pred"))
    v = _tags(spark, d).select("top", "tag")
    gp = g.join(p, "row_id").filter("top = p_top").select("top", "gold", "pred")
    return gp.join(v.withColumnRenamed("tag", "gold"), ["top", "gold"], "left_semi").join(v.withColumnRenamed("tag", "pred"), ["top", "pred"], "left_semi")


def _pair_edges(spark, d):
    """The delivered confusion graph: counts of confused pairs, and as many right rows as each tag has frames rows."""
    pairs = tables(spark, d, "tag_pairs")[0].select("top", F.col("tag_a").alias("gold"), F.col("tag_b").alias("pred"), F.col("n_confused").alias("n"))
    right = _c(spark, d).groupBy("top", F.col("tag").alias("gold")).agg(F.count("*").alias("n"))
    right = right.join(tables(spark, d, "tag_list")[0].select("top", F.col("tag").alias("gold")), ["top", "gold"]).select("top", "gold", F.col("gold").alias("pred"), "n")
    return pairs.unionByName(right)


@query
def confusion_affinity(spark, d):
    return M.affinity_of_counts(_pair_edges(spark, d)).select("top", "tag_a", "tag_b", F.round("affinity", 6).alias("affinity"))


@query
def prediction_affinity(spark, d):
    """The confusion graph of the delivered predictions."""
    return M.affinity(_gold_pred(spark, d)).select("top", "tag_a", "tag_b", F.round("affinity", 6).alias("affinity"))


def _merged(spark, d):
    counts = _pair_edges(spark, d)
    sup = counts.groupBy("top", F.col("gold").alias("tag")).agg(F.sum("n").alias("support"))
    nodes = tables(spark, d, "tag_list")[0].select("top", "tag", "tag_idx").join(sup, ["top", "tag"], "left")
    return M.merge(M.affinity_of_counts(counts), nodes, list(S.MERGE_THRESHOLDS))


@query
def merge_clusters(spark, d):
    return _merged(spark, d)


@query
def merge_aliases(spark, d):
    return M.aliases(_merged(spark, d))


@query
def threshold_sweep(spark, d):
    return M.sweep(_gold_pred(spark, d), _merged(spark, d))


@query
def recommended_threshold(spark, d):
    """The merging threshold of greatest accuracy among those that gain one in a hundred on the delivered predictions."""
    gp = materialize(_gold_pred(spark, d), "pairs")
    raw = gp.agg(F.avg((F.col("gold") == F.col("pred")).cast("double"))).first()[0] or 0.0
    return M.recommended(M.sweep(gp, _merged(spark, d)), raw)


def _length_alias(spark, d):
    """A simple alias table: each tag of tag_pairs maps to the greater of its confused partners."""
    p = tables(spark, d, "tag_pairs")[0].filter(F.col("n_confused") >= 10)
    return p.groupBy("top", F.col("tag_a").alias("tag")).agg(F.max("tag_b").alias("canonical"))


@query
def aliased_accuracy(spark, d):
    return M.aliased_accuracy(_gold_pred(spark, d), _length_alias(spark, d))


@query
def canonical_vocabulary(spark, d):
    t = tables(spark, d, "tag_list")[0].select("top", "tag")
    return L.coarser(t, _length_alias(spark, d))


@query
def raw_accuracy(spark, d):
    return _gold_pred(spark, d).groupBy("top").agg(F.count("*").alias("n_rows"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy"))
