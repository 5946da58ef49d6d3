"""The four steps end to end: prepare, train, evaluate, predict. A trained bundle is a folder of parquet tables, ML models and JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import decode, ensemble, features, labels, lexical, linear, merging, metrics, prepare
from ..operators.ensemble import CHANNELS
from ..operators.spaces import Profile, Space
from ..sources.tables import EmbeddingStore, Settings, read_text, write_text
from .runtime import materialize, scratch

BY = ["row_id", "top"]


def run_prepare(df: DataFrame, domains: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(rows with split, vocabulary, reports) of a labelled corpus (row_id, uid, domain, top, tag, description, document_format, locale, text)."""
    s = settings or Settings()
    rows = df.drop("split").join(prepare.stratified_split(df, s.fractions, s.seed).select("uid", "split"), "uid")
    rows = materialize(rows, "rows")
    vocab = materialize(labels.vocabulary(rows.filter("split = 'train'")), "vocabulary")
    reports = {"splits": prepare.describe(rows), "label_space": prepare.label_space(rows), "domains": prepare.domain_report(rows, domains), "unseen": labels.unseen_rate(rows, vocab), "leaks": prepare.leaking(rows)}
    return rows, vocab, reports | signal_report(rows, vocab, s)


def signal_report(rows: DataFrame, vocab: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """How much the texts and descriptions say of the labels: tag in the text, tag as title, domain in the description, lexical channels alone."""
    own = rows.filter(F.col("top").isin(*labels.INDUSTRIES))
    train, dev = rows.filter("split = 'train'"), own.filter("split = 'dev'")
    scores = lexical.channels(dev, vocab, lexical.idf(train, s.idf_chars), lexical.default_idf(train), window=s.heading_window, body_chars=s.body_chars)
    return {"domain_named": prepare.domain_named(rows), "tag_in_text": lexical.verbatim_rate(own), "tag_in_title": lexical.heading_hit_rate(own, s.heading_window), "lexical_top1": lexical.top1_rates(dev, scores)}


def profiles(s: Settings) -> tuple[Profile, Profile]:
    """Tier 1 tells topics apart by words; tier 2 near-equal names within an industry, by characters too."""
    dense = {"embeddings": s.use_embeddings, "scale": s.embedding_scale, "size": s.embedding_size}
    return (
        Profile("tier1", s.body_chars, True, s.min_df, s.max_features, **dense),
        Profile("tier2", s.body_chars, True, s.tier2_min_df, s.max_features, s.char_chars, s.char_min_df, s.char_max_features, **dense),
    )


def hashed_store(spark: SparkSession, s: Settings, path: str | None = None) -> EmbeddingStore:
    """The store of the hashed embedding, which stands in for a sentence encoder."""
    embed = lambda missing: features.hashed_embedding(missing, size=s.embedding_size, chars=s.embedding_chars, key="key")
    return EmbeddingStore(path or scratch(spark, "embeddings"), embed, f"hashed-{s.embedding_size}-{s.embedding_chars}", s.embedding_chars)


def prototypes(train: DataFrame, vocab: DataFrame, store: EmbeddingStore, s: Settings) -> DataFrame:
    """(label, vector) of every tag: the vector of its name and its first descriptions of the training rows."""
    told = prepare.descriptions_by_tag(train, s.most_descriptions).groupBy("top", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "description"))), lambda x: x["description"]), " ").alias("told"))
    texts = vocab.join(told, ["top", "tag"], "left").select(F.concat_ws("\t", "top", "tag").alias("label"), X.truncate(F.concat_ws(" ", "tag", "told"), s.embedding_chars).alias("text"))
    return store.get(texts, key="label").select("label", features.normalized("embedding").alias("vector"))


def _of_label(df: DataFrame, vocab: DataFrame, score: str = "score") -> DataFrame:
    """(row_id, top, tag_idx, score) of scores by ``top TAB tag``."""
    part = F.split("label", "\t")
    return df.select("row_id", part[0].alias("top"), part[1].alias("tag"), F.col(score).alias("score")).join(vocab, ["top", "tag"]).select("row_id", "top", "tag_idx", "score")


class Bundle:
    """Everything prediction needs."""

    TABLES = ("vocab", "terms1", "terms2", "cents", "protos", "idfs")

    def __init__(self, settings: Settings, tables: dict[str, DataFrame], models: dict[str, LogisticRegressionModel], decoder: dict, store: EmbeddingStore | None):
        self.settings, self.tables, self.models, self.decoder, self.store = settings, tables, models, decoder, store
        one, two = profiles(settings)
        self.spaces = {"tier1": Space(one, tables["terms1"]), "tier2": Space(two, tables["terms2"])}
        self.report: dict = {}

    @property
    def vocab(self) -> DataFrame:
        return self.tables["vocab"]

    @property
    def lam(self) -> float:
        return self.decoder["lam"]

    def save(self, path: str) -> None:
        for name in self.TABLES:
            self.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        for name, m in self.models.items():
            m.write().overwrite().save(f"{path}/model-{name}")
        spark = self.vocab.sparkSession
        write_text(spark, f"{path}/decoder.json", json.dumps({"decoder": self.decoder, "settings": self.settings.__dict__, "models": sorted(self.models), "spaces": [x.describe() for x in self.spaces.values()], "signature": self.store.signature if self.store else None}))

    @classmethod
    def load(cls, spark: SparkSession, path: str, store: EmbeddingStore | None = None) -> Bundle:
        told = read_text(spark, f"{path}/decoder.json")
        if told is None:
            raise FileNotFoundError(f"no trained bundle in {path}")
        d = json.loads(told)
        s = Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in d["settings"].items()})
        store = store or (hashed_store(spark, s) if d["signature"] else None)
        if (store.signature if store else None) != d["signature"]:
            raise ValueError(f"the bundle was trained with the embedding {d['signature']}")
        return cls(s, {n: spark.read.parquet(f"{path}/{n}") for n in cls.TABLES}, {n: LogisticRegressionModel.load(f"{path}/model-{n}") for n in d["models"]}, d["decoder"], store)

    # scoring ---------------------------------------------------------------------------------------------------------
    def embeddings(self, df: DataFrame) -> DataFrame | None:
        return materialize(self.store.get(df), "vectors") if self.store else None

    def tier1_lp(self, df: DataFrame, dense: DataFrame | None) -> DataFrame:
        space = self.spaces["tier1"]
        x = space.vectors(space.weights(df, dense), df)
        return linear.calibrated(self.models.get("platt"), linear.margins(self.models["tier1"], x))

    def channel_scores(self, df: DataFrame, dense: DataFrame | None) -> dict[str, DataFrame]:
        """(row_id, top, tag_idx, score) of each channel."""
        s, space = self.settings, self.spaces["tier2"]
        w = materialize(space.weights(df, dense), "tier2-weights")
        x = materialize(space.vectors(w, df), "tier2-vectors")
        out = {"rocchio": _of_label(features.centroid_scores(unit(w), self.tables["cents"]), self.vocab)}
        for top, n in self.decoder["n_tags"].items():
            if f"linear-{top}" in self.models:
                m = linear.head_scores(self.models[f"linear-{top}"], x, n).select("row_id", F.lit(top).alias("top"), F.posexplode("margins").alias("tag_idx", "score"))
                out["linear"] = out["linear"].unionByName(m) if "linear" in out else m
        if dense is not None:
            out["prototype"] = _of_label(features.prototype_scores(dense, self.tables["protos"], "row_id", "embedding", "label"), self.vocab)
        lex = materialize(lexical.channels(df, self.vocab, self.tables["idfs"], self.decoder["default_idf"], window=s.heading_window, body_chars=s.body_chars), "lexical")
        return out | {n: lex.withColumn("score", F.col(n)) for n in ("heading", "verbatim")}

    def channels(self, df: DataFrame, dense: DataFrame | None) -> DataFrame:
        """(row_id, top, tag_idx, one column a channel): a channel that isn't there is 0 everywhere."""
        scores = self.channel_scores(df, dense)
        got = ensemble.assemble(self.vocab, df, scores)
        return got.withColumns({n: F.lit(0.0) for n in CHANNELS if n not in scores})

    def tier2_lp(self, channels: DataFrame) -> DataFrame:
        z = ensemble.zscores(channels, list(CHANNELS), BY)
        case, temp = F.lit(0.0), F.lit(1.0)
        for top, w in self.decoder["weights"].items():
            case = F.when(F.col("top") == top, ensemble.mix(w)).otherwise(case)
            temp = F.when(F.col("top") == top, F.lit(self.decoder["temperature"].get(top, 1.0))).otherwise(temp)
        mixed = z.withColumn("mixed", case).withColumn("scaled", case / temp)
        return ensemble.with_log_softmax(mixed, "scaled", BY).join(self.vocab, ["top", "tag_idx"]).select("row_id", "top", "tag_idx", "tag", "mixed", "lp")

    def tiers(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Log probabilities of both tiers."""
        dense = self.embeddings(df)
        return materialize(self.tier1_lp(df, dense), "tier1"), materialize(self.tier2_lp(materialize(self.channels(df, dense), "channels")), "tier2")

    def predict(self, df: DataFrame, k: int = 3) -> DataFrame:
        """Prediction records of ``df(row_id, text)``."""
        t1, t2 = self.tiers(materialize(df.select("row_id", "text"), "documents"))
        return decode.as_structs(decode.decode(t1, t2, self.lam), t1, decode.top_k(t1, t2, k, self.lam))


class Predictor:
    """A loaded bundle that answers for single texts and short lists of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.bundle = spark, Bundle.load(spark, path)

    def predict_batch(self, texts: list[str], k: int = 3) -> list[dict]:
        """Records in the order of ``texts``."""
        df = self.spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "row_id bigint, text string")
        return [r.asDict(True) for r in self.bundle.predict(df, k).orderBy("row_id").collect()]

    def predict(self, text: str, k: int = 3) -> dict:
        return self.predict_batch([text], k)[0]


def unit(weights: DataFrame) -> DataFrame:
    """Weights of each document scaled to length 1 over all blocks."""
    norm = weights.groupBy("row_id").agg(F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(1e-9)).alias("norm"))
    return weights.join(norm, "row_id").select("row_id", "term", (F.col("w") / F.col("norm")).alias("w"))


def run_train(rows: DataFrame, vocab: DataFrame, domains: DataFrame, settings: Settings | None = None, grid: tuple[float, ...] | None = None, store: Callable[[SparkSession, Settings], EmbeddingStore] = hashed_store) -> Bundle:
    """Train on split ``train``, choose everything else on ``dev``; what was chosen, and how well, is in ``report`` of the bundle."""
    s = settings or Settings()
    spark = rows.sparkSession
    train, dev = rows.filter("split = 'train'"), rows.filter("split = 'dev'")
    emb = store(spark, s) if s.use_embeddings else None
    dense = {n: materialize(emb.get(d), "vectors") if emb else None for n, d in (("train", train), ("dev", dev))}
    one, two = profiles(s)
    # tier 1
    space = Space.fit(one, train)
    hard = prepare.sample_weights(train.drop("top"), domains, s.hard_negative_weight).select("row_id", "weight")
    label = labels.top_index("top").cast("double").alias("label")
    xt = materialize(space.vectors(space.weights(train, dense["train"]), train).join(train.select("row_id", label), "row_id").join(hard, "row_id"), "train-vectors").cache()
    xd = materialize(space.vectors(space.weights(dev, dense["dev"]), dev).join(dev.select("row_id", label), "row_id"), "dev-vectors").cache()
    tier1, c, acc = linear.select_c(xt, xd, grid or s.c_grid, "weight")
    models = {"tier1": tier1, "platt": linear.platt(linear.margins(tier1, xd).join(xd.select("row_id", "label"), "row_id"))}
    report: dict = {"tier1": {"selected_c": c, "dev_accuracy": acc, "space": space.describe()}, "tier2": {}}
    xt.unpersist(), xd.unpersist()
    # tier 2
    industry = train.filter(F.col("top").isin(*labels.INDUSTRIES))
    space2 = Space.fit(two, industry)
    own = materialize(labels.with_tag_index(dev, vocab), "gold")
    known = materialize(labels.with_tag_index(industry, vocab).filter("tag_idx >= 0").select("row_id", "top", "tag", "text", "tag_idx"), "known")
    w2 = materialize(space2.weights(known, dense["train"].join(known.select("row_id"), "row_id", "left_semi") if emb else None), "tier2-weights")
    x2 = materialize(space2.vectors(w2, known).join(known.select("row_id", "top", F.col("tag_idx").cast("double").alias("label")), "row_id"), "tier2-train").cache()
    d2 = dev.filter(F.col("top").isin(*labels.INDUSTRIES))
    x2d = materialize(space2.vectors(space2.weights(d2, dense["dev"].join(d2.select("row_id"), "row_id", "left_semi") if emb else None), d2).join(own.select("row_id", "top", F.col("tag_idx").cast("double").alias("label")), "row_id"), "tier2-dev").cache()
    n_tags = {r.top: r.n for r in vocab.groupBy("top").agg(F.count("*").alias("n")).collect()}  # a row an industry
    for top, n in n_tags.items():
        at = F.col("top") == top
        if x2.filter(at).select("label").distinct().limit(2).count() == 2:
            m, told, c = linear.fit_head(x2.filter(at), x2d.filter(at), n, s.tier2_c_grid)
            models[f"linear-{top}"] = m
            report["tier2"][top] = {"c_grid": told, "selected_c": c, "n_tags": n}
    x2.unpersist(), x2d.unpersist()
    gold = known.select("row_id", F.concat_ws("\t", "top", "tag").alias("label"))
    tables = {
        "vocab": vocab, "terms1": space.terms, "terms2": space2.terms,
        "cents": materialize(features.centroids(unit(w2), gold), "centroids"),
        "protos": materialize(prototypes(industry, vocab, emb, s), "prototypes") if emb else spark.createDataFrame([], "label string, vector array<double>"),
        "idfs": materialize(lexical.idf(train, s.idf_chars), "idf"),
    }
    decoder = {"default_idf": lexical.default_idf(train), "weights": {t: {c: 1.0 for c in CHANNELS} for t in labels.INDUSTRIES}, "temperature": {}, "lam": 1.0, "n_tags": n_tags}
    b = Bundle(s, tables, {k: m for k, m in models.items() if m is not None}, decoder, emb)
    ch = materialize(b.channels(dev, dense["dev"]), "channels")
    for r in single_channels(ch, own).collect():  # a row an industry and channel
        report["tier2"].setdefault(r.top, {}).setdefault("single", {})[r.channel] = r.accuracy
    for r in ensemble.search_weights(ch, own, list(CHANNELS), grid=s.ensemble_grid).collect():  # a row an industry and channel
        decoder["weights"][r.top][r.channel] = float(r.weight)
        report["tier2"].setdefault(r.top, {})["ensemble_accuracy"] = r.accuracy
    t2 = materialize(b.tier2_lp(ch), "tier2")
    for top in labels.INDUSTRIES:
        g = own.filter((F.col("top") == top) & (F.col("tag_idx") >= 0))
        decoder["temperature"][top] = ensemble.best_temperature(ensemble.temperature_losses(t2.filter(F.col("top") == top), g, ensemble.temperatures(), score="mixed"))
    t1 = materialize(b.tier1_lp(dev, dense["dev"]), "tier1")
    lambdas = spark.createDataFrame([(float(x),) for x in s.lambdas], "lam double")
    sweep = materialize(decode.sweep_lambda(t1, materialize(b.tier2_lp(ch), "tier2"), dev, lambdas), "lambdas")
    decoder["lam"] = decode.best_lambda(sweep)
    report |= {"space2": space2.describe(), "weights": decoder["weights"], "temperature": decoder["temperature"], "lambda": decoder["lam"], "lambda_sweep": [r.asDict() for r in sweep.orderBy("lam").collect()]}
    b.report = report
    return b


def single_channels(channels: DataFrame, gold: DataFrame) -> DataFrame:
    """(top, channel, accuracy) of each channel alone, the lower tag index on ties."""
    pick = lambda c: F.max_by("tag_idx", F.struct(F.col(c), -F.col("tag_idx"))).alias(c)
    best = channels.join(gold.select("row_id", "top", F.col("tag_idx").alias("gold")), BY).groupBy("row_id", "top", "gold").agg(*[pick(c) for c in CHANNELS])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), (F.col(c) == F.col("gold")).cast("double").alias("hit")) for c in CHANNELS])).alias("x")
    return best.select("top", each).groupBy("top", "x.channel").agg(F.avg("x.hit").alias("accuracy"))


def run_evaluate(bundle: Bundle, rows: DataFrame, split: str = "test") -> dict[str, DataFrame]:
    """Reports on one split; label merges are learned on dev and judged on the split."""
    d = rows.filter(F.col("split") == split)
    t1, t2 = bundle.tiers(d)
    c = materialize(metrics.compared(d, decode.decode(t1, t2, bundle.lam)), "compared")
    conf = metrics.confusion(c)
    out = {"headline": metrics.headline(c), "confusion": conf, "per_class": metrics.per_class(conf), "per_industry": metrics.per_industry(c), "locale": metrics.slices(c, "locale"), "format": metrics.slices(c, "document_format"), "coverage": metrics.coverage_curve(c, metrics.top_ok(), "top_confidence", "row_id"), "coverage_end_to_end": metrics.coverage_curve(c, metrics.exact(), "score", "row_id"), "errors_by_domain": metrics.errors_by_domain(c), "errors": metrics.error_samples(c)}

    def given_top(docs: DataFrame, lp: DataFrame) -> DataFrame:
        best = lp.groupBy("row_id", "top").agg(F.max_by("tag", F.struct(F.col("lp"), -F.col("tag_idx"))).alias("pred"))
        return docs.select("row_id", "top", F.col("tag").alias("gold")).join(best, BY).select("top", "gold", "pred")

    dev = rows.filter("split = 'dev'")
    learned = materialize(given_top(dev, bundle.tiers(dev)[1] if split != "dev" else t2), "dev-pairs")
    gp = materialize(given_top(d, t2), "pairs")
    tags = bundle.vocab.join(merging.support(learned), ["top", "tag"], "left")
    s = bundle.settings
    merged = materialize(merging.merge(merging.affinity(learned), tags, list(s.merge_thresholds), s.merge_ratio, s.max_cluster), "merged")
    raw = gp.agg(F.avg((F.col("gold") == F.col("pred")).cast("double"))).first()[0] or 0.0
    out["merge_sweep"], out["aliases"] = materialize(merging.sweep(gp, merged), "sweep"), merging.aliases(merged)
    out["recommended"] = merging.recommended(out["merge_sweep"], raw)
    return out
