"""Registered queries of the package proper, by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.operators import corpus as C
from prosegauge.operators import decide as V
from prosegauge.operators import document as D
from prosegauge.operators import evidence as E
from prosegauge.operators import features as X
from prosegauge.operators import generation as N
from prosegauge.operators import learn as M
from prosegauge.operators import preparation as G
from prosegauge.operators import ranks as K
from prosegauge.operators import rules as R
from prosegauge.operators import store as S
from prosegauge.operators import segment
from prosegauge.operators.limiter import sliding_limit
from prosegauge.operators.surface import STY, SYN, syntax
from prosegauge.plans import corpus as PC
from prosegauge.plans import decide as PV
from prosegauge.plans import store as PS
from prosegauge.plans.run import run
from prosegauge.session import materialize
from prosegauge.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _surface(docs: DataFrame) -> DataFrame:
    return D.sentence_features(docs).select("doc_id", "sent_id", *(F.round(c, 6).alias(c) for c in STY))


def _whole(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(read_table(spark, sf_dir, "documents"))


def _leak_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "ref_id")
    return C.leakage(read_table(spark, sf_dir, "documents"), items)


def _leak_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and test documents against train documents."""
    docs = G.with_split(read_table(spark, sf_dir, "documents"), _splits(spark, sf_dir))
    return C.leakage(docs.where("split <> 'train'"), docs.where("split = 'train'").select(F.col("doc_id").alias("ref_id"), "text"))


def _turns_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, their roles as the three classes; training turns are those of conversations whose digest begins with 0 to b."""
    t = read_table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai_generated").otherwise("ai_polished")
    train = F.substring(F.md5(F.col("conv_id").cast("string").cast("binary")), 1, 1) <= "b"
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), role.alias("class"), "text", train.alias("train"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document measurements in long form with the class of labelled documents."""
    ctx = X.context(X.sentence_table(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "whole_lm_frac_top1", "whole_lm_perplexity", "sty_n_words", "sty_transition_word_rate")
    d = ctx.groupBy("doc_id").agg(
        F.first("whole_lm_frac_top1").alias("whole_lm_frac_top1"), F.first("whole_lm_perplexity").alias("whole_lm_perplexity"), F.when(F.avg("sty_n_words") < 1e-9, 0.0).otherwise(F.stddev_pop("sty_n_words") / F.avg("sty_n_words")).alias("bur_cv_sent_len"),
        F.coalesce(F.avg(F.when(F.col("sent_id") > 0, F.col("ctx_abs_len_diff_prev"))), F.lit(0.0)).alias("bur_mean_abs_adjacent_diff"), F.avg("sty_transition_word_rate").alias("agg_mean_sty_transition_word_rate"),
        F.max("ctx_style_distance_to_doc").alias("shift_max_style_distance_to_doc"), F.lit(0.0).alias("rep_pos_fourgram_repeat_ratio"),
    )
    long = d.unpivot("doc_id", [c for c in d.columns if c != "doc_id"], "feature", "value")
    cls = read_table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).select("doc_id", F.when(F.col("q") == 1, "human").otherwise("ai_generated").alias("class"))
    return materialize(long.join(cls, "doc_id", "left"), "measured")


def _document_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _measured(spark, sf_dir)
    return E.meters(long.select("doc_id", "feature", "value"), E.reference(long.select("feature", "class", "value")), E.DOCUMENT, ["doc_id"]).drop("detail")


def _notable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.notable(_document_meters(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("nth").cast("long").alias("nth"), "key", "strength")


def _document_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    sents = materialize(D.sentence_words(docs), "sentences-words")
    phrases = D.repeated_spans(docs)
    scored = V.stand_in_scores(sents)
    w = F.greatest("n_words", F.lit(1))
    flagged = scored.groupBy("doc_id", "para_id").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("p")).where("p >= 0.6").select("doc_id", "para_id")
    return E.document_statements(sents.select("doc_id", F.size("words").cast("double").alias("n_words")), phrases, flagged)


def _sentence_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ("sty_n_words", "sty_root_ttr", "lm_perplexity", "lm_mean_logprob")
    ctx = X.context(X.sentence_table(read_table(spark, sf_dir, "documents").select("doc_id", "text")), *used)
    ctx = materialize(ctx.select("doc_id", "sent_id", *used, "ctx_z_mean_logprob"), "context")
    return E.sentence_statements(ctx, X.essay_context(ctx))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seed_id"), "text").where("text is not null")


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Embeddings as a table of features: three classes, groups of neighbouring ids."""
    e = read_table(spark, sf_dir, "embeddings")
    n = 64
    names = [f"x{i}" for i in range(n)]
    out = e.select("vec_id", F.floor(F.col("vec_id") / 4).cast("long").alias("group_id"), F.pmod("label", F.lit(3)).cast("int").alias("y"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(n)))
    return materialize(out, "vectors"), names


def _trained(spark: SparkSession, sf_dir: str):
    df, names = _labelled_vectors(spark, sf_dir)
    folds = M.group_folds(df, "group_id", 4)
    df = df.join(folds.select("group_id", "fold"), "group_id")
    return df, names, M.fit(df.where("fold < 3"), names)


def _train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on three folds, calibrated and predicted on the fourth."""
    df, _, t = _trained(spark, sf_dir)
    held = df.where("fold = 3")
    return M.predict(held, M.calibrate(t, held)).select("vec_id", "y", "k", *(F.round(f"p{i}", 3).alias(f"p{i}") for i in range(3)))


def _vector_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _, t = _trained(spark, sf_dir)
    return M.contributions(df.where("fold = 3"), t, "vec_id").select("vec_id", "place", "feature", F.round("contribution", 3).alias("contribution"), "direction", "method")


def _model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _labelled_vectors(spark, sf_dir)
    sets = {"all": ("x",), "few": ("x1",)}
    found = M.ablation(df, names, "group_id", ("logreg_l2", "logreg_l2_strong"), sets, 2)
    return M.best_estimators(found).select("feature_set", "estimator", F.round("cv_macro_f1", 2).alias("cv_macro_f1"), "place")


def _melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.melted(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))


def _percentile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place among the reference percentiles over all documents; the table has a row a feature."""
    m = materialize(_melted(spark, sf_dir), "melted")
    table = K.reference_percentiles(m).where("class = 'overall'").drop("class", "n", "mean", "std")
    place = E.percentile(F.col("value"), [F.col(f"p{q}") for q in E.PLACES])
    return m.join(F.broadcast(table), "feature").select("doc_id", "feature", F.round(place, 8).alias("percentile"))


def _on_pred(plan: str) -> Query:
    return lambda spark, sf_dir: V.over_predictions(plan)(V.stand_in_predictions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def _on_scores(plan: str) -> Query:
    return lambda spark, sf_dir: V.over_scores(plan)(V.stand_in_scores(D.sentence_words(read_table(spark, sf_dir, "documents").select("doc_id", "text"))))


def _on_tables(plan: str, *tables: str) -> Query:
    return lambda spark, sf_dir: run(spark, plan, **{t: read_table(spark, sf_dir, t) for t in tables})


def _scrubbed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(T.scrub(F.col("text")).cast("binary"), 256).alias("scrubbed"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of documents: who asks, and how."""
    forwarded = F.when(F.col("lang") == "de", " 10.0.0.7 , 10.0.0.1").when(F.col("lang") == "fr", "")
    save = F.when(F.col("lang") == "es", F.lit(False)).when(F.col("lang") == "en", F.lit(True))
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", forwarded.alias("forwarded"), F.col("source").alias("host"), save.alias("save"), (F.col("source") == "src3").alias("requested"))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    wrapped = F.concat(F.lit("  Here is the essay:\n# Title\n\n"), F.coalesce("text", F.lit("")), F.lit("\n(Word count: 120)"))
    topic = F.concat(F.coalesce("source", F.lit("")), F.lit(" / "), F.coalesce("lang", F.lit("")))
    return docs.select("doc_id", F.sha2(R.clean_generated(wrapped).cast("binary"), 256).alias("cleaned"), R.slug(topic, 32).alias("slug"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stand_in_scores(D.sentence_words(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def _display(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    return _scored(spark, sf_dir).select("doc_id", "sent_id", R.colour_band(s).alias("colour"), F.round(10 * s).cast("long").alias("blocks"), R.bar_width(s - 0.5).alias("bar"))


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["sty_ttr", "lm_perplexity", "agg_mean_lm_frac_top1", "bur_cv_sent_len", "doc_log_n_words", "cor_char_sim_human", "shift_n_changepoints", "rep_distinct2", "odd"]
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.posexplode(F.array(*map(F.lit, names))).alias("i", "feature"))
    value = (F.pmod(F.col("doc_id") * (F.col("i") + 1) * 31 + F.col("n_chars"), F.lit(1000)) - 500) / 1000.0
    return rows.select("doc_id", "feature", F.when(F.col("i") == 8, 0.0).otherwise(value).alias("contribution"))


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stand_in_predictions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.group_profile(read_table(spark, sf_dir, "documents"), l2=F.col("lang") == "es")


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.held_out_splits(_profile(spark, sf_dir))


def _purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    kept, users = S.purged(events, events.select("user_id").distinct(), now, 7)
    return kept.select(F.lit("events").alias("tab"), F.col("event_id").alias("id")).unionByName(users.select(F.lit("users").alias("tab"), F.col("user_id").alias("id")))


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    parents, children = S.cascaded(customers, orders, customers.where("c_acctbal < 0"), "c_custkey", "o_custkey")
    return parents.select(F.lit("customer").alias("tab"), F.col("c_custkey").alias("id")).unionByName(children.select(F.lit("orders").alias("tab"), F.col("o_orderkey").alias("id")))


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written over account balances: the newest write of each customer stays."""
    base = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit("1990-01-01").cast("timestamp").alias("at"), F.lit(0).cast("long").alias("version"))
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").cast("long").alias("version"))
    return S.upserted(base, rows, ["key"], ["at", "version"]).select("key", "value", "version")


def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers put among customers, but for keys that are taken."""
    have = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("origin"))
    return S.inserted(have, read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit("supplier").alias("origin")), ["c_custkey"])


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    key = lambda kind: F.concat(kind, F.lit(":"), F.col("user_id").cast("string"))
    cache = S.cached(events.where("event_type in ('view', 'purchase')").select(key(F.col("event_type")).alias("key"), F.col("event_id").alias("value"), "ts"), R.RETENTION_SECONDS)
    asked = events.select("user_id").distinct().withColumn("key", key(F.lit("view")))
    return S.looked_up(asked, S.invalidated(cache, "purchase:"), F.lit("2024-01-30 00:00:00").cast("timestamp")).select("user_id", "hit")


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long").getField("k").alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.to_json(F.from_json("props", "map<string, long>")).alias("again"))


def _fixed_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty requests a minute; refused ones count."""
    e = read_table(spark, sf_dir, "events")
    nth = F.row_number().over(Window.partitionBy("user_id", F.window("ts", "60 seconds")).orderBy("ts", "event_id")).cast("long")
    return e.select("event_id", "user_id", nth.alias("nth"), (nth <= 30).alias("allowed"))


def _latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count("event_id").alias("writes"))


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sign-up stands for a loaded model, an error for a part that is down."""
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(~has("signup"), "unavailable").when(has("error"), "degraded").otherwise("ok").alias("status"))


def _rounded(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    return df.select(*keys, *(F.round(c, places).alias(c) for c in df.columns if c not in keys))


def _on_sentences(op: Callable[[DataFrame], DataFrame], *keys: str) -> Query:
    return lambda spark, sf_dir: _rounded(op(X.sentence_table(read_table(spark, sf_dir, "documents").select("doc_id", "text"))), *(keys or ("doc_id",)))


def _token_lm(docs: DataFrame) -> DataFrame:
    return _rounded(X.token_table(D.sentence_words(docs)).withColumn("pos", F.col("pos").cast("long")), "doc_id", "sent_id", "pos", "w", "word_rank")


QUERIES: dict[str, Query] = {
    "token_lm": _on_documents(_token_lm),
    "token_sentences": _on_documents(lambda docs: X.anchored(X.word_positions(docs), segment.sentences(docs))),
    "sentence_lm_features": _on_sentences(lambda s: s.select("doc_id", "sent_id", *X.LM), "doc_id", "sent_id"),
    "whole_lm_features": _on_sentences(lambda s: s.groupBy("doc_id").agg(*(F.first(f"whole_{c}").alias(f"whole_{c}") for c in X.LM))),
    "context_features": _on_sentences(lambda s: X.context(s).select("doc_id", "sent_id", *X.CTX), "doc_id", "sent_id"),
    "shift_features": _on_sentences(lambda s: X.shift(materialize(X.context(s, "lm_mean_logprob", "sty_n_words", *X.STYLE).select(*X.SHIFT_USES), "context"))),
    "agg_features": _on_sentences(lambda s: X.rolled_up(X.context(s, *X.AGG_KEEP))),
    "rhythm_lm": _on_sentences(lambda s: X.rhythm_rest(X.context(s, "lm_mean_logprob", "lm_perplexity"))),
    "repetition_structure": _on_documents(lambda docs: _rounded(X.repetition_rest(docs, D.sentence_words(docs)), "doc_id")),
    "essay_context": _on_sentences(X.essay_context),
    "sentence_split": _on_documents(segment.sentences),
    "paragraph_spans": _on_documents(segment.paragraphs),
    "surface_features": _on_documents(_surface),
    "rhythm_by_document": _on_documents(D.rhythm),
    "rhythm_series": _on_documents(D.rhythm_series),
    "ngram_repetition": _on_documents(D.repetition),
    "sentence_jaccard": _on_documents(D.sentence_jaccard),
    "repeated_spans": _on_documents(D.repeated_spans),
    "document_structure": _on_documents(D.structure),
    "validate_documents": _whole(C.validated),
    "exact_duplicates": _whole(C.exact_duplicates),
    "dedup_keep_first": _whole(C.keep_first),
    "split_manifest": _on_tables(PC.MANIFEST, "documents"),
    "leakage_audit_benchmark": _leak_benchmark,
    "leakage_audit_docs": _leak_docs,
    "reference_percentiles": lambda spark, sf_dir: K.reference_percentiles(_melted(spark, sf_dir)),
    "percentile_lookup": _percentile_lookup,
    "iqr_outliers": lambda spark, sf_dir: K.iqr_outliers(_melted(spark, sf_dir)),
    "centroid_cosine_embeddings": lambda spark, sf_dir: K.nearest_centroid(read_table(spark, sf_dir, "embeddings")),
    "ngram_lm_scores": _on_documents(lambda docs: K.ngram_scores(C.folded_words(docs))),
    "verdict_rules": _on_pred(PV.VERDICT),
    "sentence_bands": _on_scores(PV.SENTENCE_BAND),
    "paragraph_rollup": _on_scores(PV.ROLLUP),
    "confusion_metrics": _on_pred(PV.CONFUSION),
    "classification_summary": _on_pred(PV.SUMMARY),
    "ece_reliability": _on_pred(PV.RELIABILITY),
    "auc_by_class": lambda spark, sf_dir: K.auc_by_class(_pred(spark, sf_dir)),
    "roc_pr_curves": lambda spark, sf_dir: K.roc_pr_curves(_pred(spark, sf_dir)),
    "losses": _on_pred(PV.LOSSES),
    "slice_metrics": _on_pred(PV.SLICES),
    "wilson_bias_by_language": _on_pred(PV.BIAS),
    "error_rates": _on_pred(PV.ERROR_RATES),
    "scrub_pii": _whole(_scrubbed),
    "recent_page": lambda spark, sf_dir: S.page(read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), [F.desc("ts"), F.desc("event_id")], 20, 40).drop("ts"),
    "event_tumbling_counts": _on_tables(PS.TUMBLING, "events"),
    "joined_results": _on_tables(PS.JOINED_RESULTS, "customer", "orders"),
    "request_rules": lambda spark, sf_dir: R.request_rules(_requests(spark, sf_dir)),
    "clean_generated": _generated,
    "display_rules": _display,
    "summary_counts": lambda spark, sf_dir: R.summary_counts(_scored(spark, sf_dir)),
    "contribution_share": lambda spark, sf_dir: R.contribution_share(_contributions(spark, sf_dir)),
    "top_contributions": lambda spark, sf_dir: R.top_contributions(_contributions(spark, sf_dir), 5),
    "abstention": lambda spark, sf_dir: R.abstention(_pred(spark, sf_dir)),
    "confident_errors": lambda spark, sf_dir: R.confident_errors(_pred(spark, sf_dir)),
    "error_cases": lambda spark, sf_dir: R.case_texts(R.error_cases(_pred(spark, sf_dir)), read_table(spark, sf_dir, "documents"), "src5"),
    "group_profile": lambda spark, sf_dir: _profile(spark, sf_dir).select("group_id", "n_docs", F.array_join("labels", "+").alias("labels"), F.array_join("topics", "+").alias("topics"), "l2"),
    "assign_splits_held_out": lambda spark, sf_dir: _splits(spark, sf_dir).drop("key_hash"),
    "split_documents": lambda spark, sf_dir: G.with_split(read_table(spark, sf_dir, "documents"), _splits(spark, sf_dir)).select("doc_id", "split"),
    "split_crosstab": lambda spark, sf_dir: G.crosstab(G.with_split(read_table(spark, sf_dir, "documents"), _splits(spark, sf_dir))),
    "data_regime": lambda spark, sf_dir: R.regime(read_table(spark, sf_dir, "documents")),
    "empirical_length_bands": lambda spark, sf_dir: G.length_bands(read_table(spark, sf_dir, "documents")),
    "latest_status": _latest_status,
    "retention_purge": _purge,
    "keyed_upsert": _upsert,
    "insert_if_absent": _insert,
    "cascade_delete": _cascade,
    "cache_lookup": _cache,
    "latest_versions": lambda spark, sf_dir: S.latest(read_table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "event_type", "place"),
    "rate_limit_fixed": _fixed_limit,
    "json_properties": _json,
    "health_rollup": _health,
    "corpus_similarity": lambda spark, sf_dir: _rounded(C.corpus_similarity(_turns_by_class(spark, sf_dir)), "id"),
    "document_meters": _document_meters,
    "notable_meters": _notable,
    "document_statements": _document_statements,
    "sentence_statements": _sentence_statements,
    "token_evidence": _on_documents(lambda docs: E.token_evidence(X.token_table(D.sentence_words(docs)))),
    "scaler_stats": lambda spark, sf_dir: _rounded(M.scaler_stats(*_labelled_vectors(spark, sf_dir)), "feature"),
    "anova_scores": lambda spark, sf_dir: _rounded(M.anova_f(*_labelled_vectors(spark, sf_dir), "y"), "feature"),
    "group_folds": lambda spark, sf_dir: M.group_folds(read_table(spark, sf_dir, "orders"), "o_custkey", 4),
    "train_predict": _train_predict,
    "vector_contributions": _vector_contributions,
    "model_comparison": _model_comparison,
    "generation_grid": lambda spark, sf_dir: N.grid(spark),
    "procedural_essays": lambda spark, sf_dir: N.procedural_essays(N.grid(spark)).select("prompt_id", F.sha2("text", 256).alias("text"), T.n_space_words(F.col("text")).alias("n_words")),
    "human_variants": lambda spark, sf_dir: N.human_variants(_seeds(spark, sf_dir)),
    "polish_pairs": lambda spark, sf_dir: N.polish_pairs(_seeds(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6)),
    "normalised_texts": lambda spark, sf_dir: read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalise(F.col("text")), 256).alias("normalised")),
    "syntax_without_parser": _on_documents(lambda docs: syntax(segment.sentences(docs)).select("doc_id", "sent_id", *SYN)),
    "rate_limit_sliding": lambda spark, sf_dir: sliding_limit(read_table(spark, sf_dir, "events")),
}
