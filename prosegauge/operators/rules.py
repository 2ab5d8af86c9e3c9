"""Small rules of the service, as columns: request checks, document shapes, cleaning of generated text, display and summary rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.functions.stats import wilson

# Limits, codes and labels.
MAX_BODY_BYTES, QUEUE_CHARS, RETENTION_SECONDS = 1_000_000, 25_000, 86_400
ERROR_CODES = {"empty": ("essay_empty", 422), "too_long": ("essay_too_long", 413), "too_short": ("essay_too_short", 422)}
REAL_SOURCES, SEED_SOURCE = ("groq", "ingested_real"), "seed_authored"
DIGEST = (
    "lm_mean_logprob lm_perplexity lm_frac_top1 lm_mean_entropy lm_n_tokens sty_n_words sty_root_ttr sty_mean_word_len sty_punct_density sty_comma_rate sty_transition_word_rate sty_nominalization_rate "
    "syn_n_clauses syn_mean_dep_depth ctx_z_mean_logprob ctx_z_n_words ctx_style_distance_to_doc ctx_pos_js_to_doc cor_char_sim_delta_ai_human"
).split()
GROUPS = {"lm": ("lm_", "whole_lm_"), "style": ("sty_", "doc_"), "syntax": ("syn_",), "context": ("ctx_", "shift_"), "rhythm": ("bur_",), "repetition": ("rep_",), "corpus": ("cor_",)}


def length_band(n_words: Column) -> Column:
    return F.when(n_words < 300, "short").when(n_words < 600, "medium").otherwise("long")


def word_band(n_words: Column) -> Column:
    return F.when(n_words < 200, "<200").when(n_words < 280, "200-280").otherwise(">=280")


def should_queue(n_chars: Column, requested: Column, enabled: bool = True, connected: bool = True) -> Column:
    return F.lit(enabled and connected) & (F.coalesce(requested, F.lit(False)) | (n_chars >= QUEUE_CHARS))


def stores_text(save: Column, allowed: bool = True) -> Column:
    """The service's setting is a ceiling; a request may only ask for less."""
    return F.lit(allowed) & ~save.eqNullSafe(F.lit(False))


def client_key(forwarded: Column, host: Column) -> Column:
    """The first address that a proxy names, else the socket's."""
    first = F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1)))
    return F.when(first != "", first).otherwise(F.coalesce(host, F.lit("unknown")))


def text_digest(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def essay_id(text: Column) -> Column:
    return F.substring(F.sha2(T.content_hash(text).cast("binary"), 256), 1, 24)


def safe_meta(text: Column) -> Column:
    """What may be logged of a text."""
    return F.struct(F.length(text).cast("long").alias("chars"), T.n_space_words(text).alias("words"), text_digest(text).alias("digest"))


def error_of(text: Column) -> tuple[Column, Column]:
    """(code, HTTP status) of a text; no code and 200 for a fit one."""
    verdict, code, status = T.verdict_of_length(text), F.lit(None).cast("string"), F.lit(200)
    for k, (name, number) in ERROR_CODES.items():
        code, status = F.when(verdict == k, name).otherwise(code), F.when(verdict == k, number).otherwise(status)
    return code, status


def request_rules(requests: DataFrame) -> DataFrame:
    """Per request (doc_id, text, forwarded, host, save, requested): how it is treated."""
    t = F.coalesce("text", F.lit(""))
    n = T.n_space_words(t)
    code, status = error_of(t)
    meta = safe_meta(t)
    return requests.select(
        "doc_id",
        (F.octet_length(t) > MAX_BODY_BYTES).alias("too_large"),
        code.alias("error_code"),
        status.alias("http_status"),
        length_band(n).alias("length_band"),
        word_band(n).alias("word_band"),
        should_queue(F.length(t), F.col("requested")).alias("queued"),
        stores_text(F.col("save")).alias("store_text"),
        client_key(F.col("forwarded"), F.col("host")).alias("client"),
        meta["chars"].alias("chars"),
        meta["words"].alias("words"),
        meta["digest"].alias("digest"),
        essay_id(t).alias("essay_id"),
        F.when(stores_text(F.col("save")), t).alias("stored_text"),
    )


def clean_generated(text: Column) -> Column:
    """What a hosted model wraps about a text is taken off: a first line of courtesy, a title, fences, a note of the word count."""
    blank = r"[ \t\n\r\f\x0B]"
    out = F.regexp_replace(text, rf"^{blank}+|{blank}+$", "")
    out = F.regexp_replace(out, rf"(?i)\A(sure[,!.]?{blank}*|certainly[,!.]?{blank}*|here(?:'s| is)[^\n]*\n+)", "")
    out = F.regexp_replace(out, rf"\A#{{1,6}}{blank}+[^\n]*\n+", "")
    out = F.regexp_replace(out, r"\A```[a-z]*\n|\n```\z", "")
    out = F.regexp_replace(out, rf"(?i)\n+{blank}*[(\[]?word count[:\s][^\n]*\z", "")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), rf"^{blank}+|{blank}+$", "")


def slug(text: Column, size: int) -> Column:
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, size)


def colour_band(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 0.75, "high").when(score >= 0.6, "elevated").when(score >= 0.4, "uncertain").otherwise("low")


def bar_width(contribution: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(contribution) / 0.5)


def percent(x: Column, places: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{places}f", F.bround(x * 100, places)), F.lit("%"))


def signed(x: Column, places: int = 3) -> Column:
    return F.format_string(f"%+.{places}f", F.bround(x, places))


def feature_group(name: Column) -> Column:
    """The group of a feature by its prefix; those rolled up belong where their sentence feature does."""
    base = F.regexp_replace(name, "^agg_(mean|std|min|max|p25|p75)_", "")
    out = F.lit("other")
    for group, stems in GROUPS.items():
        for stem in stems:
            out = F.when(base.startswith(stem), group).otherwise(out)
    return out


def regime(sources: DataFrame) -> DataFrame:
    """One row: the data regime by the sources that occur (source)."""
    has = lambda *names: F.coalesce(F.max(F.when(F.col("source").isin(*names), 1)), F.lit(0)) == 1
    kind = F.when(~has(*REAL_SOURCES), "bootstrap").when(has("groq") & has(SEED_SOURCE), "mixed").otherwise("real")
    return sources.agg(kind.alias("data_regime"), F.count("source").alias("documents"))


def warnings_of(backend: Column, has_reference: Column, data_regime: Column, has_sentence_model: Column) -> Column:
    """The warnings that go with an answer, in order."""
    found = F.array(
        F.when(~backend.eqNullSafe(F.lit("spacy")), "syntax_not_measured"),
        F.when(~F.coalesce(has_reference, F.lit(False)), "no_reference_corpus"),
        F.when(data_regime == "bootstrap", "bootstrap_corpus"),
        F.when(~F.coalesce(has_sentence_model, F.lit(False)), "no_sentence_model"),
    )
    return F.array_compact(found)


def summary_counts(scored: DataFrame) -> DataFrame:
    """Per document of ``scored`` (doc_id, para_id, sent_id, score, n_words): the parts of the scored sentences, and flagged paragraphs."""
    s = F.col("score")
    n = lambda when, name: F.count(F.when(when, 1)).alias(name)
    per = scored.groupBy("doc_id").agg(F.count("sent_id").alias("n_sentences"), F.count("score").alias("sentences_scored"), n(s >= 0.6, "flagged_sentences"), n((s >= 0.4) & (s < 0.6), "uncertain_sentences"), n(s < 0.4, "human_like_sentences"))
    w = F.greatest("n_words", F.lit(1))
    para = scored.where("score IS NOT NULL").groupBy("doc_id", "para_id").agg((F.sum(s * w) / F.sum(w)).alias("p"), F.max(s).alias("peak"), F.count(s).alias("k"))
    flagged = (F.col("p") >= 0.6) | ((F.col("p") < 0.4) & (F.col("peak") >= 0.75) & (F.col("k") >= 3))
    para = para.groupBy("doc_id").agg(n(flagged, "flagged_paragraphs"), n((F.col("p") >= 0.4) & (F.col("p") < 0.6), "uncertain_paragraphs"))
    share = F.when(F.col("sentences_scored") == 0, 0.0).otherwise(F.round(F.col("flagged_sentences") / F.col("sentences_scored"), 4))
    return per.join(para, "doc_id", "left").select(*per.columns, F.coalesce("flagged_paragraphs", F.lit(0)).alias("flagged_paragraphs"), F.coalesce("uncertain_paragraphs", F.lit(0)).alias("uncertain_paragraphs"), share.alias("flagged_share"))


def contribution_share(contributions: DataFrame) -> DataFrame:
    """Per document of ``contributions`` (doc_id, feature, contribution): each feature group's share of the absolute sum, ranked."""
    g = contributions.groupBy("doc_id", feature_group(F.col("feature")).alias("feature_group")).agg(F.sum(F.abs("contribution")).alias("total"), F.count("feature").alias("n_features"))
    whole = F.sum("total").over(Window.partitionBy("doc_id"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("total"), "feature_group"))
    return g.select("doc_id", "feature_group", rank.cast("long").alias("place"), F.round(F.when(whole == 0, 0.0).otherwise(F.col("total") / whole), 4).alias("share"), "n_features")


def top_contributions(contributions: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` largest contributions of each document by size, without those of nothing, and which way they point."""
    size = F.abs("contribution")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(size), "feature"))
    return contributions.where(size > 1e-9).select("doc_id", rank.cast("long").alias("place"), "feature", F.round("contribution", 6).alias("contribution"), F.when(F.col("contribution") > 0, "machine").otherwise("human").alias("direction")).where(F.col("place") <= k)


def ranked(pred: DataFrame) -> DataFrame:
    """``pred`` (p0, p1, p2, y, n_sentences, n_words) with top, margin, k (the class, ties to the first) and why the verdict abstains, if it does."""
    p = [F.col(f"p{i}") for i in range(3)]
    top = F.greatest(*p)
    k = F.when(p[0] == top, 0).when(p[1] == top, 1).otherwise(2)
    second = F.element_at(F.array_sort(F.array(*p)), -2)
    reason = F.when(p[0].isNull(), "no_model").when((F.col("n_sentences") < 5) | (F.col("n_words") < 120), "too_little_text").when(top < 0.45, "low_confidence").when(top - second < 0.1, "narrow_margin")
    return pred.withColumns({"top": top, "margin": top - second, "k": k, "reason": reason})


def abstention(pred: DataFrame) -> DataFrame:
    """One row: how often the verdict abstains, and how often it is right when it answers, with Wilson bounds."""
    r = ranked(pred).agg(F.count("doc_id").alias("n_documents"), F.count("reason").alias("abstained"), F.count(F.when(F.col("reason").isNull() & (F.col("k") == F.col("y")), 1)).alias("right"))
    answered = F.col("n_documents") - F.col("abstained")
    low, high = wilson(F.col("right"), answered)
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 4))
    return r.select("n_documents", "abstained", rate(F.col("abstained"), F.col("n_documents")).alias("abstention_rate"), answered.alias("answered"), rate(F.col("right"), answered).alias("accuracy_when_answering"), low.alias("low"), high.alias("high"))


def confident_errors(pred: DataFrame, k: int = 20, least: float = 0.55) -> DataFrame:
    """The wrong answers given with most confidence: those over ``least``, or any where fewer than ``k`` are. At most ``max(k, 3)``."""
    wrong = ranked(pred).where("k <> y")
    some = wrong.agg(F.count(F.when(F.col("top") >= least, 1)).alias("sure"))
    shown = wrong.join(F.broadcast(some)).where((F.col("top") >= least) | (F.col("sure") < k))
    return shown.select("doc_id", F.col("y").cast("long").alias("y"), F.col("k").cast("long").alias("k"), F.round("top", 6).alias("confidence"), (F.col("sure") < k).alias("fallback")).orderBy(F.desc("confidence"), "doc_id").limit(max(k, 3))


def error_cases(pred: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` cases, by id, of each kind of error: human text called a machine's, machine text called human, polished text called anything else."""
    r = ranked(pred).where("k <> y")
    kinds = F.array_compact(F.array(F.when(F.col("y") == 0, "false_positive"), F.when((F.col("y") != 0) & (F.col("k") == 0), "missed"), F.when(F.col("y") == 2, "polished_confusion")))
    r = r.select("doc_id", F.explode(kinds).alias("kind"), F.col("y").cast("long").alias("y"), F.col("k").cast("long").alias("k"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("doc_id"))
    return r.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def case_texts(cases: DataFrame, docs: DataFrame, hidden_source: str) -> DataFrame:
    """Cases with the beginning of their texts; those of ``hidden_source`` are withheld, and it is said why."""
    joined = cases.join(docs.select("doc_id", "source", "text"), "doc_id", "left")
    hidden = F.col("source") == hidden_source
    return joined.select(*cases.columns, "source", F.when(~F.coalesce(hidden, F.lit(False)), F.substring("text", 1, 280)).alias("excerpt"), F.when(hidden, "withheld: ingested text").alias("withheld"))
