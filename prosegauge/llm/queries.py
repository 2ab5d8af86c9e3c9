"""The ``opN_`` queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from prosegauge.llm import hmm, packing
from prosegauge.llm.ann import nearest
from prosegauge.llm.decontaminate import decontaminate
from prosegauge.llm.html_text import extract
from prosegauge.llm.language import language_id
from prosegauge.llm.lines import kept_text, line_dedup
from prosegauge.llm.quality import quality
from prosegauge.llm.secret_scan import BASE, find_secrets, span_text
from prosegauge.llm.simhash import hex16, near_dedup
from prosegauge.sources import read_table


def _fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = read_table(spark, sf_dir, "pages").select("page_id", "url", extract(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; the ids themselves stay with the workers."""
    files = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = packing.pack(read_table(spark, sf_dir, "documents"), *files, emit_ids=False)
    return out.drop("ids")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that 10 or more documents hold are dropped everywhere."""
    out = line_dedup(read_table(spark, sf_dir, "documents"), mode="frequent", min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep_bitmap")).cast("binary"), 256).alias("kept_sha256"))


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts under the hidden Markov model and its unigram base, learnt from rows outside the held-out fold."""
    out = hmm.score(read_table(spark, sf_dir, "documents"), _fold("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at two or fewer bits."""
    out = near_dedup(read_table(spark, sf_dir, "documents"), shingle=3, width=64, segments=2, max_bits=2)
    return out.select("doc_id", hex16(F.col("fp.f0")).alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from those outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    labelled = docs.where((_fold("doc_id", 5) != 0) & F.col("lang").isNotNull())
    found = docs.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), language_id(docs, labelled).alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base kinds and entropy spans."""
    found = read_table(spark, sf_dir, "documents").select("doc_id", find_secrets(F.col("text")).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of benchmark items in all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"), window=10).select("row.doc_id", F.col("hit").alias("r"))
    items = F.array_join(F.array_sort("r.items"), ",")
    return found.select(
        "doc_id", "r.n_words", "r.n_hit", F.size("r.items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("r.n_hit") > 0).alias("contaminated")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from rows outside the held-out fold."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    held_out = (_fold("doc_id", 5) == 0).alias("held_out")
    return quality(docs, labels, _fold("doc_id", 5) != 0).select("row.doc_id", "score").select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every vector whose id is divisible by 50."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_pack": op2_pack,
    "op3_hmm": op3_hmm,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_secrets": op7_secrets,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_nearest": op10_nearest,
}
