"""From raw documents to packed training sequences, in five stages over the operators of the llm package.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again. All but the last return the columns of ``documents``, with ``n_chars`` following the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import packing
from prosegauge.llm.decontaminate import remove_contamination
from prosegauge.llm.language import UND, language_id
from prosegauge.llm.lines import kept_text, line_dedup
from prosegauge.llm.near_text import keep_one
from prosegauge.session import materialize
from prosegauge.sources import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits a letter beyond which a text is in no learnt language, if it has LEAST_CHARS characters. Of the labelled documents of sf0.1 with that many
#: characters the highest has 6.5 bits (percentile 99.9 of a language: 3.9 to 5.0); random letters have 7.6 to 12.9, random base64 6.8 to 12.2.
JUNK_BITS, LEAST_CHARS = 7.5, 16


def _documents(df: DataFrame, **own) -> DataFrame:
    """The columns of ``documents``, ``own`` in place of those of that name; whatever else a table has goes."""
    now = df.select(*(own.get(c, F.col(c)).alias(c) for c in COLUMNS if c != "n_chars"))
    return now.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those in no learnt language; a missing ``lang`` is filled in. Where nothing could be learnt, all texts with a letter stay."""
    found = docs.select(F.struct(*COLUMNS).alias("row"), language_id(docs, docs).alias("found"))
    pred, text = F.col("found.lang_pred"), F.col("row.text")
    # a text with letters is undetermined only where no language was learnt
    stays = F.when(pred == UND, text.rlike(r"\p{L}")).otherwise((F.col("found.entropy") <= JUNK_BITS) | (F.length(text) < LEAST_CHARS))
    return _documents(found.where(stays).select("row.*", pred.alias("found_lang")), lang=F.coalesce("lang", F.when(F.col("found_lang") != UND, F.col("found_lang"))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of any length that several documents hold stays in the first of them only (empty ones stay); documents that lose all their words by that go."""
    cut = line_dedup(docs.select(*COLUMNS), mode="first", min_docs=2, min_chars=1).withColumn("now", kept_text(F.col("text"), F.col("keep_bitmap")))
    kept = cut.where((F.col("n_dropped") == 0) | F.col("now").rlike(r"\S"))
    return _documents(kept, text=F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("now")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays. SimHash gives the candidates; links are those whose sets of five-word shingles are similar to 0.8 or more."""
    return keep_one(docs.select(*COLUMNS), shingle=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return _documents(remove_contamination(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, as pieces of documents."""
    return packing.pack(docs, *(public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")), public_tokenizers.PATTERN)


STAGES = [("language_id", languages), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", decontaminated), ("pack", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
