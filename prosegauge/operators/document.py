"""Documents to the tables that the per-document plans read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as L
from prosegauge.functions import text as T
from prosegauge.functions.stats import array_sum
from prosegauge.operators.segment import sentences
from prosegauge.operators.surface import hapaxes, surface
from prosegauge.plans import documents as P
from prosegauge.plans.run import run
from prosegauge.session import materialize


def sentence_features(docs: DataFrame) -> DataFrame:
    return surface(sentences(docs))


def tokens(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pos, n, w, content, dull): the words of ``sents`` (with ``words``); n numbers a document's words from 0."""
    t = sents.select("doc_id", "sent_id", F.posexplode_outer("words").alias("pos", "w")).where("w is not null")
    flag = lambda yes: F.when(yes, 1).otherwise(0)
    # sent_id and pos order the words; as one number they order windows just as well
    return t.withColumns({"n": F.col("sent_id") * (1 << 24) + F.col("pos"), "content": flag(~F.col("w").isin(*L.FUNCTION_WORDS)), "dull": flag(F.col("w").isin(*P.DULL))})


def whole_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_words, kinds, hapax, syl) of each whole text."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", F.transform(T.words(F.col("text")), F.lower)).withColumn("o", F.array_sort("w"))
    return d.select(
        "doc_id",
        F.length("text").alias("n_chars"),
        F.size("w").alias("n_words"),
        F.size(F.array_distinct("w")).alias("kinds"),
        hapaxes(F.col("o")).alias("hapax"),
        array_sum(F.transform("w", T.syllables)).alias("syl"),
    )


def rhythm(docs: DataFrame) -> DataFrame:
    return run(docs.sparkSession, P.RHYTHM, sent=materialize(sentence_features(docs), "sentences"))


def rhythm_series(docs: DataFrame) -> DataFrame:
    return run(docs.sparkSession, P.RHYTHM_SERIES, sent=materialize(sentence_features(docs), "sentences"))


def repetition(docs: DataFrame) -> DataFrame:
    return run(docs.sparkSession, P.REPETITION, tok=materialize(tokens(sentence_words(docs)), "tokens"))


def sentence_jaccard(docs: DataFrame) -> DataFrame:
    return run(docs.sparkSession, P.JACCARD, tok=materialize(tokens(sentence_words(docs)), "tokens"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    return run(docs.sparkSession, P.REPEATED_SPANS, tok=materialize(tokens(sentence_words(docs)), "tokens"))


def structure(docs: DataFrame) -> DataFrame:
    return run(docs.sparkSession, P.STRUCTURE, sent=materialize(sentence_features(docs), "sentences"), whole=whole_texts(docs))



def sentence_words(docs: DataFrame) -> DataFrame:
    """Sentences with their words in lower case."""
    return sentences(docs).withColumn("words", F.transform(T.words(F.col("text")), F.lower))
