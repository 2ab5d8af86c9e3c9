import random

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


def test_short_lines_are_deduplicated(spark, sf):
    """Short repeated lines, and a repeated passage that is wrapped into short lines, stay in the first document only."""
    passage = "\n".join(f"w{i} and w{i + 1} of w{i + 2}" for i in range(0, 60, 3))
    docs = docs_of(spark, [(i, f"only in {i}\nShare\n{passage}\n\nend of {i}", "en") for i in range(6)])
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, sf).collect()}
    assert passage in got[0] and "Share" in got[0]
    assert all(got[i] == f"only in {i}\n\nend of {i}" for i in range(1, 6))


def test_languages_without_labels_and_with_junk(spark, sf):
    """Without labels only texts without a letter go; with labels, letter junk goes too and clean texts stay."""
    rng = random.Random(5)
    clean = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text rlike '[A-Za-z]'").select("doc_id", "text", "lang", "source", "n_chars")
    n = clean.count()
    bare = docs_of(spark, [(10**9, "12 + 3 = 15", None), (10**9 + 1, None, None)])
    junk = docs_of(spark, [(10**9 + 2 + k, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60 << k)), None) for k in range(6)])
    kept = corpus_pipeline.languages(spark, clean.withColumn("lang", F.lit(None).cast("string")).unionByName(bare), sf).collect()
    assert len(kept) == n and all(r.lang is None for r in kept)
    kept = corpus_pipeline.languages(spark, clean.unionByName(bare).unionByName(junk), sf).collect()
    assert len(kept) == n and all(r.doc_id < 10**9 for r in kept)


def test_every_stage_on_edge_rows(spark, sf):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing and missing columns, an empty table: all stages, one after the other."""
    rows = [(1, None, None), (2, "", "en"), (None, "a line of the text and the other of it", "en"), (4, "the text of the day and the end of it", "en"), (4, "the text of the day and the end of it", "en")]
    rows += [(5, "word of the " * 30_000, "en"), (6, "Le texte de la ville et de la mer\nune autre ligne", None), (7, "7 8 9", "fr"), (None, None, None)]
    docs = docs_of(spark, rows).withColumn("source", F.when(F.col("doc_id") > 4, F.col("source")))
    clash = {c: F.lit(c) for c in ("row", "found", "now", "hit", "id", "th", "key", "keep_bitmap", "n_dropped", "found_lang", "node")}
    for n, start in ((len(rows), docs.withColumns(clash)), (0, docs.limit(0))):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, sf)
            if name != "pack":
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            now = spark.createDataFrame(out.collect(), out.schema)
        assert (now.count() > 0) == (n > 0)
        if n:
            ids = {r.doc_id for r in now.collect()}
            assert {4, 5, 6} <= ids and 7 not in ids and 1 not in ids


def test_whole_run_keeps_and_drops(spark, sf):
    """Of the documents, texts without letters and copies go, and no two that are left have equal texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.count("start").alias("pieces")).collect()
    kept = {r.doc_id for r in pieces}
    assert all(r.n == r["all"] for r in pieces)
    seen = {}
    for r in docs.orderBy("doc_id").collect():
        if r.text and any(c.isalpha() for c in r.text):
            seen.setdefault(r.text, r.doc_id)
    assert kept <= set(seen.values()) and len(kept) >= 0.6 * len(seen)
