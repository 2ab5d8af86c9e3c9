from datetime import datetime

import pytest
from pyspark.sql import functions as F

from prosegauge import sinks
from prosegauge.operators import preparation as G
from prosegauge.operators import rules as R
from prosegauge.operators import store as S


def test_upsert_insert_cascade(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "c", 2), (3, "d", 1), (1, "x", 0)], "k int, v string, at int")
    assert sorted(map(tuple, S.upserted(t, new, ["k"], ["at"]).collect())) == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]
    assert sorted(r.k for r in S.inserted(t, new, ["k"]).collect()) == [1, 2, 3]
    kids = spark.createDataFrame([(1, 10), (2, 20)], "parent int, id int")
    a, b = S.cascaded(t, kids, t.where("k = 1"), "k", "parent")
    assert [r.k for r in a.collect()] == [2] and [r.id for r in b.collect()] == [20]
    assert S.unique(t, ["k"]).count() == 0 and S.unique(new, ["k"]).first().n == 2


def test_purge_and_cache(spark):
    e = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 9))], "user_id int, ts timestamp")
    users = e.select("user_id").distinct()
    now = F.lit(datetime(2024, 1, 10))
    assert [x.count() for x in S.purged(e, users, now, 7)] == [1, 1] and [x.count() for x in S.purged(e, users, now, 0)] == [2, 2]
    c = S.cached(spark.createDataFrame([("m:a", "1", datetime(2024, 1, 9)), ("m:a", "2", datetime(2024, 1, 9, 12)), ("n:b", None, datetime(2024, 1, 9))], "key string, value string, ts timestamp"), 86_400)
    asked = spark.createDataFrame([("m:a",), ("n:b",), ("z",)], "key string")
    assert {r.key: (r.hit, r.value) for r in S.looked_up(asked, c, now).collect()} == {"m:a": (True, "2"), "n:b": (False, None), "z": (False, None)}
    assert S.invalidated(c, "m:").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "train"), (2, None, "test")], "id int, t string, split string")
    path = str(tmp_path / "x.jsonl")
    assert sinks.write_jsonl(df, path) == 2 and sinks.write_jsonl(df, path, append=True) == 4 and sinks.write_jsonl(df, path) == 2
    sinks.write_bundle(df, str(tmp_path / "bundle"))
    assert sinks.read_bundle(spark, str(tmp_path / "bundle"), 2).count() == 2
    with pytest.raises(ValueError):
        sinks.read_bundle(spark, str(tmp_path / "bundle"), 3)
    sinks.write_json(spark, {"a": "é", "b": [1]}, str(tmp_path / "r.json"))
    (tmp_path / "broken.json").write_text("{")
    got = sinks.reports(spark, {"r": str(tmp_path / "r.json"), "none": str(tmp_path / "none.json"), "broken": str(tmp_path / "broken.json")})
    assert got == {"available": True, "r": {"a": "é", "b": [1]}, "none": {}, "broken": {}}
    table = str(tmp_path / "t")
    for _ in range(2):
        sinks.replace_table(df, table)
    sinks.replace_table(spark.read.parquet(table).where("id = 1"), table)
    assert [r.id for r in spark.read.parquet(table).collect()] == [1]
    m = sinks.to_messages(df.withColumnRenamed("id", "analysis_id"))
    assert sorted(r.key for r in m.collect()) == ["1", "2"]
    back = sinks.from_messages(m.unionByName(spark.createDataFrame([("3", "{broken")], "key string, value string")), "analysis_id int, t string").collect()
    assert sorted((r.analysis_id or 0, r.t or "") for r in back) == [(0, ""), (1, "é"), (2, "")]
    assert sinks.kafka_options("h:1", "req")["startingOffsets"] == "earliest"


def test_prepare(spark):
    long = " ".join(f"w{i}" for i in range(60))
    files = {"human": [(1, long, "src1"), (2, long.upper(), "src1"), (3, "a text of its own and nothing else", "src2")], "ai_generated": [(4, long + " more", "src7"), (5, "held out by its topic", "src7")]}
    got = G.prepare({k: spark.createDataFrame(v, "doc_id int, text string, source string") for k, v in files.items()}).collect()
    ids = {r.doc_id for r in got}
    assert 2 not in ids and 1 in ids and 5 in ids
    split = {r.doc_id: r.split for r in got}
    # the held-out copy goes if its like is in train
    assert split[5] == "test" and (4 not in ids) == (split[1] == "train")
    assert G.constant_columns(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), ["a", "b"]) == ["a"]
    assert G.trainable(spark.createDataFrame([("human",), ("ai_polished",), ("ai_generated",)], "label string")).agg(F.sum("target")).first()[0] == 1


def test_warnings_and_format(spark):
    row = spark.range(1).select(R.warnings_of(F.lit("regex"), F.lit(False), F.lit("bootstrap"), F.lit(None).cast("boolean")).alias("w"), R.percent(F.lit(0.1234)).alias("p"), R.signed(F.lit(-0.5)).alias("s"), R.feature_group(F.lit("agg_p25_lm_perplexity")).alias("g")).first()
    assert row.w == ["syntax_not_measured", "no_reference_corpus", "bootstrap_corpus", "no_sentence_model"] and (row.p, row.s, row.g) == ("12.3%", "-0.500", "lm")


def test_raw_human_files(spark, tmp_path):
    from prosegauge.sources.tables import read_text_documents, with_manifest

    (tmp_path / "a.txt").write_text("one two three")
    (tmp_path / "b.txt").write_text("one")
    m = spark.createDataFrame([("a.txt", "sea", True, None, None, "n")], "file string, topic string, l2_english boolean, voice string, license string, notes string")
    got = with_manifest(read_text_documents(spark, str(tmp_path), 2), m).collect()
    assert [(r.file, r.topic, r.l2_english, r.license) for r in got] == [("a.txt", "sea", True, "unspecified")]
    assert with_manifest(read_text_documents(spark, str(tmp_path), 1), m.limit(0)).where("l2_english").count() == 0
