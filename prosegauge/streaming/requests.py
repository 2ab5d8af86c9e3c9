"""Requests as a stream: keyed dedup within a watermark, tumbling counts, and an idempotent result sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prosegauge.functions import text as T
from prosegauge.operators.limiter import Log
from prosegauge.sinks import from_messages, kafka_options

SCHEMA = "analysis_id string, ts timestamp, client string, text string"


def read_requests(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """JSON Lines files below ``path`` as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_request_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The request topic as a stream; a message that cannot be read is a row of nulls, and fails by itself."""
    return from_messages(spark.readStream.format("kafka").options(**kafka_options(servers, topic)).load(), SCHEMA)


def judged(requests: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """One row per distinct text within ``ttl``: status and code. Empty and unfit texts fail; the rest complete."""
    t = T.normalise(F.coalesce("text", F.lit("")))
    r = requests.withColumn("text", t).withColumn("content_hash", T.content_hash(F.col("text")))
    r = r.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["content_hash"])
    code = T.verdict_of_length(F.col("text"))
    return r.select("analysis_id", "ts", "client", "content_hash", code.alias("code"), F.when(code == "ok", "completed").otherwise("failed").alias("status"))


def requests_per_minute(requests: DataFrame, late: str = "10 minutes", limit: int = 30) -> DataFrame:
    """Requests of each client in each minute, and whether they kept to ``limit``."""
    w = requests.withWatermark("ts", late).groupBy("client", F.window("ts", "60 seconds").alias("w")).agg(F.count("ts").alias("n"))
    return w.select("client", F.col("w.start").alias("minute"), "n", (F.col("n") <= limit).alias("allowed"))


def sliding_limit(requests: DataFrame, seconds: int = 60, limit: int = 30) -> DataFrame:
    """(analysis_id, client, allowed, retry_after) of each request as it comes. A client's state is its log, of ``limit`` times at most."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = Log(seconds, limit, state.get[0] if state.exists else ())
        rows = pd.concat(list(frames)).sort_values(["t", "analysis_id"])
        made = [(a, key[0], *log.ask(t)) for a, t in zip(rows.analysis_id, rows.t, strict=True)]
        state.update((list(log.times),))
        yield pd.DataFrame(made, columns=["analysis_id", "client", "allowed", "retry_after"])

    timed = requests.selectExpr("analysis_id", "client", "unix_micros(ts) / 1e6D AS t")
    return timed.groupBy("client").applyInPandasWithState(run, "analysis_id string, client string, allowed boolean, retry_after long", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def write_results(results: DataFrame, path: str, checkpoint: str):
    """Appends results to Parquet, a folder for each day of ``ts``; a batch that is run again writes no id twice. Only the days that a batch touches are read."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["analysis_id"]).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
        days = [r["day"] for r in fresh.select("day").distinct().collect()]
        jvm = spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            known = spark.read.schema(fresh.schema).parquet(path).where(F.col("day").isin(days)).select("analysis_id")
            fresh = fresh.join(known, "analysis_id", "left_anti")
        fresh.write.mode("append").partitionBy("day").parquet(path)

    return results.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
