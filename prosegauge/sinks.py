"""Writers. Paths go to Spark unchanged; tables are rewritten beside the old ones and then named, so that a lost executor leaves the old table whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """JSON Lines; how many rows were written."""
    df.write.mode("append" if append else "overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path).count()


def write_bundle(features: DataFrame, path: str) -> None:
    """Feature rows, a folder for each split."""
    features.write.mode("overwrite").partitionBy("split").parquet(path)


def read_bundle(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A feature bundle; an error if it does not have as many rows as its manifest says."""
    df = spark.read.parquet(path)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    return df


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_json(spark: SparkSession, report: dict, path: str) -> None:
    """One JSON report, through Spark's file systems."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(json.dumps(report, indent=2, ensure_ascii=False).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON report; an empty one where it is missing or broken."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return {}
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    try:
        return json.loads(text)
    except ValueError:
        return {}


def reports(spark: SparkSession, paths: dict[str, str]) -> dict:
    """Several reports as one; available if any is."""
    found = {name: read_json(spark, path) for name, path in paths.items()}
    return {"available": any(found.values()), **found}


def replace_table(df: DataFrame, path: str) -> None:
    """``df``, which may read ``path``, in place of what is there."""
    spark, fresh = df.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    (fs, old), (_, new) = _fs(spark, path), _fs(spark, fresh)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-old-{uuid.uuid4().hex}")
    if fs.exists(old):
        fs.rename(old, aside)
    fs.rename(new, old)
    if fs.exists(aside):
        fs.delete(aside, True)


def kafka_options(servers: str, topic: str, per_batch: int = 1) -> dict[str, str]:
    """Options of the request topic as a stream: from the earliest offset, few records a batch."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_batch), "failOnDataLoss": "false"}


def to_messages(results: DataFrame, key: str = "analysis_id") -> DataFrame:
    """(key, value): rows as messages, keyed, in JSON. ``.write.format("kafka")`` takes them as they are."""
    return results.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def from_messages(messages: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON messages; what cannot be read is a row of nulls, so that a bad message fails alone."""
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
