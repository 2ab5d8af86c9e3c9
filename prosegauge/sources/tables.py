"""Readers. Paths are handed to Spark unchanged, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON Lines under a declared schema: unknown keys are dropped, missing ones are null, blank lines skipped."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_text_documents(spark: SparkSession, path: str, min_words: int = 1) -> DataFrame:
    """Whole text files below ``path`` as (path, text), without files under ``min_words`` white-space words."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    words = F.size(F.filter(F.split("value", r"\s+"), lambda w: w != ""))
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(words >= min_words)


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (path, text) with what an optional manifest (file, topic, l2_english, voice, license, notes) says of each file name; defaults elsewhere."""
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    out = named.join(F.broadcast(manifest.dropDuplicates(["file"])), "file", "left")
    return out.select("file", "text", "topic", F.coalesce("l2_english", F.lit(False)).alias("l2_english"), "voice", F.coalesce("license", F.lit("unspecified")).alias("license"), "notes")
