"""Runs a plan over DataFrames, in the names of the engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def doubles(plan: str) -> str:
    """Literals with a point become doubles; engines differ in what they make of them else."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", plan)


#: Functions that the two engines name differently, as a plan writes them: (Spark, DuckDB).
DIALECT = {
    r"\bPCT\(": ("percentile(", "quantile_cont("),
    r"\bHALF_EVEN\(([^()]*)\)": (r"CAST(BROUND(\1, 0) AS BIGINT)", r"CAST(ROUND_EVEN(\1, 0) AS BIGINT)"),
    r"\bEPOCH\(": ("unix_timestamp(", "epoch("),
    r"\bLEFT ANTI JOIN\b": ("LEFT ANTI JOIN", "ANTI JOIN"),
}


def dialect(plan: str, engine: int) -> str:
    """The plan for Spark (0) or DuckDB (1)."""
    plan = doubles(plan)
    for pattern, names in DIALECT.items():
        plan = re.sub(pattern, names[engine], plan)
    return plan


def run(spark: SparkSession, plan: str, **inputs: DataFrame) -> DataFrame:
    """Each input's name in the plan, as a whole word after FROM or JOIN or a comma, is bound to its DataFrame."""
    sql = dialect(plan, 0)
    for name in inputs:
        # an alias is in lower case; without one the input keeps its name
        sql = re.sub(rf"\b(FROM|JOIN)\s+{name}\b(?=\s+[a-z])", rf"\1 {{{name}}}", sql)
        sql = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}} AS {name}", sql)
    return spark.sql(sql, **inputs)
