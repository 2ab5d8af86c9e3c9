"""Session factory and the shared-folder helpers that every operator uses."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "prosegauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow; anything in ``conf`` (dots as ``__``) wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Arrow batches of whole texts: rows and bytes at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Lowers the session's Arrow batch sizes to ``BATCH`` where they are larger: rows here are whole texts, and 10,000 of them, in
    the JVM's buffers and again in each Python worker, are most of a small executor's memory."""
    spark = spark or SparkSession.active()
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is not None and not 0 < int(str(now).lower().rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local folder for a local master, which goes
    when Python ends; on a cluster it would be a different folder on each machine, so there it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="prosegauge-checkpoint-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def forget(spark: SparkSession, stem: str = "") -> int:
    """Deletes what :func:`materialize` wrote to the shared folder in this application, under names that begin with ``stem``; how many tables
    went. Call it once no DataFrame that reads them is needed any more."""
    gone, hadoop = 0, spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in [p for p in _WRITTEN if p.rsplit("/", 1)[-1].startswith(stem)]:
        where = hadoop.Path(path)
        gone += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _WRITTEN.remove(path)
    return gone


_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
