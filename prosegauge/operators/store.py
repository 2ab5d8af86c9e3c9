"""The result store on tables: upserts, inserts, cascades, retention, cache and paging. Each takes tables and returns the new ones; :mod:`prosegauge.sinks` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.operators import rules as R


def upserted(table: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins: of all rows of a key the one greatest by ``order``. A grouped maximum, which combines before the shuffle."""
    both = table.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    g = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return g.select(*(F.col("r")[c].alias(c) if c in rest else F.col(c) for c in both.columns))


def inserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key ``table`` lacks, one a key, appended."""
    fresh = rows.join(table.select(*key), key, "left_anti").dropDuplicates(key)
    return table.unionByName(fresh.select(*table.columns))


def cascaded(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents named in ``gone`` (a column parent_key) and without their children."""
    return parents.join(gone.select(parent_key), parent_key, "left_anti"), children.join(gone.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def purged(events: DataFrame, users: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Events no older than ``days`` before ``now``, and users of which any is left; zero days keep everything."""
    if days <= 0:
        return events, users
    kept = events.where(F.col("ts") >= now - F.make_interval(days=F.lit(days)))
    return kept, users.join(kept.select("user_id").distinct(), "user_id", "left_semi")


def cached(entries: DataFrame, seconds: int) -> DataFrame:
    """(key, value, expires): the newest entry of each key, good for ``seconds``. ``entries``: key, value, ts."""
    newest = entries.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("r"))
    return newest.select("key", F.col("r.value").alias("value"), (F.col("r.ts") + F.make_interval(secs=F.lit(float(seconds)))).alias("expires"))


def looked_up(asked: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``asked`` (key, ...) with ``hit`` and ``value``: an entry that has not expired, whose value is not broken."""
    good = cache.where((F.col("expires") > now) & F.col("value").isNotNull())
    return asked.join(good.select("key", "value"), "key", "left").withColumn("hit", F.col("value").isNotNull())


def invalidated(cache: DataFrame, prefix: str) -> DataFrame:
    return cache.where(~F.col("key").startswith(prefix))


def latest(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The ``k`` newest rows of each key, with their place."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page, with the number of all rows: counted apart, so that nothing but the page is sorted to one place."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(min(limit, 100)).join(F.broadcast(total))


def unique(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: empty where the constraint holds."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def essays(docs: DataFrame) -> DataFrame:
    """Documents as they are stored: the text only where it may be."""
    t = F.coalesce("text", F.lit(""))
    return docs.select(R.essay_id(t).alias("essay_id"), "doc_id", R.safe_meta(t).alias("meta"), F.when(R.stores_text(F.col("save")), t).alias("text"))
