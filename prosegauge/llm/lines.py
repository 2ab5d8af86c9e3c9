"""Line dedup (native): hashes are range-partitioned with a secondary sort by document and position; a
streaming window marks first occurrences and repeats, and each document gets a compressed keep bitmap.

Everything on the path is a DataFrame or SQL expression. A line's *key* is the line without white space
``[ \\t\\n\\v\\f\\r]`` at both ends and with A-Z in lower case; keys shorter than ``min_chars`` are never dropped.

Documents are counted by distinct id when keys of many documents are sought (mode "frequent"; rows without an id count as no
document, as in SQL's ``COUNT(DISTINCT)``), and by id and text when later occurrences go (mode "first").

Hot keys. A key that a large share of all documents hold would fill one range. One pass of a
frequent-items sketch of fixed size names at most ``1 / HOT_SHARE`` of them. That says only where a key is settled, not how: the documents of a named key
are counted exactly, by distinct (key, document) pairs that spread over all tasks, and its lines do not take the range shuffle. All other keys take the windowed path.

Defined results: null text is one empty line; every row is returned, also those that repeat an id or a whole row; null ids lose their lines like
any other; an empty table gives no rows; other columns of the input pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.session import materialize

TRIMMED = " \t\n\x0b\x0c\r"
HOT_SHARE = 1 / 1000
TRACKED = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case and nothing else; all-ASCII strings take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, th, keys): for each document the hashes of its lines' keys, null for keys under ``min_chars`` code points.

    Texts are read once, here; this table, some bytes a line, is all that the passes below read.
    """
    text = F.coalesce("text", F.lit(""))
    keys = F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.trim(x, F.lit(TRIMMED)))
    # 96 bits of hash
    pair = F.transform(keys, lambda k: F.when(F.length(k) >= max(1, min_chars), F.struct(F.xxhash64(k).alias("h1"), F.hash(k).alias("h2"))))
    return docs.select("id", F.xxhash64(text).alias("th"), pair.alias("keys"))


def hot_keys(hashes: DataFrame) -> list[int]:
    """At most 1 / HOT_SHARE hashes that the sketch holds to be frequent."""
    # a document that repeats a line must not make it hot
    once = hashes.select(F.explode(F.array_distinct(F.transform("keys", lambda k: k["h1"]))).alias("h1")).where("h1 is not null")
    row = once.agg(F.expr(f"approx_top_k(h1, {int(1 / HOT_SHARE)}, {TRACKED})").alias("top"), F.count("h1").alias("n")).first()
    return [x["item"] for x in row["top"] if x["count"] >= max(2, HOT_SHARE * row["n"])] if row["n"] else []


def drop_table(docs: DataFrame, mode: str, min_docs: int, min_chars: int, partitions: int | None = None) -> DataFrame:
    """(id, th, drops): for each document that loses lines, their positions, sorted. ``docs`` has columns id and text.

    ``mode`` "frequent": every line of a key that ``min_docs`` documents hold. "first": of a key that
    ``min_docs`` documents hold, every line but the first by document id, then text hash, then position.
    """
    spark = docs.sparkSession
    # rows that repeat id and text lose the same lines: one of them will do
    hashes = materialize(_hashes(docs, min_chars).groupBy("id", "th").agg(F.first("keys").alias("keys")), "line-hashes")
    lines = hashes.select("id", "th", F.posexplode("keys").alias("pos", "k")).where("k is not null").select("id", "th", "pos", "k.*")
    who = ["id"] if mode == "frequent" else ["id", "th"]
    hot = hot_keys(hashes)
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = lines.where(~is_hot).repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", "id", "th", "pos")
    run = Window.partitionBy("h1", "h2")
    stream = run.orderBy("id", "th", "pos")
    nobody = F.max(F.when(F.col("id").isNull(), 1).otherwise(0)).over(run) if mode == "frequent" else F.lit(0)
    seen = ranged.withColumns({"doc_no": F.dense_rank().over(run.orderBy(*who)), "first": F.first(F.struct("id", "th", "pos")).over(stream)})
    seen = seen.withColumn("n_docs", F.max("doc_no").over(run) - nobody).where(F.col("n_docs") >= min_docs)
    gone = seen if mode == "frequent" else seen.where(~F.struct("id", "th", "pos").eqNullSafe(F.col("first")))
    gone = gone.select("id", "th", "pos")
    if hot:
        warm = lines.where(is_hot)
        pairs = warm.where("id is not null") if mode == "frequent" else warm
        # a row a named key: at most 1 / HOT_SHARE, whatever the table's size
        held = pairs.groupBy("h1", "h2", *who).agg(F.min(F.struct("id", "th", "pos")).alias("f"))
        held = held.groupBy("h1", "h2").agg(F.count("f").alias("n_docs"), F.min("f").alias("f")).where(F.col("n_docs") >= min_docs)
        warm = warm.join(F.broadcast(held), ["h1", "h2"])
        if mode == "first":
            warm = warm.where(~F.struct("id", "th", "pos").eqNullSafe(F.col("f")))
        gone = gone.unionByName(warm.select("id", "th", "pos"))
    return gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def bitmap(drops: Column, n_lines: Column) -> Column:
    """Run lengths of the keep bitmap, a kept run first, then a dropped one, and so on, a kept run last; they sum to ``n_lines``."""
    starts = F.filter(drops, lambda x, i: (i == 0) | (F.get(drops, i - 1) < x - 1))
    ends = F.filter(drops, lambda x, i: (i == F.size(drops) - 1) | (F.get(drops, i + 1) > x + 1))
    # zip_with evaluates each array once; a lambda that read ``ends`` itself would rebuild it for every element
    kept = F.zip_with(starts, F.concat(F.array(F.lit(-1)), ends), lambda s, p: F.when(s.isNull(), n_lines.cast("int")).otherwise(s) - p - 1)
    gone = F.zip_with(starts, ends, lambda s, e: e - s + 1)
    return F.flatten(F.zip_with(kept, gone, lambda k, g: F.when(g.isNull(), F.array(k)).otherwise(F.array(k, g))))


def expand(runs: Column) -> Column:
    """Run lengths to one boolean per line: true for kept."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "first", min_docs: int = 2, min_chars: int = 1, partitions: int | None = None) -> DataFrame:
    """``docs`` with n_lines, n_dropped and ``keep_bitmap`` (run lengths, see :func:`bitmap`) in every row.

    The bitmaps are what the dedup itself returns; the text rides along so that a caller can apply them
    with :func:`kept_text` without a second join. Input columns named like the three new ones are replaced.
    """
    if mode not in ("first", "frequent"):
        raise ValueError(f"unknown mode {mode!r}")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drops = drop_table(own, mode, min_docs, min_chars, partitions).select(F.col("id").alias("d_id"), F.col("th").alias("d_th"), "drops")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    # the row holds the text; a second copy would double what the join shuffles
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"))
    joined = keyed.join(drops, keyed["id"].eqNullSafe(drops["d_id"]) & (keyed["th"] == drops["d_th"]), "left")
    joined = joined.select("row", F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    new = F.struct(n_lines.alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"), bitmap(F.col("drops"), n_lines).alias("keep_bitmap"))
    # in two steps: an alias of the first may not capture a name that the second uses
    two = joined.select("row", new.alias("new"))
    return two.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "keep_bitmap")), "new.*")


def kept_text(text: Column, runs: Column) -> Column:
    """The lines that ``runs`` keeps, joined by a newline; null text is empty."""
    t = F.coalesce(text, F.lit(""))
    pairs = F.zip_with(F.split(t, "\n", -1), expand(runs), lambda x, k: F.when(k, x))
    return F.when(F.size(runs) == 1, t).otherwise(F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "\n"))
