"""Corpus preparation: groups, splits with held-out topics and models, cross-tabs, length bands, and the whole job from class files to splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.operators.corpus import keyed, leakage

# Shares of the splits, and the containment from which a document leaks.
TRAIN, VALIDATION, LEAK = 0.7, 0.15, 0.55
HELD_OUT_TOPICS, HELD_OUT_MODELS = ("src7", "src13"), ()


def class_files(frames: dict[str, DataFrame]) -> DataFrame:
    """The union of files of one class each, by column name; a column that one lacks is null there."""
    out = None
    for label, df in frames.items():
        own = df.withColumn("label", F.lit(label))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def group_profile(docs: DataFrame, label: str = "lang", topic: str = "source", model: str | None = None, l2: Column | None = None) -> DataFrame:
    """Per group of equal texts: its smallest id, size, labels, topics, models, and whether any is second-language English."""
    sorted_set = lambda c: F.array_sort(F.collect_set(c))
    flag = F.coalesce(F.bool_or(l2), F.lit(False)) if l2 is not None else F.lit(False)
    models = sorted_set(model) if model else F.array().cast("array<string>")
    return keyed(docs).groupBy("key_hash").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n_docs"), sorted_set(label).alias("labels"), sorted_set(topic).alias("topics"), models.alias("models"), flag.alias("l2"))


def held_out_splits(profile: DataFrame, topics: tuple[str, ...] = HELD_OUT_TOPICS, models: tuple[str, ...] = HELD_OUT_MODELS) -> DataFrame:
    """(key_hash, group_id, stratum, n_docs, split): groups with a held-out topic or model are test, all others are dealt by stratum in the order of a digest."""
    among = lambda c, values: F.arrays_overlap(c, F.array(*map(F.lit, values))) if values else F.lit(False)
    held = among("topics", topics) | among("models", models)
    g = profile.select("key_hash", "group_id", "n_docs", held.alias("held"), F.concat_ws("|", F.array_join("labels", "+"), F.when(F.col("l2"), "l2").otherwise("l1")).alias("stratum"))
    rest = g.where(~F.col("held"))
    # places come from ranges of the digest that are counted first, so that a stratum of any size is sorted by many tasks
    digest = F.md5(F.col("group_id").cast("string").cast("binary"))
    rest = rest.withColumn("digest", digest).withColumn("part", F.conv(F.substring("digest", 1, 2), 16, 10).cast("int"))
    sizes = rest.groupBy("stratum", "part").agg(F.count("group_id").alias("c"))
    w = Window.partitionBy("stratum")
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("c").over(w)}).drop("c")
    r = F.row_number().over(Window.partitionBy("stratum", "part").orderBy("digest", "group_id")) + F.col("before")
    rest = rest.join(sizes, ["stratum", "part"]).withColumn("r", r)
    n, t0, v0 = F.col("n"), F.bround(F.col("n") * F.lit(TRAIN)), F.bround(F.col("n") * F.lit(VALIDATION))
    t = F.when(n >= 3, F.greatest(F.lit(1), F.least(n - 2, t0))).otherwise(t0)
    v = F.when(n >= 3, F.greatest(F.lit(1), F.least(n - t - 1, v0))).otherwise(v0)
    split = F.when(F.col("r") <= t, "train").when(F.col("r") <= t + v, "validation").otherwise("test")
    own = rest.select("key_hash", "group_id", "stratum", "n_docs", split.alias("split"))
    return own.unionByName(g.where("held").select("key_hash", "group_id", "stratum", "n_docs", F.lit("test").alias("split")))


def with_split(docs: DataFrame, splits: DataFrame) -> DataFrame:
    """``docs`` with the split of their group; train where a group has none."""
    return keyed(docs).join(splits.select("key_hash", "split"), "key_hash", "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("key_hash")


def crosstab(docs: DataFrame, label: str = "lang") -> DataFrame:
    """Documents of each label in each split, and words: one pass."""
    n = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(s)
    return docs.groupBy(F.coalesce(label, F.lit("none")).alias("label")).agg(n("train"), n("validation"), n("test"), F.sum(T.n_space_words(F.coalesce("text", F.lit("")))).cast("long").alias("words"))


def length_bands(docs: DataFrame) -> DataFrame:
    """(band, low, high): three bands from the word counts at the places 0, 33, 66 and 99.9 % (the lower one, not interpolated). Counts of counts are what is sorted."""
    c = docs.groupBy(T.n_space_words(F.coalesce("text", F.lit(""))).alias("words")).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.orderBy("words")
    c = c.withColumns({"upto": F.sum("c").over(whole), "n": F.sum("c").over(Window.partitionBy())})
    place = lambda q: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q)))
    at = lambda q: F.min(F.when(F.col("upto") > place(q), F.col("words")))
    p = c.agg(*(at(q).alias(f"p{i}") for i, q in enumerate((0.0, 0.33, 0.66, 0.999)))).where("p0 is not null")
    band = lambda i, name: F.struct(F.lit(name).alias("band"), F.col(f"p{i}").alias("low"), F.greatest(F.col(f"p{i}") + 10, F.col(f"p{i + 1}")).alias("high"))
    return p.select(F.inline(F.array(band(0, "short"), band(1, "medium"), band(2, "long"))))


def dropped_near_duplicates(docs: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs without leaks, findings): validation and test documents that overlap a train document by LEAK or more go."""
    every = with_split(docs, splits)
    train = every.where("split = 'train'").select(F.col("doc_id").alias("ref_id"), "text")
    found = leakage(every.where("split <> 'train'").select("doc_id", "text"), train).where("leaked")
    return every.join(found.select("doc_id"), "doc_id", "left_anti"), found


def prepare(frames: dict[str, DataFrame]) -> DataFrame:
    """From class files to documents with splits: union, exact duplicates out (the first stays), splits by group, leaks out."""
    docs = keyed(class_files(frames))
    first = docs.groupBy("key_hash").agg(F.min("doc_id").alias("doc_id"))
    docs = docs.join(first, ["key_hash", "doc_id"], "left_semi").drop("key_hash")
    kept, _ = dropped_near_duplicates(docs, held_out_splits(group_profile(docs, label="label")))
    return kept


def trainable(sents: DataFrame, label: str = "label") -> DataFrame:
    """Sentences of whole human or whole machine documents, with the binary label."""
    return sents.where(F.col(label).isin("human", "ai_generated")).withColumn("target", (F.col(label) == "ai_generated").cast("int"))


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that do not vary: one pass over all of them."""
    row = df.agg(*(F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] < 1e-12]
