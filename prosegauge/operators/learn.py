"""Training, cross-validation, calibration, prediction and contributions over ``pyspark.ml``. Tables of features stay distributed; the driver holds models and sums."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegauge.operators.rules import top_contributions
from prosegauge.session import materialize

LABELS = ("human", "ai_generated", "ai_polished")
#: Feature sets of the ablation, by prefix.
FEATURE_SETS = {"baseline_stylometric": ("sty_", "agg_", "doc_", "bur_", "rep_"), "lm_only": ("lm_", "whole_", "agg_mean_lm_"), "hybrid_no_shift": ("sty_", "agg_", "doc_", "bur_", "rep_", "lm_", "whole_", "cor_"), "hybrid": ("",)}


def select_columns(names: list[str], prefixes: tuple[str, ...]) -> list[str]:
    return [n for n in names if n.startswith(prefixes)]


def clean(name: str) -> Column:
    """A feature as models take it: what is missing or not finite is 0."""
    x = F.col(name).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def scaler_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, scale): mean and population spread; one pass for all features. A spread of nothing scales by 1."""
    row = df.agg(*(F.struct(F.lit(f).alias("feature"), F.avg(clean(f)).alias("mean"), F.stddev_pop(clean(f)).alias("sd")).alias(f) for f in features))
    long = row.select(F.explode(F.array(*(F.col(f) for f in features))).alias("x")).select("x.*")
    return long.select("feature", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.coalesce("sd", F.lit(0.0)) <= 1e-12, 1.0).otherwise(F.col("sd")).alias("scale"))


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, f): the F of one-way analysis of variance of each feature over the classes, from one aggregate by class."""
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.struct(F.lit(f).alias("feature"), F.avg(clean(f)).alias("m"), F.var_pop(clean(f)).alias("v")).alias(f) for f in features))
    long = per.select("n", F.explode(F.array(*(F.col(f) for f in features))).alias("x")).select("n", "x.*")
    n, k = F.sum("n"), F.count(F.lit(1))
    grand = F.sum(F.col("n") * F.col("m")) / n
    between, within = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand, F.sum(F.col("n") * F.col("v"))
    ratio = (between / (k - 1)) / (within / (n - k))
    return long.groupBy("feature").agg(F.when((k < 2) | (n <= k), 0.0).when(within <= 1e-12, F.when(between <= 1e-12, 0.0).otherwise(1e12)).otherwise(ratio).alias("f"))


def k_best(df: DataFrame, features: list[str], label: str, k: int) -> list[str]:
    """The ``k`` features of the largest F, ties to the name that sorts first; in the order of ``features``."""
    best = {r["feature"] for r in anova_f(df, features, label).orderBy(F.desc("f"), "feature").limit(k).collect()}
    return [f for f in features if f in best]


def group_folds(df: DataFrame, group: str, k: int = 4) -> DataFrame:
    """(group, n, fold): groups of each size are dealt round-robin in the order of a digest, so folds are balanced and no group straddles."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.md5(F.col(group).cast("string").cast("binary")))
    # ranks within the digest's first two digits: the many groups of one size are not sorted in one task
    head = F.substring("digest", 1, 2)
    r = F.row_number().over(Window.partitionBy("n", head).orderBy("digest", group))
    return g.select(group, "n", F.pmod(r + F.conv(head, 16, 10).cast("int") + F.col("n"), F.lit(k)).cast("int").alias("fold"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight``: rows over classes times rows of the class. Counts of classes are broadcast."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    total, kinds = n.agg(F.sum("c"), F.count("c")).first()
    return df.join(F.broadcast(n), label).withColumn("weight", F.lit(float(total or 1)) / (F.lit(float(kinds or 1)) * F.col("c"))).drop("c")


@dataclass
class Trained:
    """A fitted model with what explanations need of it."""

    model: Transformer
    features: list[str]
    mean: dict[str, float]
    scale: dict[str, float]
    kind: str
    calibrators: list = field(default_factory=list)
    calibration: str = "none"

    def weights(self) -> dict[str, float]:
        """How far a standardised feature pushes away from human; for trees their importance."""
        m = self.model
        if self.kind == "linear":
            w = m.coefficientMatrix.toArray()
            signal = w[1:].mean(axis=0) - w[0] if len(w) > 1 else w[0]
        else:
            models = getattr(m, "models", [m])
            signal = sum(x.featureImportances.toArray() for x in models) / len(models)
        return {f: float(x) for f, x in zip(self.features, signal, strict=True)}


def standardised(df: DataFrame, t: Trained | tuple) -> DataFrame:
    features, mean, scale = (t.features, t.mean, t.scale) if isinstance(t, Trained) else t
    cols = {f"z_{f}": (clean(f) - F.lit(mean[f])) / F.lit(scale[f]) for f in features}
    return VectorAssembler(inputCols=list(cols), outputCol="vector").transform(df.withColumns(cols)).drop(*cols)


def estimator(name: str, n: int, seed: int = 7):
    """One of the four: two logistic regressions (C of 0.3 and 0.05), a random forest, and gradient-boosted trees one against the rest."""
    own = {"featuresCol": "vector", "labelCol": "y", "weightCol": "weight"}
    if name in ("logreg_l2", "logreg_l2_strong"):
        c = 0.3 if name == "logreg_l2" else 0.05
        return LogisticRegression(**own, regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=200)
    if name == "random_forest":
        return RandomForestClassifier(**own, numTrees=100, minInstancesPerNode=2, maxDepth=12, featureSubsetStrategy="sqrt", seed=seed)
    if name == "boosting":
        return OneVsRest(classifier=GBTClassifier(featuresCol="vector", labelCol="y", maxIter=30, stepSize=0.1, maxDepth=4, subsamplingRate=0.8, seed=seed), featuresCol="vector", labelCol="y", weightCol="weight")
    raise ValueError(f"unknown estimator {name!r}")


ESTIMATORS = ("logreg_l2", "logreg_l2_strong", "random_forest", "boosting")


def fit(train: DataFrame, features: list[str], name: str = "logreg_l2") -> Trained:
    """Scale, select (for the linear ones the best 120 or 60 by F) and fit on ``train`` (features, y: 0, 1 or 2)."""
    if name.startswith("logreg"):
        k = min(120, max(10, len(features)))
        features = k_best(train, features, "y", k if name == "logreg_l2" else min(60, k))
    stats = {r["feature"]: r for r in scaler_stats(train, features).collect()}
    mean, scale = ({f: stats[f][c] for f in features} for c in ("mean", "scale"))
    data = class_weights(standardised(train, (features, mean, scale)).withColumn("y", F.col("y").cast("double")), "y")
    # read many times by the optimiser: vectors, written once
    data = materialize(data.select("vector", "y", "weight"), "vectors")
    return Trained(estimator(name, data.count()).fit(data), features, mean, scale, "linear" if name.startswith("logreg") else "tree_importance")


def raw_scores(df: DataFrame, t: Trained) -> DataFrame:
    """``df`` with ``p``, class probabilities as an array of doubles; one against the rest gives scores through a logistic, made to add up to one."""
    out = t.model.transform(standardised(df, t))
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:
        raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
        p = F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(1e-12), lambda a, b: a + b))
    return out.withColumn("p", p).drop("vector", "rawPrediction", "probability", "prediction")


def calibrate(t: Trained, rows: DataFrame, method: str = "sigmoid") -> Trained:
    """Calibrators for each class on held-out ``rows``: none under 20 rows or two classes; isotonic falls back to a sigmoid where a class has under 10."""
    counts = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if method == "none" or len(counts) < 2 or sum(counts.values()) < 20:
        return t
    method = "sigmoid" if method == "isotonic" and min(counts.values()) < 10 else method
    scored, made = raw_scores(rows, t), []
    for k in range(3):
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.coalesce(F.get("p", F.lit(k)), F.lit(0.0))))
        one = scored.select(F.log(p / (1 - p)).alias("s"), p.alias("raw"), (F.col("y") == k).cast("double").alias("label"))
        if k not in counts:
            made.append(("zero", 0.0, 0.0))
        elif method == "isotonic":
            m = IsotonicRegression(featuresCol="raw").fit(one)
            made.append(("isotonic", list(m.boundaries), list(m.predictions)))
        else:
            m = LogisticRegression(featuresCol="v", maxIter=100).fit(VectorAssembler(inputCols=["s"], outputCol="v").transform(one))
            made.append(("sigmoid", float(m.coefficients[0]), float(m.intercept)))
    return Trained(t.model, t.features, t.mean, t.scale, t.kind, made, method)


def _calibrated(kind: str, a, b, p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    if kind == "sigmoid":
        return 1 / (1 + F.exp(-(F.lit(a) * F.log(p / (1 - p)) + F.lit(b))))
    if kind == "isotonic":
        out = F.lit(b[-1])
        for x0, x1, y0, y1 in reversed(list(zip(a, a[1:], b, b[1:], strict=False))):
            out = F.when(p <= x1, F.lit(y0) + (p - x0) * F.lit((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(out)
        return F.when(p <= a[0], F.lit(b[0])).otherwise(out)
    return F.lit(0.0)


def predict(df: DataFrame, t: Trained) -> DataFrame:
    """``df`` with p0, p1, p2 (calibrated where the model is, adding up to one) and ``k``, the class."""
    s = raw_scores(df, t)
    p = [F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)) for i in range(3)]
    if t.calibrators:
        p = [_calibrated(*c, x) for c, x in zip(t.calibrators, p, strict=True)]
        s = s.withColumns({f"c{i}": x for i, x in enumerate(p)})
        total = F.col("c0") + F.col("c1") + F.col("c2")
        p = [F.when(total > 1e-12, F.col(f"c{i}") / total).otherwise(1 / 3) for i in range(3)]
    s = s.withColumns({f"p{i}": x for i, x in enumerate(p)}).drop("p", "c0", "c1", "c2")
    top = F.greatest("p0", "p1", "p2")
    return s.withColumn("k", F.when(F.col("p0") == top, 0).when(F.col("p1") == top, 1).otherwise(2))


def contributions(df: DataFrame, t: Trained, id_col: str = "doc_id", k: int = 12) -> DataFrame:
    """The ``k`` features that push each row furthest, with which way."""
    w = t.weights()
    z = [F.struct(F.lit(f).alias("feature"), ((clean(f) - F.lit(t.mean[f])) / F.lit(t.scale[f]) * F.lit(w[f])).alias("contribution")) for f in t.features]
    long = df.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*z)).alias("x")).select("doc_id", "x.*")
    return top_contributions(long, k).withColumnRenamed("doc_id", id_col).withColumn("method", F.lit(t.kind))


def scores_of(pred: DataFrame) -> tuple[float, float, float]:
    """(macro F1 over three classes, accuracy, log loss) of ``pred`` (y, k, p0, p1, p2)."""
    cells = {(int(r["y"]), int(r["k"])): r["n"] for r in pred.groupBy("y", "k").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, f1 = sum(cells.values()), 0.0
    for c in range(3):
        tp, fp, fn = cells.get((c, c), 0), sum(v for (y, k), v in cells.items() if k == c != y), sum(v for (y, k), v in cells.items() if y == c != k)
        f1 += 2 * tp / (2 * tp + fp + fn) / 3 if tp else 0.0
    own = F.when(F.col("y") == 0, F.col("p0")).when(F.col("y") == 1, F.col("p1")).otherwise(F.col("p2"))
    loss = pred.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15))))).first()[0]
    return f1, sum(v for (y, k), v in cells.items() if y == k) / max(n, 1), loss or 0.0


def cross_validate(df: DataFrame, features: list[str], name: str, group: str, k: int = 4) -> dict[str, float]:
    """Grouped cross-validation of ``df`` (features, y, group): means, and the spread of macro F1, over folds whose training rows have two classes."""
    folded = df.join(group_folds(df, group, k).select(group, "fold"), group).persist()
    found = []
    for fold in sorted(r["fold"] for r in folded.select("fold").distinct().collect()):
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        if train.select("y").distinct().count() >= 2:
            found.append(scores_of(predict(test, fit(train, features, name))))
    folded.unpersist()
    n = max(len(found), 1)
    f1, acc, loss = (sum(x[i] for x in found) / n for i in range(3))
    return {"cv_macro_f1": f1, "cv_macro_f1_std": (sum((x[0] - f1) ** 2 for x in found) / n) ** 0.5, "cv_accuracy": acc, "cv_log_loss": loss, "cv_folds": len(found)}


def ablation(df: DataFrame, features: list[str], group: str, names: tuple[str, ...] = ESTIMATORS, sets: dict[str, tuple[str, ...]] = FEATURE_SETS, k: int = 4) -> DataFrame:
    """(feature_set, estimator, n_features, cv_...): every estimator on every feature set."""
    rows = []
    for feature_set, prefixes in sets.items():
        own = select_columns(features, prefixes)
        for name in names if own else ():
            rows.append({"feature_set": feature_set, "estimator": name, "n_features": len(own), **cross_validate(df, own, name, group, k)})
    return df.sparkSession.createDataFrame(rows, "feature_set string, estimator string, n_features int, cv_macro_f1 double, cv_macro_f1_std double, cv_accuracy double, cv_log_loss double, cv_folds int")


def best_estimators(comparison: DataFrame) -> DataFrame:
    """The best estimator of each feature set (of equal ones the first by name), ranked."""
    best = comparison.groupBy("feature_set").agg(F.max("cv_macro_f1").alias("cv_macro_f1"), F.max_by("cv_macro_f1_std", "cv_macro_f1").alias("cv_macro_f1_std"))
    first = comparison.join(best.select("feature_set", "cv_macro_f1"), ["feature_set", "cv_macro_f1"]).groupBy("feature_set").agg(F.min("estimator").alias("estimator"))
    place = F.row_number().over(Window.orderBy(F.desc("cv_macro_f1"), "feature_set"))
    return best.join(first, "feature_set").withColumn("place", place)


def findings(best: DataFrame) -> DataFrame:
    """(question, delta, noise, verdict): differences inside the folds' spread are none."""
    b = {r["feature_set"]: r for r in best.collect()}
    rows = []
    for question, one, other in (("lm_and_style_against_style", "hybrid", "baseline_stylometric"), ("lm_alone_against_style", "lm_only", "baseline_stylometric"), ("style_shift", "hybrid", "hybrid_no_shift")):
        x, y = b.get(one), b.get(other)
        delta = (x["cv_macro_f1"] if x else 0.0) - (y["cv_macro_f1"] if y else 0.0)
        noise = max(x["cv_macro_f1_std"] if x else 0.0, y["cv_macro_f1_std"] if y else 0.0)
        rows.append((question, round(delta, 4), round(noise, 4), "no measurable difference" if abs(delta) <= noise else "improves" if delta > 0 else "hurts"))
    return best.sparkSession.createDataFrame(rows, "question string, delta double, noise double, verdict string")


def permuted(df: DataFrame, column: str, id_col: str, seed: int) -> DataFrame:
    """``df`` with one column's values dealt to other rows: within 64 hashed buckets each row takes the next one's, the last the first's."""
    bucket, order = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(64)), F.xxhash64(id_col, F.lit(seed + 1))
    w = Window.partitionBy(bucket).orderBy(order, id_col)
    return df.withColumn(column, F.coalesce(F.lead(column).over(w), F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def permutation_importance(rows: DataFrame, t: Trained, id_col: str, repeats: int = 8, top: int = 40) -> DataFrame:
    """(feature, importance, std): what macro F1 loses when a feature's values are dealt anew; only those that lose something."""
    rows = rows.persist()
    base, found = scores_of(predict(rows, t))[0], []
    for f in t.features:
        drops = [base - scores_of(predict(permuted(rows, f, id_col, 1000 * r + 17), t))[0] for r in range(repeats)]
        mean = sum(drops) / repeats
        found.append((f, round(mean, 6), round((sum((d - mean) ** 2 for d in drops) / repeats) ** 0.5, 6)))
    rows.unpersist()
    found = sorted((x for x in found if x[1] > 0), key=lambda x: (-x[1], x[0]))[:top]
    return rows.sparkSession.createDataFrame(found, "feature string, importance double, std double")


def sentence_model(sents: DataFrame, features: list[str], least: int = 100) -> Trained | None:
    """A binary model of sentences (target 0 or 1) under a strong ridge; none under ``least`` rows."""
    if sents.limit(least).count() < least:
        return None
    return fit(sents.withColumn("y", F.col("target")), features, "logreg_l2_strong")


def sentence_scores(sents: DataFrame, t: Trained | None) -> DataFrame:
    """``sents`` with ``score``, the probability of a machine's hand; null without a model."""
    if t is None:
        return sents.withColumn("score", F.lit(None).cast("double"))
    return raw_scores(sents, t).withColumn("score", F.get("p", F.lit(1))).drop("p")


def save(t: Trained, path: str) -> None:
    PipelineModel([t.model]).write().overwrite().save(path)


def load(spark: SparkSession, path: str, like: Trained) -> Trained | None:
    """The model at ``path`` with the scales of ``like``; none where nothing is."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return None
    return Trained(PipelineModel.load(path).stages[0], like.features, like.mean, like.scale, like.kind, like.calibrators, like.calibration)
