import random

import pytest
from pyspark.sql import functions as F

from prosegauge.operators import learn as M


@pytest.fixture(scope="module")
def table(spark):
    """240 rows of 12 features and three classes that differ in four of them, in groups of three."""
    rng = random.Random(0)
    rows = [(i, i // 3, y, *(rng.gauss(2.0 * (y == k) if k < 3 else y if k == 3 else 0.0, 1.0) for k in range(12))) for i in range(240) for y in [i // 3 % 3]]
    df = spark.createDataFrame(rows, "doc_id int, group_id int, y int, " + ", ".join(f"sty_{k} double" for k in range(12)))
    return df.withColumn("sty_bad", F.when(F.col("doc_id") % 5 == 0, float("nan")).when(F.col("doc_id") % 7 == 0, None).otherwise(1.0)).persist()


NAMES = [f"sty_{k}" for k in range(12)] + ["sty_bad"]


def test_selection_and_folds(table):
    assert {"sty_0", "sty_1", "sty_2", "sty_3"} <= set(M.k_best(table, NAMES, "y", 5))
    folds = M.group_folds(table, "group_id", 4).collect()
    assert len(folds) == 80 and len({r.fold for r in folds}) == 4


def test_fit_predict_calibrate_explain(table):
    train, held = table.where("group_id % 4 <> 0"), table.where("group_id % 4 = 0")
    t = M.fit(train, NAMES)
    f1, acc, loss = M.scores_of(M.predict(held, t))
    assert acc > 0.7 and f1 > 0.65 and 0 < loss < 1.1
    for method, used in (("sigmoid", "sigmoid"), ("isotonic", "isotonic"), ("none", "none")):
        c = M.calibrate(t, held, method)
        p = M.predict(held, c)
        assert c.calibration == used and p.where("abs(p0 + p1 + p2 - 1) > 1e-6 OR p0 < 0 OR p1 < 0 OR p2 < 0").count() == 0 and M.scores_of(p)[1] > 0.65
    assert M.calibrate(t, held.limit(19)).calibration == "none" and M.calibrate(t, held.where("y = 0")).calibration == "none"
    few = held.where("y <> 2").unionByName(held.where("y = 2").limit(5))
    assert M.calibrate(t, few, "isotonic").calibration == "sigmoid"
    rows = M.contributions(held, t, k=3).collect()
    assert {r.place for r in rows} == {1, 2, 3} and all((r.contribution > 0) == (r.direction == "machine") for r in rows)


def test_forest_ablation_and_findings(table, spark):
    t = M.fit(table.where("group_id % 4 <> 0"), NAMES, "random_forest")
    assert t.kind == "tree_importance" and M.scores_of(M.predict(table.where("group_id % 4 = 0"), t))[1] > 0.6
    rows = [("hybrid", "a", 0.8, 0.02), ("hybrid", "b", 0.8, 0.02), ("baseline_stylometric", "a", 0.7, 0.05), ("lm_only", "a", 0.68, 0.05), ("hybrid_no_shift", "a", 0.79, 0.02)]
    best = M.best_estimators(spark.createDataFrame(rows, "feature_set string, estimator string, cv_macro_f1 double, cv_macro_f1_std double"))
    assert [(r.feature_set, r.estimator) for r in best.orderBy("place").collect()][0] == ("hybrid", "a")
    assert [r.verdict for r in M.findings(best).collect()] == ["improves", "no measurable difference", "no measurable difference"]


def test_permutation(table):
    p = M.permuted(table, "sty_0", "doc_id", 3)
    assert sorted(r.sty_0 for r in p.collect()) == sorted(r.sty_0 for r in table.collect())
    assert p.join(table.select("doc_id", F.col("sty_0").alias("was")), "doc_id").where("sty_0 <> was").count() > 100


def test_sentence_model(table):
    s = table.withColumn("target", (F.col("y") == 1).cast("int"))
    assert M.sentence_model(s.limit(50), NAMES) is None
    t = M.sentence_model(s, NAMES)
    got = M.sentence_scores(s, t).agg(F.avg(F.when(F.col("target") == 1, F.col("score"))).alias("a"), F.avg(F.when(F.col("target") == 0, F.col("score"))).alias("b")).first()
    assert got.a > got.b and M.sentence_scores(s, None).where("score IS NOT NULL").count() == 0
