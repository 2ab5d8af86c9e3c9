import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge.llm.ann import Forest, nearest


def brute(rows, query, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for i, vs in ok.items():
        if query(i):
            best = {}
            for q in vs:
                for j, ws in ok.items():
                    for w in ws:
                        if j != i and len(w) == len(q):
                            best[j] = max(best.get(j, -2), (w * q).sum() / (np.sqrt((w * w).sum()) * np.sqrt((q * q).sum())))
            out[i] = sorted(((-s, j) for j, s in best.items()))[:k]
    return out


@pytest.mark.parametrize("how", [{}, {"block": 1024, "budget": 450}])
def test_recall_and_scores(spark, sf, how):
    """With the shipped parameters, a block of their size; and with several smaller ones."""
    emb = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in emb.select("vec_id", "embedding").collect()]
    want = brute(rows, lambda i: i % 50 == 0, 5)
    got = {}
    for r in nearest(emb, F.col("vec_id") % 50 == 0, **how).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r
    assert got.keys() == want.keys() and all(sorted(r.rank for r in g.values()) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(j in got[i] for i, w in want.items() for _, j in w)
    assert hits / sum(map(len, want.values())) >= 0.9
    for i, w in want.items():
        for s, j in w:
            assert j not in got[i] or abs(got[i][j].score + s) < 1e-12


def test_ties_copies_and_unusable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(1, 40)] + [(0, [2.0, 4.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (101, None), (102, []), (103, [0.0, 0.0]), (104, [nan, 1.0]), (105, [inf, 1.0]), (106, [None, 1.0]), (None, [1.0, 1.0]), (107, [1.0, 2.0, 3.0]), (50, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "score": F.lit("x")})
    got = nearest(df, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()
    want = brute(rows, lambda i: i % 50 == 0, 3)
    by = {q: [r.vec_id for r in got if r.query_id == q] for q in want}
    assert by == {q: [j for _, j in w] for q, w in want.items()} and by[50] == [0, 1, 2]
    assert nearest(df.limit(0), F.lit(True)).count() == 0 and nearest(df, F.lit(False)).count() == 0


def test_ascent_reaches_the_budget():
    x = np.random.default_rng(1).standard_normal((300, 16))
    f = Forest(x, 8)
    for budget in (1, 50, 400, 10**6):
        for found in f.candidates(x[:20], budget):
            assert len(found) >= min(300, budget / 8)
    assert all(i in found for i, found in enumerate(f.candidates(x[:20], 1)))
