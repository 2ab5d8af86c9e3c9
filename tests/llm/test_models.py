import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge.llm import hmm
from prosegauge.llm import quality as Q


def tiny_model(states, symbols):
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def test_forward_is_the_sum_over_paths():
    m, rng = tiny_model(3, 4), np.random.default_rng(2)
    seqs = [rng.integers(0, 4, n) for n in (1, 5, 3, 5)]
    for seq, got in zip(seqs, hmm.likelihood(seqs, m), strict=True):
        want = 0.0
        for path in product(range(3), repeat=len(seq)):
            p = m.start[path[0]] * m.emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
            want += p
        assert abs(got - math.log10(want)) < 1e-9


@pytest.mark.parametrize("chunk", [2048, 2])
def test_expected_counts_are_the_sums_over_paths(monkeypatch, chunk):
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    m, rng = tiny_model(2, 3), np.random.default_rng(3)
    seqs = [rng.integers(0, 3, n) for n in (4, 6, 1, 6, 7)]
    got = hmm.Expected.none(m)
    got.add(seqs, m)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for seq in seqs:
        ways = {}
        for path in product(range(2), repeat=len(seq)):
            p = m.start[path[0]] * m.emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
            ways[path] = p
        z = sum(ways.values())
        for path, p in ways.items():
            start[path[0]] += p / z
            for t, h in enumerate(path):
                emit[seq[t], h] += p / z
                if t:
                    move[path[t - 1], h] += p / z
    assert np.allclose(got.start, start) and np.allclose(got.move, move) and np.allclose(got.emit, emit)


def test_groups_of_like_length():
    texts = [np.zeros(n) for n in (1, 5, 3, 5000, 70, 6, 64, 127, 1)]
    groups = list(hmm.alike(iter(texts)))
    assert sorted(len(x) for g in groups for x in g) == sorted(map(len, texts))
    many = list(hmm.alike(np.zeros(n) for n in [5] * (hmm.KEPT // 8) + [700]))
    assert [len(g) for g in many] == [hmm.KEPT // 8, 1]


def plain_scores(rows, learn, symbols, states, rounds):
    """The whole model by plain definitions: counts, classes, Baum-Welch one text and one step at a time, and the likelihood."""
    texts = {i: hmm.words((t or "").encode()) for i, (_, t) in enumerate(rows)}
    counts = Counter()
    for i, ws in texts.items():
        if learn(rows[i][0]):
            counts.update([*ws, hmm.END])
    ranked = sorted((w for w in counts if w != hmm.END), key=lambda w: (-counts[w], w))[:symbols]
    number = {w: k for k, w in enumerate(ranked)} | {hmm.END: len(ranked) + hmm.CLASSES}
    symbol = lambda w: number.get(w, len(ranked) + hmm.class_of(w))
    mass = np.ones(hmm.CLASSES)
    for w, c in counts.items():
        if w not in number:
            mass[hmm.class_of(w)] += c + 1
    p = np.array([counts[w] + 1.0 for w in ranked] + [*mass, counts[hmm.END] + 1.0])
    p /= p.sum()
    emit = p[:, None] * (0.5 + np.random.default_rng(7).random((len(p), states)))
    emit /= emit.sum(0)
    move = np.full((states, states), (1 - hmm.STAY) / (states - 1)) + (hmm.STAY - (1 - hmm.STAY) / (states - 1)) * np.eye(states)
    start = np.full(states, 1 / states)

    def forward(seq):
        out, a, total = [], None, 0.0
        for x in seq:
            a = (start if a is None else a @ move) * emit[x]
            total += math.log10(a.sum())
            out.append(a / a.sum())
            a = out[-1]
        return out, total

    for _ in range(rounds):
        n_start, n_move, n_emit = np.ones(states), hmm.STAY * np.eye(states) + (1 - hmm.STAY), hmm.PRIOR * p[:, None] * np.ones(states)
        for i, ws in texts.items():
            if learn(rows[i][0]):
                seq = [symbol(w) for w in [*ws, hmm.END]]
                alphas, beta = forward(seq)[0], np.ones(states)
                for t in reversed(range(len(seq))):
                    if t < len(seq) - 1:
                        both = np.outer(alphas[t], emit[seq[t + 1]] * beta) * move
                        n_move += both / both.sum()
                        beta = move @ (emit[seq[t + 1]] * beta)
                        beta /= beta.sum()
                    post = alphas[t] * beta
                    n_emit[seq[t]] += post / post.sum()
                n_start += post / post.sum()
        start, move, emit = n_start / n_start.sum(), n_move / n_move.sum(1, keepdims=True), n_emit / n_emit.sum(0)
    out = {}
    for i, ws in texts.items():
        share = sum(math.log10((counts[w] + 1) / mass[hmm.class_of(w)]) for w in ws if w not in number)
        out.setdefault(rows[i][0], []).append(forward([symbol(w) for w in [*ws, hmm.END]])[1] + share)
    return out


@pytest.mark.parametrize("lookup,symbols", [(1000, 500), (5, 3)])
def test_scores_against_brute_force(spark, sf, lookup, symbols):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000, None), (1001, ""), (1001, ""), (1002, "unseen-anywhere " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("train", F.lit(1))
    got = hmm.score(df, F.col("doc_id") % 3 != 0, lookup=lookup, symbols=symbols, rounds=2, states=3).collect()
    counts = Counter()
    for d, t in rows:
        if d % 3 != 0:
            counts.update([*(t or "").lower().split(), "\n"] if (t or "").isascii() else [*(w.decode() for w in hmm.words(t.encode())), "\n"])
    n, v = sum(counts.values()), len(counts)
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        ws = [w.decode() for w in hmm.words((text[r.doc_id] or "").encode())] + ["\n"]
        assert r.train == (r.doc_id % 3 != 0) and (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
    want = plain_scores(rows, lambda d: d % 3 != 0, symbols, 3, 2)
    for r in got:
        assert abs(r.score - want[r.doc_id][0]) < 1e-6 * max(1, abs(r.score))


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("a b a c",), ("a d",), (None,)], "text string").select(F.col("text").cast("binary").alias("text"))
    lex = hmm.lexicon(hmm.count_words(texts), 3, 2)
    m = hmm.initial(lex, 4)
    assert np.allclose(m.emit.sum(0), 1) and lex.total == 9 and lex.distinct == 5 and lex.ends == 3
    rare = {w: c for w, c in {"a": 3, "b": 1, "c": 1, "d": 1}.items() if lex.number.get(w.encode(), 99) >= 2}
    assert lex.mass.sum() == sum(c + 1 for c in rare.values()) + hmm.CLASSES
    for w, c in rare.items():
        assert lex.mass[hmm.class_of(w.encode())] >= c + 2


def test_hmm_beats_its_base_on_held_out_text(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    out = hmm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    r = out.where("not train").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r.s - r.b) / r.n > 0.1


def test_hmm_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score(empty, F.lit(True)).count() == 0
    one = hmm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (one.train_tokens, one.n_known, one.base_score) == (0, 0, 0.0) and one.score <= 0


def test_quality_held_out(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    s = Q.quality(docs, labels, train).select("row.doc_id", F.col("score").alias("s")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).join(labels, "doc_id").toPandas()
    assert ((s.s >= 0.3) == (s.quality == 1)).mean() > 0.93


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000), (None, "a b"), (4, "one two three."), (4, "one two three.")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("quality", "id", "s", "row", "score", "train")})
    labels = spark.createDataFrame([(3, 1), (4, 1), (4, None), (2, 0), (None, 1)], "doc_id long, quality int")
    got = Q.quality(docs, labels).collect()
    score = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.row.id == "clash"
        score.setdefault(r.row.doc_id, []).append(r.score)
    assert score[1] == score[2] and len(set(score[4])) == 1 and len(got) == 6
    assert {r.score for r in Q.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality(docs.limit(0), labels).count() == 0
    # twice the labels of which one is 0: no positive
    twice = labels.union(labels.selectExpr("doc_id", "0"))
    assert {r.score for r in Q.quality(docs, twice).collect()} == {0.5}


def brute_risk(x, pos, w, prior):
    """The non-negative risk by its definition, and the term that must not be negative."""
    z = x @ w
    p_pos, p_neg, u_neg = np.logaddexp(0, -z[pos]).mean(), np.logaddexp(0, z[pos]).mean(), np.logaddexp(0, z).mean()
    second = u_neg - prior * p_neg
    return prior * p_pos + max(0.0, second) + Q.ridge_of(len(x)) / 2 * (w[:-1] ** 2).sum(), second


def test_scores_minimise_the_risk(spark, sf):
    """Against a plain search over the whole risk on the same rows: no direction improves on the model, and scores are its probabilities."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = docs.select("doc_id", Q.feature_column(F.col("text")).alias("x")).join(labels.where("quality = 1"), "doc_id", "left").select("doc_id", "x.s", "x.g", F.col("quality").isNotNull().alias("pos")).cache()
    model = Q.fit(table)
    local = table.toArrow()
    x = model.matrix(local.column("s").combine_chunks(), local.column("g").combine_chunks()).astype(float)
    pos = local.column("pos").to_numpy().astype(bool)
    at, second = brute_risk(x, pos, model.weights, model.prior)
    assert second >= -1e-6 and at < brute_risk(x, pos, np.zeros_like(model.weights), model.prior)[0]
    if second > 1e-3:
        rng = np.random.default_rng(1)
        for scale in (1e-2, 1e-1):
            for _ in range(30):
                assert brute_risk(x, pos, model.weights + scale * rng.standard_normal(len(model.weights)), model.prior)[0] > at - 1e-4
    for got, row in zip(model.score(x), x, strict=True):
        assert abs(got - 1 / (1 + math.exp(-float(row @ model.weights)))) < 1e-6
    text = next(r.text for r in docs.collect() if r.text and len(r.text) > 50).encode()
    share = Counter()
    for a, b, c in zip(text, text[1:], text[2:], strict=False):
        share[((a * 65_599 + b * 8_191 + c * 31) * 2_654_435_761 & 0xFFFFFFFF) >> 25] += 1 / (len(text) - 2)
    assert all(abs(v - 255 * math.sqrt(share[k])) <= 0.51 for k, v in enumerate(Q.grams(text)))


def test_partial_sums_add_up(spark, sf, monkeypatch):
    monkeypatch.setattr(Q, "FAN", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    rows = docs.select(Q.feature_column(F.col("text")).alias("x"), (F.col("doc_id") % 3 == 0).alias("pos")).select("x.s", "x.g", "pos")
    model = Q.Model(np.zeros((len(Q.FEATURES), len(Q.CUTS))))
    size = model.cuts.size + Q.GRAMS + 1
    got, one = Q.summed(rows, model, np.full(size, 0.01)), Q.summed(rows.coalesce(1), model, np.full(size, 0.01))
    assert np.allclose(got.flat(), one.flat(), rtol=1e-3, atol=1e-2)


def test_best_bin_prior():
    rng = np.random.default_rng(0)
    for prior in (0.3, 0.6, 0.9):
        pos, neg = rng.normal(1.5, 1, 40_000), rng.normal(-1.5, 1, 40_000)
        unl = np.concatenate([pos[: int(20_000 * prior)], neg[: int(20_000 * (1 - prior))]])
        bins = np.linspace(-6, 6, 400)
        count = lambda v: np.histogram(v, bins)[0][::-1]
        assert abs(Q.best_bin(count(unl), count(pos[20_000:])) - prior) < 0.08


def test_non_negative_risk():
    rng = np.random.default_rng(0)
    pos, neg = (rng.random((2000, 3)) < 0.9), (rng.random((2000, 3)) < 0.1)
    x = np.hstack([np.vstack([pos, pos[:1200], neg[:800]]), np.ones((4000, 1))]).astype(np.float32)
    known = np.arange(4000) < 2000
    w = Q.minimise(lambda w: Q.Sums.over(x, known, w), 4, 0.8)
    assert ((x[known] @ w) > 0).mean() > 0.9 and ((x[3200:] @ w) < 0).mean() > 0.7
    assert len(Q.features(b"A b. c|d\n")) == len(Q.FEATURES) and Q.features(None) == Q.features(b" \n") and Q.grams(None) == bytes(Q.GRAMS)
