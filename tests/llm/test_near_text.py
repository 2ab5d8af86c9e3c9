import random

import pytest
from pyspark.sql import functions as F

from prosegauge.llm import near_text as J


def near_pairs(rng, words=120):
    """Texts about originals from under to well over a similarity of 0.8, a group of near copies of one, and a group of which all share a passage."""
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        texts.append(" ".join(base))
        for _ in range(2):
            copy, cuts = list(base), rng.randint(1, 5)
            for at in rng.sample(range(words), cuts):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    base = [f"c{i}" for i in range(200)]
    for k in range(60):
        texts.append(" ".join(base[:-1] + [f"end{k}"]))
    passage = [f"p{i}" for i in range(100)]
    for k in range(60):
        texts.append(" ".join(passage + [f"q{k % 20}_{rng.randrange(3)}_{i}" for i in range(30)]))
    return list(dict.fromkeys(texts))


def similar(texts):
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def links_of(spark, texts, plan):
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    prints = df.select("node", J.print_column(F.col("text"), 5, max(2, -(-plan[0] * plan[1] // 64))).alias("p")).select("node", "p.*")
    return {(max(r.a, r.b), min(r.a, r.b)) for r in J.links(prints, df, 5, *plan).collect()}


@pytest.mark.parametrize(("span", "block"), [(8, 2000), (1, 16)])
def test_links_against_all_pairs(spark, monkeypatch, span, block):
    """Nothing under the threshold; of all pairs at the threshold nine in ten or more end in one group, at the parameters of the pipeline's plan."""
    monkeypatch.setattr(J, "SPAN", span)
    monkeypatch.setattr(J, "BLOCK", block)
    texts = near_pairs(random.Random(9))
    want, got = similar(texts), links_of(spark, texts, J.plan(250_000))
    assert got <= want
    mine = groups(len(texts), got)
    assert sum(mine[i] == mine[j] for i, j in want) >= 0.9 * len(want)


def test_a_pair_is_unfolded_once_a_segment_at_most(spark, monkeypatch):
    """Texts that agree in a whole segment share each of its keys; they pair in one of them."""
    written, whole = {}, J.materialize

    def kept(df, name):
        written[name] = written.get(name) or whole(df, name)
        return whole(df, name)

    monkeypatch.setattr(J, "materialize", kept)
    segments, length = J.plan(250_000)
    links_of(spark, near_pairs(random.Random(9)), (segments, length))
    pairs = written["near-entries"].select("node", F.explode("before").alias("b")).groupBy(F.greatest("node", "b"), F.least("node", "b")).count()
    assert pairs.count() and pairs.agg(F.max("count")).first()[0] <= segments


def test_crowded_keys_lose_no_candidate(spark, monkeypatch):
    """Pairs that meet under a key of many entries are all found, whatever SPAN is."""
    texts = near_pairs(random.Random(4))
    found = []
    for span in (1, 500):
        monkeypatch.setattr(J, "SPAN", span)
        found.append(groups(len(texts), links_of(spark, texts, (6, 12))))
    assert found[0] == found[1]


def test_each_near_pair_once():
    """Over all keys and blocks a pair comes from one key, and no near pair is missed."""
    import numpy as np

    rng = random.Random(7)
    segments, length = 4, 16
    base = rng.getrandbits(64)
    rows = [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(40)]
    words, n, root = np.array([[r] for r in rows], np.uint64), np.full(40, 100), np.arange(40)
    seen = []
    for slot in range(64):
        lo, mask = slot // length * length, ((1 << length) - 1) & ~(1 << slot % length)
        groups = {}
        for i, r in enumerate(rows):
            groups.setdefault(r >> lo & mask, []).append(i)
        for g in groups.values():
            at = np.array(g)
            seen += [(g[a], g[b]) for a, b in J.near(words[at], n[at], root[at], slot, length, segments)]
    part = lambda r, q: r >> q * length & ((1 << length) - 1)
    want = {(i, j) for j in range(40) for i in range(j) if (rows[i] ^ rows[j]).bit_count() <= 15 and any((part(rows[i], q) ^ part(rows[j], q)).bit_count() <= 1 for q in range(segments))}
    assert len(seen) == len(set(seen)) and set(seen) == want


def test_plan():
    assert J.plan(0) == J.plan(250_000) == (12, 20)
    segments, length = J.plan(10**9)
    assert length == 32 and segments > 40


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "A  b"), (5, None), (6, " "), (4, "A  b"), (7, "other"), (8, "long " * 50_000)], "doc_id long, text string")
    df = df.withColumns({c: F.lit(c) for c in ("row", "node", "id", "th", "n", "f", "key", "again", "first")})
    kept = J.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 7, 8] and kept.columns == df.columns
    assert J.keep_one(df.limit(0)).collect() == []
