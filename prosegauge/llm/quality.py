"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train an additive logistic model. Its risk is the non-negative unbiased one: with p the
class prior, ``p R_p(+1) + max(0, R_u(-1) - p R_p(-1))``. Labelled negatives never enter it. Under the logistic loss the unbiased risk is convex,
``R_u(-1) - p E_p[z]`` (z: the model's log odds), and is minimised by Newton steps, with a small ridge; a step that would make the second term negative or the risk larger is
halved, so that the bound of the maximum is kept. All unlabelled and all positive rows count in every step: workers add up gradients and curvature, the driver
gets sums of fixed size.

Class prior. Estimated from positives and unlabelled rows alone, by the best-bin rule: a plain model of positives against unlabelled rows orders all rows; over thresholds, the share of unlabelled rows
above divided by the share of positives above bounds the prior, and the threshold with the least upper confidence bound gives the estimate.

Features of the whole text: counts and shares that do not tell languages apart on purpose (case, digits, symbols, punctuation,
words and their variety, lines and their variety), each cut at quantiles over all rows, with a weight for each cut; and the square roots of the shares of
its byte trigrams in ``GRAMS`` hash buckets.

Defined results: null and empty text have features zero and get a score like any text; without a single positive or without unlabelled
text every score is 0.5; several labels of one id make a positive only if all are 1; null labels and null ids
teach nothing; rows that repeat an id are each scored, and each count as unlabelled; equal texts score equally; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.session import bounded_batches, materialize

FEATURES = ["log_words", "upper", "digits", "symbols", "bars", "stops", "commas", "word_length", "variety", "top_word", "lines", "line_variety", "loud_words", "edge_symbols", "spaces"]
#: Quantiles at which features are cut: the tails, where junk lies, in finer steps.
CUTS = [0.005, 0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98, 0.995]
GRAMS = 128
STEPS = 14
#: The ridge is SHRINK over the number of rows, and RIDGE at least.
SHRINK, RIDGE = 80, 1e-3
#: So many partial sums reach the driver at most; more are added up by tasks first.
FAN = 32

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_PROSE = np.zeros(256, bool)
_PROSE[[9, 10, 13, 32, 33, 39, 44, 45, 46, 58, 59, 63]] = True
_PROSE[_UPPER] = _PROSE[_LOWER] = _PROSE[_DIGIT] = _PROSE[128:] = True
_PLAIN_END = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:?'\")") | frozenset(range(128, 256))


def features(text: bytes | None) -> list[float]:
    """The feature vector of one text in UTF-8."""
    b = text or b""
    words = b.split()
    if not words:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    n, k, letters = len(b), len(words), int(c[_UPPER].sum() + c[_LOWER].sum())
    lines, counted = b.split(b"\n"), Counter(words)
    return [
        np.log(k),
        c[_UPPER].sum() / max(letters, 1),
        c[_DIGIT].sum() / n,
        c[~_PROSE].sum() / n,
        c[124] / k,
        c[46] / k,
        c[44] / k,
        sum(map(len, words)) / k,
        # variety falls with length in any text: types against a power of the number of words
        len(counted) / k**0.9,
        max(counted.values()) / k,
        len(lines) / k,
        len(set(lines)) / len(lines),
        sum(w.isupper() for w in words) / k,
        sum(w[-1] not in _PLAIN_END for w in words) / k,
        c[32] / k,
    ]


def grams(text: bytes | None) -> bytes:
    """Square roots of the shares of byte trigrams in each bucket, in steps of 1/255."""
    b = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return bytes(GRAMS)
    h = (b[:-2] * 65_599 + b[1:-1] * 8_191 + b[2:] * 31) * np.uint32(2_654_435_761)
    share = np.bincount(h >> np.uint32(32 - GRAMS.bit_length() + 1), minlength=GRAMS) / len(h)
    return np.round(255 * np.sqrt(share)).astype(np.uint8).tobytes()


def feature_column(text: Column) -> Column:
    @F.arrow_udf("struct<s: array<double>, g: binary>")
    def of(texts: pa.Array) -> pa.Array:
        whole = [t.as_py() for t in texts.cast(pa.binary())]
        return pa.StructArray.from_arrays([pa.array([features(t) for t in whole], pa.list_(pa.float64())), pa.array(map(grams, whole), pa.binary())], ["s", "g"])

    return of(text)


@dataclass
class Model:
    """cuts [feature, cut]; weights, the last of them the bias; none: nothing was learnt."""

    cuts: np.ndarray
    weights: np.ndarray | None = None
    prior: float = 0.5

    def matrix(self, s: pa.Array, g: pa.Array) -> np.ndarray:
        """A row a text: is each feature above each cut, the trigram buckets about their mean, and a one."""
        n = len(s)
        surface = s.flatten().to_numpy(zero_copy_only=False).reshape(n, len(FEATURES))
        buckets = np.frombuffer(b"".join(x.as_py() for x in g), np.uint8).reshape(n, GRAMS)
        above = (surface[:, :, None] > self.cuts[None]).reshape(n, -1)
        return np.hstack([above, buckets / np.float32(255 / np.sqrt(GRAMS)) - 1, np.ones((n, 1))]).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the positive class."""
        # row by row, not as a matrix product, whose sums depend on a row's place: equal texts score equally
        return _sigmoid((x * self.weights).sum(1)) if self.weights is not None else np.full(len(x), 0.5)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Sums:
    """Over rows at some weights: how many, losses of either label, gradients and curvatures; of all rows (u) and of positives (p)."""

    n_u: float
    n_p: float
    loss_u: float
    loss_p: float
    z_p: float
    x_p: np.ndarray
    grad_u: np.ndarray
    grad_p: np.ndarray
    bend_u: np.ndarray
    bend_p: np.ndarray

    @classmethod
    def over(cls, x: np.ndarray, pos: np.ndarray, w: np.ndarray) -> Sums:
        z = (x @ w.astype(np.float32)).astype(np.float64)
        p, own = _sigmoid(z), x[pos]
        bend = (p * (1 - p)).astype(np.float32)[:, None]
        soft = np.logaddexp(0, z)
        return cls(len(x), pos.sum(), soft.sum(), soft[pos].sum(), z[pos].sum(), own.sum(0, dtype=np.float64), (x.T @ p.astype(np.float32)).astype(np.float64), (own.T @ p[pos].astype(np.float32)).astype(np.float64), (x * bend).T @ x, (own * bend[pos]).T @ own)

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(v).astype(np.float64) for v in vars(self).values()])

    @classmethod
    def of(cls, flat: np.ndarray, d: int) -> Sums:
        heads, rest = flat[:5], flat[5:]
        return cls(*heads, rest[:d], rest[d : 2 * d], rest[2 * d : 3 * d], rest[3 * d : 3 * d + d * d].reshape(d, d), rest[3 * d + d * d :].reshape(d, d))


def summed(rows: DataFrame, model: Model, w: np.ndarray) -> Sums:
    """The sums over ``rows`` (s, g, pos)."""
    sent = rows.sparkSession.sparkContext.broadcast((model, w))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = sent.value
        total = np.zeros(Sums.over(np.zeros((0, len(at)), np.float32), np.zeros(0, bool), at).flat().shape)
        for b in batches:
            total += Sums.over(known.matrix(b.column("s"), b.column("g")), b.column("pos").to_numpy(zero_copy_only=False).astype(bool), at).flat()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"part": pa.array([0], pa.int32()), "sums": pa.array([whole.tobytes()], pa.binary())})

    parts = rows.select("s", "g", "pos").mapInArrow(add, "part int, sums binary")
    if rows.rdd.getNumPartitions() > FAN:
        parts = parts.groupBy(F.col("part") % FAN).applyInArrow(merge, "part int, sums binary")
    found = [np.frombuffer(r["sums"]) for r in parts.select("sums").collect()]
    sent.unpersist()
    return Sums.of(sum(found), len(w))


def ridge_of(rows: float) -> float:
    return max(RIDGE, SHRINK / max(rows, 1))


def risk(t: Sums, w: np.ndarray, prior: float | None) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(risk, its non-negative term, gradient, curvature). Without a prior: the plain loss of positives against unlabelled rows, of equal weight."""
    small = ridge_of(t.n_u)
    ridge = small * np.append(w[:-1], 0)
    if prior is None:
        value = t.loss_u / t.n_u + (t.loss_p - t.z_p) / t.n_p
        grad, bend, second = t.grad_u / t.n_u + (t.grad_p - t.x_p) / t.n_p, t.bend_u / t.n_u + t.bend_p / t.n_p, 1.0
    else:
        value = t.loss_u / t.n_u - prior * t.z_p / t.n_p
        grad, bend, second = t.grad_u / t.n_u - prior * t.x_p / t.n_p, t.bend_u / t.n_u, t.loss_u / t.n_u - prior * t.loss_p / t.n_p
    return value + w[:-1] @ ridge[:-1] / 2, second, grad + ridge, bend + small * np.eye(len(w))


def minimise(sums, size: int, prior: float | None) -> np.ndarray:
    """Newton steps from zero; ``sums`` gives the sums at some weights."""
    w = np.zeros(size)
    value, _, grad, bend = risk(sums(w), w, prior)
    step = -np.linalg.solve(bend, grad)
    for _ in range(STEPS):
        there = w + step
        v, second, g, b = risk(sums(there), there, prior)
        if second < 0 or v > value + 1e-9:
            step = step / 2
            continue
        done = value - v < 1e-5
        w, value, step = there, v, -np.linalg.solve(b, g)
        if done:
            break
    return w


def best_bin(u: np.ndarray, p: np.ndarray) -> float:
    """The prior from counts of unlabelled and positive rows by score, the highest score first."""
    n_u, n_p = max(u.sum(), 1), max(p.sum(), 1)
    above_u, above_p = np.cumsum(u) / n_u, np.cumsum(p) / n_p
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(n_p))
    bound = np.where(above_p > slack, (above_u + slack) / np.maximum(above_p, 1e-12), np.inf)
    k = int(np.argmin(bound))
    return float(np.clip(above_u[k] / max(above_p[k], 1e-12), 0.02, 0.98))


def _scores(known, s: Column, g: Column) -> Column:
    @F.arrow_udf("double")
    def of(s: pa.Array, g: pa.Array) -> pa.Array:
        m: Model = known.value
        return pa.array(np.asarray(m.score(m.matrix(s, g)), np.float64), pa.float64())

    return of(s, g)


def fit(rows: DataFrame) -> Model:
    """A model from ``rows`` (s, g, pos), all of them unlabelled and some of them known to be positive."""
    spark = rows.sparkSession
    cuts = rows.agg(F.count("s").alias("n"), F.count(F.when(F.col("pos"), 1)).alias("p"), *(F.percentile_approx(F.col("s")[i], F.array(*map(F.lit, CUTS)), F.lit(1000)).alias(f"c{i}") for i in range(len(FEATURES)))).first()
    if not cuts["n"] or not cuts["p"]:
        return Model(np.zeros((len(FEATURES), len(CUTS))))
    model = Model(np.array([cuts[f"c{i}"] for i in range(len(FEATURES))]))
    size = model.cuts.size + GRAMS + 1
    sums = lambda w: summed(rows, model, w)
    plain = Model(model.cuts, minimise(sums, size, None))
    scored = rows.select("pos", F.floor(_scores(spark.sparkContext.broadcast(plain), F.col("s"), F.col("g")) * 1000).cast("int").alias("bin"))
    bins = scored.groupBy("bin").agg(F.count("pos").alias("u"), F.count(F.when(F.col("pos"), 1)).alias("p")).orderBy(F.desc("bin")).collect()
    model.prior = best_bin(np.array([r["u"] for r in bins]), np.array([r["p"] for r in bins]))
    model.weights = minimise(sums, size, model.prior)
    return model


def quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Two columns: ``row``, the row of ``docs`` without its text, and ``score``, the probability of label 1. Learns from the rows that ``train`` picks (all, if none is given) and their
    labels alone. Texts are read once; what is written to the shared folder are the features."""
    bounded_batches(docs.sparkSession)
    learn = F.coalesce(train, F.lit(False)) if train is not None else F.lit(True)
    made = docs.select(F.struct(*(F.col(c) for c in docs.columns if c != text_col)).alias("row"), F.col(id_col).alias("id"), learn.alias("train"), feature_column(F.col(text_col)).alias("x"))
    made = materialize(made.select("row", "id", "train", "x.s", "x.g"), "quality-features")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y")).where("y = 1").select("id", F.lit(True).alias("known"))
    rows = made.where("train").select("id", "s", "g").join(known, "id", "left").select("s", "g", F.coalesce("known", F.lit(False)).alias("pos"))
    model = docs.sparkSession.sparkContext.broadcast(fit(materialize(rows, "quality-rows")))
    return made.select("row", _scores(model, F.col("s"), F.col("g")).alias("score"))
