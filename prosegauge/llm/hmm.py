"""Language-model scoring with a hidden Markov model over words.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end token a text.

Counts. Every training text is counted: tasks count their own words, and a shuffle by word adds them up. The ``lookup`` most
frequent words travel to the workers with their counts (a bound on the broadcast); the counts of all others are joined to the texts by
word, in a shuffle. So each token's count is exact, whatever the vocabulary's size.

Model. Latent states emit symbols: the ``symbols`` most frequent words, the end, and ``CLASSES`` classes of all rarer words, by their last letters. A rarer word's
probability is its class's, times the word's share (c + 1) / T of the add-one mass of its class; T includes one unit for the unseen. So
the probabilities of all words add up to one in every state. ``symbols``, ``CLASSES`` and ``states`` are the model's size, whatever the corpus's; the counts behind
shares and emissions grow with it.

Training is Baum-Welch over whole texts: each task runs the scaled forward and
backward recursions over its texts and adds up expected counts, Spark adds those up across tasks by symbol, and the driver, which gets ``symbols`` x
``states`` numbers, re-estimates. Texts of like length run abreast; forward values are kept for ``CHUNK`` steps at a time and
made anew from the chunk's beginning on the way back, so that memory does not grow with a text's length.

Score. The scaled forward recursion over the whole text, uncut, gives the exact log10 likelihood of its tokens.

Defined results: null and empty text is the end token alone; rows with equal ids are scored each for itself; ties in count go to the word that
sorts first; without training texts nothing is known, and base and model give the unseen all mass; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.session import bounded_batches, materialize

#: The end token's own entry in the tables of counts: no word has white space in it.
END = b"\n"
#: Words of a task's counter before it is sent on, tokens of texts that run abreast, and rows of a batch.
HELD, ABREAST, ROWS = 400_000, 1 << 19, 2048
#: Steps whose forward values are kept, and how many such values of training texts.
CHUNK, KEPT = 1024, 1 << 18
CLASSES = 256
#: Strength of the unigram prior in a state's emissions, and of the stay-put prior in its transitions.
PRIOR, STAY = 200.0, 0.95


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space parts


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (text binary), with the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                held.update(words(t.as_py()))
                held[END] += 1
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def class_of(word: bytes) -> int:
    """The class of a rarer word."""
    return zlib.crc32(word[-2:]) % CLASSES


@dataclass
class Lexicon:
    """What workers know of the counts. ``number``: word -> rank by count; ranks under ``symbols`` are symbols of the model. ``mass``: of each class."""

    number: dict[bytes, int]
    counts: np.ndarray
    symbols: int
    total: int
    distinct: int
    ends: int
    mass: np.ndarray

    @property
    def end(self) -> int:
        return self.symbols + CLASSES

    def unigram(self) -> np.ndarray:
        p = np.concatenate([self.counts[: self.symbols] + 1.0, self.mass, [self.ends + 1.0]])
        return p / p.sum()


def lexicon(counts: DataFrame, lookup: int, symbols: int) -> Lexicon:
    """From the whole table of counts; ``lookup`` rows of it, and one for each class, reach the driver."""
    end = F.col("word") == F.lit(END)
    whole = counts.agg(F.sum("c").alias("n"), F.count("word").alias("v"), F.sum(F.when(end, F.col("c"))).alias("ends")).first()
    top = counts.where(~end).orderBy(F.desc("c"), "word").limit(lookup).toArrow()
    c, words_ = top.column("c").to_numpy(), top.column("word").to_pylist()
    n, v, ends = whole["n"] or 0, whole["v"] or 0, whole["ends"] or 0
    k = min(symbols, len(c))
    kind = (F.crc32(F.substring("word", -2, 2)) % CLASSES).alias("kind")
    mass = np.ones(CLASSES)
    for r in counts.where(~end).groupBy(kind).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["kind"]] += r["m"]
    for w, x in zip(words_[:k], c[:k], strict=True):
        mass[class_of(w)] -= x + 1
    return Lexicon({w: i for i, w in enumerate(words_)}, c.astype(np.float64), k, n, v, ends, mass)


_CODED = "ids binary, n_tokens long, known long, base double, rare double, tail array<binary>"


def encode(rows: DataFrame, sent) -> DataFrame:
    """For ``rows`` (id, train, text binary): id, train, the text's symbols, what the lookup gives for its sums, and the words that need the join."""
    names = [x.split()[0] for x in _CODED.split(", ")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = sent.value
        logs, get, log_ends = np.log10(lex.counts + 1), lex.number.get, math.log10(lex.ends + 1)
        kinds, log_mass = np.fromiter(map(class_of, lex.number), np.int64, len(lex.number)), np.log10(lex.mass)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, texts = part.num_rows, [words(t.as_py()) for t in part.column("text")]
                sizes = np.array([len(ws) for ws in texts])
                flat = list(chain.from_iterable(texts))
                found = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
                owner, seen = np.repeat(np.arange(n), sizes), found >= 0
                log = np.zeros(len(flat))
                log[seen] = logs[found[seen]]
                rare = ~seen | (found >= lex.symbols)
                lost = np.flatnonzero(~seen)
                kind = np.zeros(len(flat), np.int64)
                kind[seen] = kinds[found[seen]]
                kind[lost] = [class_of(flat[i]) for i in lost]
                ids = np.insert(np.where(rare, lex.symbols + kind, found), np.cumsum(sizes), lex.end).astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32)
                tails = np.concatenate([[0], np.cumsum(np.bincount(owner[lost], minlength=n))]).astype(np.int32)
                made = [
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * offsets).tobytes()), pa.py_buffer(ids.tobytes())]),
                    pa.array(sizes + 1, pa.int64()),
                    pa.array(np.bincount(owner[seen], minlength=n) + (lex.ends > 0), pa.int64()),
                    pa.array(np.bincount(owner, log, n) + log_ends, pa.float64()),
                    pa.array(np.bincount(owner, (log - log_mass[kind]) * rare, n), pa.float64()),
                    pa.ListArray.from_arrays(pa.array(tails), pa.array([flat[i] for i in lost], pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("train"), *made], names=["id", "train", *names])

    return rows.mapInArrow(code, f"id {rows.schema['id'].dataType.simpleString()}, train boolean, {_CODED}")


@dataclass
class Model:
    """start [states], move [states, states], emit [symbols, states]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def initial(lex: Lexicon, states: int) -> Model:
    """Unigram emissions, moved apart by a fixed pseudo-random share for each word and state; states tend to stay."""
    p = lex.unigram()
    emit = p[:, None] * (0.5 + np.random.default_rng(7).random((len(p), states)))
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def lanes(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[step, lane] symbols, the longest lane first (by ``order``), and how many lanes go on at each step."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    grid = np.zeros((size[0], len(seqs)), np.intp)
    for lane, i in enumerate(order):
        grid[: size[lane], lane] = seqs[i]
    return grid, order, np.searchsorted(-size, -np.arange(size[0]), side="left")


def likelihood(seqs: list[np.ndarray], m: Model) -> np.ndarray:
    """Exact log10 likelihood of each sequence, by the scaled forward recursion."""
    grid, order, live = lanes(seqs)
    out = np.zeros(len(seqs))
    for t, _, scale in _forward(grid, live, 0, len(live), None, m):
        out[: live[t]] += np.log10(scale)
    back = np.empty_like(out)
    back[order] = out
    return back


def likelihoods(column: pa.Array, m: Model) -> np.ndarray:
    """The same for a column of symbols, in groups of like length whose grids hold at most ABREAST cells (or one text)."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
    out, order, at = np.zeros(len(size)), np.argsort(-size, kind="stable"), 0
    while at < len(order):
        some = order[at : at + max(1, ABREAST // int(size[order[at]]))]
        out[some] = likelihood([np.frombuffer(column[int(i)].as_buffer(), "<u4") for i in some], m)
        at += len(some)
    return out


@dataclass
class Expected:
    """Sums of expected counts over texts."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def none(cls, m: Model) -> Expected:
        return cls(np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit))

    def add(self, seqs: list[np.ndarray], m: Model) -> None:
        """Forward and backward over whole texts."""
        grid, _, live = lanes(seqs)
        steps, heads, alpha = len(live), [], None
        for at in range(0, steps, CHUNK):
            heads.append(alpha)
            if at + CHUNK < steps:
                for _, alpha, _ in _forward(grid, live, at, at + CHUNK, alpha, m):
                    pass
        ahead, back, states = None, np.ascontiguousarray(m.move.T), len(m.start)
        moves, cell = np.zeros((states, states)), np.zeros(len(m.emit), np.intp)
        for at, head in zip(reversed(range(0, steps, CHUNK)), reversed(heads), strict=True):
            kept = list(_forward(grid, live, at, min(at + CHUNK, steps), head, m))
            for t, alpha, scale in reversed(kept):
                now = m.emit.take(grid[t, : live[t]], 0)
                # backward values are ones where a text ends; scaled forward times scaled backward is the posterior: it adds up to one
                if ahead is not None:
                    n = len(ahead)
                    moves += alpha[:n].T @ ahead
                    beta = ahead @ back
                    now[:n] *= beta
                    alpha[:n] *= beta
                ahead = now
                ahead /= scale[:, None]
            if not at:
                self.start += kept[0][1].sum(0)
            # by the distinct symbols of this chunk: a sum over all symbols for each part would cost more than the part
            seen = np.concatenate([grid[t, : live[t]] for t, _, _ in kept])
            cell[seen] = 1
            symbols = np.flatnonzero(cell)
            cell[symbols] = np.arange(len(symbols)) * states
            first = cell[seen]
            cell[symbols] = 0
            sums, begun = np.zeros(len(symbols) * states), 0
            for some in range(0, len(kept), 128):
                weight = np.concatenate([alpha for _, alpha, _ in kept[some : some + 128]])
                cells = first[begun : begun + len(weight), None] + np.arange(states)
                sums += np.bincount(cells.ravel(), weight.ravel(), len(sums))
                begun += len(weight)
            self.emit[symbols] += sums.reshape(-1, states)
        self.move += m.move * moves


def _forward(grid: np.ndarray, live: np.ndarray, at: int, end: int, alpha: np.ndarray | None, m: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(step, scaled forward values, scales) from step ``at`` on, where ``alpha`` are those of the step before."""
    ones = np.ones(len(m.start))
    for t in range(at, end):
        n = live[t]
        # take and a product with ones: several times as fast as an index and a sum over short rows
        now = m.emit.take(grid[t, :n], 0)
        now *= m.start if alpha is None else alpha[:n] @ m.move
        alpha, scale = now, now @ ones
        alpha /= scale[:, None]
        yield t, alpha, scale


def alike(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts in groups of like length (by a power of two) of about KEPT forward values at a time; what is left at the end in groups of twice that, the longest first, so that few
    groups are narrow."""
    held: dict[int, list[np.ndarray]] = {}
    for x in texts:
        k = len(x).bit_length()
        held.setdefault(k, []).append(x)
        if len(held[k]) * min(1 << k, CHUNK) >= KEPT:
            yield held.pop(k)
    group, values = [], 0
    for x in (x for k in sorted(held, reverse=True) for x in held[k]):
        group.append(x)
        values += min(len(x), CHUNK)
        if values >= 2 * KEPT:
            yield group
            group, values = [], 0
    if group:
        yield group


def expected_counts(coded: DataFrame, sent, states: int) -> DataFrame:
    """(symbol, s0, ...): expected counts over all rows. Symbols -1 - h are the moves out of state h, -1 - states the starts."""
    cols = [f"s{h}" for h in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        total = Expected.none(m)
        # copies: a view would hold on to its whole batch
        for seqs in alike(np.frombuffer(x.as_buffer(), "<u4").copy() for batch in batches for x in batch.column("ids")):
            total.add(seqs, m)
        seen = np.flatnonzero(total.emit.any(1))
        table = np.vstack([total.emit[seen], total.move, total.start[None]])
        symbol = np.concatenate([seen, -1 - np.arange(states + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["symbol", *cols])

    sums = coded.select("ids").mapInArrow(run, "symbol long, " + ", ".join(f"{c} double" for c in cols))
    return sums.groupBy("symbol").agg(*(F.sum(c).alias(c) for c in cols))


def train(coded: DataFrame, lex: Lexicon, states: int, rounds: int) -> Model:
    """Baum-Welch over all rows of ``coded``."""
    m, p = initial(lex, states), lex.unigram()
    for _ in range(rounds):
        got = expected_counts(coded, coded.sparkSession.sparkContext.broadcast(m), states).toArrow()
        symbol = got.column("symbol").to_numpy()
        table = np.column_stack([got.column(f"s{h}").to_numpy() for h in range(states)]).reshape(-1, states)
        order = np.argsort(symbol, kind="stable")
        symbol, table = symbol[order], table[order]
        # the lowest symbol is the starts, then the moves, from the last state to the first
        if not len(symbol):
            return m
        start, move = table[0] + 1.0, table[1 : states + 1][::-1]
        move = move + STAY * np.eye(states) + (1 - STAY)
        emit = PRIOR * p[:, None] * np.ones(states)
        emit[symbol[states + 1 :]] += table[states + 1 :]
        m = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return m


def score(docs: DataFrame, train_when, id_col: str = "doc_id", text_col: str = "text", states: int = 8, rounds: int = 5, lookup: int = 250_000, symbols: int = 60_000) -> DataFrame:
    """Per row of ``docs``: id, ``train``, n_tokens, n_known, train_tokens, base_score and score (log10). ``train_when``: which rows are learnt from."""
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(train_when, F.lit(False)).alias("train"), F.col(text_col).cast("binary").alias("text"))
    counts = materialize(count_words(own.where("train").select("text")), "hmm-counts")
    lex = lexicon(counts, lookup, symbols)
    # keys of their own, as ids may repeat; they are fixed once the table is written
    coded = materialize(encode(own, sc.broadcast(lex)).withColumn("key", F.monotonically_increasing_id()), "hmm-coded")
    model = train(coded.where("train"), lex, states, rounds)
    sent = sc.broadcast(model)

    @F.arrow_udf("double")
    def forward(ids: pa.Array) -> pa.Array:
        return pa.array(likelihoods(ids, sent.value), pa.float64())

    # words beyond the lookup meet their counts by a shuffle; the unseen add log10(0 + 1)
    tail = coded.select("key", F.explode("tail").alias("word")).join(counts, "word")
    tail = tail.groupBy("key").agg(F.sum(F.log10(F.col("c") + 1)).alias("tail_sum"), F.count("c").alias("tail_known"))
    base = math.log10(lex.total + lex.distinct + 1)
    out = coded.select("key", "id", "train", "n_tokens", "known", "base", "rare", forward(F.col("ids")).alias("forward")).join(tail, "key", "left")
    tail_sum = F.coalesce("tail_sum", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "train",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + tail_sum - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("forward") + F.col("rare") + tail_sum).alias("score"),
    )
