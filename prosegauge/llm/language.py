"""Language ID by cross-parsing entropy.

Each language's labelled text becomes a suffix automaton. A text is parsed greedily into the longest phrases that
occur in that text; the number of phrases, times the bits to point at one, per character, estimates the cross entropy. The
language with the fewest normalised phrases wins.

Model. A bounded sample: about ``sample_chars`` characters per language, in pieces of ``PIECE`` characters from the
middle of documents picked by a hash of their id. An automaton's letters are numbered among its own; its transitions are a dense table while all tables together
take ``DENSE`` entries at most, else sorted edges, so that alphabets of thousands of letters and many languages stay small.

Texts are parsed whole. A batch is parsed in NumPy: segments of ``SEGMENT`` characters run abreast, and then each segment is parsed again from the state
in which the one before it ended, up to the character from which both parses agree, until nothing changes. The phrases are those of the whole text.

Defined results: null text, or text without any letter, is ``und`` with score 0; ties go to the language that sorts first;
without any labelled text everything is ``und``; letters that no sample has make phrases of their own; texts and samples are compared in
the composed form NFC; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.session import bounded_batches

UND = "und"
PIECE = 400
SEGMENT = 512
#: Characters parsed abreast, and entries of dense tables, bounds on a worker's memory.
ABREAST, DENSE = 1 << 19, 1 << 24
SPACE = 0


@dataclass
class Table:
    """Transitions of one automaton over its own letters: ``own`` gives them by letter class. States are multiplied by ``width``; the root is 0,
    and 0 stands for no transition, as nothing leads to the root."""

    own: np.ndarray
    width: int
    keys: np.ndarray
    to: np.ndarray
    dense: np.ndarray | None = None

    def __post_init__(self) -> None:
        # from the root, by letter
        self.root = np.zeros(self.width, self.to.dtype)
        first = (self.keys >= 0) & (self.keys < self.width)
        self.root[self.keys[first]] = self.to[first]

    @property
    def kind(self) -> type:
        return self.to.dtype.type

    def spread(self) -> None:
        """From edges to a dense table."""
        self.dense = np.zeros(int(self.to.max(initial=0)) + self.width, np.int32)
        self.dense[self.keys[self.keys >= 0]] = self.to[self.keys >= 0]
        self.root, self.keys, self.to = self.root.astype(np.int32), self.keys[:0], self.to[:0].astype(np.int32)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = state + letter
        if self.dense is not None:
            return self.dense[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)


@dataclass
class Parser:
    """tables by language; ``fold``: code point -> letter class (0: no letter); bits: to point into the sample."""

    langs: list[str]
    tables: list[Table]
    bits: list[float]
    fold: np.ndarray


def _fold(sample: dict[str, str]) -> tuple[np.ndarray, int]:
    known: dict[str, int] = {}
    for text in sample.values():
        for c in text.lower():
            if c.isalpha():
                known.setdefault(c, len(known) + 1)
    other = len(known) + 1
    table = np.zeros(0x110000, np.uint16 if other < 1 << 16 else np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = known.get(c.lower()[0], other)
    return table, other + 1


def _classes(text: str, fold: np.ndarray) -> np.ndarray:
    """Letter classes, each run of anything else as one space, none at the ends."""
    x = fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = x > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = x[keep]
    return x[:-1] if len(x) and x[-1] == SPACE else x


def suffix_automaton(seq: list[int], classes: int) -> Table:
    """The automaton of all substrings of a sequence of letter classes."""
    length, link, edges = [0], [-1], [{}]
    last = 0
    for c in seq:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                edges.append(dict(edges[q]))
                link[q] = link[new] = twin
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
        last = new
    letters = sorted({SPACE, *seq})
    width = len(letters) + 1
    # letters of other languages share one number, which has no edge
    own = np.full(classes, len(letters), np.int32)
    own[letters] = np.arange(len(letters))
    found = sorted((state * width + int(own[c]), to * width) for state, out in enumerate(edges) for c, to in out.items())
    keys, to = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.full(1, -1), np.zeros(1, np.int64))
    return Table(own, width, keys, to)


def tables_of(coded: list[np.ndarray], classes: int) -> list[Table]:
    tables = [suffix_automaton(x.tolist(), classes) for x in coded]
    if sum(int(t.to.max(initial=0)) + t.width for t in tables) <= DENSE:
        for t in tables:
            t.spread()
    return tables


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str, sample_chars: int) -> Parser:
    """Automata from a sample of about ``sample_chars`` characters of each language's rows."""
    text = F.col(text_col)
    own = docs.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(17)).alias("h"), F.substring(text, F.greatest(F.lit(1), (F.length(text) / 2).cast("int") - PIECE // 2), F.lit(PIECE)).alias("piece")).where("lang is not null and length(piece) > 0")
    have = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("h").alias("n")).collect()}
    want = 2 * -(-sample_chars // PIECE)
    share = F.coalesce(*(F.when(F.col("lang") == k, min(1.0, 3 * want / n)) for k, n in have.items()), F.lit(0.0))
    # the hash first thins each language to about three times what is wanted, then the least hashes are taken
    some = own.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).where(F.col("r") <= want)
    sample: dict[str, str] = {}
    for r in sorted(some.select("lang", "h", "piece").collect(), key=lambda r: (r["lang"], r["h"], r["piece"])):
        if len(sample.get(r["lang"], "")) < sample_chars:
            sample[r["lang"]] = sample.get(r["lang"], "") + r["piece"] + "\n"
    sample = {k: unicodedata.normalize("NFC", v) for k, v in sample.items()}
    fold, classes = _fold(sample)
    langs = sorted(k for k, v in sample.items() if any(map(str.isalpha, v)))
    coded = [_classes(sample[k], fold) for k in langs]
    return Parser(langs, tables_of(coded, classes), [math.log2(len(x) + 1) for x in coded], fold)


def phrases(lanes: np.ndarray, length: np.ndarray, before: np.ndarray, table: Table) -> np.ndarray:
    """Phrases that begin in each lane. lanes: [step, lane] letter classes, the longest lane first; before: the lane that goes on in this one, or -1."""
    lanes = table.own[lanes]
    n, active = lanes.shape[1], np.searchsorted(-length, -np.arange(len(lanes)), side="left")
    states, begins = np.zeros(lanes.shape, table.kind), np.zeros(lanes.shape, bool)
    state, entry = np.zeros(n, table.kind), np.zeros(n, table.kind)

    def go(now: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = table.step(now, c)
        new = to == 0
        # a new phrase starts where the old one cannot go on; at the root, the first one does
        return np.where(new, table.root[c], to), new | (now == 0)

    for t, k in enumerate(active):
        state[:k], begins[t, :k] = go(state[:k], lanes[t, :k])
        states[t, :k] = state[:k]
    while True:
        want = np.where(before >= 0, state[before], 0)
        lane = np.flatnonzero(want != entry)
        if not len(lane):
            return begins.sum(0)
        now = entry[lane] = want[lane]
        for t in range(len(lanes)):
            now, begins[t, lane] = go(now, lanes[t, lane])
            again, over = now == states[t, lane], length[lane] == t + 1
            states[t, lane] = now
            state[lane[over]] = now[over]
            on = ~(again | over)
            lane, now = lane[on], now[on]
            if not len(lane):
                break


def entropies(texts: list[str], parser: Parser) -> tuple[np.ndarray, np.ndarray]:
    """[text, language] bits a character, and characters by text."""
    coded = [_classes(unicodedata.normalize("NFC", t), parser.fold) for t in texts]
    sizes = np.array([len(x) for x in coded], np.int64)
    flat = np.concatenate([*coded, np.zeros(SEGMENT, np.uint16)]).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, length = first[owner] + nth * SEGMENT, np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
    by = np.argsort(-length, kind="stable")
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    before = np.where(nth > 0, place[np.maximum(np.arange(len(by)) - 1, 0)], -1)[by]
    owner, start, length = owner[by], start[by], length[by]
    out = np.zeros((len(texts), len(parser.langs)))
    if len(owner):
        lanes = np.zeros((int(length[0]), len(start)), np.int32)
        for t in range(len(lanes)):
            lanes[t] = flat[np.minimum(start + t, len(flat) - 1)]
        for j, (table, bits) in enumerate(zip(parser.tables, parser.bits, strict=True)):
            out[:, j] = np.bincount(owner, phrases(lanes, length, before, table), len(texts)) * bits
    return out / np.maximum(sizes, 1)[:, None], sizes


def decide(texts: list[str | None], parser: Parser, sharpness: float = 4.0) -> list[tuple[str, float, float | None]]:
    """(language, score, bits a character) of each text. Score: softmax over minus the entropies, from 0 to 1."""
    out: list[tuple[str, float, float | None]] = [(UND, 0.0, None)] * len(texts)
    if not parser.langs:
        return out
    todo, held, batches = [], 0, []
    for i, t in enumerate(texts):
        if t:
            todo.append(i)
            held += len(t)
            if held > ABREAST:
                batches.append(todo)
                todo, held = [], 0
    for some in [*batches, todo]:
        if not some:
            continue
        h, sizes = entropies([texts[i] for i in some], parser)
        for i, row, n in zip(some, h, sizes, strict=True):
            if n:
                j = int(row.argmin())
                out[i] = (parser.langs[j], float(1 / np.exp(-sharpness * (row - row[j])).sum()), float(row[j]))
    return out


def language_id(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = 40_000) -> Column:
    """A struct column for ``docs``: lang_pred, score, entropy (bits a character; null for ``und``). Learns from ``labelled`` alone."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(labelled, text_col, lang_col, id_col, sample_chars))

    @F.arrow_udf("lang_pred string, score double, entropy double")
    def of(texts: pa.Array) -> pa.Array:
        rows = decide(texts.to_pylist(), sent.value)
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], ["lang_pred", "score", "entropy"])

    # one call a row, also where a filter and a projection both read it
    return of.asNondeterministic()(F.col(text_col))
