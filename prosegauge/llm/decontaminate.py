"""Benchmark decontamination with a generalised suffix automaton over words.

All items, as sequences of word numbers, go into one automaton. A document's words stream through it: at each word the
state and the length of the longest suffix that is a substring of some item are known, so every occurrence of a
``window``-word window (or of a whole shorter item) ends where that length reaches the window. Hit words merge to spans;
spans of ``min_span`` words or more are cut from the text, and a document whose share of hit words exceeds ``max_coverage`` is marked
for removal.

The index is bounded: items are dealt by a hash of their id over as many automata as keep each at about ``block_words``
words (or one item), measured before anything is collected. One automaton at a time is built, broadcast, streamed over by all documents and given up; what each
one finds is written to the shared folder, and a shuffle by row brings the spans of a document together. Each further automaton costs a pass over the documents, no memory.

Defined results: null text has no words and no hits; an empty item table hits nothing; items without words are ignored;
items with equal text are all found; null item ids are ignored; rows with equal ids are judged each for itself; other columns,
whatever their names, pass through untouched.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.session import bounded_batches, materialize

#: A-Z to a-z, a-z, 0-9 and all bytes of non-ASCII letters as they are, anything else to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>, clean string"


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of item word sequences, with what a reader needs at each state."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        number = self.vocabulary
        coded = [(name, [number.setdefault(w, len(number)) for w in words(text)]) for name, text in items]
        coded = [(name, seq) for name, seq in coded if seq]
        self.length, self.link, edges = [0], [-1], [{}]
        for _, seq in coded:
            at = 0
            for w in seq:
                at = self._extend(edges, at, w)
        self.step = {(state, w): to for state, out in enumerate(edges) for w, to in out.items()}
        self.names = [name for name, _ in coded]
        self._mark(edges, coded)

    def _extend(self, edges: list[dict], last: int, w: int) -> int:
        length, link = self.length, self.link

        def clone(p: int, q: int) -> int:
            new = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            edges.append(dict(edges[q]))
            link[q] = new
            while p >= 0 and edges[p].get(w) == q:
                edges[p][w] = new
                p = link[p]
            return new

        if w in edges[last]:
            q = edges[last][w]
            return q if length[q] == length[last] + 1 else clone(last, q)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        edges.append({})
        p = last
        while p >= 0 and w not in edges[p]:
            edges[p][w] = new
            p = link[p]
        if p >= 0:
            q = edges[p][w]
            link[new] = q if length[q] == length[p] + 1 else clone(p, q)
        return new

    def _mark(self, edges: list[dict], coded: list[tuple[str, list[int]]]) -> None:
        """``whole``: state -> items with the state's window-long suffix. ``short``: state -> (words, item) of whole shorter items."""
        size, n = self.window, len(self.length)
        own, brief = [set() for _ in range(n)], [[] for _ in range(n)]
        for k, (_, seq) in enumerate(coded):
            at = 0
            for w in seq:
                at = edges[at][w]
                up = at
                while up > 0 and k not in own[up] and self.length[up] >= size:
                    own[up].add(k)
                    up = self.link[up]
            if len(seq) < size:
                while self.length[self.link[at]] >= len(seq):
                    at = self.link[at]
                brief[at].append((len(seq), k))
        self.whole, self.short = {}, {}
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[state]
            if found := [*brief[state], *self.short.get(up, ())]:
                self.short[state] = found
            if self.length[state] >= size:
                self.whole[state] = self.whole[up] if self.length[up] >= size else frozenset(own[state])

    def read(self, seq: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Hit spans of word positions (end exclusive, in order, apart) and the items that occur."""
        step, link, length, window, short, whole = self.step, self.link, self.length, self.window, self.short, self.whole
        spans, found = [], set()
        state = matched = 0
        for i, w in enumerate(map(self.vocabulary.get, seq)):
            if w is None:
                state = matched = 0
                continue
            to = step.get((state, w))
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step.get((state, w))
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            start = i + 1
            if matched >= window:
                found |= whole[state]
                start = i + 1 - matched
            if state in short:
                for m, k in short[state]:
                    if m <= matched:
                        found.add(k)
                        start = min(start, i + 1 - m)
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, found


def _joined(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def judge(text: bytes | None, automata: list[Automaton], min_span: int) -> tuple:
    """(n_words, n_hit, item names, spans in code points, the text without them or None if it stays as it is)."""
    spans, names = [], set()
    for a in automata:
        more, found = a.read(words(text or b""))
        spans += more
        names |= {a.names[k] for k in found}
    return cut(text, spans, names, min_span)


def cut(text: bytes | None, spans: list[list[int]], names: set[str], min_span: int) -> tuple:
    """The same from spans of word positions, in any order, and the items found."""
    n = len(words(text or b""))
    if not spans:
        return n, 0, [], [], None
    spans = _joined(spans)
    chars = text.decode()
    at = [m.span() for m in _WORD.finditer(chars)]
    places = [(at[a][0], at[b - 1][1]) for a, b in spans]
    gone = [p for p, (a, b) in zip(places, spans, strict=True) if b - a >= min_span]
    clean = "".join(chars[a:b] for a, b in zip([0, *(p[1] for p in gone)], [*(p[0] for p in gone), len(chars)], strict=True)) if gone else None
    return n, sum(b - a for a, b in spans), sorted(names), places, clean


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in rows], pa.list_(span))


def _result(rows: list[tuple]) -> pa.Array:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    made = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string())), _spans(cols[3]), pa.array(cols[4], pa.string())]
    return pa.StructArray.from_arrays(made, ["n_words", "n_hit", "items", "spans", "clean"])


def _one_pass(text: Column, sent, min_span: int) -> Column:
    """All there is to know of a text, by the only automaton."""

    @F.arrow_udf(RESULT)
    def of(texts: pa.Array) -> pa.Array:
        return _result([judge(t.as_py(), [sent.value], min_span) for t in texts.cast(pa.binary())])

    # one call a row, also where a filter and a projection both read it
    return of.asNondeterministic()(text)


def _found(text: Column, sent) -> Column:
    """What one of several automata finds: spans of word positions, and items."""

    @F.arrow_udf("spans array<struct<start: long, end: long>>, items array<string>")
    def of(texts: pa.Array) -> pa.Array:
        a = sent.value
        rows = [a.read(words(t.as_py() or b"")) for t in texts.cast(pa.binary())]
        return pa.StructArray.from_arrays([_spans([r[0] for r in rows]), pa.array([sorted(a.names[k] for k in r[1]) for r in rows], pa.list_(pa.string()))], ["spans", "items"])

    return of.asNondeterministic()(text)


def _summed(text: Column, spans: Column, items: Column, min_span: int) -> Column:
    """The result from what all automata found."""

    @F.arrow_udf(RESULT)
    def of(texts: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
        rows = zip(texts.cast(pa.binary()), spans.to_pylist(), items.to_pylist(), strict=True)
        return _result([cut(t.as_py(), [[x["start"], x["end"]] for x in found or []], set(names or []), min_span) for t, found, names in rows])

    return of.asNondeterministic()(text, spans, items)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, min_span: int = 1, block_words: int = 200_000) -> DataFrame:
    """Two columns: ``row``, the row of ``docs``, and ``hit``: n_words, n_hit, items, spans (code points of the text, end exclusive) and ``clean``, the text without
    spans of ``min_span`` words or more (null: nothing to cut)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    # a word has at least one character and a gap
    size = own.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_words))

    def sent(k: int):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        return spark.sparkContext.broadcast(Automaton(sorted((r["id"], r["text"].encode()) for r in part.toLocalIterator()), window))

    rows = docs.select(F.struct("*").alias("row"))
    if blocks == 1:
        return rows.withColumn("hit", _one_pass(F.col("row")[text_col], sent(0), min_span))
    rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "decontaminate-rows")
    parts = []
    for k in range(blocks):
        automaton = sent(k)
        part = rows.select("key", _found(F.col("row")[text_col], automaton).alias("f")).select("key", "f.*").where(F.size("items") > 0)
        parts.append(materialize(part, "decontaminate-hits"))
        automaton.destroy()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return rows.join(hits, "key", "left").select("row", _summed(F.col("row")[text_col], F.col("spans"), F.col("items"), min_span).alias("hit"))


def remove_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.8, **limits: int) -> DataFrame:
    """``docs`` without hit spans; a document of which more than ``max_coverage`` of the words are hit goes whole."""
    # a cut may leave nothing but a few words between two spans: the share decides, not what is left
    kept = decontaminate(docs, items, text_col, **limits).where(F.col("hit.n_hit") <= max_coverage * F.col("hit.n_words"))
    own = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.coalesce("hit.clean", F.col("row")[text_col])}
    return kept.select(*(x.alias(c) for c, x in own.items()))
