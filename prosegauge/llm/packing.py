"""Bounded-space online packing of token streams into fixed windows.

Each partition keeps ``open_windows`` windows. A document (its ids, then the end id) is first cut into whole windows;
what remains goes best-fit: into the open window with the least room that still holds it. When none holds it, the fullest
window is topped up with the head of the piece (cuts are free) and emitted full, and the rest is placed anew. A partition ends
with at most ``open_windows`` windows that are not full; these leftovers are merged: within the partition first, then, from the
shared folder, over groups of ``MERGE_FAN`` partitions, level by level, until one group is left. A last
window that is still short is cut at powers of two, so that it needs no padding either.

Memory is bounded by the open windows and one Arrow batch. The placed pieces are written to the shared folder once, so that merged
leftovers and full windows come from one and the same pass, also when executors are lost.

Ids are those of ``tokenizers`` for the file at ``vocabulary``, its added tokens included where a text spells them; see :class:`Encoder`.

Defined results: null or empty text is the end id alone; texts of any length or of one long run are encoded whole; rows with equal ids are packed each
for itself; ties for the best window go to the window opened first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.session import bounded_batches, materialize

END = 0
#: Partitions whose leftovers one task merges at a time.
MERGE_FAN = 64
#: Sequence ids: the partition's (or the merging group's) number in the high bits.
SHIFT = 40

_PIECE = "id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _schema(id_type: str) -> str:
    return _PIECE.format(id_type) + ", part int, open boolean"


class Encoder:
    """Text to ids as ``tokenizers`` gives them with ``vocabulary`` (a JSON file) at its default settings and no special tokens added. Loaded once in
    each Python worker.

    ``ranks_path`` and ``pattern`` give the same ids through ``tiktoken``, several times as fast; a test holds the two against each other.
    It cannot do runs of white space that fill its regex engine's stack: texts with a run of ``RUN`` or more, or whatever else it fails on, go
    through ``tokenizers``. Without ranks everything does.
    """

    RUN = re.compile(r"\s{1024}")
    _known: dict[tuple, Encoder] = {}

    def __new__(cls, vocabulary: str, ranks_path: str | None = None, pattern: str | None = None) -> Encoder:
        key = (vocabulary, ranks_path, pattern)
        if key not in cls._known:
            made = cls._known[key] = super().__new__(cls)
            made._load(*key)
        return cls._known[key]

    def _load(self, vocabulary: str, ranks_path: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.whole, self.fast = Tokenizer.from_file(vocabulary), None
        with open(vocabulary, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        # added tokens that take white space or whole words with them are not plain strings
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added)
        if ranks_path and plain:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

    def encode(self, text: str) -> list[int]:
        if self.fast and not self.RUN.search(text):
            try:
                return self.fast.encode(text, allowed_special="all")
            except BaseException as e:  # the library's panics are no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return self.whole.encode(text, add_special_tokens=False).ids


class Window:
    """One open sequence: pieces in order and how many ids they hold."""

    __slots__ = ("pieces", "used")

    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.used = 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[2])


def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    """The first n ids of a piece (id, start, ids, doc_tokens), and the rest."""
    d, start, ids, total = piece
    return (d, start, ids[:n], total), (d, start + n, ids[n:], total)


class Packer:
    """The online rule. ``take`` yields windows that are full; ``rest`` holds those that are not."""

    def __init__(self, size: int, space: int) -> None:
        self.size, self.space, self.rest = size, space, []

    def take(self, piece: tuple) -> Iterator[Window]:
        while len(piece[2]) >= self.size:
            w = Window()
            head, piece = cut(piece, self.size)
            w.add(head)
            yield w
        while len(n := piece[2]):
            fit = min((w for w in self.rest if w.used + len(n) <= self.size), key=lambda w: self.size - w.used, default=None)
            if fit is None and len(self.rest) < self.space:
                self.rest.append(fit := Window())
            if fit is None:
                fit = max(self.rest, key=lambda w: w.used)
                head, piece = cut(piece, self.size - fit.used)
                fit.add(head)
            else:
                fit.add(piece)
                piece = (piece[0], piece[1], piece[2][:0], piece[3])
            if fit.used == self.size:
                self.rest.remove(fit)
                yield fit


def merged(windows: list[Window], size: int) -> tuple[list[Window], Window]:
    """The windows' pieces, the fullest window's first, as full windows and one that is not."""
    full, now = [], Window()
    for piece in (p for w in sorted(windows, key=lambda w: -w.used) for p in w.pieces):
        while len(piece[2]):
            head, piece = cut(piece, min(size - now.used, len(piece[2])))
            now.add(head)
            if now.used == size:
                full.append(now)
                now = Window()
    return full, now


def halved(window: Window) -> list[Window]:
    """A window cut into windows whose lengths are the powers of two in its length, the largest first."""
    out, todo = [], list(window.pieces)
    for bit in reversed(range(window.used.bit_length())):
        if window.used >> bit & 1:
            w = Window()
            while w.used < 1 << bit:
                head, tail = cut(todo[0], min(len(todo[0][2]), (1 << bit) - w.used))
                w.add(head)
                todo = ([tail] if len(tail[2]) else []) + todo[1:]
            out.append(w)
    return out


class Rows:
    """Pieces as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, emit_ids: bool) -> None:
        self.schema, self.emit_ids, self.cols, self.held = schema, emit_ids, [[] for _ in schema], 0

    def put(self, w: Window, sequence: int, part: int, is_open: bool) -> None:
        at = 0
        for d, start, ids, total in w.pieces:
            raw = ids.tobytes()
            row = (d, start, len(ids), zlib.crc32(raw), total, sequence, at, raw if is_open or self.emit_ids else None, part, is_open)
            for c, x in zip(self.cols, row, strict=True):
                c.append(x)
            at += len(ids)
            self.held += 100 + (len(raw) if row[7] else 0)

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.cols[0] and self.held >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema, strict=True)], schema=self.schema)
            self.cols, self.held = [[] for _ in self.schema], 0


def _arrow(id_type: pa.DataType) -> pa.Schema:
    long = pa.int64()
    return pa.schema([("id", id_type), ("start", long), ("length", long), ("ids_crc32", long), ("doc_tokens", long), ("sequence_id", long), ("offset", long), ("ids", pa.binary()), ("part", pa.int32()), ("open", pa.bool_())])


def _placer(files: tuple, size: int, space: int, emit_ids: bool):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, part, n = Encoder(*files).encode, Packer(size, space), TaskContext.get().partitionId(), 0
        rows = None
        for batch in batches:
            rows = rows or Rows(_arrow(batch.schema.field("id").type), emit_ids)
            for d, text in zip(batch.column("id"), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                for w in packer.take((d.as_py(), 0, ids, len(ids))):
                    rows.put(w, part << SHIFT | n, part, False)
                    n += 1
                yield from rows.flush(4 << 20)
        if rows:
            full, last = merged(packer.rest, size)
            for w in full:
                rows.put(w, part << SHIFT | n, part, False)
                n += 1
            rows.put(last, part << SHIFT | n, part, True)
            yield from rows.flush(0)

    return place


def _merger(size: int, last_level: bool, emit_ids: bool, base: int):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        schema, windows = _arrow(table.schema.field("id").type), {}
        for r in table.sort_by([("part", "ascending"), ("offset", "ascending")]).to_pylist():
            windows.setdefault(r["part"], Window()).add((r["id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
        full, last = merged(list(windows.values()), size)
        group, n, rows = key[0].as_py(), 0, Rows(schema, emit_ids)
        for w, is_open in [(w, False) for w in full] + ([(w, False) for w in halved(last)] if last_level else [(last, True)]):
            rows.put(w, base + group << SHIFT | n, group, is_open)
            n += 1
        return pa.Table.from_batches(rows.flush(0), schema)

    return merge


def pack(docs: DataFrame, vocabulary: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, open_windows: int = 16, emit_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32 bits; null without ``emit_ids``)."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    placed = materialize(own.mapInArrow(_placer((vocabulary, ranks_path, pattern), size, open_windows, emit_ids), _schema(kind)), "packing")
    done, left = [placed.where("not open")], placed.where("open")
    # each level has a base of its own in the sequence ids, above every partition's, also of those that left nothing open
    last = placed.agg(F.max("part").alias("all"), F.max(F.when(F.col("open"), F.col("part"))).alias("open")).first()
    parts, base = (last["open"] or 0) + 1, (last["all"] or 0) + 1
    while parts:
        last_level, groups = parts <= MERGE_FAN, -(-parts // MERGE_FAN)
        level = left.groupBy(F.floor(F.col("part") / MERGE_FAN).cast("int").alias("g")).applyInArrow(_merger(size, last_level, emit_ids, base), _schema(kind))
        level = materialize(level, "packing-merge")
        done.append(level.where("not open"))
        left, base, parts = level.where("open"), base + groups, 0 if last_level else groups
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
