"""SimHash near-dedup over deletion-variant signatures.

Fingerprint. A-Z to lower case, words ``[^\\x20\\x09-\\x0D]+``, ``shingle``-word shingles (repeats count; fewer
words make one shingle; none at all gives fingerprint zero), XXH64 with seed 42 of each, and a bit is 1 if it
is set in over half of the hashes. A fingerprint of more than 64 bits takes its further words from the same hash, remixed.

Candidates. Two fingerprints at ``2 * segments - 1`` or fewer differing bits agree in one of ``segments`` segments up
to one bit (beyond that many bits, most still do). So each distinct fingerprint is indexed under every one-wildcard
variant of every segment: the segment with one bit deleted, and which one. Equal keys are joined by a
sorted window that pairs each entry with the ``SPAN`` entries before it, and each pair is verified on all bits.

Crowded keys, those with more entries than that, would need all pairs of a group. Their entries are searched besides by an exact
way that emits no more than one link for each entry. At two bits, balls of radius one about the fingerprints meet if and only if
they link, and no ball's centre has over 65 entries (:func:`_ball_links`). At more bits, the entries of a key
are dealt to blocks, and each two blocks give a spanning forest of their links (:func:`_block_links`). No candidate is dropped.

Groups. Copies share a fingerprint and meet as one row. Links join distinct fingerprints only; components come
from alternating large-star and small-star steps on tables in the shared folder, never on the driver.

Defined results: null or wordless text has fingerprint zero and links like any other; a null id is never the
smallest of a component that has another id; repeated rows are returned as often as they occur; an empty table gives no
rows; other columns are not read, but for :func:`keep_one`, which returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.session import bounded_batches, materialize

#: Entries of one key that a new entry is paired with directly.
SPAN = 8
WORD = 64
#: Fingerprints with more than this share of all rows, one in HOT, are hot.
HOT = 1000
#: Entries of a crowded key that one task compares with each other.
BLOCK = 20_000
_BATCH = 1 << 15
#: Odd multipliers that remix a hash into further words.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _more(h: np.ndarray, word: int) -> np.ndarray:
    """The ``word``-th 64 bits of the hashes ``h``."""
    for _ in range(word):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX[0])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[1])
        h = h ^ (h >> np.uint64(32))
    return h


def fingerprint(text: bytes | None, shingle: int, width: int = WORD) -> list[int]:
    """The fingerprint of one text in UTF-8, as unsigned 64-bit words, the lowest first."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return [0] * (width // WORD)
    h64, n = xxhash.xxh64_intdigest, len(words)
    total, ones = max(1, n - shingle + 1), np.zeros((width // WORD, WORD), np.int64)
    for at in range(0, total, _BATCH):
        part = words[at : at + _BATCH + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle)), strict=False) if n > shingle else [words]
        h = np.fromiter((h64(b" ".join(q), 42) for q in rows), np.uint64)
        for k in range(width // WORD):
            ones[k] += np.unpackbits(_more(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * o > total, bitorder="little").tobytes(), "little") for o in ones]


def bits_of(hashes: np.ndarray, words: int) -> list[int]:
    """The bits set in over half of the hashes (uint64), as unsigned words."""
    ones = np.zeros((words, WORD), np.int64)
    for at in range(0, len(hashes), _BATCH):
        for k in range(words):
            ones[k] += np.unpackbits(_more(hashes[at : at + _BATCH], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * o > len(hashes), bitorder="little").tobytes(), "little") for o in ones]


def names(width: int, stem: str = "f") -> list[str]:
    return [f"{stem}{k}" for k in range(width // WORD)]


def fingerprint_column(text: Column, shingle: int, width: int = WORD) -> Column:
    """A struct of signed longs, in Arrow batches."""

    @F.arrow_udf("struct<" + ", ".join(f"{n}: long" for n in names(width)) + ">")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t.as_py(), shingle, width) for t in texts.cast(pa.binary())], np.uint64).reshape(-1, width // WORD)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in found.T], names(width))

    return of(text)


def _hamming(a: list[Column], b: list[Column]) -> Column:
    parts = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    return sum(parts[1:], parts[0])


def places(width: int, segments: int) -> list[str]:
    """SQL structs (slot, word, at, over, mask) of the one-wildcard variants: the bit left out, where its segment begins, where the segment goes on in the next word
    (-1: nowhere), and which bits of it count."""
    edges, out = [round(i * width / segments) for i in range(segments + 1)], []
    for lo, hi in zip(edges, edges[1:], strict=False):
        word, at = divmod(lo, WORD)
        over = WORD - at if at + hi - lo > WORD else -1
        out += [f"named_struct('slot', {lo + i}, 'word', {word}, 'at', {at}, 'over', {over}, 'mask', {((1 << (hi - lo)) - 1) & ~(1 << i)}L)" for i in range(hi - lo)]
    return out


def _variants(fps: DataFrame, width: int, segments: int) -> DataFrame:
    """(f0, ..., slot, rest): slot is the bit left out, rest the other bits of its segment; ``width`` rows a fingerprint.

    Places and masks are rows of one constant array and the bits one expression over them: an expression for each bit would make a
    generated method whose compilation takes more memory than the data.
    """
    where = places(width, segments)
    own = f"element_at(array({', '.join(names(width))}), v.word + 1)"
    rest = f"shiftrightunsigned({own}, v.at)"
    if any("'over', -1" not in p for p in where):
        rest = f"({rest} | if(v.over < 0, 0L, shiftleft(element_at(array({', '.join(names(width))}, 0L), v.word + 2), v.over)))"
    placed = fps.select(*names(width), F.expr(f"explode(array({', '.join(where)}))").alias("v"))
    return placed.select(*names(width), F.col("v.slot").alias("slot"), F.expr(f"{rest} & v.mask").alias("rest"))


def _ball_links(fps: DataFrame) -> DataFrame:
    """Links at two bits or fewer by shared centres: two fingerprints are that near exactly if some centre is within one bit of both.

    All entries of a centre link pairwise, so a link from each to the smallest keeps every component.
    """
    flips = [0] + [1 << i for i in range(63)] + [-(1 << 63)]
    centres = fps.select("f0", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda m: F.col("f0").bitwiseXOR(m))).alias("centre"))
    found = centres.withColumn("g0", F.min("f0").over(Window.partitionBy("centre")))
    return found.where("f0 <> g0").select("f0", "g0")


def forest(words: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links that span each component of the rows of ``words`` (uint64) under at most ``max_bits`` differing bits."""
    left = np.arange(len(words))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(words[left] ^ words[x]).sum(1) <= max_bits
            found = left[near]
            yield from ((x, y) for y in found)
            todo.extend(found)
            left = left[~near]


def _block_links(entries: DataFrame, width: int, max_bits: int) -> DataFrame:
    """Spanning links within each crowded key, over blocks of about ``BLOCK`` entries, each with each other."""
    f, g = names(width), names(width, "g")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64(*f), blocks).cast("int")
    others = F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), blocks - 1), lambda x: x != F.col("mine")))
    dealt = entries.withColumn("mine", mine).withColumn("other", F.explode(others))
    dealt = dealt.select("slot", "rest", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), *f)

    def span(table: pa.Table) -> pa.Table:
        words = np.column_stack([table.column(c).to_numpy() for c in f]).view(np.uint64)
        pairs = np.array(list(forest(words, max_bits)), np.int64).reshape(-1, 2)
        signed = words.view(np.int64)
        return pa.table([pa.array(signed[pairs[:, side], k]) for side in (0, 1) for k in range(len(f))], names=[*f, *g])

    return dealt.groupBy("slot", "rest", "lo", "hi").applyInArrow(span, ", ".join(f"{n} long" for n in [*f, *g]))


def links(fps: DataFrame, width: int, segments: int, max_bits: int) -> DataFrame:
    """Links (a, b), structs, that give the components of the distinct fingerprints ``fps`` (f0, ...)."""
    f, g = names(width), names(width, "g")
    keyed = _variants(fps, width, segments)
    w = Window.partitionBy("rest", "slot")
    before = F.collect_list(F.struct(*(F.col(x).alias(y) for x, y in zip(f, g, strict=True)))).over(w.orderBy(*f).rowsBetween(-SPAN, -1))
    entries = keyed.select("slot", "rest", *f, F.count("slot").over(w).alias("size"), before.alias("before")).where("size > 1")
    # verified where they stand: what is written and unfolded are links, not candidates
    linked = F.filter("before", lambda b: _hamming([F.col(x) for x in f], [b[y] for y in g]) <= max_bits)
    # the exact second way finds all links of a crowded key, with one row an entry; here they would come several times
    entries = entries.withColumn("before", F.when(F.col("size") <= SPAN + 1, linked)).where((F.size("before") > 0) | (F.col("size") > SPAN + 1))
    kept = materialize(entries, "simhash-entries")
    near = kept.select(*f, F.explode("before").alias("b")).select(*f, "b.*")
    crowd = kept.where(F.col("size") > SPAN + 1)
    far = _ball_links(crowd.select("f0").distinct()) if (width, max_bits) == (WORD, 2) else _block_links(crowd.select("slot", "rest", "size", *f), width, max_bits)
    return near.unionByName(far).select(F.struct(*f).alias("a"), F.struct(*(F.col(y).alias(x) for x, y in zip(f, g, strict=True))).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps; each step's table is written to the shared folder.
    """
    both = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    while True:
        sides = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        large = materialize(large.where("u <> v").distinct(), "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "components")
        # a table of stars about their smallest members: nobody is both a child and a parent, and no child has two parents
        child = after.groupBy("u").agg(F.count("v").alias("n"))
        loose = child.where("n > 1").limit(1).count() or after.select(F.col("v").alias("u")).distinct().join(after, "u", "left_semi").limit(1).count()
        both = after
        if not loose:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(docs: DataFrame, shingle: int, width: int, segments: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (id, text): one row per document (id, th, fp), and one per fingerprint (fp, first, hot): the component's smallest (id, th), and
    whether the fingerprint has over a ``1 / HOT`` share of all rows."""
    bounded_batches(docs.sparkSession)
    own = docs.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), fingerprint_column(F.col("text"), shingle, width).alias("fp"))
    prints = materialize(own, "simhash-prints")
    # a null id sorts first in a struct; it must not win over an id
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    firsts = materialize(prints.groupBy("fp").agg(least.alias("first"), F.count("th").alias("rows")), "simhash-firsts")
    many = (firsts.agg(F.sum("rows")).first()[0] or 0) / HOT
    comp = components(links(firsts.select("fp.*"), width, segments, max_bits)).withColumnRenamed("node", "fp")
    rooted = firsts.join(comp, "fp", "left").select("fp", "first", (F.col("rows") > many).alias("hot"), F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return prints, materialize(rooted.select("fp", "hot", "root").join(low, "root").select("fp", "hot", "first"), "simhash-classes")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, width: int = WORD, segments: int = 2, max_bits: int = 2) -> DataFrame:
    """Per row of ``docs``: id, ``fp`` (a struct of signed longs) and ``component_id``, the smallest id of the documents reachable by links."""
    prints, found = classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, width, segments, max_bits)
    # copies of one text may be a third of all rows: the few fingerprints that are so frequent, fewer than HOT, are broadcast, and their rows are not shuffled
    hot = F.broadcast(found.where("hot").select("fp", "first"))
    both = prints.join(hot, "fp").select("id", "fp", "first").unionByName(prints.join(hot, "fp", "left_anti").join(found.where("not hot"), "fp").select("id", "fp", "first"))
    return both.select(F.col("id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of equal ids, of the smallest text hash)."""
    _, found = classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), **how)
    keep = found.select("first.id", "first.th").distinct().select(F.col("id").alias("k_id"), F.col("th").alias("k_th"))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"))
    stays = row.join(keep, row["id"].eqNullSafe(keep["k_id"]) & (row["th"] == keep["k_th"]), "left_semi")
    again = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(1)))
    return stays.withColumn("again", again).where("again = 1").select("row.*")


def hex16(fp: Column) -> Column:
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
