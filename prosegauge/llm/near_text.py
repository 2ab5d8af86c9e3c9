"""SimHash near-dedup at a Jaccard similarity of shingle sets, over the deletion-variant signatures of :mod:`prosegauge.llm.simhash`.

Sets. A-Z to lower case, words ``[^\\x20\\x09-\\x0D]+``, the distinct XXH64 (seed 42) of ``shingle``-word shingles (fewer words make one shingle,
none at all the empty one). Texts that are equal are one member from the start.

Candidates. A fingerprint bit is 1 if it is set in over half of a set's hashes. Two sets of similarity ``SIMILAR`` differ in about 15 of 100 bits
(the angle between them, by pi), so the fingerprint is cut into segments, and each is indexed under all its one-wildcard variants: a pair meets if any segment differs
by one bit at most. :func:`plan` makes segments long enough for the number of texts, so that keys do not fill up with chance meetings, and as many of them as
keep the share of pairs that no key holds under ``LOST`` for pairs at just ``SIMILAR``; it falls fast above that. On 1,056 pairs in 18,322 documents with 240 bits in twelve
segments, 2 % were lost of all pairs at 0.8 or more, and 4.5 % of those under 0.85.

Links. Each entry of a key is paired with the ``SPAN`` entries before it, by size of set. Keys with more entries than that and with more than one component after
this step are searched besides in blocks, each two blocks whole, for pairs of different components; a pair that several keys hold comes from the first of them alone. Pairs whose sizes rule the
similarity out, or that differ in more than ``NEAR`` of 128 bits or a share of ``APART`` of all, go at once; all others are verified on the whole sets, made anew from the texts, so no pair under ``SIMILAR`` is a link.

Groups are the components of the links; the document of the smallest id stays (a null id is never the smallest beside another; of equal ids the smallest text hash).

Defined results: null and empty texts are equal; rows that repeat a text, whatever their ids, leave one; an empty table gives no rows; other columns, whatever
their names, pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.llm.simhash import WORD, bits_of, components, places
from prosegauge.session import bounded_batches, materialize

SIMILAR, LOST = 0.8, 0.12
SPAN = 8
#: Entries of a crowded key that one task compares with each other.
BLOCK = 2_000
#: Of 128 bits: pairs at SIMILAR differ in about 19, with a spread of 4; others in about 64.
NEAR = 36
#: The share of all bits beyond which entries of a crowded key are no pair: at SIMILAR it is 0.15, with a spread of 0.023 over 240 bits.
APART = 0.225
#: So many pairs, at most, have the members that they name broadcast.
NAMED = 500_000


def plan(texts: int) -> tuple[int, int]:
    """(segments, bits of a segment) for so many texts."""
    length = min(32, max(20, math.ceil(math.log2(max(texts, 1))) + 2))
    p = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
    meets = (1 - p) ** length + length * p * (1 - p) ** (length - 1)
    return math.ceil(math.log(LOST) / math.log(1 - meets)), length


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of one text in UTF-8."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    rows = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) > shingle else [words]
    h64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h64(b" ".join(q), 42) for q in rows), np.uint64))


def print_column(text: Column, shingle: int, words: int) -> Column:
    """A struct: n, the size of the text's set, and f, its fingerprint of so many words."""

    @F.arrow_udf("struct<n: int, f: array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        found = [shingles(t.as_py(), shingle) for t in texts.cast(pa.binary())]
        prints = np.array([bits_of(s, words) for s in found], np.uint64).reshape(-1)
        f = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * words), pa.array(prints.view(np.int64)))
        return pa.StructArray.from_arrays([pa.array([len(s) for s in found], pa.int32()), f], ["n", "f"])

    return of(text)


def set_column(text: Column, shingle: int) -> Column:
    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        found = [shingles(t.as_py(), shingle).view(np.int64) for t in texts.cast(pa.binary())]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))

    return of(text)


def _sizes(n, m):
    """May sets of these sizes be similar? 0.8 in whole numbers."""
    return (n * 5 >= m * 4) & (m * 5 >= n * 4)


def _cut(words: np.ndarray, segment: int, length: int) -> np.ndarray:
    """The bits of one segment of each row of ``words`` (uint64)."""
    word, at = divmod(segment * length, WORD)
    out = words[:, word] >> np.uint64(at)
    if at + length > WORD:
        out = out | words[:, word + 1] << np.uint64(WORD - at)
    return out & np.uint64((1 << length) - 1)


def near(words: np.ndarray, n: np.ndarray, root: np.ndarray, slot: int, length: int, segments: int, own: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of different ``root`` that may be similar, by all bits of their fingerprints (uint64) and sizes, and for which the key of ``slot`` is the first of all keys that hold both:
    the earliest segment in which they differ by one bit at most, and there the bit that differs, or the first one. ``own``: rows of one kind are not paired with each other."""
    segment, most = slot // length, math.ceil(APART * segments * length)
    parts = np.stack([_cut(words, q, length) for q in range(segments)])
    for j in range(len(n)):
        ok = (root[j + 1 :] != root[j]) & _sizes(n[j + 1 :], n[j])
        if own is not None:
            ok &= own[j + 1 :] != own[j]
        y = np.flatnonzero(ok) + j + 1
        if not len(y):
            continue
        apart = np.bitwise_count(parts[:, y] ^ parts[:, j, None])
        first = np.argmax(apart <= 1, axis=0)
        same = apart[segment] == 0
        yield from ((j, k) for k in y[(apart.sum(0) <= most) & (first == segment) & (~same | (slot % length == 0))])


def _crowd_pairs(crowd: DataFrame, prints: DataFrame, segments: int, length: int) -> DataFrame:
    """Pairs within each crowded key (key, node, size, root) that may link, over blocks of about ``BLOCK`` entries, each with each other; each pair once, whatever keys hold it."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    others = F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), blocks - 1), lambda x: x != F.col("mine")))
    dealt = crowd.withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(others))
    dealt = dealt.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "root").join(prints.select("node", "n", "f"), "node")

    def span(table: pa.Table) -> pa.Table:
        nodes, root, n, mine = (table.column(c).to_numpy() for c in ("node", "root", "n", "mine"))
        lists = table.column("f").combine_chunks()
        words = lists.flatten().to_numpy().view(np.uint64).reshape(len(lists), -1)
        key, lo, hi = (table.column(c)[0].as_py() for c in ("key", "lo", "hi"))
        # entries of one block meet each other beside block 0, those of block 0 beside block 1
        each = np.arange(len(mine))
        kind = each if hi <= 1 else np.where((lo == 0) & (mine == hi), each + hi + 1, mine)
        pairs = np.array(list(near(words, n.astype(np.int64), root, key >> 32, length, segments, kind)), np.int64).reshape(-1, 2)
        return pa.table([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], names=["a", "b"])

    return dealt.groupBy("key", "lo", "hi").applyInArrow(span, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, written to the shared folder. ``texts``: (node, text), a row a document."""
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    own = texts.join(F.broadcast(named) if pairs.count() <= NAMED else named, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(own.select("node", set_column(F.col("text"), shingle).alias("set")), "near-sets")
    two = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
    similar = F.size(F.array_intersect("s", "t")) * 9 >= (F.size("s") + F.size("t")) * 4
    return materialize(two.where(similar).select("a", "b"), "near-links")


def links(prints: DataFrame, texts: DataFrame, shingle: int, segments: int, length: int) -> DataFrame:
    """Links (a, b) that give the components of ``prints`` (node, n, f), one row a text."""
    word = "element_at(f, v.word + 1)"
    rest = f"shiftrightunsigned({word}, v.at) | if(v.over < 0, 0L, shiftleft(coalesce(get(f, v.word + 1), 0L), v.over))"
    variants = F.expr(f"explode(array({', '.join(places(segments * length, segments))}))").alias("v")
    # the bit that the key leaves out
    skipped = f"CAST(shiftrightunsigned({rest}, v.slot % {length}) & 1 AS INT)"
    keyed = prints.select("node", "n", "f", variants).select("node", "n", F.expr("f[0]").alias("f0"), F.expr("f[1]").alias("f1"), F.expr(skipped).alias("bit"), F.expr(f"shiftleft(CAST(v.slot AS BIGINT), 32) | (({rest}) & v.mask)").alias("key"))
    w = Window.partitionBy("key")
    mine = F.struct(F.col("node").alias("b"), F.col("n").alias("m"), F.col("f0").alias("g0"), F.col("f1").alias("g1"), F.col("bit").alias("c"))
    before = F.collect_list(mine).over(w.orderBy("n", "node").rowsBetween(-SPAN, -1))
    entries = keyed.select("key", "node", "n", "f0", "f1", "bit", F.count("key").over(w).alias("size"), before.alias("before")).where("size > 1")
    # verified as far as it goes where they stand: what is written and unfolded are pairs that may link
    hamming = lambda x: F.bit_count(F.col("f0").bitwiseXOR(x["g0"])) + F.bit_count(F.col("f1").bitwiseXOR(x["g1"]))
    # entries that agree in the whole segment share all its keys: they pair in the first of them. Pairs that this leaves out of a crowded key are found by its search
    first = F.shiftright("key", 32) % length == 0
    once = lambda x: first | (F.col("bit") != x["c"])
    may = F.transform(F.filter("before", lambda x: once(x) & _sizes(x["m"], F.col("n")) & (hamming(x) <= NEAR)), lambda x: x["b"])
    entries = entries.select("key", "node", "size", may.alias("before")).where((F.size("before") > 0) | (F.col("size") > SPAN + 1))
    entries = materialize(entries, "near-entries")
    pairs = entries.select("node", F.explode("before").alias("b")).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
    found = _verified(materialize(pairs, "near-pairs"), texts, shingle)
    comp = components(found)
    crowd = entries.where(F.col("size") > SPAN + 1).select("key", "node", "size")
    crowd = crowd.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = crowd.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    more = _crowd_pairs(crowd.join(mixed, "key", "left_semi").select("key", "node", "size", "root"), prints, segments, length)
    return found.unionByName(_verified(materialize(more, "near-pairs"), texts, shingle))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of equal ids, of the smallest text hash)."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(text_col, F.lit(""))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    # a null id sorts first in a struct; it must not win over an id
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th")).alias("first")
    # by the number of rows, which one scan of the footers gives
    segments, length = plan(docs.count())
    own = docs.select(F.xxhash64(text).alias("node"), first, print_column(text, shingle, max(2, -(-segments * length // WORD))).alias("p"))
    own = materialize(own.select("node", "first", "p.n", "p.f"), "near-prints")
    prints = materialize(own.groupBy("node").agg(F.min("first").alias("first"), F.first("n").alias("n"), F.first("f").alias("f")), "near-texts")
    comp = components(links(prints.select("node", "n", "f"), texts, shingle, segments, length))
    least = prints.select("node", "first").join(comp, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    keep = least.select(F.col("first.id").alias("k_id"), F.col("first.th").alias("k_th"))
    stays = row.join(keep, row["id"].eqNullSafe(keep["k_id"]) & (row["th"] == keep["k_th"]), "left_semi")
    again = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(1)))
    return stays.withColumn("again", again).where("again = 1").select("row.*")
