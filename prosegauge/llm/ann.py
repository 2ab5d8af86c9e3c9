"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt by a hash to blocks of about ``block`` vectors. Each block holds a forest: per tree a sorted array of ``BITS``-bit hash strings,
the signs of the centred vectors on random directions. A query descends every tree to the entries that share its longest prefixes, by binary
search, and ascends all trees together, one bit at a time, until the shared prefix is short enough that the trees hold ``budget`` entries
between them. Those entries, from all trees, are its candidates; their cosines are computed in double precision from the original
vectors. Each block gives its best ``k`` for each query, and the best ``k`` of all blocks are kept.

Queries meet all blocks, in chunks of ``CHUNK``: a stated set against all rows. Memory is one block and one chunk. Each block's recall for the neighbours
that it holds is that of a table of its size, so recall does not fall as the table grows.

Copies. Of equal vectors only the ``k + 1`` smallest ids enter the index: ties go to the smaller id, so no further copy can be in any answer.

Defined results: vectors null, empty, zero, or holding a null or a number that is not finite take no part, nor do null ids; repeated rows count once; a
query finds no row of its own id; vectors of different lengths never meet; a query with fewer than ``k`` candidates gets all of them; an empty
table or query set gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 32
CHUNK = 4096
_OUT = "query_id long, vec_id long, score double"


class Forest:
    """Sorted hash strings of one block's vectors, a sorted array for each tree."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int = 11) -> None:
        rng = np.random.default_rng([seed, vectors.shape[1]])
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.middle = unit.mean(0) if len(unit) > 2 else np.zeros(vectors.shape[1])
        self.directions = rng.standard_normal((trees, vectors.shape[1], BITS))
        keys = self.strings(unit)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def strings(self, unit: np.ndarray) -> np.ndarray:
        """[tree, row] hash strings; the first direction's sign is the highest bit."""
        powers = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        return np.stack([((unit - self.middle) @ d > 0) @ powers for d in self.directions])

    def candidates(self, queries: np.ndarray, budget: int) -> list[np.ndarray]:
        """Row numbers for each query: all entries that share at least as many bits as gather ``budget`` entries over all trees."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        mine, (trees, n) = self.strings(unit), self.keys.shape
        low = np.zeros((BITS + 1, trees, len(queries)), np.int32)
        high = np.full_like(low, n)
        for depth in range(1, BITS + 1):
            rest = np.uint64(BITS - depth)
            for t in range(trees):
                first = mine[t] >> rest << rest
                low[depth, t] = np.searchsorted(self.keys[t], first)
                high[depth, t] = np.searchsorted(self.keys[t], first + (np.uint64(1) << rest))
        held = (high - low).sum(1)
        # the deepest level that holds the budget; at the root every tree holds every row
        deep = BITS - np.argmax(held[::-1] >= min(budget, trees * n), axis=0)
        out = []
        for q, depth in enumerate(deep):
            found = np.zeros(n, bool)
            for t in range(trees):
                found[self.order[t, low[depth, t, q] : high[depth, t, q]]] = True
            out.append(np.flatnonzero(found))
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def search_block(rows: pa.Table, queries: pa.Table, k: int, trees: int, budget: int) -> pa.Table:
    """The best ``k`` rows of one block for each query."""
    out: list[tuple[int, int, float]] = []
    if rows.num_rows and queries.num_rows:
        ids, x = rows.column("id").to_numpy(), _matrix(rows.column("v"))
        names, y = queries.column("id").to_numpy(), _matrix(queries.column("v"))
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], x[by]
        sizes = np.sqrt((x * x).sum(1))
        for name, q, found in zip(names, y, Forest(x, trees).candidates(y, budget), strict=True):
            found = found[ids[found] != name]
            score = (x[found] * q).sum(1) / (sizes[found] * np.sqrt((q * q).sum()))
            best = np.argsort(-score, kind="stable")[:k]
            out += zip([int(name)] * len(best), ids[found[best]].tolist(), score[best].tolist(), strict=True)
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def usable(v: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block: int = 2048, trees: int = 128, budget: int = 900) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows by cosine found for each row that ``is_query`` picks; rank counts from 1."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null").where(usable(F.col("v")))
    rows = own.select("id", "v").distinct()
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    index = rows.withColumn("copy", copies).where(F.col("copy") <= k + 1).select("id", "v")
    asked = own.where("q").select("id", "v").distinct()
    # numbers of rows decide the blocks and chunks alone; every row and query is in exactly one of each
    n = own.agg(F.count("id").alias("rows"), F.count(F.when(F.col("q"), 1)).alias("queries")).first()
    blocks, chunks = max(1, -(-n["rows"] // block)), max(1, -(-n["queries"] // CHUNK))
    deal = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = index.withColumn("block", deal(blocks, 1)).withColumn("chunk", every(chunks)).withColumn("dim", F.size("v"))
    right = asked.withColumn("chunk", deal(chunks, 2)).withColumn("block", every(blocks)).withColumn("dim", F.size("v"))
    keys = ["dim", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: search_block(a, b, k, trees, budget), _OUT)
    # an id with several vectors asks with each; a row counts once, with its best score
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
