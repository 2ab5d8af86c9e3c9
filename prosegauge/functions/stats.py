"""Small statistics with fixed conventions: population spread, interpolated percentiles, zero for nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(x) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def std(x) -> Column:
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def cv(x) -> Column:
    m = mean(x)
    return F.when(F.abs(m) < 1e-9, 0.0).otherwise(std(x) / F.abs(m))


def pct(x, q: int) -> Column:
    return F.coalesce(F.percentile(x, F.lit(q / 100)), F.lit(0.0))


def ratio(a: Column, b: Column, per: float = 1.0) -> Column:
    return F.when(b == 0, 0.0).otherwise(a * F.lit(per) / b)


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of positive counts."""
    start = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("n"))
    return F.aggregate(
        counts,
        start,
        lambda a, c: F.struct((a["h"] + c * F.log2(c.cast("double"))).alias("h"), (a["n"] + c).alias("n")),
        lambda a: F.when(a["n"] == 0, 0.0).otherwise(F.log2(a["n"]) - a["h"] / a["n"]),
    )


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where either is zero."""
    dot = array_sum(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))
    na, nb = (F.sqrt(array_sum(F.transform(v, lambda x: (x * x).cast("double")))) for v in (a, b))
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(dot / (na * nb))


def js_divergence(a: Column, b: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays of weights, clipped at 1e-12 and renormalised; two zero arrays are 0 apart."""
    low = F.lit(1e-12)
    p, q = (F.transform(v, lambda x: F.greatest(x.cast("double"), low)) for v in (a, b))
    sp, sq = array_sum(p), array_sum(q)
    terms = F.zip_with(p, q, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def add(acc: Column, t: Column) -> Column:
        x, y = t["x"] / acc["sp"], t["y"] / acc["sq"]
        m = (x + y) / 2
        return F.struct((acc["s"] + 0.5 * x * F.log2(x / m) + 0.5 * y * F.log2(y / m)).alias("s"), acc["sp"].alias("sp"), acc["sq"].alias("sq"))

    out = F.aggregate(terms, F.struct(F.lit(0.0).alias("s"), sp.alias("sp"), sq.alias("sq")), add, lambda acc: acc["s"])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, clamped to [0, 1], four places; zeros for no trials."""
    p, z2 = k / n, z * z
    middle, half = p + z2 / (2 * n), F.lit(z) * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    bound = lambda x: F.when(n == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / (1 + z2 / n))), 4))
    return bound(middle - half), bound(middle + half)

