"""Statistics as column expressions: similarity transforms, correlation from sums, Student and hypergeometric tails."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def similarity(r: Column, network_type: str = "signed hybrid") -> Column:
    """unsigned |r|, signed (1 + r) / 2, signed hybrid max(r, 0)."""
    if network_type == "unsigned":
        return F.abs(r)
    if network_type == "signed":
        return (r + 1) / 2
    if network_type == "signed hybrid":
        return F.when(r > 0, r).when(r.isNotNull(), F.lit(0.0))
    raise ValueError(f"unknown network type {network_type!r}")


def soft_threshold(s: Column, power: float) -> Column:
    return F.pow(s, F.lit(float(power)))


def pearson(x: Column, y: Column, w: Column | None = None) -> Column:
    """Correlation of pairs that are both present, as an aggregate; null for no spread (up to rounding). Weighted if w is given."""
    both = x.isNotNull() & y.isNotNull()
    w = F.lit(1.0) if w is None else w
    total = lambda e: F.sum(F.when(both, e * w))
    n, sx, sy, sxx, syy, sxy = (total(e) for e in (F.lit(1.0), x, y, x * x, y * y, x * y))
    a, b = n * sxx - sx * sx, n * syy - sy * sy
    r = (n * sxy - sx * sy) / F.sqrt(F.when((a > 1e-12 * n * sxx) & (b > 1e-12 * n * syy), a * b))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))  # greatest and least pass over nulls


def student_p(r: Column, n: Column, alternative: str = "two-sided") -> Column:
    """p-value of a correlation of n pairs, from the finite series of Student's distribution for whole degrees of freedom; null for n < 3."""
    v = (n - 2).cast("int")
    t = r * F.sqrt(v / F.when(r * r < 1, 1 - r * r))
    theta = F.atan(F.abs(t) / F.sqrt(v))
    s, c2 = F.sin(theta), F.pow(F.cos(theta), 2)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def series(count: Column, factor) -> Column:
        def add(a, k):
            term = a["term"] * factor(k) * c2
            return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

        # the first term is 1; further ones are steps 1 .. count
        steps = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, add)["total"]

    odd = 1 - (2 / math.pi) * (theta + F.when(v > 1, s * F.cos(theta) * series(F.floor((v - 3) / 2).cast("int"), lambda k: (2.0 * k) / (2.0 * k + 1))).otherwise(0.0))
    even = 1 - s * series(F.floor((v - 2) / 2).cast("int"), lambda k: (2.0 * k - 1) / (2.0 * k))
    both = F.when(v < 1, None).when(r * r >= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.when(v % 2 == 1, odd).otherwise(even)))
    if alternative == "two-sided":
        return both
    upward = r > 0 if alternative == "greater" else r < 0
    return F.when(upward, both / 2).otherwise(1 - both / 2)


def log_factorial(n: Column) -> Column:
    """ln n! for n >= 0: Stirling's series at n + 10 less the ten factors above n."""
    m = n.cast("double") + 10
    stirling = m * F.log(m) - m + 0.5 * F.log(2 * math.pi * m) + 1 / (12 * m) - 1 / (360 * F.pow(m, 3)) + 1 / (1260 * F.pow(m, 5))
    above = F.lit(0.0)
    for k in range(1, 11):
        above = above + F.log(n.cast("double") + k)
    return stirling - above


def log_choose(a: Column, b: Column) -> Column:
    return log_factorial(a) - log_factorial(b) - log_factorial(a - b)


def hypergeometric_p(x: Column, a: Column, b: Column, n: Column, alternative: str = "greater") -> Column:
    """Fisher's exact test of an overlap x between sets of a and b out of n.

    A tail starts from one probability and goes on by the ratio of neighbouring ones, always away from the mode, where they fall; a tail that holds the
    mode is one less the other."""
    x, a, b, n = (c.cast("long") for c in (x, a, b, n))
    low, high = F.greatest(F.lit(0).cast("long"), a + b - n), F.least(a, b)
    mode = F.least(high, F.greatest(low, F.floor((a + 1) * (b + 1) / (n + 2))))
    chance = lambda k: F.exp(log_choose(a, k) + log_choose(n - a, b - k) - log_choose(n, b))
    up = lambda k: (a - k) * (b - k) / ((k + 1) * (n - a - b + k + 1))  # noqa: E731  chance(k + 1) / chance(k)
    down = lambda k: k * (n - a - b + k) / ((a - k + 1) * (b - k + 1))  # noqa: E731  chance(k - 1) / chance(k)

    def tail(first: Column, count: Column, ratio, step: int, limit: Column | None = None) -> Column:
        """The sum of chance(first) and ``count`` - 1 further ones on one side; of those alone that are at most ``limit``, if given."""
        counted = lambda p: p if limit is None else F.when(p <= limit, p).otherwise(0.0)
        begin = chance(first)
        add = lambda s, i: F.struct((s["p"] * ratio(first + step * (i - 1))).alias("p"), (s["total"] + counted(s["p"] * ratio(first + step * (i - 1)))).alias("total"))
        steps = F.when(count > 1, F.sequence(F.lit(1).cast("long"), F.greatest(count - 1, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(count > 0, F.aggregate(steps, F.struct(begin.alias("p"), counted(begin).alias("total")), add)["total"]).otherwise(0.0)

    above = lambda k, limit=None: tail(k, high - k + 1, up, 1, limit)  # noqa: E731  k to high
    below = lambda k, limit=None: tail(k, k - low + 1, down, -1, limit)  # noqa: E731  low to k
    if alternative == "greater":
        p = F.when(x > mode, above(x)).otherwise(1 - below(x - 1))
    elif alternative == "less":
        p = F.when(x < mode, below(x)).otherwise(1 - above(x + 1))
    else:
        limit = chance(x) * (1 + 1e-7)
        p = above(mode, limit) + below(mode - 1, limit)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def jaccard(inter: Column, a: Column, b: Column) -> Column:
    return inter / F.when(a + b - inter > 0, a + b - inter)


def core_size(size: Column, min_size: int) -> Column:
    """Members of a branch that count as its core: all up to a base, then the root of the rest."""
    base = min_size / 2 + 1
    return F.when(size > base, F.floor(base + F.sqrt(F.greatest(size - base, F.lit(0.0))))).otherwise(size).cast("long")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], into: str = "p_adjusted") -> DataFrame:
    """Adjusted p within each group: the least of p * m / rank over ranks from here on, at most 1."""
    up = W.partitionBy(*by).orderBy(p)
    ranked = df.withColumn("__rank", F.row_number().over(up)).withColumn("__m", F.count(p).over(W.partitionBy(*by)))
    raw = F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("__rank"))
    down = W.partitionBy(*by).orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranked.withColumn("__raw", raw).withColumn(into, F.min("__raw").over(down)).drop("__rank", "__m", "__raw")


def minus_log10(p: Column, by: W) -> Column:
    """-log10 p, with infinity shown as one more than the largest finite value of the window."""
    raw = F.when(p > 0, -F.log10(p))
    return F.when(p.isNull(), None).otherwise(F.coalesce(raw, F.max(raw).over(by) + 1))
