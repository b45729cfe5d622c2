"""Information theory over probability columns.

Functions take Columns and return aggregates or expressions; natural logarithms
unless named otherwise; terms whose probability is zero are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _plogp(p: Column, q: Column | None = None) -> Column:
    """p * ln(p / q), or p * ln(p); 0 where p is 0."""
    return F.when(p > 0, p * F.log(p / q if q is not None else p)).otherwise(0.0)


def kl_divergence(a: Column, b: Column) -> Column:
    return F.sum(_plogp(a, b))


def js_divergence(a: Column, b: Column) -> Column:
    m = (a + b) / 2
    return 0.5 * F.sum(_plogp(a, m)) + 0.5 * F.sum(_plogp(b, m))


def cross_entropy(a: Column, b: Column) -> Column:
    return -F.sum(F.when(a > 0, a * F.log(b)).otherwise(0.0))


def kl_bayes(a: Column, b: Column) -> Column:
    """Divergence in the space of densities: n / 2 * ln(mean(a/b) * mean(b/a))."""
    return F.count(a) / 2 * F.log(F.avg(a / b) * F.avg(b / a))


def js_bayes(a: Column, b: Column) -> Column:
    m = (a + b) / 2
    return 0.5 * kl_bayes(a, m) + 0.5 * kl_bayes(b, m)


def renyi_entropy(p: Column, alpha: float = 2.0) -> Column:
    """Order alpha; at 1 the Shannon entropy."""
    if alpha == 1:
        return -F.sum(_plogp(p))
    return F.log(F.sum(F.when(p > 0, F.pow(p, alpha)).otherwise(0.0))) / (1 - alpha)


def max_entropy(p: Column) -> Column:
    return F.log(F.count_if(p > 0))


def min_entropy(p: Column) -> Column:
    return -F.log(F.max(p))


def normalized_entropy(p: Column) -> Column:
    """Shannon entropy over its maximum; 0 for a single outcome."""
    n = F.count_if(p > 0)
    return F.when(n > 1, -F.sum(_plogp(p)) / F.log(n)).otherwise(0.0)


def conditional_entropy(joint: DataFrame, row: str, p: str) -> DataFrame:
    """One row (h): entropy of the column given the row of a joint table."""
    sums = joint.groupBy(row).agg(F.sum(p).alias("r"), F.sum(_plogp(F.col(p))).alias("s"))
    return sums.agg(F.sum(_plogp(F.col("r")) - F.col("s")).alias("h"))


def cumulative_entropy(df: DataFrame, col: str) -> DataFrame:
    """One row (h): minus the mean log of the empirical distribution function."""
    from ..operators.ranks import running, value_counts

    counts = running(value_counts({"n": df}, col), "v", ["n"])
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).agg((-F.sum(F.col("n") * F.log(F.col("run_n") / F.col("t"))) / F.sum("n")).alias("h"))


def _entropy2(counts: DataFrame, name: str) -> DataFrame:
    return counts.agg(((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")) / F.log(F.lit(2.0))).alias(name))


def mutual_information(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """One row (mi, nmi, cpl[, cmi, cmi_compat]) in bits, from counts.

    ``cmi`` is the textbook conditional information; ``cmi_compat`` is
    H(X, Z) - H(X, Y, Z), which another implementation reports under that name.
    """
    cols = [x, y] + ([z] if z else [])
    base = df.na.drop(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    h = lambda *c: _entropy2(base.groupBy(*c).agg(F.sum("n").alias("n")), "h_" + "_".join(c))
    parts = h(x).join(h(y)).join(h(x, y))
    mi = F.greatest(F.lit(0.0), F.col(f"h_{x}") + F.col(f"h_{y}") - F.col(f"h_{x}_{y}"))
    out = [mi.alias("mi"), F.when(F.col(f"h_{x}") > 0, mi / F.col(f"h_{x}")).alias("nmi"), (1 - F.pow(F.lit(2.0), -mi)).alias("cpl")]
    if z:
        parts = parts.join(h(x, z)).join(h(y, z)).join(h(z)).join(h(x, y, z))
        out += [
            (F.col(f"h_{x}_{z}") + F.col(f"h_{y}_{z}") - F.col(f"h_{z}") - F.col(f"h_{x}_{y}_{z}")).alias("cmi"),
            (F.col(f"h_{x}_{z}") - F.col(f"h_{x}_{y}_{z}")).alias("cmi_compat"),
        ]
    return parts.select(*out)


def max_information_leakage(joint: DataFrame, x: str, y: str, p: str) -> DataFrame:
    """One row (leakage): the most that an outcome of y tells about x, in bits."""
    bits = lambda c: F.when(c > 0, -c * F.log2(c)).otherwise(0.0)
    hx = joint.groupBy(x).agg(F.sum(p).alias("px")).agg(F.sum(bits(F.col("px"))).alias("hx"))
    given = joint.withColumn("q", F.col(p) / F.sum(p).over(Window.partitionBy(y)))
    per = given.groupBy(y).agg(F.sum(bits(F.col("q"))).alias("h"))
    return per.join(F.broadcast(hx)).agg(F.max(F.col("hx") - F.col("h")).alias("leakage"))


def surprisal(p: Column, base: float = 2.0) -> Column:
    """Null where p is not positive."""
    return F.when(p > 0, -F.log(p) / F.log(F.lit(float(base))))


def positive_disclosure(prior: DataFrame, posterior: DataFrame, name: str, p: str) -> DataFrame:
    """One row (pid): largest relative gain of posterior over prior."""
    both = prior.select(name, F.col(p).alias("a")).join(posterior.select(name, F.col(p).alias("b")), name)
    return both.filter("a > 0").agg(F.max((F.col("b") - F.col("a")) / F.col("a")).alias("pid"))


def privacy_score(df: DataFrame, sensitivity: str, visibility: str, normalize: bool = False) -> DataFrame:
    """One row (score): sensitivity times visibility, summed."""
    s = F.sum(F.col(sensitivity) * F.col(visibility))
    return df.agg((s / (F.sum(sensitivity) * F.max(visibility)) if normalize else s).alias("score"))


def error_statistics(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (mape, mae, mse, rmse) of y against x."""
    d = F.col(x) - F.col(y)
    return df.agg(
        (100 * F.avg(F.abs(d / F.nullif(F.col(x), F.lit(0.0))))).alias("mape"), F.avg(F.abs(d)).alias("mae"),
        F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"),
    )


def aitchison(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (ait): Aitchison distance over rows in which both are positive,
    divided by twice their number."""
    logs = df.filter((F.col(x) > 0) & (F.col(y) > 0)).select((F.log(x) - F.log(y)).alias("d"))
    return logs.agg((F.sqrt(F.var_pop("d") * F.count("d")) / (2 * F.count("d"))).alias("ait"))


def permanent(a: Sequence[Sequence[float]]) -> float:
    """Permanent of a small square matrix by inclusion and exclusion over columns."""
    n = len(a)
    total = 0.0
    for r in range(1, n + 1):
        for cols in combinations(range(n), r):
            term = 1.0
            for row in a:
                term *= sum(row[c] for c in cols)
            total += (-1) ** (n - r) * term
    return total


def system_anonymity_level(a: Sequence[Sequence[float]]) -> float:
    """ln of the permanent over ln of n!; 0 for one sender or no matching."""
    import math

    n = len(a)
    p = permanent(a)
    return 0.0 if n <= 1 or p <= 0 else math.log(p) / math.lgamma(n + 1)
