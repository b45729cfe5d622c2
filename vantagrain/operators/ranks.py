"""Running sums, ranks and distribution functions without a global window.

A column is cut at approximate quantiles into buckets of bounded size; running
sums are made within buckets and shifted by the sums of the buckets before.
Equal values never part, so results do not depend on where the cuts fall.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import kolmogorov_sf, norm_cdf

BUCKET_ROWS = 500_000


def running(df: DataFrame, by: str, sums: Sequence[str], within: Sequence[str] = (), bucket_rows: int | None = None) -> DataFrame:
    """``df``, with distinct values of ``by`` in each group ``within``, and
    ``run_<c>``, the inclusive running sum of c in the order of ``by``."""
    n = df.count()
    cuts: list = []
    parts = -(-n // (bucket_rows or BUCKET_ROWS))
    if parts > 1:
        probs = [k / parts for k in range(1, parts)]
        cuts = sorted(set(df.agg(F.percentile_approx(by, F.array(*map(F.lit, probs)), F.lit(10 * parts))).first()[0]))
    bucket = F.lit(0)
    for k, cut in enumerate(cuts, 1):
        bucket = F.when(F.col(by) > cut, k).otherwise(bucket)
    marked = df.withColumn("__b", bucket)
    keys = [*within, "__b"]
    order = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumns({f"run_{c}": F.sum(c).over(order) for c in sums})
    if not cuts:
        return local.drop("__b")
    totals = marked.groupBy(*keys).agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    before = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*keys, *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    shifts = shifts.withColumnsRenamed({k: f"__r{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r{k}")) for k in keys]
    joined = local.join(shifts, on)
    out = joined.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"__o_{c}") for c in sums})
    return out.drop("__b", *[f"__r{k}" for k in keys], *[f"__o_{c}" for c in sums])


def value_counts(frames: dict[str, DataFrame], col: str, within: Sequence[str] = (), weights: dict[str, str | None] | None = None) -> DataFrame:
    """(within, v, one count or weight sum per frame) over the pooled values."""
    names, weights = list(frames), weights or {}
    heavy = any(weights.values())
    pooled = None
    for name, df in frames.items():
        amount = F.col(weights[name]).cast("double") if weights.get(name) else F.lit(1.0 if heavy else 1)
        part = df.select(*within, F.col(col).cast("double").alias("v"), *[amount.alias(n) if n == name else F.lit(0.0 if heavy else 0).alias(n) for n in names])
        part = part.filter("v is not null and not isnan(v)")
        pooled = part if pooled is None else pooled.unionByName(part)
    return pooled.groupBy(*within, "v").agg(*[F.sum(n).cast("double" if heavy else "bigint").alias(n) for n in names])


def ks_two_sample(x: DataFrame, y: DataFrame, col: str, within: Sequence[str] = ()) -> DataFrame:
    """(within, ks_statistic, n_x, n_y): the largest gap between the two
    distribution functions, for groups that both sides have."""
    counts = running(value_counts({"x": x, "y": y}, col, within), "v", ["x", "y"], within)
    totals = counts.groupBy(*within).agg(F.sum("x").alias("n_x"), F.sum("y").alias("n_y")).filter("n_x > 0 and n_y > 0")
    if within:
        totals = totals.withColumnsRenamed({k: f"__{k}" for k in within})
        both = counts.join(totals, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in within]).drop(*[f"__{k}" for k in within])
    else:
        both = counts.join(totals)
    gap = F.abs(F.col("run_x") / F.col("n_x") - F.col("run_y") / F.col("n_y"))
    return both.groupBy(*within, "n_x", "n_y").agg(F.max(gap).alias("ks_statistic")).select(*within, "ks_statistic", "n_x", "n_y")


def ks_p_value(statistic: float, n_x: int, n_y: int) -> float:
    return kolmogorov_sf(statistic * (n_x * n_y / (n_x + n_y)) ** 0.5)


def ks_p_column(statistic: Column, n_x: Column, n_y: Column) -> Column:
    """The same p-value as an expression."""
    x = statistic * F.sqrt(n_x * n_y / (n_x + n_y))
    steps = lambda n: F.sequence(F.lit(1), F.lit(n))
    small = F.aggregate(steps(39), F.lit(0.0), lambda s, k: s + F.exp(-F.pow(2 * k - 1, F.lit(2)) * math.pi**2 / (8 * x * x)))
    large = F.aggregate(steps(100), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    dual = 1 - math.sqrt(2 * math.pi) / x * small
    return F.when(x <= 0, 1.0).when(x < 1, dual).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * large)))


def average_ranks(df: DataFrame, col: str, within: Sequence[str] = ()) -> DataFrame:
    """(within, v, n, rank): the average rank of every distinct value."""
    counts = running(value_counts({"n": df}, col, within), "v", ["n"], within)
    return counts.select(*within, "v", "n", (F.col("run_n") - (F.col("n") - 1) / 2).alias("rank"))


def auc(positives: DataFrame, negatives: DataFrame, col: str) -> DataFrame:
    """Probability that a positive scores above a negative, ties one half."""
    counts = running(value_counts({"p": positives, "n": negatives}, col), "v", ["n"])
    u = F.sum(F.col("p") * (F.col("run_n") - F.col("n") / 2))
    return counts.agg((u / (F.sum("p") * F.sum("n"))).alias("auc"))


def signed_rank_p(diffs: DataFrame, col: str, alternative: str = "less") -> float:
    """Paired Wilcoxon test by the normal approximation with continuity and tie
    corrections; zeros are dropped; 1 without differences."""
    d = diffs.select(F.round(F.col(col), 12).alias("d")).filter("d <> 0")
    ties = d.groupBy(F.abs("d").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running(ties, "v", ["n"]).withColumn("rank", F.col("run_n") - (F.col("n") - 1) / 2)
    row = ranked.agg(
        F.sum(F.col("up") * F.col("rank")).alias("v"), F.sum("n").alias("n"), F.sum(F.pow("n", 3) - F.col("n")).alias("t")
    ).first()
    if not row.n:
        return 1.0
    mean, var = row.n * (row.n + 1) / 4, row.n * (row.n + 1) * (2 * row.n + 1) / 24 - row.t / 48
    if var <= 0:
        return 1.0
    if alternative == "less":
        return norm_cdf((row.v - mean + 0.5) / var**0.5)
    return 1 - norm_cdf((row.v - mean - 0.5) / var**0.5)
