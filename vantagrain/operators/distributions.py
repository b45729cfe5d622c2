"""Distances between numeric distributions and summary statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import t_ppf
from .cells import cells, cramers_v, total_variation
from .common import MeasureResult, complete, group_quantiles, key_join, quantiles, safe_div, scalar_row
from .ranks import average_ranks, ks_p_column, ks_two_sample, running, value_counts


def compare_ks(x: DataFrame, y: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Two-sample KS statistic and its asymptotic p-value, by group."""
    found = ks_two_sample(x, y, col, group)
    return found.select(*group, "ks_statistic", ks_p_column(F.col("ks_statistic"), F.col("n_x"), F.col("n_y")).alias("p_value"))


def wasserstein(
    x: DataFrame, y: DataFrame, col: str, group: Sequence[str] = (), *, n_grid: int = 1000, weight_x: str | None = None, weight_y: str | None = None
) -> DataFrame:
    """(group, wasserstein): mean gap between (weighted) quantile functions on a grid."""
    grid = [k / (n_grid - 1) for k in range(n_grid)]
    sides = [group_quantiles(df, col, grid, group, weight=w).withColumnRenamed("q", f"q{n}") for n, (df, w) in enumerate(((x, weight_x), (y, weight_y)))]
    both = key_join(sides[0], sides[1], group, "inner") if group else sides[0].join(sides[1])  # a row a side
    gaps = F.zip_with("q0", "q1", lambda a, b: F.abs(a - b))
    return both.select(*group, (F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / n_grid).alias("wasserstein"))


def wasserstein_nominal(x: DataFrame, y: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    return total_variation(x, y, col, group).withColumnRenamed("tv", "wasserstein")


def ci_proximity(
    x: DataFrame, y: DataFrame, cols: Sequence[str], *, level: float = 0.95, weight_x: str | None = None, weight_y: str | None = None
) -> MeasureResult:
    """Overlap of the confidence intervals of means, per variable.

    With a weight the mean is weighted and the spread is the weighted mean
    square; n stays the number of rows with a value and a weight.
    """

    def side(df: DataFrame, weight: str | None) -> dict:
        if not weight:
            return df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))]).first().asDict()
        w = F.col(weight).cast("double")
        known = lambda c, e: F.when(F.col(c).isNotNull() & w.isNotNull(), e)
        means = df.agg(
            *[F.count(known(c, w)).alias(f"n_{c}") for c in cols],
            *[(F.sum(known(c, w * F.col(c))) / F.sum(known(c, w))).alias(f"m_{c}") for c in cols],
        ).first().asDict()
        spread = df.agg(*[F.sqrt(F.sum(known(c, w * F.pow(F.col(c) - F.lit(means[f"m_{c}"]), 2))) / F.sum(known(c, w))).alias(f"s_{c}") for c in cols]).first().asDict()
        return means | spread

    a, b = side(x, weight_x), side(y, weight_y)
    rows = []
    for c in cols:
        cis = []
        for r in (a, b):
            n, m, s = r[f"n_{c}"], r[f"m_{c}"], r[f"s_{c}"] or 0.0
            half = t_ppf(0.5 + level / 2, n - 1) * s / math.sqrt(n) if n > 1 else 0.0
            cis.append((m - half, m + half, m, s))
        (l1, u1, m1, s1), (l2, u2, m2, s2) = cis
        union = max(u1, u2) - min(l1, l2)
        overlap = max(0.0, min(u1, u2) - max(l1, l2)) / union if union > 0 else float(m1 == m2)
        pooled = math.sqrt((s1 * s1 + s2 * s2) / 2)
        error = abs(m1 - m2) / abs(m1) if abs(m1) > 1e-10 else (abs(m1 - m2) / pooled if pooled else 0.0)
        accuracy = 1 / (1 + error)
        rows.append((c, m1, m2, l1, u1, l2, u2, overlap, error, (overlap + accuracy) / 2, l2 <= m1 <= u2))
    per = x.sparkSession.createDataFrame(
        rows, "variable string, mean_x double, mean_y double, lower_x double, upper_x double, lower_y double, upper_y double, "
        "overlap double, relative_error double, proximity double, contains_orig_mean boolean",
    )
    summary = per.agg(
        F.avg("proximity").alias("proximity_mean"), F.avg("overlap").alias("overlap_mean"), F.avg("relative_error").alias("relative_error_mean"),
        (100 * F.avg(F.col("contains_orig_mean").cast("int"))).alias("pct_containing_orig_mean"),
    )
    return MeasureResult(summary, groups=per)


def moments(df: DataFrame, cols: Sequence[str], group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(group, variable, n, mean, sd, median, iqr, skewness, kurtosis) per variable.

    Weighted: mean, sd (with sum of weights less one) and the weighted median
    (the least value at which half of the weight is reached).  Skewness and
    excess kurtosis standardise with that sd.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in cols]))
    rows = df.select(*group, w.alias("w"), pairs.alias("p")).select(*group, "w", "p.variable", "p.v").filter("v is not null and w is not null")
    keys = [*group, "variable"]
    s = lambda k: F.sum(F.col("w") * F.pow("v", k))
    first = rows.groupBy(*keys).agg(F.sum("w").alias("n"), (s(1) / F.sum("w")).alias("mean"))
    first = key_join(first, group_quantiles(rows, "v", [0.25, 0.5, 0.75], keys), keys, "inner", na_rm=False)
    centred = key_join(rows, first.select(*keys, "mean"), keys, "inner").withColumn("d", F.col("v") - F.col("mean"))
    m = lambda k: F.sum(F.col("w") * F.pow("d", k))
    second = centred.groupBy(*keys).agg(m(2).alias("m2"), m(3).alias("m3"), m(4).alias("m4"))
    both = key_join(first, second, keys, "inner")
    sd = F.sqrt(F.col("m2") / (F.col("n") - 1))
    if weight:
        order = Window.partitionBy(*keys).orderBy("v")
        values = rows.groupBy(*keys, "v").agg(F.sum("w").alias("w"))
        half = key_join(values.withColumn("r", F.sum("w").over(order)), first.select(*keys, "n"), keys, "inner")
        med = half.filter(F.col("r") >= 0.5 * F.col("n")).groupBy(*keys).agg(F.min("v").alias("median"))
        both = key_join(both, med, keys, "inner")
    else:
        both = both.withColumn("median", F.col("q")[1])
    return both.select(
        *keys, "n", "mean", sd.alias("sd"), "median", (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
        (F.col("m3") / F.col("n") / F.pow(sd, 3)).alias("skewness"), (F.col("m4") / F.col("n") / F.pow(sd, 4) - 3).alias("kurtosis"),
    )


def median_absolute_deviation(df: DataFrame, col: str) -> float:
    med = quantiles(df, col, [0.5])
    return 1.4826 * quantiles(df.select(F.abs(F.col(col) - med[0]).alias("d")), "d", [0.5])[0] if med else float("nan")


def group_deviation(df: DataFrame, col: str, group: Sequence[str]) -> DataFrame:
    """(group, median, mad): the median and the scaled median absolute deviation of each group."""
    median = group_quantiles(df, col, [0.5], group).select(*group, F.col("q")[0].alias("median"))
    gaps = key_join(df.select(*group, F.col(col).cast("double").alias("_v")), median, group, "inner", na_rm=False)
    spread = group_quantiles(gaps.withColumn("_d", F.abs(F.col("_v") - F.col("median"))), "_d", [0.5], group)
    return key_join(median, spread.select(*group, (1.4826 * F.col("q")[0]).alias("mad")), group, "inner", na_rm=False)


def huber(df: DataFrame, col: str, *, k: float = 1.5, tol: float = 1e-6, max_iter: int = 50) -> float:
    """Huber's M-estimate of location: a sum and a count over all rows a round."""
    mad = median_absolute_deviation(df, col)
    mu = quantiles(df, col, [0.5])[0]
    if not mad:
        return mu
    for _ in range(max_iter):
        clipped = F.greatest(F.lit(mu - k * mad), F.least(F.lit(mu + k * mad), F.col(col)))
        new = df.agg(F.avg(clipped)).first()[0]
        if abs(new - mu) < tol * mad:
            return new
        mu = new
    return mu


def means_frequencies(x: DataFrame, y: DataFrame, cont: Sequence[str], cat: Sequence[str], group: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Moments of both sides, and counts and shares of categories of both sides."""
    means = moments(x, cont, group).withColumn("side", F.lit("x")).unionByName(moments(y, cont, group).withColumn("side", F.lit("y")))
    from .cells import long_values

    both = cells(long_values(x, cat), long_values(y, cat), ["var", "level"])
    totals = both.groupBy("var").agg(F.sum("o").alias("no"), F.sum("r").alias("nr"))
    freq = key_join(both, totals, ["var"], "inner").select(
        "var", "level", "o", "r", (F.col("o") / F.col("no")).alias("share_x"), (F.col("r") / F.col("nr")).alias("share_y")
    )
    return means, freq


def pairwise(df: DataFrame, cols: Sequence[str], how: str = "corr") -> DataFrame:
    """(var1, var2, value) over all pairs, in one pass; pairwise complete."""
    f = {"corr": F.corr, "cov": F.covar_samp}[how]
    pairs = list(combinations(cols, 2))
    row = df.agg(*[f(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{n}") for n, (a, b) in enumerate(pairs)])
    out = F.explode(F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"c{n}").alias("value")) for n, (a, b) in enumerate(pairs)]))
    return row.select(out.alias("p")).select("p.*")


def with_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns replaced by average ranks, each over its own values."""
    out = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    for c in cols:
        ranks = average_ranks(out, c).select(F.col("v").alias("__v"), F.col("rank").alias("__r"))
        out = out.join(ranks, F.col(c) == F.col("__v"), "left").drop(c, "__v").withColumnRenamed("__r", c)
    return out


def correlation_ratio(df: DataFrame, cat: str, num: str) -> DataFrame:
    """One row (eta): root of the between-group share of the sum of squares."""
    per = complete(df, [cat, num]).groupBy(cat).agg(F.count(F.lit(1)).alias("n"), F.avg(num).alias("m"), F.var_pop(F.col(num).cast("double")).alias("v"))
    all_ = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    joined = per.join(F.broadcast(all_)).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w")
    )
    return joined.select(F.sqrt(safe_div(F.col("b"), F.col("b") + F.col("w"))).alias("eta"))


def correlation_matrices(x: DataFrame, y: DataFrame, cols: Sequence[str], method: str = "pearson") -> MeasureResult:
    """Correlations on both sides and how far apart they are."""
    x, y = (with_ranks(d, cols) if method == "spearman" else d for d in (x, y))
    both = key_join(pairwise(x, cols).withColumnRenamed("value", "corr_x"), pairwise(y, cols).withColumnRenamed("value", "corr_y"), ["var1", "var2"], "inner")
    per = both.withColumn("diff", F.abs(F.col("corr_x") - F.col("corr_y")))
    summary = per.agg(
        F.avg("diff").alias("mean_diff"), F.max("diff").alias("max_diff"), F.median("diff").alias("median_diff"),
        F.sqrt(2 * F.sum(F.pow("diff", 2))).alias("frobenius"),
    )
    return MeasureResult(summary, groups=per)


def mixed_associations(x: DataFrame, y: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """(var1, var2, assoc_x, assoc_y): Cramer's V and correlation ratios."""
    out = None
    for a, b in [*combinations(cat, 2), *((c, n) for c in cat for n in num)]:
        f = (lambda d, a=a, b=b: cramers_v(d, a, b).select(F.col("v").alias("s"))) if b in cat else (lambda d, a=a, b=b: correlation_ratio(d, a, b).select(F.col("eta").alias("s")))
        one = f(x).withColumnRenamed("s", "assoc_x").join(f(y).withColumnRenamed("s", "assoc_y"))
        one = one.select(F.lit(a).alias("var1"), F.lit(b).alias("var2"), "assoc_x", "assoc_y")
        out = one if out is None else out.unionByName(one)
    return out


def weighted_covariance(df: DataFrame, cols: Sequence[str], weight: str) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means and covariance, over the sum of weights less one; rows with
    a null are left out."""
    rows = complete(df, [*cols, weight])
    w, c = F.col(weight).cast("double"), [F.col(k).cast("double") for k in cols]
    first = rows.agg(F.sum(w).alias("w"), *[(F.sum(w * v) / F.sum(w)).alias(f"m{i}") for i, v in enumerate(c)]).first()
    mean = np.array([first[f"m{i}"] for i in range(len(c))], float)
    d = [v - float(m) for v, m in zip(c, mean, strict=True)]
    row = rows.agg(*[F.sum(w * d[i] * d[j]).alias(f"c{i}_{j}") for i in range(len(c)) for j in range(i, len(c))]).first()
    cov = np.zeros((len(c), len(c)))
    for i in range(len(c)):
        for j in range(i, len(c)):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] / (first.w - 1)
    return mean, cov


def multivariate_statistics(x: DataFrame, y: DataFrame, cols: Sequence[str], *, weight_x: str | None = None, weight_y: str | None = None) -> DataFrame:
    """(var1, var2, cov_x, cov_y, cov_diff, cor_x, cor_y, cor_diff); without
    weights pairwise complete, with weights over complete rows."""
    parts = []
    for s, d, w in (("x", x, weight_x), ("y", y, weight_y)):
        if w:
            _, cov = weighted_covariance(d, cols, w)
            rows = [(a, b, float(cov[i, j]), float(cov[i, j] / math.sqrt(cov[i, i] * cov[j, j])) if cov[i, i] * cov[j, j] > 0 else None) for (i, a), (j, b) in combinations(enumerate(cols), 2)]
            both = x.sparkSession.createDataFrame(rows, f"var1 string, var2 string, cov_{s} double, cor_{s} double")
            parts += [both.drop(f"cor_{s}"), both.drop(f"cov_{s}")]
            continue
        parts.append(pairwise(d, cols, "cov").withColumnRenamed("value", f"cov_{s}"))
        parts.append(pairwise(d, cols, "corr").withColumnRenamed("value", f"cor_{s}"))
    out = parts[0]
    for p in parts[1:]:
        out = key_join(out, p, ["var1", "var2"], "inner")
    return out.withColumns({"cov_diff": F.col("cov_x") - F.col("cov_y"), "cor_diff": F.col("cor_x") - F.col("cor_y")})


def covariance(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, covariance matrix and count: sums of p * p numbers in one pass."""
    rows = complete(df, cols)
    p = len(cols)
    c = [F.col(k).cast("double") for k in cols]
    row = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{i}") for i, a in enumerate(c)],
        *[F.covar_samp(c[i], c[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)],
    ).first()
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] if row[f"c{i}_{j}"] is not None else 0.0
    return np.array([row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(p)]), cov, row.n


def mahalanobis_between(x: DataFrame, y: DataFrame, cols: Sequence[str]) -> float:
    """Mahalanobis distance of the mean vectors under the pooled covariance."""
    (m1, c1, n1), (m2, c2, n2) = covariance(x, cols), covariance(y, cols)
    pooled = ((n1 - 1) * c1 + (n2 - 1) * c2) / max(1, n1 + n2 - 2)
    d = m1 - m2
    return float(math.sqrt(max(0.0, d @ np.linalg.pinv(pooled) @ d)))


def outliers(df: DataFrame, cols: Sequence[str], *, method: str = "zscore", threshold: float | None = None) -> DataFrame:
    """(variable, n_outliers, pct_outliers) by z-scores or quartile fences."""
    rows = []
    for c in cols:
        if method == "zscore":
            m, s = df.agg(F.avg(c), F.stddev_samp(c)).first()
            rows.append((c, m - (threshold or 3.0) * (s or 0), m + (threshold or 3.0) * (s or 0)))
        else:
            q1, q3 = quantiles(df, c, [0.25, 0.75])
            rows.append((c, q1 - (threshold or 1.5) * (q3 - q1), q3 + (threshold or 1.5) * (q3 - q1)))
    counts = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"o{k}") for k, (c, lo, hi) in enumerate(rows)], *[F.count(c).alias(f"n{k}") for k, (c, *_) in enumerate(rows)])
    out = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"o{k}").alias("n_outliers"), (100 * F.col(f"o{k}") / F.col(f"n{k}")).alias("pct_outliers")) for k, (c, *_) in enumerate(rows)]))
    return counts.select(out.alias("p")).select("p.*")


def compare_outliers(x: DataFrame, y: DataFrame, cols: Sequence[str], **params) -> DataFrame:
    a, b = (outliers(d, cols, **params).withColumnsRenamed({"n_outliers": f"n_outliers_{s}", "pct_outliers": f"pct_outliers_{s}"}) for s, d in (("x", x), ("y", y)))
    return key_join(a, b, ["variable"], "inner")


def density_histogram(x: DataFrame, y: DataFrame, col: str, *, bins: int = 30, group: Sequence[str] = ()) -> DataFrame:
    """(group, bin, lower, upper, density_x, density_y) on common equal-width bins."""
    low, high = x.select(col).unionByName(y.select(col)).agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    width = (high - low) / bins or 1.0
    place = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col(col) - low) / width))).cast("int").alias("bin")
    both = cells(x.filter(F.col(col).isNotNull()).select(*group, place), y.filter(F.col(col).isNotNull()).select(*group, place), [*group, "bin"])
    one = [*group] or ["_all"]
    both = both if group else both.withColumn("_all", F.lit(1))
    totals = both.groupBy(*one).agg(F.sum("o").alias("no"), F.sum("r").alias("nr"))
    lower = low + (F.col("bin") - 1) * width
    return key_join(both, totals, one, "inner").select(
        *group, "bin", lower.alias("lower"), (lower + width).alias("upper"),
        F.coalesce(safe_div(F.col("o"), F.col("no") * width), F.lit(0.0)).alias("density_x"), F.coalesce(safe_div(F.col("r"), F.col("nr") * width), F.lit(0.0)).alias("density_y"),
    )


def boxplot_stats(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, lower_whisker, q1, median, q3, upper_whisker, n_out)."""
    one = [*group] or ["_all"]
    rows = (df if group else df.withColumn("_all", F.lit(1))).filter(F.col(col).isNotNull())
    q = group_quantiles(rows, col, (0.25, 0.5, 0.75), one)
    joined = key_join(rows.select(*one, F.col(col).alias("v")), q, one, "inner")
    q1, q3 = F.col("q")[0], F.col("q")[2]
    inside = F.col("v").between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    out = joined.groupBy(*one, "q").agg(
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"), F.max(F.when(inside, F.col("v"))).alias("upper_whisker"), F.count_if(~inside).alias("n_out")
    )
    return out.select(*group, "lower_whisker", q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"), "upper_whisker", "n_out")


def ecdf_table(x: DataFrame, y: DataFrame, col: str, group: Sequence[str] = (), *, weight_x: str | None = None, weight_y: str | None = None) -> DataFrame:
    """(group, v, ecdf_x, ecdf_y), weighted if weights are given, at every pooled
    value; null without rows."""
    one = [*group] or ["_all"]
    x, y = (x, y) if group else (d.withColumn("_all", F.lit(1)) for d in (x, y))
    sums = value_counts({"x": x, "y": y}, col, one, {"x": weight_x, "y": weight_y})
    counts = running(sums, "v", ["x", "y"], one)
    totals = counts.groupBy(*one).agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    both = key_join(counts, totals, one, "inner")
    return both.select(*group, "v", safe_div(F.col("run_x"), F.col("nx")).alias("ecdf_x"), safe_div(F.col("run_y"), F.col("ny")).alias("ecdf_y"))


def copula_fidelity(x: DataFrame, y: DataFrame, cols: Sequence[str], *, n_grid: int = 50) -> MeasureResult:
    """Mean squared gap of the bivariate empirical copulas on a grid, per pair.

    Ranks fall into n_grid steps; two-way counts of steps (n_grid squared at
    most) are accumulated along both axes.
    """
    per = None
    sides = []
    for d in (x, y):
        rows = complete(d, cols)
        n = rows.count()
        ranked = with_ranks(rows, cols)
        steps = [F.greatest(F.lit(1), F.ceil(F.round(F.col(c) / (n + 1) * n_grid, 9))).cast("int").alias(c) for c in cols]
        sides.append((ranked.select(*steps), n))
    axis = x.sparkSession.range(1, n_grid + 1).select(F.col("id").cast("int").alias("g"))
    grid = axis.select(F.col("g").alias("i")).join(axis.select(F.col("g").alias("j")))  # n_grid squared rows
    for a, b in combinations(cols, 2):
        tables = []
        for k, (d, n) in enumerate(sides):
            counts = d.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count(F.lit(1)).alias("n"))
            full = key_join(grid, counts, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
            rows_sum = F.sum("n").over(Window.partitionBy("i").orderBy("j"))
            both_sum = F.sum("r").over(Window.partitionBy("j").orderBy("i"))
            tables.append(full.withColumn("r", rows_sum).withColumn(f"c{k}", both_sum / n).select("i", "j", f"c{k}"))
        gap = key_join(tables[0], tables[1], ["i", "j"], "inner").agg(F.avg(F.pow(F.col("c0") - F.col("c1"), 2)).alias("cvm"))
        one = gap.select(F.lit(a).alias("var1"), F.lit(b).alias("var2"), "cvm")
        per = one if per is None else per.unionByName(one)
    summary = per.agg(F.avg("cvm").alias("mean_cvm"), (1 / (1 + 100 * F.avg("cvm"))).alias("utility_score"))
    return MeasureResult(summary, groups=per)


def tail_fidelity(x: DataFrame, y: DataFrame, cols: Sequence[str], *, percentile: float = 95.0, tails: str = "both", n_probs: int = 50) -> MeasureResult:
    """Mean quantile gap in the tails, in units of the original's quartile range."""
    p = percentile / 100
    probs = []
    if tails in ("both", "upper"):
        probs += [p + (1 - p) * k / (n_probs - 1) for k in range(n_probs)]
    if tails in ("both", "lower"):
        probs += [(1 - p) * k / (n_probs - 1) for k in range(n_probs)]
    rows = []
    for c in cols:
        a, b = np.array(quantiles(x, c, probs)), np.array(quantiles(y, c, probs))
        q1, q3 = quantiles(x, c, [0.25, 0.75])
        scale = (q3 - q1) or x.agg(F.stddev_samp(c)).first()[0] or 1.0
        rows.append((c, float(np.mean(np.abs(a - b)) / scale)))
    per = x.sparkSession.createDataFrame(rows, "variable string, qq_divergence double")
    summary = per.agg(F.avg("qq_divergence").alias("qq_divergence"), F.exp(-F.avg("qq_divergence")).alias("utility_score"))
    return MeasureResult(summary, groups=per)


def hill_estimator(df: DataFrame, col: str, *, percentile: float = 95.0) -> float | None:
    """Tail index from the k largest of the upper tail, k the root of its size.

    The k + 1 largest values are found as a quantile; sums run over the rows
    above it, so no sorted tail is collected.
    """
    cut = quantiles(df, col, [percentile / 100])
    if not cut:
        return None
    tail = df.filter((F.col(col) > cut[0]) & (F.col(col) > 0))
    n = tail.count()
    k = int(math.sqrt(n))
    if k < 1 or n <= k:
        return None
    ranks = quantiles(tail, col, [(n - 1 - k) / (n - 1)])[0]
    row = tail.filter(F.col(col) > ranks).agg(F.sum(F.log(F.col(col) / ranks)).alias("s")).first()
    return k / row.s if row.s else None


def least_squares(df: DataFrame, predictors: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(coefficients, standard errors, n) of a linear fit with intercept, from the
    means and covariances of one pass over the complete rows."""
    mean, cov, n = covariance(df, [*predictors, y])
    p = len(predictors)
    sxx, sxy, syy = cov[:p, :p] * (n - 1), cov[:p, p] * (n - 1), cov[p, p] * (n - 1)
    inverse = np.linalg.pinv(sxx)
    slopes = inverse @ sxy
    s2 = max(0.0, syy - slopes @ sxy) / (n - p - 1) if n > p + 1 else 0.0
    m = mean[:p]
    errors = [math.sqrt(s2 * (1 / n + m @ inverse @ m)) if n else 0.0, *np.sqrt(s2 * np.diag(inverse))]
    return np.array([mean[p] - slopes @ m, *slopes]), np.array(errors), n


def regression_fidelity(a: DataFrame, b: DataFrame, x: str | Sequence[str], y: str, *, level: float = 0.95) -> MeasureResult:
    """A linear model fitted on both sides: bias, interval overlap and
    significance of each coefficient.  ``x`` names one or several numeric
    predictors."""
    names = [x] if isinstance(x, str) else list(x)
    fits = [least_squares(d, names, y) for d in (a, b)]
    rows = []
    for k, term in enumerate(["intercept", "slope"] if isinstance(x, str) else ["intercept", *names]):
        (e1, e2), (s1, s2) = (tuple(float(f[i][k]) for f in fits) for i in (0, 1))
        h1, h2 = (t_ppf(0.5 + level / 2, n - len(names) - 1) * s for (_, _, n), s in zip(fits, (s1, s2), strict=True))
        inter = max(0.0, min(e1 + h1, e2 + h2) - max(e1 - h1, e2 - h2))
        overlap = min(1.0, inter / (h1 + h2)) if h1 + h2 > 0 else float(e1 == e2)
        same = (abs(e1) > h1) == (abs(e2) > h2)
        rows.append((term, e1, e2, s1, s2, e2 - e1, (e2 - e1) / s1 if s1 else 0.0, overlap, same))
    per = a.sparkSession.createDataFrame(
        rows, "term string, estimate_x double, estimate_y double, se_x double, se_y double, bias double, std_bias double, ci_overlap double, sig_agree boolean"
    )
    summary = per.agg(
        F.avg("ci_overlap").alias("mean_ci_overlap"), F.avg(F.abs("std_bias")).alias("mean_abs_std_bias"),
        F.avg(F.col("sig_agree").cast("int")).alias("sig_agreement_rate"), F.count(F.lit(1)).alias("n_coef"),
    )
    return MeasureResult(summary, groups=per)


def one_row(df: DataFrame, **values) -> DataFrame:
    return scalar_row(df.sparkSession, **values)
