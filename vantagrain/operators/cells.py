"""Frequencies of categories and of their combinations, on both sides."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.special import chi2_sf
from .common import MeasureResult, complete, key_join, safe_div


def cells(x: DataFrame, y: DataFrame, cols: Sequence[str], weight_x: str | None = None, weight_y: str | None = None) -> DataFrame:
    """(cols, o, r): counts or weight sums of each combination on both sides,
    zeros filled, over combinations that occur on either."""

    def side(df: DataFrame, weight: str | None, name: str) -> DataFrame:
        amount = F.sum(weight) if weight else F.count(F.lit(1))
        return df.groupBy(*cols).agg(amount.cast("double").alias(name))

    both = side(x, weight_x, "o").withColumn("r", F.lit(0.0)).unionByName(side(y, weight_y, "r").withColumn("o", F.lit(0.0)))
    return both.groupBy(*cols).agg(F.sum("o").alias("o"), F.sum("r").alias("r"))


def long_values(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """(var, level), with a weight also _w: a row for each value of each column;
    nulls, and rows without a weight, are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("var"), F.col(c).cast("string").alias("level")) for c in cols]))
    if not weight:
        return df.select(pairs.alias("p")).select("p.var", "p.level").filter("level is not null")
    return df.select(pairs.alias("p"), F.col(weight).alias("_w")).select("p.var", "p.level", "_w").filter("level is not null and _w is not null")


def hellinger(x: DataFrame, y: DataFrame, cols: Sequence[str], *, weight_x: str | None = None, weight_y: str | None = None) -> MeasureResult:
    """Hellinger distance of every categorical variable, in one pass over each
    side; a row counts as its weight says."""
    both = cells(long_values(x, cols, weight_x), long_values(y, cols, weight_y), ["var", "level"], "_w" if weight_x else None, "_w" if weight_y else None)
    totals = both.groupBy("var").agg(F.sum("o").alias("no"), F.sum("r").alias("nr"))
    gap = F.sqrt(F.col("o") / F.col("no")) - F.sqrt(F.col("r") / F.col("nr"))
    per = key_join(both, totals, ["var"], "inner").groupBy("var").agg(
        (F.sqrt(F.sum(gap * gap)) / math.sqrt(2)).alias("hellinger"), F.count_if(F.col("o") > 0).alias("n_levels_x"), F.count_if(F.col("r") > 0).alias("n_levels_y")
    )
    summary = per.agg(
        F.avg("hellinger").alias("hellinger_mean"), F.max("hellinger").alias("hellinger_max"), F.min("hellinger").alias("hellinger_min"),
        F.count(F.lit(1)).alias("n_vars"), (1 - F.avg("hellinger")).alias("utility_score"),
    )
    return MeasureResult(summary, groups=per)


def contingency_fidelity(x: DataFrame, y: DataFrame, cols: Sequence[str]) -> MeasureResult:
    """Total variation of all two-way tables; all pairs are counted in one pass."""

    def pairs(df: DataFrame) -> DataFrame:
        every = [
            F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(a).cast("string").alias("l1"), F.col(b).cast("string").alias("l2"))
            for a, b in combinations(cols, 2)
        ]
        return df.select(F.explode(F.array(*every)).alias("p")).select("p.*").filter("l1 is not null and l2 is not null")

    both = cells(pairs(x), pairs(y), ["var1", "var2", "l1", "l2"])
    totals = both.groupBy("var1", "var2").agg(F.sum("o").alias("no"), F.sum("r").alias("nr"))
    per = key_join(both, totals, ["var1", "var2"], "inner").groupBy("var1", "var2").agg(
        (0.5 * F.sum(F.abs(F.col("o") / F.col("no") - F.col("r") / F.col("nr")))).alias("tv"),
        F.count_distinct("l1").alias("k1"), F.count_distinct("l2").alias("k2"),
    )
    per = per.withColumn("tv", F.when((F.col("k1") > 1) & (F.col("k2") > 1), F.col("tv"))).drop("k1", "k2")
    summary = per.agg(F.avg("tv").alias("mean_tv"), (1 - F.avg("tv")).alias("utility_score"), F.count(F.lit(1)).alias("n_pairs"))
    return MeasureResult(summary, groups=per)


def chisq_utility(x: DataFrame, y: DataFrame, cols: Sequence[str], *, weight_x: str | None = None, weight_y: str | None = None, eps: float = 1e-10) -> MeasureResult:
    """Chi-square and related distances of the joint table.

    Cells that are empty on both sides are counted, not made: they add nothing
    but to the smoothed divergence, for which their number is enough.
    """
    x, y = complete(x, cols), complete(y, cols)
    both = cells(x, y, cols, weight_x, weight_y)
    levels = x.select(*cols).unionByName(y.select(*cols)).agg(*[F.count_distinct(c).alias(f"k{n}") for n, c in enumerate(cols)]).first()
    grid = math.prod(int(v) for v in levels)
    totals = both.agg(F.sum("o").alias("no"), F.sum("r").alias("nr"))
    px, py = F.col("o") / F.col("no"), F.col("r") / F.col("nr")
    e = F.greatest(px * F.col("nr"), F.lit(eps))
    a, b = px + eps, py + eps
    mid = (a + b) / 2
    js = 0.5 * a * F.log(a / mid) + 0.5 * b * F.log(b / mid)
    found = both.join(totals).agg(
        F.sum(F.pow(F.col("r") - e, 2) / e).alias("chi2"), (F.count_if(F.col("o") > 0) - 1).alias("df"),
        (4 * F.sum(F.pow(F.sqrt("r") - F.sqrt(e), 2))).alias("ft"),
        (2 * F.sum(F.when(F.col("r") > 0, F.col("r") * F.log(F.col("r") / e)).otherwise(0.0))).alias("g"),
        F.sum(js).alias("jsd"), F.count(F.lit(1)).alias("n_filled"), F.count_if(F.col("o") == 0).alias("e_o"),
        F.count_if(F.col("r") == 0).alias("e_r"), F.first("no").alias("n_orig"), F.first("nr").alias("n_synth"),
    )
    vw = (F.col("chi2") - F.col("df")) / F.col("n_synth")
    empty = F.lit(grid) - F.col("n_filled")
    summary = found.select(
        "chi2", "df", vw.alias("vw"), F.col("ft"), "g", "jsd", F.lit(grid).cast("bigint").alias("n_cells"),
        (F.col("e_o") + empty).alias("n_empty_orig"), (F.col("e_r") + empty).alias("n_empty_synth"),
        (100 * F.exp(-10 * F.abs(vw))).alias("pct_utility"), "n_orig", "n_synth",
    )
    return MeasureResult(summary, groups=both)


def chisq_p_value(summary: DataFrame) -> float:
    row = summary.first()
    return chi2_sf(row.chi2, row.df) if row.df > 0 else 1.0


def chisq_gof(x: DataFrame, y: DataFrame, col: str, group: Sequence[str] = (), *, weight_x: str | None = None, weight_y: str | None = None) -> DataFrame:
    """Goodness of fit of released (weighted) counts to original proportions, by group.

    Levels that the original lacks in a group are left out, as their expected
    count is zero.
    """
    both = cells(complete(x, [col, *group]), complete(y, [col, *group]), [*group, col], weight_x, weight_y).filter("o > 0")
    one = [*group] or ["_all"]
    both = both if group else both.withColumn("_all", F.lit(1))
    totals = both.groupBy(*one).agg(F.sum("o").alias("no"), F.sum("r").alias("nr"), F.count(F.lit(1)).alias("k"))
    e = F.col("o") / F.col("no") * F.col("nr")
    out = key_join(both, totals, one, "inner").filter("nr > 0").groupBy(*one, "k", "nr").agg(F.sum(F.pow(F.col("r") - e, 2) / e).alias("chi_sq_statistic"))
    v = F.when(F.col("k") > 1, F.sqrt(F.col("chi_sq_statistic") / (F.col("nr") * (F.col("k") - 1))))
    return out.select(*group, "chi_sq_statistic", (F.col("k") - 1).alias("df"), v.alias("cramers_v"))


def chisq_gof_simulated(x: DataFrame, y: DataFrame, col: str, group: Sequence[str] = (), *, rounds: int = 2000, seed: int = 1, weight_x: str | None = None, weight_y: str | None = None) -> DataFrame:
    """(group, chi_sq_statistic, p_value): the share of ``rounds`` multinomial
    draws from the original proportions with at least that statistic.  A task
    holds the levels of a group."""
    both = cells(complete(x, [col, *group]), complete(y, [col, *group]), [*group, col], weight_x, weight_y).filter("o > 0")
    one = [*group] or ["_all"]
    both = both if group else both.withColumn("_all", F.lit(1))
    kinds = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in one)

    def run(key: tuple, levels: pd.DataFrame) -> pd.DataFrame:
        levels = levels.sort_values(col)
        share, seen = levels["o"].to_numpy() / levels["o"].sum(), levels["r"].to_numpy()
        n = int(round(seen.sum()))
        expected = share * seen.sum()
        found = float(((seen - expected) ** 2 / expected).sum()) if n else 0.0
        drawn = np.random.default_rng(seed).multinomial(n, share, rounds)
        null = ((drawn - share * n) ** 2 / (share * n)).sum(axis=1) if n else np.zeros(rounds)
        return pd.DataFrame([[*key, found, (1 + int((null >= found - 1e-9).sum())) / (1 + rounds)]], columns=[*one, "chi_sq_statistic", "p_value"])

    out = both.groupBy(*one).applyInPandas(run, f"{kinds}, chi_sq_statistic double, p_value double")
    return out.select(*group, "chi_sq_statistic", "p_value")


def total_variation(x: DataFrame, y: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, tv) of a nominal variable, for groups that both sides have."""
    both = cells(complete(x, [col, *group]), complete(y, [col, *group]), [*group, col])
    one = [*group] or ["_all"]
    both = both if group else both.withColumn("_all", F.lit(1))
    totals = both.groupBy(*one).agg(F.sum("o").alias("no"), F.sum("r").alias("nr")).filter("no > 0 and nr > 0")
    gap = F.abs(F.col("o") / F.col("no") - F.col("r") / F.col("nr"))
    return key_join(both, totals, one, "inner").groupBy(*one).agg((0.5 * F.sum(gap)).alias("tv")).select(*group, "tv")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (v, n) from the two-way table; empty cells enter in closed form."""
    table = complete(df, [a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = table.groupBy(a).agg(F.sum("n").alias("na"))
    cols = table.groupBy(b).agg(F.sum("n").alias("nb"))
    sizes = table.agg(F.sum("n").alias("n_all"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    both = key_join(key_join(table, rows, [a], "inner"), cols, [b], "inner").join(F.broadcast(sizes))
    # sum of (n - e)^2 / e over all cells equals sum of n^2 / e over filled ones, minus n
    found = both.groupBy("n_all", "ka", "kb").agg(F.sum(F.col("n") * F.col("n") * F.col("n_all") / (F.col("na") * F.col("nb"))).alias("s"))
    chi2 = F.col("s") - F.col("n_all")
    least = F.least("ka", "kb") - 1
    return found.select(F.when(least > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.col("n_all") * least))).alias("v"), F.col("n_all").alias("n"))


def saturated_pmse(x: DataFrame, y: DataFrame, cols: Sequence[str]) -> MeasureResult:
    """Propensity mean squared error of the saturated logit over categories.

    Its fitted probability is the released share of each cell, so no fit is
    needed: a cell's rows share one probability.
    """
    both = cells(complete(x, cols), complete(y, cols), cols)
    totals = both.agg(F.sum("o").alias("no"), F.sum("r").alias("nr"), F.count(F.lit(1)).alias("k"))
    n = F.col("o") + F.col("r")
    p = F.col("r") / n
    c = F.col("nr") / (F.col("no") + F.col("nr"))
    right = F.when(p > 0.5, F.col("r")).when(p < 0.5, F.col("o")).otherwise(n / 2)
    found = both.join(totals).agg(
        (F.sum(n * F.pow(p - c, 2)) / F.sum(n)).alias("pmse"), (F.sum(right) / F.sum(n)).alias("po50"),
        F.first("k").alias("k"), F.first(c).alias("c"), F.sum(n).alias("n"),
    )
    null = (F.col("k") - 1) * F.pow(1 - F.col("c"), 2) * F.col("c") / F.col("n")
    sd = F.sqrt(2 * (F.col("k") - 1) * F.pow(1 - F.col("c"), 4) * F.col("c") * F.col("c")) / F.col("n")
    summary = found.select(
        "pmse", null.alias("pmse_null"), safe_div(F.col("pmse"), null).alias("pmse_ratio"),
        safe_div(F.col("pmse") - null, sd).alias("s_pmse"), (100 * F.col("po50")).alias("po50"), "c", F.col("k").alias("k"), F.col("n").alias("n"),
    )
    return MeasureResult(summary, groups=both)


def missing_values(x: DataFrame, y: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(var, n_missing_x, prop_missing_x, n_missing_y, prop_missing_y)."""

    def side(df: DataFrame, s: str) -> DataFrame:
        one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{k}") for k, c in enumerate(cols)])
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("var"), F.col(f"m{k}").alias("m"), F.col("n").alias("n")) for k, c in enumerate(cols)]))
        return one.select(rows.alias("p")).select("p.var", F.col("p.m").alias(f"n_missing_{s}"), safe_div(F.col("p.m"), F.col("p.n")).alias(f"prop_missing_{s}"))

    return side(x, "x").join(side(y, "y"), "var")


def missing_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(pattern, n): M for missing and O for observed, in the order of ``cols``."""
    flags = F.concat(*[F.when(F.col(c).isNull(), "M").otherwise("O") for c in cols])
    return df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, cols: Sequence[str], name: str = "p") -> DataFrame:
    """(cols, name): relative frequency of every combination."""
    counts = complete(df, cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("n_all")))).select(*cols, (F.col("n") / F.col("n_all")).alias(name))

