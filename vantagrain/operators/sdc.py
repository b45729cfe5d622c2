"""Privacy models on key equivalence classes of one table.

Every measure reduces the table to one row per class first; what follows works
on classes.  Rows with a null in a key are left out (``na_rm``) or form classes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.special import neg_binomial_pmf
from .common import MeasureResult, complete, is_numeric, key_join, quantiles
from .ranks import running


def classes(df: DataFrame, keys: Sequence[str], na_rm: bool = True) -> DataFrame:
    """(keys, f): the size of every equivalence class."""
    return complete(df, keys, na_rm).groupBy(*keys).agg(F.count(F.lit(1)).alias("f"))


def kanonymity(df: DataFrame, id_col: str, keys: Sequence[str], *, k: int = 5, na_rm: bool = True) -> MeasureResult:
    ec = classes(df, keys, na_rm)
    small = F.sum(F.when(F.col("f") < k, F.col("f")).otherwise(0))
    summary = ec.agg(
        F.min("f").alias("k_level"), (F.min("f") >= k).alias("satisfies_k"), small.alias("n_violating"),
        (100 * small / F.sum("f")).alias("pct_violating"), F.sum("f").alias("n_records"), F.count(F.lit(1)).alias("n_ec"),
        F.count_if(F.col("f") == 1).alias("n_unique"), (100 * F.count_if(F.col("f") == 1) / F.sum("f")).alias("pct_unique"),
        F.avg("f").alias("mean_ec_size"), F.median("f").alias("median_ec_size"),
    )
    sizes = ec.groupBy(F.when(F.col("f") >= 10, "10+").otherwise(F.col("f").cast("string")).alias("size")).agg(
        F.count(F.lit(1)).alias("n_ec"), F.sum("f").alias("n_records")
    )
    records = key_join(complete(df, keys, na_rm).select(id_col, *keys), ec.filter(F.col("f") < k), keys, "inner", na_rm)
    return MeasureResult(summary, records.select(id_col, "f"), sizes)


def ldiversity(df: DataFrame, keys: Sequence[str], sensitive: str, *, l: int = 2, c: float = 2.0, na_rm: bool = True) -> MeasureResult:  # noqa: E741
    """Distinct, entropy and recursive (c, l) diversity of every class."""
    cells = complete(df, [*keys, sensitive], na_rm).groupBy(*keys, sensitive).agg(F.count(F.lit(1)).alias("n"))
    ranked = cells.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), sensitive)))
    total = F.sum("n")
    per = ranked.groupBy(*keys).agg(
        total.alias("size"), F.count(F.lit(1)).alias("distinct_l"),
        (F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias("entropy"),
        F.max("n").alias("top"), F.sum(F.when(F.col("r") >= l, F.col("n")).otherwise(0)).alias("rest"),
    )
    per = per.withColumns({
        "entropy_l": F.exp("entropy"),
        "recursive_cl": (F.col("distinct_l") >= l) & (F.col("top") < c * F.col("rest")),
        "bad_distinct": F.col("distinct_l") < l,
        "bad_entropy": F.round("entropy", 9) < round(math.log(l), 9),
    })
    n = F.sum("size")
    summary = per.agg(
        F.min("distinct_l").alias("distinct_l"), F.min("entropy_l").alias("entropy_l"), F.every("recursive_cl").alias("recursive_cl"),
        F.sum(F.when(F.col("bad_distinct"), F.col("size")).otherwise(0)).alias("n_violating_distinct"),
        F.sum(F.when(F.col("bad_entropy"), F.col("size")).otherwise(0)).alias("n_violating_entropy"),
        n.alias("n_records"), F.count(F.lit(1)).alias("n_ec"), F.every(~F.col("bad_distinct")).alias("satisfies_distinct_l"),
        F.every(~F.col("bad_entropy")).alias("satisfies_entropy_l"),
    )
    return MeasureResult(summary, groups=per)


def tcloseness(df: DataFrame, keys: Sequence[str], sensitive: str, *, t: float = 0.2, na_rm: bool = True) -> MeasureResult:
    """Distance of each class's sensitive distribution from the table's.

    Categorical: total variation.  Numeric: mean absolute difference of the
    distribution functions over the m distinct values, divided by m - 1.  A
    numeric class is summed over the runs between its own values in closed form
    from the table's running sums, so no class-by-value grid is made.
    """
    rows = complete(df, [*keys, sensitive], na_rm)
    cells = rows.groupBy(*keys, sensitive).agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy(*keys).agg(F.sum("n").alias("size"))
    whole = cells.groupBy(sensitive).agg(F.sum("n").alias("big"))
    total = sizes.agg(F.sum("size").alias("total"))
    joined = key_join(cells, sizes, keys, "inner", na_rm)
    if not is_numeric(df, sensitive):
        both = key_join(joined, whole, [sensitive], "inner", na_rm).join(F.broadcast(total))
        p, q = F.col("n") / F.col("size"), F.col("big") / F.col("total")
        # values a class lacks add their whole share: 1 - sum of q over its own
        per = both.groupBy(*keys, "size").agg((0.5 * (F.sum(F.abs(p - q)) + 1 - F.sum(q))).alias("distance"))
    else:
        n_all = total.first().total
        grid = running(whole.select(F.col(sensitive).cast("double").alias("v"), "big", F.lit(1).alias("one")), "v", ["big", "one"])
        grid = grid.select("v", F.col("run_one").alias("i"), (F.col("run_big") / n_all).alias("cdf"))
        grid = running(grid, "v", ["cdf"]).select("v", "i", "cdf", F.col("run_cdf").alias("area"))
        m = grid.agg(F.max("i")).first()[0] or 0
        own = Window.partitionBy(*keys).orderBy(sensitive)
        steps = joined.withColumn("level", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)) / F.col("size"))
        spans = steps.join(grid.select("v", F.col("i").alias("a")), F.col(sensitive).cast("double") == F.col("v"))
        spans = spans.withColumns({"b": F.coalesce(F.lead("a").over(own), F.lit(m + 1)), "first": F.row_number().over(own) == 1})
        # runs [a, b) of value numbers on which the class's function is level
        spans = spans.select(*keys, "size", "level", "a", "b").unionByName(
            spans.filter("first and a > 1").select(*keys, "size", F.lit(0.0).alias("level"), F.lit(1).alias("a"), F.col("a").alias("b"))
        )
        # c: the value numbers up to c have a table function of at most the level
        marks = grid.select(F.col("cdf").alias("level"), F.lit(1).alias("one")).unionByName(spans.select("level", F.lit(0).alias("one")))
        under = running(marks.groupBy("level").agg(F.sum("one").alias("one")), "level", ["one"])
        spans = spans.join(under.select(F.col("level").alias("l2"), F.col("run_one").alias("c")), F.col("level") == F.col("l2"))
        spans = spans.withColumn("c", F.least(F.col("b"), F.greatest(F.col("a"), F.col("c") + 1)))
        for at in ("a", "b", "c"):  # area below the table's function before value number at
            areas = grid.select((F.col("i") + 1).alias("j"), F.col("area").alias(f"area_{at}"))
            spans = spans.join(areas, F.col(at) == F.col("j"), "left").drop("j").withColumn(f"area_{at}", F.coalesce(f"area_{at}", F.lit(0.0)))
        below = F.col("level") * (F.col("c") - F.col("a")) - (F.col("area_c") - F.col("area_a"))
        above = (F.col("area_b") - F.col("area_c")) - F.col("level") * (F.col("b") - F.col("c"))
        per = spans.groupBy(*keys, "size").agg((F.sum(below + above) / max(1, m - 1)).alias("distance"))
        if m <= 1:
            per = per.withColumn("distance", F.lit(0.0))
    bad = F.round("distance", 9) > t
    summary = per.agg(
        F.max("distance").alias("t_achieved"), F.sum(F.when(bad, F.col("size")).otherwise(0)).alias("n_violating"),
        F.sum("size").alias("n_records"), F.count(F.lit(1)).alias("n_ec"), F.every(~bad).alias("satisfies_t"),
    )
    return MeasureResult(summary.withColumn("pct_violating", 100 * F.col("n_violating") / F.col("n_records")), groups=per)


def suda(df: DataFrame, id_col: str, keys: Sequence[str], *, max_msu: int | None = None) -> MeasureResult:
    """Special uniques: minimal key subsets on which a record is unique.

    All subsets are counted in one grouping-sets pass over distinct key tuples;
    a tuple held by two rows is unique on no subset.  What is unique goes back
    to its tuple by a 128-bit hash of the keys, in one join.
    """
    p = len(keys)
    most = max_msu or p
    rows = complete(df, keys)
    whole = [F.xxhash64(*keys).alias("h1"), F.xxhash64(F.lit(1), *keys).alias("h2")]
    tuples = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("f")).select("*", *whole)
    subsets = [s for r in range(1, most + 1) for s in combinations(keys, r)]
    sizes = tuples.groupingSets([[F.col(c) for c in s] for s in subsets], *keys).agg(
        F.sum("f").alias("g"), F.min("h1").alias("h1"), F.min("h2").alias("h2"), F.grouping_id().alias("gid")
    )
    unique = sizes.filter("g = 1").groupBy("h1", "h2").agg(F.collect_set("gid").alias("gids"))  # at most one for each subset
    found = tuples.join(unique, ["h1", "h2"], "left")
    # the grouping id has a bit for each key that is not in the subset, the first key highest
    gid = lambda s: sum(1 << (p - 1 - i) for i, c in enumerate(keys) if c not in s)
    flags = [F.coalesce(F.array_contains("gids", F.lit(gid(s)).cast("bigint")), F.lit(False)) for s in subsets]
    minimal = []
    for n, s in enumerate(subsets):
        below = [flags[m] for m, t in enumerate(subsets) if set(t) < set(s)]
        minimal.append(flags[n] & ~reduce(lambda a, b: a | b, below, F.lit(False)))
    score = sum((F.when(m, 2.0 ** -(len(s) - 1)).otherwise(0.0) for m, s in zip(minimal, subsets, strict=True)), F.lit(0.0))
    scale = sum(math.comb(p, k) / 2 ** (k - 1) for k in range(1, most + 1))
    by_size = {
        r: sum((m.cast("int") for m, s in zip(minimal, subsets, strict=True) if len(s) == r), F.lit(0)) for r in range(1, most + 1)
    }
    scored = found.select(*keys, "f", score.alias("suda"), (score / scale).alias("dis"), *[c.alias(f"msu_{r}") for r, c in by_size.items()])
    records = key_join(rows.select(id_col, *keys), scored, keys, "inner")
    summary = records.agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(sum((F.col(f"msu_{r}") for r in by_size), F.lit(0))).alias("n_msu"),
        *[F.sum(f"msu_{r}").alias(f"msu_size_{r}") for r in by_size], F.avg("suda").alias("mean_suda"), F.max("suda").alias("max_suda"),
        F.avg("dis").alias("mean_dis"), F.max("dis").alias("max_dis"),
    )
    return MeasureResult(summary, records)


def high_risk_by_suda(records: DataFrame) -> DataFrame:
    """Records whose score reaches the 75th percentile of the positive scores."""
    cut = quantiles(records.filter("suda > 0"), "suda", [0.75])
    return records.filter(F.col("suda") >= cut[0]) if cut else records.limit(0)


def individual_risk(df: DataFrame, id_col: str, keys: Sequence[str], *, weight: str | None = None, threshold: float = 0.1) -> MeasureResult:
    """Re-identification risk per record: 1 / class size, or with weights
    1 / max(sum of weights, 1)."""
    rows = complete(df, keys)
    size = F.greatest(F.sum(weight), F.lit(1.0)) if weight else F.count(F.lit(1)).cast("double")
    ec = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("f"), size.alias("est"))
    ec = ec.withColumn("risk", F.least(F.lit(1.0), 1 / F.col("est")))
    records = key_join(rows.select(id_col, *keys), ec, keys, "inner").select(id_col, "f", "risk")
    n = F.sum("f")
    high = F.sum(F.when(F.col("risk") > threshold, F.col("f")).otherwise(0))
    summary = ec.agg(
        (F.sum(F.col("f") * F.col("risk")) / n).alias("mean_risk"), F.max("risk").alias("max_risk"), high.alias("n_high_risk"),
        (100 * high / n).alias("pct_high_risk"), n.alias("n_records"), F.count_if(F.col("f") == 1).alias("n_unique"), F.count(F.lit(1)).alias("n_ec"),
    )
    return MeasureResult(summary, records, ec)


def high_risk_records(records: DataFrame, id_col: str, *, threshold: float | None = None, top: int | None = None) -> DataFrame:
    """Records above a risk threshold, or the ``top`` riskiest (ids break ties)."""
    found = records if threshold is None else records.filter(F.col("risk") > threshold)
    return found.orderBy(F.desc("risk"), id_col).limit(top) if top else found


def population_uniqueness(df: DataFrame, id_col: str, keys: Sequence[str], *, sampling_fraction: float = 0.01) -> MeasureResult:
    """Probability that a sample unique is unique in the population, by the
    Pitman, Zayatz and shifted negative binomial estimators."""
    ec = classes(df, keys)
    pi = sampling_fraction
    row = ec.agg(
        F.count_if(F.col("f") == 1).alias("f1"), F.count_if(F.col("f") == 2).alias("f2"), F.sum("f").alias("n"),
        F.avg("f").alias("mean"), F.var_samp("f").alias("var"),
    ).first()
    f1, f2, n = row.f1 or 0, row.f2 or 0, row.n or 0
    alpha = f1 * f1 / (2 * f2) if f1 and f2 else (f1 if f1 else 1.0)
    alpha = max(alpha, 0.01)
    pitman = alpha / (alpha + n * pi)
    zayatz = (1 - pi) ** (1 / pi - 1)
    snb = 1.0
    if row.var and row.mean:
        ratio = row.mean / row.var
        q = min(max((ratio - 1) / (ratio + pi), 1e-6), 1 - 1e-6)
        r = row.mean * (1 - q) / (pi * q)
        top = int(min(max(100, 5 * math.ceil(r * q)), 10_000))
        if r > 0:
            weights = [neg_binomial_pmf(k, r, 1 - q) for k in range(top + 1)]
            total = sum(weights)
            snb = min(1.0, weights[0] / total) if total > 0 else 1.0
    spark = df.sparkSession
    share = f1 / n if n else 0.0
    summary = spark.range(1).select(
        F.lit(f1).cast("bigint").alias("n_sample_uniques"), F.lit(100 * share).alias("pct_sample_uniques"), F.lit(n).cast("bigint").alias("n_records"),
        *[F.lit(float(p)).alias(f"p_{m}") for m, p in (("pitman", pitman), ("zayatz", zayatz), ("snb", snb))],
        *[F.lit(float(p * share)).alias(f"global_{m}") for m, p in (("pitman", pitman), ("zayatz", zayatz))],
        F.lit(pitman * f1).alias("n_population_uniques_est"), F.lit(pitman * share <= 0.1).alias("privacy_pass"),
    )
    rows = key_join(complete(df, keys).select(id_col, *keys), ec, keys, "inner")
    return MeasureResult(summary, rows.select(id_col, F.when(F.col("f") == 1, pitman).otherwise(0.0).alias("risk")))


def attacker_risk(df: DataFrame, id_col: str, keys: Sequence[str], *, sampling_fraction: float = 0.01) -> MeasureResult:
    """Prosecutor, journalist and marketer risk."""
    ec = classes(df, keys)
    one = F.count_if(F.col("f") == 1)
    summary = ec.agg(
        (F.count(F.lit(1)) / F.sum("f")).alias("prosecutor"),
        (sampling_fraction * F.count(F.lit(1)) / F.sum("f")).alias("journalist"),
        (F.count(F.lit(1)) / F.sum("f")).alias("marketer"),
        one.alias("n_uniques"), F.try_divide(one, F.count(F.lit(1))).alias("pct_uniques"), F.sum("f").alias("n_records"),
        (F.count(F.lit(1)) / F.sum("f") <= 0.1).alias("privacy_pass"),
    )
    rows = key_join(complete(df, keys).select(id_col, *keys), ec, keys, "inner")
    sizes = ec.groupBy("f").agg(F.count(F.lit(1)).alias("n_ec"))
    return MeasureResult(summary, rows.select(id_col, (1 / F.col("f")).alias("prosecutor"), (sampling_fraction / F.col("f")).alias("journalist")), sizes)


def delta_presence(original: DataFrame, released: DataFrame, keys: Sequence[str], *, delta_min: float = 0.0, delta_max: float = 1.0) -> MeasureResult:
    """Probability of membership for each key combination of the original:
    released count over original count, at most 1.  Combinations that only the
    released table has are counted as fabricated."""
    own, theirs = classes(original, keys), classes(released, keys).withColumnRenamed("f", "g")
    both = key_join(own, theirs, keys, "left")
    prob = F.least(F.lit(1.0), F.coalesce("g", F.lit(0)) / F.col("f"))
    per = both.select(*keys, "f", F.coalesce("g", F.lit(0)).alias("g"), prob.alias("membership_prob"))
    low = F.sum(F.when(F.col("membership_prob") < delta_min, F.col("f")).otherwise(0))
    high = F.sum(F.when(F.col("membership_prob") > delta_max, F.col("f")).otherwise(0))
    n = F.sum("f")
    fabricated = key_join(theirs, own, keys, "left_anti").agg(F.count(F.lit(1)).alias("n_fabricated"))
    summary = per.agg(
        (F.sum(F.col("f") * F.col("membership_prob")) / n).alias("mean_prob"), F.min("membership_prob").alias("min_prob"), F.max("membership_prob").alias("max_prob"),
        low.alias("n_violations_lower"), high.alias("n_violations_upper"), ((low + high) / n).alias("pct_violations"),
        ((low + high) == 0).alias("satisfies_delta"), n.alias("n_original"),
    )
    return MeasureResult(summary.join(fabricated), groups=per)
