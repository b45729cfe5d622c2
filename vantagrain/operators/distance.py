"""Risk from closeness: nearest records, radii, neighbours and bands.

Rows with a null in a used column are left out.  Distances are Gower's over the
used columns, with ranges over all tables of a call, or Euclidean after min-max
scaling.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.special import chi2_ppf, residual_risk, wilson
from .blocks import category_weights, counts_within, distance_sum, keyed, minima, minmax_vectors, nearest, pooled, predicate_counts, rank_of, ranges, vectors
from .common import MeasureResult, complete, is_numeric, kept, quantiles, scalar_row
from .density import concentrated_covariance
from .distributions import covariance
from .ranks import running, signed_rank_p


def _vectors(frames: Sequence[DataFrame], id_col: str, cols: Sequence[str], method: str, weights: dict[str, float] | None = None):
    rows = [complete(f, cols) for f in frames]
    spans = ranges(rows, cols)
    if method == "euclidean":
        nums = [c for c in cols if c in spans]
        lows = minima(rows, nums)
        return [minmax_vectors(r, id_col, nums, spans, lows) for r in rows], {"metric": "euclidean", "sums": False}
    return [vectors(r, id_col, cols, spans, weights) for r in rows], {"cat_weights": category_weights(cols, spans, weights), "sums": False}


def dcr(train: DataFrame, released: DataFrame, holdout: DataFrame, id_col: str, cols: Sequence[str], *, method: str = "gower") -> MeasureResult:
    """Distance of released records to their closest training and holdout record."""
    (t, y, h), how = _vectors([train, released, holdout], id_col, cols, method)
    both = nearest(y, t, **how).select("id", F.col("d1").alias("dcr_train")).join(nearest(y, h, **how).select("id", F.col("d1").alias("dcr_holdout")), "id")
    summary = both.agg(
        F.avg("dcr_train").alias("mean_dcr_train"), F.avg("dcr_holdout").alias("mean_dcr_holdout"),
        F.median("dcr_train").alias("median_dcr_train"), F.median("dcr_holdout").alias("median_dcr_holdout"),
        F.try_divide(F.avg("dcr_train"), F.avg("dcr_holdout")).alias("dcr_ratio"),
        F.avg((F.col("dcr_train") < F.col("dcr_holdout")).cast("int")).alias("dcr_share"), F.count(F.lit(1)).alias("n_synthetic"),
    )
    return MeasureResult(summary, both, params={"wilcoxon": lambda: signed_rank_p(both.withColumn("d", F.col("dcr_train") - F.col("dcr_holdout")), "d")})


def dcr_null(records: DataFrame, *, n_null: int = 100, seed: int = 1) -> DataFrame:
    """(b, share): the share under random exchange of the two labels of a record.

    Distances are reused; only labels are drawn, all rounds in one job.
    """
    flip = F.pmod(F.xxhash64("id", "b", F.lit(seed)), F.lit(2)) == 0
    rounds = records.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_null))))
    a, b = F.col("dcr_train"), F.col("dcr_holdout")
    return rounds.groupBy("b").agg(F.avg(F.when(flip, a < b).otherwise(b < a).cast("int")).alias("share"))


def nndr(train: DataFrame, released: DataFrame, holdout: DataFrame, id_col: str, cols: Sequence[str], *, method: str = "gower") -> MeasureResult:
    """Nearest over second nearest distance, to training and holdout records."""
    (t, y, h), how = _vectors([train, released, holdout], id_col, cols, method)
    ratio = F.when(F.col("d1") == 0, 0.0).when(F.col("d2") > 0, F.col("d1") / F.col("d2"))
    both = nearest(y, t, **how).select("id", ratio.alias("nndr_train")).join(nearest(y, h, **how).select("id", ratio.alias("nndr_holdout")), "id")
    p = [F.percentile(c, F.array(F.lit(0.05), F.lit(0.1), F.lit(0.5))) for c in ("nndr_train", "nndr_holdout")]
    found = both.agg(
        F.avg("nndr_train").alias("mean_nndr_train"), F.avg("nndr_holdout").alias("mean_nndr_holdout"), p[0].alias("pt"), p[1].alias("ph"),
        F.count_if(F.col("nndr_train") < 0.1).alias("n_suspicious"), F.count(F.lit(1)).alias("n_synthetic"),
    )
    summary = found.select(
        "mean_nndr_train", "mean_nndr_holdout", F.col("pt")[2].alias("median_nndr_train"), F.col("ph")[2].alias("median_nndr_holdout"),
        F.col("pt")[0].alias("p5_train"), F.col("ph")[0].alias("p5_holdout"), F.col("pt")[1].alias("p10_train"), F.col("ph")[1].alias("p10_holdout"),
        F.when(F.col("ph")[0] != 0, F.col("pt")[0] / F.col("ph")[0]).alias("nndr_ratio"),
        "n_suspicious", F.try_divide(100 * F.col("n_suspicious"), F.col("n_synthetic")).alias("pct_suspicious"),
    )
    return MeasureResult(summary, both)


def hitting_rate(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], *, threshold: float = 0.05, method: str = "gower") -> MeasureResult:
    """Share of released records within ``threshold`` of an original."""
    (x, y), how = _vectors([original, released], id_col, cols, method)
    records = nearest(y, x, **how).select("id", F.round("d1", 9).alias("min_distance"))
    summary = records.agg(
        F.avg((F.col("min_distance") <= threshold).cast("int")).alias("rate"), F.count_if(F.col("min_distance") <= threshold).alias("n_hits"),
        F.avg((F.col("min_distance") == 0).cast("int")).alias("rate_at_zero"), F.count(F.lit(1)).alias("n_synthetic"),
    )
    return MeasureResult(summary.withColumn("privacy_pass", F.col("rate") <= 0.1), records)


def hitting_sweep(records: DataFrame, taus: Sequence[float] = (0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3)) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tau"), (F.col("min_distance") <= t).cast("int").alias("hit")) for t in taus]))
    return records.select(each.alias("p")).groupBy("p.tau").agg(F.avg("p.hit").alias("rate"))


def entropy_weights(df: DataFrame, cols: Sequence[str], n_bins: int = 20) -> dict[str, tuple[float, float]]:
    """Entropy of each column (numeric ones in equal-width bins), and the weight
    that is proportional to its inverse; uniform if all entropies are 0."""
    out = {}
    for c in cols:
        level = F.col(c).cast("string")
        if is_numeric(df, c):
            low, high = df.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
            width = (high - low) / n_bins
            level = F.least(F.lit(n_bins), F.greatest(F.lit(1), F.ceil(F.round((F.col(c) - low) / width, 9)))) if width else F.lit(1)
        counts = df.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h")).first()
        out[c] = max(0.0, row.h or 0.0)
    inverse = {c: 1 / h if h > 1e-12 else 0.0 for c, h in out.items()}
    total = sum(inverse.values())
    return {c: (h, inverse[c] / total if total else 1 / len(cols)) for c, h in out.items()}


def epsilon_identifiability(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], *, epsilon: float = 0.05, n_bins: int = 20) -> MeasureResult:
    """Share of released records within epsilon of an original, under a Gower
    distance that weighs columns by inverse entropy."""
    weights = entropy_weights(complete(original, cols), cols, n_bins)
    (x, y), how = _vectors([original, released], id_col, cols, "gower", {c: w for c, (_, w) in weights.items()})
    records = nearest(y, x, **how).select("id", F.round("d1", 9).alias("distance")).withColumn("flagged", F.col("distance") < epsilon)
    summary = records.agg(
        F.avg(F.col("flagged").cast("int")).alias("identifiability_rate"), F.count_if("flagged").alias("n_flagged"), F.count(F.lit(1)).alias("n_synthetic"),
        F.avg("distance").alias("mean_distance"),
    )
    return MeasureResult(summary, records, params={"weights": weights})


def nnaa(train: DataFrame, released: DataFrame, holdout: DataFrame, id_col: str, cols: Sequence[str], *, method: str = "gower") -> MeasureResult:
    """Nearest-neighbour adversarial accuracy against training and holdout."""
    (t, s, h), how = _vectors([train, released, holdout], id_col, cols, method)

    def side(a: DataFrame, b: DataFrame) -> DataFrame:
        """Share of a's records farther from b than from their own kind."""
        cross = nearest(a, b, **how).select("id", F.col("d1").alias("dc"))
        own = nearest(a, a, not_self=True, **how).select("id", F.col("d1").alias("do"))
        return cross.join(own, "id").agg(F.avg((F.col("dc") > F.col("do")).cast("int")).alias("s"))

    parts = {"aa_train_left": side(t, s), "aa_train_right": side(s, t), "aa_holdout_left": side(h, s), "aa_holdout_right": side(s, h)}
    row = reduce(DataFrame.join, [d.withColumnRenamed("s", n) for n, d in parts.items()])
    aa_t, aa_h = (0.5 * (F.col(f"aa_{k}_left") + F.col(f"aa_{k}_right")) for k in ("train", "holdout"))
    summary = row.select("*", aa_t.alias("aa_train"), aa_h.alias("aa_holdout"), (aa_h - aa_t).alias("privacy_loss"))
    return MeasureResult(summary.withColumn("privacy_pass", F.col("privacy_loss") <= 0.1))


def domias(train: DataFrame, released: DataFrame, holdout: DataFrame, id_col: str, cols: Sequence[str], *, radius: float = 0.1) -> MeasureResult:
    """Membership by density: released over reference neighbours within a radius."""
    (t, y, h), how = _vectors([train, released, holdout], id_col, cols, "gower")
    # each vector of training and holdout meets each of the release and the holdout once
    queries, refs = pooled({"train": t, "holdout": h}), pooled({"near": y, "base": h})
    found = counts_within(queries, refs, radius + 1e-9, ["train", "holdout"], ["near", "base"], how["cat_weights"])

    def side(own: int) -> tuple:
        """Whether a vector has a ratio, and the ratio, with ``own`` of the holdout left out."""
        has = (F.col("holdout" if own else "train") > 0) & (F.col("all_near") > 0) & (F.col("all_base") > own)
        return has, F.try_divide(F.col("near") + 1, F.col("base") - own + 1)

    (has_t, ratio_t), (has_h, ratio_h) = side(0), side(1)
    none = F.lit(0).cast("bigint")
    both = F.array(
        F.struct(F.round(ratio_t, 12).alias("v"), F.when(has_t, F.col("train")).otherwise(none).alias("p"), none.alias("n")),
        F.struct(F.round(ratio_h, 12).alias("v"), none.alias("p"), F.when(has_h, F.col("holdout")).otherwise(none).alias("n")),
    )
    values = found.select(F.explode(both).alias("e")).select("e.*").filter("p + n > 0").groupBy("v").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n = F.sum("p"), F.sum("n")
    found_auc = F.try_divide(F.sum(F.col("p") * (F.col("run_n") - F.col("n") / 2)), p.cast("double") * n)
    summary = running(kept(values), "v", ["n"]).agg(
        found_auc.alias("auc"), F.try_divide(F.sum(F.col("v") * F.col("p")), p).alias("mean_ratio_train"), F.try_divide(F.sum(F.col("v") * F.col("n")), n).alias("mean_ratio_holdout"),
        F.coalesce(p, none).alias("n_train"), F.coalesce(n, none).alias("n_holdout"),
    ).select(
        "auc", "mean_ratio_train", "mean_ratio_holdout", F.try_divide("mean_ratio_train", "mean_ratio_holdout").alias("memorization_score"),
        "n_train", "n_holdout", (F.col("auc") <= 0.6).alias("privacy_pass"),
    )
    records = keyed(t, ["nums", "cats"]).select("id", "_h", "_g").join(found.filter(has_t).select("_h", "_g", ratio_t.alias("ratio")), ["_h", "_g"]).select("id", "ratio")
    return MeasureResult(summary, records)


def paired_gower(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str]) -> MeasureResult:
    """Mean Gower distance of records that share an id."""
    x, y = complete(original, cols), complete(released, cols)
    spans = ranges([x, y], cols)
    theirs = y.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{c}") for c in cols])
    both = x.select(id_col, *cols).join(theirs, F.col(id_col) == F.col("__id"))
    terms = [
        (F.abs(F.col(c) - F.col(f"__{c}")) / spans[c] if spans[c] else F.lit(0.0)) if c in spans else (F.col(c) != F.col(f"__{c}")).cast("double")
        for c in cols
    ]
    records = both.select(id_col, (reduce(lambda a, b: a + b, terms) / len(cols)).alias("distance"))
    summary = records.agg(F.avg("distance").alias("gower_distance"), (1 - F.avg("distance")).alias("utility_score"), F.count(F.lit(1)).alias("n_records"))
    return MeasureResult(summary.withColumn("n_variables", F.lit(len(cols))), records)


def drisk_interval(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], *, outlier_par: float = 0.01) -> MeasureResult:
    """Share of originals with a released record within a band in every column.

    The band join is bucketed: a column is cut into steps of its band, released
    rows are filed under their step and its neighbours, and rows meet on the
    steps of all columns before the exact test.
    """
    x, y = complete(original, cols), complete(released, cols)
    n = x.count()
    widths = {}
    for c in cols:
        q1, q3 = quantiles(x, c, [0.25, 0.75])
        widths[c] = outlier_par * (q3 - q1) / (2 * n) ** (1 / 3)
    step = lambda c: F.floor(F.col(c) / (widths[c] or 1.0) / 2)  # noqa: E731  a step is two bands wide
    left = x.select(F.col(id_col).alias("id"), *cols, *[step(c).alias(f"s{k}") for k, c in enumerate(cols)])
    right = y.select(*[F.col(c).alias(f"__{c}") for c in cols]).distinct()
    for k, c in enumerate(cols):
        w = widths[c] or 1.0
        at = [F.floor((F.col(f"__{c}") + d * widths[c]) / w / 2) for d in (-1.001, 1.001)]
        right = right.withColumn(f"__s{k}", F.explode(F.array_distinct(F.array(*at))))
    on = reduce(lambda a, b: a & b, [F.col(f"s{k}") == F.col(f"__s{k}") for k in range(len(cols))])
    close = reduce(lambda a, b: a & b, [F.abs(F.col(c) - F.col(f"__{c}")) <= F.lit(widths[c]) for c in cols])
    hit = left.join(right, on & close, "left_semi").select("id")
    summary = hit.agg(F.count(F.lit(1)).alias("n_at_risk")).select(
        (F.col("n_at_risk") / n).alias("drisk_interval"), "n_at_risk", F.lit(n).cast("bigint").alias("n_original")
    )
    return MeasureResult(summary, hit, params={"widths": widths})


def drisk_mahalanobis(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], *, alpha: float = 0.05, robust: bool = True) -> MeasureResult:
    """Share of originals whose nearest released record is within the
    chi-square radius, in Mahalanobis distance by the minimum covariance
    determinant or, with ``robust`` false, by the covariance."""
    x, y = complete(original, cols), complete(released, cols)
    cov = concentrated_covariance(x, cols)[1] if robust and len(cols) > 1 else covariance(x, cols)[1]
    root = np.linalg.cholesky(np.linalg.pinv(cov) + 1e-12 * np.eye(len(cols)))
    rotated = lambda d: d.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.array(*[reduce(lambda a, b: a + b, [F.col(c).cast("double") * float(root[i, j]) for i, c in enumerate(cols)]) for j in range(len(cols))]).alias("nums"),
        F.array().cast("array<bigint>").alias("cats"),
    )
    cut = math.sqrt(chi2_ppf(1 - alpha, len(cols)))
    records = nearest(rotated(x), rotated(y), metric="euclidean", sums=False).select("id", F.col("d1").alias("min_rmd"))
    summary = records.agg(F.avg((F.col("min_rmd") < cut).cast("int")).alias("drisk_rmd"), F.avg("min_rmd").alias("mean_rmd"), F.count(F.lit(1)).alias("n_original"))
    return MeasureResult(summary, records)


def singling_out(
    train: DataFrame, holdout: DataFrame, attacks: DataFrame, id_col: str, cols: Sequence[str], medians: dict[str, float], *, n_cols: int | None = None, seed: int = 1
) -> MeasureResult:
    """Attack rows make conjunctions; one succeeds if exactly one record matches.

    A numeric value above the released median makes ``>= v``, else ``<= v``; a
    category ``= v``; a condition with a null on either side fails.  With
    ``n_cols`` each attack uses so many columns, drawn by a digest of its id (one
    column: the univariate mode).  ``attacks`` is a stated query set; records are
    counted against it in blocks.
    """
    nums, cats = [c for c in cols if c in medians], [c for c in cols if c not in medians]
    digest = lambda c: F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{c}:{seed}")))

    def used(c: str) -> Column:
        """1 if fewer than n_cols columns have a smaller digest."""
        if n_cols is None:
            return F.lit(1)
        ahead = [(digest(o) < digest(c)).cast("int") for o in cols if o != c]
        return (reduce(lambda a, b: a + b, ahead, F.lit(0)) < n_cols).cast("int")

    def vectors_of(df: DataFrame, null: int) -> list[Column]:
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in nums]
        levels = [F.when(F.col(c).isNull(), F.lit(null).cast("bigint")).otherwise(F.xxhash64(F.col(c).cast("string"))) for c in cats]
        return [_array(numbers, "double").alias("nums"), _array(levels, "bigint").alias("cats")]

    above = _array([F.coalesce((F.col(c) > medians[c]).cast("int"), F.lit(0)) for c in nums], "int").alias("above")
    masks = [_array([used(c) for c in some], "int").alias(name) for some, name in ((nums, "num_used"), (cats, "cat_used"))]
    i = F.col(id_col).cast("bigint").alias("id")
    guesses = attacks.select(i, *vectors_of(attacks, 0), above, *masks)
    both = guesses.select("id")
    for df, name in ((train, "n_train"), (holdout, "n_holdout")):
        found = predicate_counts(guesses, df.select(i, *vectors_of(df, 1))).select(F.col("id").alias("_i"), F.col("n").alias(name))
        both = both.join(found, F.col("id") == F.col("_i"), "left").drop("_i").withColumn(name, F.coalesce(name, F.lit(0)))
    row = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_train") == 1).alias("a"), F.count_if(F.col("n_holdout") == 1).alias("c")).first()
    return MeasureResult(_attack_summary(train, row.n, row.a, row.c), both)


def _array(columns: Sequence[Column], kind: str) -> Column:
    return (F.array(*columns) if columns else F.array()).cast(f"array<{kind}>")


def _attack_summary(df: DataFrame, n: int, hits: int, control: int) -> DataFrame:
    a, c = (hits / n, control / n) if n else (0.0, 0.0)
    (al, au), (cl, cu) = wilson(hits, n), wilson(control, n)
    risk = residual_risk(a, c)
    return scalar_row(
        df.sparkSession, risk=risk, risk_lower=residual_risk(al, cu), risk_upper=residual_risk(au, cl), risk_attack=a, risk_control=c,
        n_attacks=n, n_success=hits, n_control_success=control, privacy_pass=risk <= 0.1,
    )


def linkability(
    train: DataFrame, holdout: DataFrame, released: DataFrame, id_col: str, aux: Sequence[str], secret: Sequence[str], *, neighbours: int = 1
) -> MeasureResult:
    """Is the released record nearest in some columns among the ``neighbours``
    nearest in the others?  The lower id comes first among equally near ones."""

    def side(df: DataFrame) -> DataFrame:
        (a, y), how = _vectors([df, released], id_col, aux, "gower")
        first = nearest(a, y, **how).select("id", F.col("d1_id").alias("n0"))
        (b, z), how = _vectors([df, released], id_col, secret, "gower")
        if neighbours == 1:
            second = nearest(b, z, **how).select("id", F.col("d1_id").alias("n1"))
            return first.join(second, "id").select("id", (F.col("n0") == F.col("n1")).alias("link"))
        theirs = z.select(F.col("id").alias("rid"), F.col("nums").alias("r_nums"), F.col("cats").alias("r_cats"))
        known = b.join(first, "id").withColumnRenamed("n0", "rid").join(theirs, "rid")
        ahead = rank_of(known, z, how["cat_weights"])
        return first.join(ahead, "id", "left").select("id", F.coalesce(F.col("n") < neighbours, F.lit(False)).alias("link"))

    a, c = side(train), side(holdout)
    ra, rc = (d.agg(F.count(F.lit(1)).alias("n"), F.count_if("link").alias("k")).first() for d in (a, c))
    pa, pc = (r.k / r.n if r.n else 0.0 for r in (ra, rc))
    (al, au), (cl, cu) = wilson(ra.k, ra.n), wilson(rc.k, rc.n)
    risk = residual_risk(pa, pc)
    summary = scalar_row(
        train.sparkSession, risk=risk, risk_lower=residual_risk(al, cu), risk_upper=residual_risk(au, cl), risk_attack=pa, risk_control=pc,
        n_attacks=ra.n, n_success=ra.k, n_control_success=rc.k, privacy_pass=risk <= 0.1,
    )
    return MeasureResult(summary, a)


def energy_distance(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str]) -> MeasureResult:
    """Energy distance after pooled z-scores; self pairs are left out."""
    x, y = complete(original, cols), complete(released, cols)
    m = x.select(*cols).unionByName(y.select(*cols)).agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)], *[F.stddev_samp(c).alias(f"s{k}") for k, c in enumerate(cols)]).first()
    z = lambda d: d.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.array(*[(F.col(c).cast("double") - m[f"m{k}"]) / (m[f"s{k}"] or 1.0) for k, c in enumerate(cols)]).alias("nums"),
        F.array().cast("array<bigint>").alias("cats"),
    )
    zx, zy = z(x), z(y)
    n, k = zx.count(), zy.count()
    xy, xx, yy = (distance_sum(a, b) for a, b in ((zx, zy), (zx, zx), (zy, zy)))  # a row with itself adds nothing
    share = lambda total, pairs: total / pairs if pairs else None
    row = scalar_row(x.sparkSession, mean_dist_xy=share(xy, n * k), mean_dist_xx=share(xx, n * (n - 1)), mean_dist_yy=share(yy, k * (k - 1)))
    e = F.greatest(F.lit(0.0), 2 * F.col("mean_dist_xy") - F.col("mean_dist_xx") - F.col("mean_dist_yy"))
    within = (F.col("mean_dist_xx") + F.col("mean_dist_yy")) / 2
    return MeasureResult(row.select("*", e.alias("energy_distance"), (e / within).alias("energy_distance_normalized"), F.exp(-e).alias("utility_score")))


def mmd_rff(original: DataFrame, released: DataFrame, cols: Sequence[str], *, sigma: float, n_features: int = 500, seed: int = 1) -> DataFrame:
    """Maximum mean discrepancy by random Fourier features: one pass a side.

    Frequencies are drawn from the seed; a task returns the sum of each feature
    over its rows, so the cost is linear in the rows and nothing else travels.
    """
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(0, 1 / sigma, (len(cols), n_features)), rng.uniform(0, 2 * math.pi, n_features)
    pooled = original.select(*cols).unionByName(released.select(*cols)).na.drop()
    m = pooled.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)], *[F.stddev_samp(c).alias(f"s{k}") for k, c in enumerate(cols)]).first()
    mean, sd = np.array([float(m[f"m{k}"]) for k in range(len(cols))]), np.array([float(m[f"s{k}"] or 1.0) for k in range(len(cols))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(n_features), 0
        for b in batches:
            z = (np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]) - mean) / sd
            for at in range(0, len(z), 4096):
                total += np.cos((z[at : at + 4096] @ omega + phase).astype(np.float32)).sum(axis=0, dtype=float)  # single precision is vectorised
            n += len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_features)), pa.array(total), pa.array(np.full(n_features, n))], names=["k", "s", "n"])

    def means(df: DataFrame) -> np.ndarray:
        rows = complete(df, cols).select(*[F.col(c).cast("double").alias(c) for c in cols])
        found = rows.mapInArrow(run, "k bigint, s double, n bigint").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("m")).collect()  # a row a feature
        out = np.zeros(n_features)
        for r in found:
            out[r.k] = r.m
        return out

    mmd2 = float(2 / n_features * ((means(original) - means(released)) ** 2).sum())
    return scalar_row(original.sparkSession, mmd2=mmd2, sigma=sigma, utility_score=min(1.0, max(0.0, math.exp(-mmd2 / sigma**2))))
