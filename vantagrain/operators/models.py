"""Measures that fit models: attribute prediction, propensities, train-on-released.

Models are MLlib's.  Numeric predictors are used as they are, categorical ones
one-hot encoded with unseen levels kept; rows with nulls in used columns are
left out.  Random choices come from hashes of the id and a seed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.special import norm_ppf, wilson
from .common import MeasureResult, bin_of, complete, is_numeric, pooled_breaks, quantiles, scalar_row
from .ranks import auc, ks_p_value, ks_two_sample, signed_rank_p


def _order(id_col: str, seed: int):
    """A reproducible random order: a digest of the id, spread over [0, 1)."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _features(df: DataFrame, cols: Sequence[str], hot: bool = True) -> list:
    nums = [c for c in cols if is_numeric(df, c)]
    cats = [c for c in cols if c not in nums]
    stages: list = [StringIndexer(inputCol=c, outputCol=f"__i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in cats]
    parts = [f"__i_{c}" for c in cats]
    if hot and cats:
        stages.append(OneHotEncoder(inputCols=parts, outputCols=[f"__h_{c}" for c in cats], handleInvalid="keep"))
        parts = [f"__h_{c}" for c in cats]
    return [*stages, VectorAssembler(inputCols=[*nums, *parts], outputCol="__x")]


def classifier(kind: str, label: str, seed: int = 1, trees: int = 50):
    made = {
        "logit": lambda: LogisticRegression(featuresCol="__x", labelCol=label, maxIter=50),
        "rf": lambda: RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, maxDepth=8, maxBins=256, seed=seed),
        "cart": lambda: DecisionTreeClassifier(featuresCol="__x", labelCol=label, maxDepth=8, maxBins=256, minInstancesPerNode=5, seed=seed),
        "gbm": lambda: GBTClassifier(featuresCol="__x", labelCol=label, maxIter=20, maxBins=256, seed=seed),
    }
    return made[kind]()


def regressor(kind: str, label: str, seed: int = 1, trees: int = 50):
    made = {
        "lm": lambda: LinearRegression(featuresCol="__x", labelCol=label, solver="normal"),
        "rf": lambda: RandomForestRegressor(featuresCol="__x", labelCol=label, numTrees=trees, maxDepth=8, maxBins=256, seed=seed),
        "cart": lambda: DecisionTreeRegressor(featuresCol="__x", labelCol=label, maxDepth=8, maxBins=256, seed=seed),
        "gbm": lambda: GBTRegressor(featuresCol="__x", labelCol=label, maxIter=20, maxBins=256, seed=seed),
    }
    return made[kind]()


def _fit(df: DataFrame, cols: Sequence[str], model) -> PipelineModel:
    hot = isinstance(model, LogisticRegression | LinearRegression | GeneralizedLinearRegression)
    return Pipeline(stages=[*_features(df, cols, hot), model]).fit(df)


def class_probabilities(train: DataFrame, score: DataFrame, cols: Sequence[str], target: str, kind: str, seed: int = 1) -> DataFrame:
    """``score`` with ``_p_true``, the probability given to the true class (0 for
    a class that training did not have), ``_hit``, and ``_probs``, a map of the
    probabilities of all classes that training had."""
    index = StringIndexer(inputCol="__t", outputCol="__y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train.withColumn("__t", F.col(target).cast("string")))
    k = len(index.labels)
    model = _fit(index.transform(train.withColumn("__t", F.col(target).cast("string"))), cols, classifier(kind, "__y", seed))
    out = model.transform(index.transform(score.withColumn("__t", F.col(target).cast("string"))))
    p = F.coalesce(F.get(vector_to_array("probability"), F.col("__y").cast("int")), F.lit(0.0))
    out = out.withColumns({"_p_true": F.when(F.col("__y") < k, p).otherwise(0.0), "_hit": F.col("prediction") == F.col("__y")})
    every = F.map_from_arrays(F.array(*map(F.lit, index.labels)), F.slice(vector_to_array("probability"), 1, k))
    return out.select(*score.columns, "_p_true", "_hit", every.alias("_probs"))


def _fill(df: DataFrame, keys: Sequence[str], target: str, strategy: str, constant: float) -> DataFrame:
    if strategy == "complete":
        return df
    cats = [c for c in [*keys, target] if not is_numeric(df, c)]
    out = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in cats})
    if target in cats or strategy == "drop":
        return out
    if strategy == "constant":
        return out.withColumn(target, F.coalesce(F.col(target).cast("double"), F.lit(float(constant))))
    if strategy != "median":
        raise ValueError(f"unknown na_strategy: {strategy}")
    middle = quantiles(df, target, [0.5])
    return out.withColumn(target, F.coalesce(F.col(target).cast("double"), F.lit(middle[0]))) if middle else out


def rapid(
    original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], target: str, *, model: str = "rf",
    num_epsilon: float = 10.0, metric: str = "symmetric", delta: float = 0.01, cat_tau: float = 1.0, cat_eval: str = "conditional", seed: int = 1,
    na_strategy: str = "complete", na_constant: float = 0.0,
) -> MeasureResult:
    """Risk of attribute prediction: fit on the released table, judge originals.

    ``na_strategy``: complete leaves out rows with a null in any used column;
    otherwise a null category is the level ``missing``, and a null numeric target
    is left out (drop), ``na_constant`` (constant) or its side's median (median).
    Rows with a null numeric key are always left out.

    A categorical target is at risk if the score of the true class exceeds
    ``cat_tau``: conditional (against its class mean), marginal (against its
    share) or nce (normalised cross-entropy).
    """
    x, y = (complete(_fill(d, keys, target, na_strategy, na_constant), [*keys, target]) for d in (original, released))
    if is_numeric(x, target):
        if model == "logit":
            raise ValueError("logit needs a categorical target")
        fitted = _fit(y.withColumn("__y", F.col(target).cast("double")), keys, regressor(model, "__y", seed))
        scored = fitted.transform(x)
        a, b = F.col(target).cast("double"), F.col("prediction")
        gap = F.abs(a - b)
        error = {"symmetric": 200 * gap / (F.abs(a) + F.abs(b) + 2 * delta), "stabilised_relative": 100 * gap / (F.abs(a) + delta), "absolute": gap}[metric]
        records = scored.select(id_col, *keys, a.alias("actual"), b.alias("predicted"), error.alias("score")).withColumn("at_risk", F.col("score") < num_epsilon)
        fit = F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).alias("fit")
    else:
        if model == "lm":
            raise ValueError("lm needs a numeric target")
        scored = class_probabilities(y, x, keys, target, model, seed)
        per = scored.groupBy(F.col(target).alias("__c")).agg(F.avg("_p_true").alias("__m"), F.count(F.lit(1)).alias("__n"))
        n, k = x.count(), x.select(target).distinct().count()
        joined = scored.join(per, F.col(target) == F.col("__c"))
        g = F.col("_p_true")
        share = F.col("__n") / max(1, n)
        score = {
            "conditional": F.when(F.col("__m") > 0, g / F.col("__m")).otherwise(0.0),
            "marginal": F.when(share < 1, (g - share) / (1 - share)).otherwise(0.0),
            "nce": 1 + F.log(F.greatest(g, F.lit(1e-10))) / math.log(max(2, k)),
        }[cat_eval]
        records = joined.select(id_col, *keys, F.col(target).alias("actual"), g.alias("predicted"), score.alias("score"), "_hit", "_probs").withColumn("at_risk", F.col("score") > cat_tau)
        fit = F.avg(F.col("_hit").cast("int")).alias("fit")
    n, hit = F.count(F.lit(1)), F.count_if("at_risk")
    return MeasureResult(records.agg(F.try_divide(hit, n).alias("rapid"), hit.alias("n_at_risk"), F.try_divide(100 * hit, n).alias("pct_at_risk"), n.alias("n_records"), fit), records)


def rapid_confint(summary: DataFrame, *, level: float = 0.95, method: str = "wilson") -> DataFrame:
    row = summary.select("n_at_risk", "n_records").first()
    p = row.n_at_risk / row.n_records
    if method == "wilson":
        low, high = wilson(row.n_at_risk, row.n_records, level)
    else:
        half = norm_ppf(0.5 + level / 2) * math.sqrt(p * (1 - p) / row.n_records)
        low, high = max(0.0, p - half), min(1.0, p + half)
    return scalar_row(summary.sparkSession, lower=low, upper=high)


def rapid_bootstrap(records: DataFrame, id_col: str, *, level: float = 0.95, n_boot: int = 200, seed: int = 1) -> DataFrame:
    """Percentile interval from Poisson resamples, all rounds in one pass."""
    u = (F.pmod(F.xxhash64(id_col, "b", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    w = sum(((u > c).cast("int") for c in _POISSON), F.lit(0))
    rounds = records.select(id_col, "at_risk", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b")).withColumn("w", w)
    shares = rounds.groupBy("b").agg((F.sum(F.when(F.col("at_risk"), F.col("w")).otherwise(0)) / F.sum("w")).alias("s"))
    q = quantiles(shares, "s", [(1 - level) / 2, (1 + level) / 2])
    return scalar_row(records.sparkSession, lower=q[0], upper=q[1])


_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def _null_rounds(records: DataFrame, id_col: str, rounds: int, seed: int) -> tuple[DataFrame, dict]:
    """(b, g, share): the marginal score's parts under exchanged classes.

    A record draws its class in each round from the class shares by a hash of
    its id, which needs no shuffle of the records; its probability of the drawn
    class is the model's.
    """
    total = records.count()
    shares = {r.c: r.n / total for r in records.groupBy(F.col("actual").cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    u = F.pmod(F.xxhash64(id_col, "b", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    names = sorted(shares)
    drawn, at = F.lit(names[-1]), 1.0
    for c, after in zip(reversed(names[:-1]), reversed(names[1:]), strict=True):
        at -= shares[after]
        drawn = F.when(u < at, F.lit(c)).otherwise(drawn)
    every = records.select(id_col, "_probs", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b")).withColumn("d", drawn)
    share = F.element_at(F.create_map(*[F.lit(v) for c in names for v in (c, shares[c])]), F.col("d"))
    return every.select("b", F.coalesce(F.try_element_at("_probs", F.col("d")), F.lit(0.0)).alias("g"), share.alias("share")), shares


def rapid_threshold_select(records: DataFrame, id_col: str, thresholds: Sequence[float], *, n_permutations: int = 99, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """(threshold, observed, null_quantile, null_mean, p_value, exceeds, selected)
    for marginal scores; selected is the largest threshold whose observed risk
    exceeds the null quantile.  All rounds and thresholds are one pass."""
    rounds, _ = _null_rounds(records, id_col, n_permutations, seed)
    score = (F.col("g") - F.col("share")) / (1 - F.col("share"))
    per = rounds.groupBy("b").agg(*[F.avg((score > t).cast("int")).alias(f"r{k}") for k, t in enumerate(thresholds)])
    nulls = [[r[f"r{k}"] for k in range(len(thresholds))] for r in per.collect()]  # one row a round
    own = records.agg(*[F.avg((F.col("score") > t).cast("int")).alias(f"r{k}") for k, t in enumerate(thresholds)]).first()
    rows, chosen = [], None
    for k, t in enumerate(thresholds):
        values = sorted(n[k] for n in nulls)
        at = (1 - alpha) * (len(values) - 1)
        q = values[int(at)] + (values[min(len(values) - 1, int(at) + 1)] - values[int(at)]) * (at - int(at))
        p = (1 + sum(v >= own[k] for v in values)) / (1 + len(values))
        rows.append([float(t), own[k], q, sum(values) / len(values), p, own[k] > q])
        chosen = t if own[k] > q else chosen
    out = [(*r, r[0] == chosen) for r in rows]
    return records.sparkSession.createDataFrame(out, "threshold double, observed double, null_quantile double, null_mean double, p_value double, exceeds boolean, selected boolean")


def rapid_test(records: DataFrame, id_col: str, *, cat_tau: float = 0.3, n_permutations: int = 99, seed: int = 1) -> DataFrame:
    """Test of the categorical, marginally scored risk: the model and its
    predictions stay, true classes are drawn anew."""
    rounds, _ = _null_rounds(records, id_col, n_permutations, seed)
    hit = (F.col("g") - F.col("share")) / (1 - F.col("share")) > cat_tau
    per = rounds.groupBy("b").agg(F.avg(hit.cast("int")).alias("r"))
    observed = records.agg(F.avg((F.col("score") > cat_tau).cast("int")).alias("o"))
    return per.join(observed).agg(
        F.first("o").alias("statistic"), ((1 + F.count_if(F.col("r") >= F.col("o"))) / (1 + F.count(F.lit(1)))).alias("p_value"),
        F.avg("r").alias("null_mean"), F.stddev_samp("r").alias("null_sd"),
    )


def threshold_curve(records: DataFrame, thresholds: Sequence[float], *, above: bool = True) -> DataFrame:
    """(threshold, rapid): the share at risk at each threshold, in one pass."""
    hit = lambda t: (F.col("score") > t) if above else (F.col("score") < t)
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), hit(t).cast("int").alias("h")) for t in thresholds]))
    return records.select(each.alias("p")).groupBy("p.threshold").agg(F.avg("p.h").alias("rapid"))


def rapid_contributions(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], target: str, *, groups: dict[str, Sequence[str]] | None = None, **params) -> DataFrame:
    """(key, delta_rapid): risk lost when a key, or a named group of keys, is
    withheld, largest first."""
    withheld = {k: [k] for k in keys} | {name: list(g) for name, g in (groups or {}).items()}
    for name, g in withheld.items():
        if not set(g) <= set(keys) or (name in (groups or {}) and set(g) == set(keys)):
            raise ValueError(f"group {name} must hold some, not all, of the keys")
    full = rapid(original, released, id_col, keys, target, **params).summary.first().rapid
    rows = []
    for k, gone in withheld.items():
        rest = [c for c in keys if c not in gone]
        rows.append((k, full - rapid(original, released, id_col, rest, target, **params).summary.first().rapid if rest else full))
    return original.sparkSession.createDataFrame(rows, "key string, delta_rapid double").orderBy(F.desc("delta_rapid"), "key")


def rapid_cross_validation(original: DataFrame, synthesizer: Callable[[DataFrame], DataFrame], id_col: str, keys: Sequence[str], target: str, *, k: int = 5, seed: int = 1, **params) -> DataFrame:
    """(fold, rapid): synthesise from k - 1 folds, attack the held-out one."""
    fold = F.floor(_order(id_col, seed) * k)
    rows = []
    for f in range(k):
        found = rapid(original.filter(fold == f), synthesizer(original.filter(fold != f)), id_col, keys, target, **params).summary.first()
        rows.append((f, found.rapid))
    return original.sparkSession.createDataFrame(rows, "fold int, rapid double")


def risk_factors(records: DataFrame, keys: Sequence[str], n_bins: int = 4) -> DataFrame:
    """(key, level, n, share_at_risk, effect): log odds of each level of each key
    minus the mean over the key's levels."""
    parts = []
    for k in keys:
        level = bin_of(k, pooled_breaks([records], k, n_bins)).cast("string") if is_numeric(records, k) else F.col(k).cast("string")
        parts.append(F.struct(F.lit(k).alias("key"), level.alias("level")))
    rows = records.select("at_risk", F.explode(F.array(*parts)).alias("p")).groupBy("p.key", "p.level").agg(F.count(F.lit(1)).alias("n"), F.count_if("at_risk").alias("r"))
    from pyspark.sql import Window

    odds = F.log((F.col("r") + 0.5) / (F.col("n") - F.col("r") + 0.5))
    return rows.withColumn("o", odds).select("key", "level", "n", (F.col("r") / F.col("n")).alias("share_at_risk"), (F.col("o") - F.avg("o").over(Window.partitionBy("key"))).alias("effect"))


def propensities(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], *, model: str = "logit", folds: int = 1, seed: int = 1) -> DataFrame:
    """(id, origin, p): probability of being released.

    With ``folds`` above 1 each record is scored by a model that did not see it,
    which keeps forests from separating what they have memorised.
    """
    both = complete(original, cols).select(F.col(id_col).alias("id"), *cols, F.lit(0.0).alias("origin")).unionByName(
        complete(released, cols).select(F.col(id_col).alias("id"), *cols, F.lit(1.0).alias("origin"))
    )
    if folds == 1:
        parts = [(both, both)]
    else:
        fold = F.floor(_order("id", seed) * folds)
        parts = [(both.filter(fold != f), both.filter(fold == f)) for f in range(folds)]
    out = None
    for train, test in parts:
        scored = _fit(train, cols, classifier(model, "origin", seed)).transform(test).select("id", "origin", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        out = scored if out is None else out.unionByName(scored)
    return out


def propensity_summary(scores: DataFrame) -> DataFrame:
    """pMSE, SPECKS, PO50 and the score ratio of a propensity table."""
    c = scores.agg(F.avg("origin")).first()[0]
    rounded = scores.withColumn("p", F.round("p", 12))
    ks = ks_two_sample(rounded.filter("origin = 0"), rounded.filter("origin = 1"), "p").first()
    right = F.avg(((F.col("p") > 0.5).cast("double") == F.col("origin")).cast("int"))
    found = scores.agg(
        F.avg(F.pow(F.col("p") - c, 2)).alias("pmse"), (100 * right).alias("po50"), F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("p") >= c) / F.nullif(F.count_if(F.col("p") < c), F.lit(0))).alias("ps_ratio"),
        F.avg(F.when(F.col("origin") == 0, F.col("p"))).alias("mean_ps_x"), F.avg(F.when(F.col("origin") == 1, F.col("p"))).alias("mean_ps_y"),
    )
    return found.select(
        "pmse", F.lit(ks.ks_statistic).alias("specks"), F.lit(ks_p_value(ks.ks_statistic, ks.n_x, ks.n_y)).alias("ks_pvalue"), "po50", "ps_ratio",
        "mean_ps_x", "mean_ps_y", F.lit(c).alias("c"), "n", F.lit(1 - ks.ks_statistic).alias("utility_score"),
    )


def pmse(
    original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], *, model: str = "logit", k: int | None = None, seed: int = 1,
    max_order: int = 1, breaks: dict[str, int] | None = None, n_perm: int = 0,
) -> MeasureResult:
    """Propensity mean squared error; for the logit with its expected value.

    ``breaks`` cuts numeric columns at that many pooled quantiles into classes;
    ``max_order`` 2 adds all two-way terms (products of numbers, combinations of
    classes, and a number within each class); with ``n_perm`` the value is also
    compared with that many permutations of the origin (``perm_mean``,
    ``perm_ratio``, ``perm_p``).
    """
    for c, n in (breaks or {}).items():
        cuts = pooled_breaks([original, released], c, n)
        original, released = (d.withColumn(c, bin_of(c, cuts).cast("string")) for d in (original, released))
    if max_order > 1:
        original, released, cols = _two_way(original, released, cols)
    scores = propensities(original, released, id_col, cols, model=model, folds=1 if model != "rf" else 5, seed=seed)
    summary = propensity_summary(scores)
    if model == "logit":
        terms = k or (1 + sum(1 if is_numeric(original, c) else max(1, original.select(c).distinct().count() - 1) for c in cols))
        null = (terms - 1) * F.pow(1 - F.col("c"), 2) * F.col("c") / F.col("n")
        sd = F.sqrt(F.lit(2.0 * (terms - 1))) * F.pow(1 - F.col("c"), 2) * F.col("c") / F.col("n")
        summary = summary.withColumns({"pmse_null": null, "pmse_ratio": F.col("pmse") / null, "s_pmse": (F.col("pmse") - null) / sd})
    if n_perm:
        drawn, own = pmse_null(original, released, id_col, cols, model=model, n_perm=n_perm, seed=seed), summary.first().pmse
        mean = sum(drawn) / n_perm
        summary = summary.withColumns({"perm_mean": F.lit(mean), "perm_ratio": F.lit(own / mean if mean else None).cast("double"), "perm_p": F.lit((1 + sum(v >= own for v in drawn)) / (1 + n_perm))})
    return MeasureResult(summary, scores)


def _two_way(original: DataFrame, released: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with a column for each two-way term, and the names of all terms."""
    from itertools import combinations

    made: dict = {}
    for a, b in combinations(cols, 2):
        num_a, num_b = is_numeric(original, a), is_numeric(original, b)
        if num_a and num_b:
            made[f"{a}:{b}"] = F.col(a).cast("double") * F.col(b).cast("double")
        elif not num_a and not num_b:
            made[f"{a}:{b}"] = F.concat_ws(" ", a, b)
        else:
            n, c = (a, b) if num_a else (b, a)
            levels = sorted({r[0] for d in (original, released) for r in d.select(c).distinct().collect() if r[0] is not None})  # the terms of the model
            made |= {f"{n}:{c}={v}": F.when(F.col(c) == v, F.col(n).cast("double")).otherwise(0.0) for v in levels[1:]}
    return original.withColumns(made), released.withColumns(made), [*cols, *made]


def pmse_null(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], *, model: str = "cart", n_perm: int = 20, seed: int = 1) -> list[float]:
    """pMSE under permuted origins, one fit a round."""
    pool = original.select(id_col, *cols).unionByName(released.select(id_col, *cols))
    out = []
    for b in range(n_perm):
        coin = F.pmod(F.xxhash64(id_col, *cols, F.lit(seed + b)), F.lit(2))
        parts = pool.filter(coin == 0), pool.filter(coin == 1)
        out.append(propensity_summary(propensities(*parts, id_col, cols, model=model)).first().pmse)
    return out


def tstr(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], target: str, *, model: str = "glm", test_fraction: float = 0.3, seed: int = 1) -> MeasureResult:
    """Train on released, test on real, against train on real: R squared or AUC."""
    x, y = (complete(d, [*cols, target]) for d in (original, released))
    u = _order(id_col, seed)
    train, test = x.filter(u >= test_fraction), x.filter(u < test_fraction)
    numeric = is_numeric(x, target)
    rows = []
    for name, fit_on in (("tstr", y), ("trtr", train)):
        if numeric:
            kind = {"glm": "lm", "rpart": "cart"}.get(model, model)
            out = _fit(fit_on.withColumn("__y", F.col(target).cast("double")), cols, regressor(kind, "__y", seed)).transform(test)
            r = out.agg((1 - F.sum(F.pow(F.col(target) - F.col("prediction"), 2)) / F.nullif(F.var_pop(F.col(target).cast("double")) * F.count(target), F.lit(0.0))).alias("r")).first().r
            rows.append((name, max(0.0, r or 0.0)))
        else:
            kind = {"glm": "logit", "rpart": "cart"}.get(model, model)
            levels = sorted(r[0] for r in x.select(target).distinct().collect())
            scores = []
            for level in levels if len(levels) > 2 else levels[-1:]:
                one = fit_on.withColumn("__y", (F.col(target) == level).cast("double"))
                if one.select("__y").distinct().count() < 2:
                    scores.append(0.5)
                    continue
                out = _fit(one, cols, classifier(kind, "__y", seed)).transform(test).select(F.round(F.get(vector_to_array("probability"), F.lit(1)), 12).alias("p"), (F.col(target) == level).alias("t"))
                scores.append(auc(out.filter("t"), out.filter("not t"), "p").first().auc or 0.5)
            rows.append((name, sum(scores) / len(scores)))
    got = dict(rows)
    ratio = got["tstr"] / got["trtr"] if got["trtr"] > 1e-10 else None
    summary = scalar_row(
        x.sparkSession, tstr_performance=got["tstr"], trtr_performance=got["trtr"], tstr_ratio=ratio if ratio is not None else float("nan"),
        utility_score=min(1.0, max(0.0, ratio)) if ratio is not None else float("nan"), metric="r2" if numeric else "auc",
    )
    return MeasureResult(summary)


def mia_classifier(original: DataFrame, released: DataFrame, holdout: DataFrame, id_col: str, cols: Sequence[str], *, n_iter: int = 2, trees: int = 50, seed: int = 1) -> DataFrame:
    """Membership inference by a forest that tells released from holdout rows:
    precision, recall and macro F1 on training rows against unseen ones."""
    rows = []
    for b in range(n_iter):
        u = _order(id_col, seed + b)
        h = holdout.select(id_col, *cols)
        train = released.select(*cols, F.lit(1.0).alias("__y")).unionByName(h.filter(u < 0.75).select(*cols, F.lit(0.0).alias("__y")))
        negatives = h.filter(u >= 0.75).select(*cols, F.lit(0.0).alias("__y"))
        share = negatives.count() / max(1, original.count())
        positives = original.filter(u < share).select(*cols, F.lit(1.0).alias("__y"))
        out = _fit(train.na.drop(), cols, classifier("rf", "__y", seed + b, trees)).transform(positives.unionByName(negatives).na.drop())
        c = {(r.prediction, r["__y"]): r["count"] for r in out.groupBy("prediction", "__y").count().collect()}
        tp, fp, fn, tn = c.get((1.0, 1.0), 0), c.get((1.0, 0.0), 0), c.get((0.0, 1.0), 0), c.get((0.0, 0.0), 0)
        f1 = lambda a, b, d: 2 * a / (2 * a + b + d) if a else 0.0
        rows.append((tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0, (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2))
    df = original.sparkSession.createDataFrame(rows, "precision double, recall double, macro_f1 double")
    se = lambda c: (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_se")
    return df.agg(*[F.avg(c).alias(c) for c in df.columns], *[se(c) for c in df.columns]).withColumn("privacy_pass", F.col("recall") <= 0.55)


def forest_leaves(tables: dict[str, DataFrame], id_col: str, cols: Sequence[str], *, trees: int = 20, seed: int = 1) -> DataFrame:
    """(source, id, tree, leaf) of a forest that separates the first two tables."""
    names = list(tables)
    rows = None
    for n, name in enumerate(names):
        part = complete(tables[name], cols).select(F.lit(name).alias("source"), F.col(id_col).cast("bigint").alias("id"), *cols, F.lit(float(n)).alias("__y"))
        rows = part if rows is None else rows.unionByName(part)
    model = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=6, maxBins=256, seed=seed, leafCol="__leaf")
    fitted = _fit(rows.filter(F.col("source").isin(names[:2])), cols, model)
    leaves = fitted.transform(rows).select("source", "id", F.posexplode(vector_to_array("__leaf")).alias("tree", "leaf"))
    return leaves


def proximity_to(leaves: DataFrame, queries: str, refs: str, trees: int) -> DataFrame:
    """(id, max_prox, mean_prox) of query rows towards reference rows.

    The mean needs only how many references share a leaf; the maximum joins
    distinct leaf signatures, so equal rows are one.
    """
    q, r = leaves.filter(F.col("source") == queries), leaves.filter(F.col("source") == refs)
    n = r.select("id").distinct().count()
    sizes = r.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("k"))
    mean = q.join(sizes, ["tree", "leaf"], "left").groupBy("id").agg((F.sum(F.coalesce("k", F.lit(0))) / (n * trees)).alias("mean_prox"))
    sign = lambda d: d.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tree", "leaf"))).alias("sig"))
    kinds = sign(r).select("sig").distinct().withColumn("rid", F.xxhash64("sig"))
    cells = kinds.select("rid", F.explode("sig").alias("c")).select("rid", "c.tree", "c.leaf")
    mine = sign(q)
    own = mine.select(F.xxhash64("sig").alias("qid"), "sig").distinct().select("qid", F.explode("sig").alias("c")).select("qid", "c.tree", "c.leaf")
    shared = own.join(cells, ["tree", "leaf"]).groupBy("qid", "rid").agg(F.count(F.lit(1)).alias("s"))
    best = shared.groupBy("qid").agg((F.max("s") / trees).alias("max_prox"))
    return mine.select("id", F.xxhash64("sig").alias("qid")).join(best, "qid", "left").join(mean, "id").select("id", F.coalesce("max_prox", F.lit(0.0)).alias("max_prox"), "mean_prox")


def rf_privacy(train: DataFrame, released: DataFrame, holdout: DataFrame, id_col: str, cols: Sequence[str], *, trees: int = 20, seed: int = 1) -> MeasureResult:
    """Forest proximity of released rows to training against holdout rows."""
    leaves = forest_leaves({"t": train, "y": released, "h": holdout}, id_col, cols, trees=trees, seed=seed).cache()
    a = proximity_to(leaves, "y", "t", trees).toDF("id", "max_train", "mean_train")
    b = proximity_to(leaves, "y", "h", trees).toDF("id", "max_holdout", "mean_holdout")
    both = a.join(b, "id")
    share = lambda x, y: F.avg(F.when(F.col(x) > F.col(y), 1.0).when(F.col(x) == F.col(y), 0.5).otherwise(0.0))
    ratio = lambda x, y: F.avg(x) / F.greatest(F.avg(y), F.lit(1 / trees))
    summary = both.agg(
        share("max_train", "max_holdout").alias("max_prox_share"), ratio("max_train", "max_holdout").alias("max_prox_ratio"),
        share("mean_train", "mean_holdout").alias("prox_share"), ratio("mean_train", "mean_holdout").alias("prox_ratio"),
        F.avg("max_train").alias("max_prox_train"), F.avg("max_holdout").alias("max_prox_holdout"), F.count(F.lit(1)).alias("n_synthetic"),
    )
    return MeasureResult(summary, both, params={"wilcoxon": lambda: signed_rank_p(both.withColumn("d", F.col("max_train") - F.col("max_holdout")), "d", "greater")})


def poisson_individual_risk(df: DataFrame, id_col: str, keys: Sequence[str], *, max_cells: int = 100_000) -> MeasureResult:
    """Individual risk 1 / fitted size under a main-effects Poisson model.

    The main-effects fit on a full contingency table is the product of the
    margins over n ** (p - 1), zero cells included, so margins are all it takes.
    """
    rows = complete(df, keys).select(id_col, *[F.col(k).cast("string").alias(k) for k in keys])
    n = rows.count()
    out = rows
    for k in keys:
        margin = rows.groupBy(F.col(k).alias("__k")).agg(F.count(F.lit(1)).alias(f"__m_{k}"))
        out = out.join(margin, F.col(k) == F.col("__k")).drop("__k")
    fitted = F.lit(float(n))
    for k in keys:
        fitted = fitted * F.col(f"__m_{k}") / n
    risk = F.least(F.lit(1.0), 1 / F.greatest(F.lit(1.0), fitted))
    records = out.select(id_col, F.greatest(F.lit(1.0), fitted).alias("fitted"), risk.alias("risk"))
    return MeasureResult(records.agg(F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"), F.count_if(F.col("risk") > 0.1).alias("n_high_risk"), F.count(F.lit(1)).alias("n_records")), records)


def cross_validated(df: DataFrame, id_col: str, cols: Sequence[str], target: str, kind: str, *, folds: int = 3, seed: int = 1) -> float:
    """Mean held-out RMSE or accuracy."""
    rows = complete(df, [*cols, target])
    numeric = is_numeric(rows, target)
    fold = F.floor(_order(id_col, seed) * folds)
    out = []
    for f in range(folds):
        train, test = rows.filter(fold != f), rows.filter(fold == f)
        if numeric:
            model = _fit(train.withColumn("__y", F.col(target).cast("double")), cols, regressor(kind, "__y", seed))
            out.append(model.transform(test).agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col("prediction"), 2)))).first()[0])
        else:
            out.append(class_probabilities(train, test, cols, target, kind, seed).agg(F.avg(F.col("_hit").cast("int"))).first()[0])
    return float(sum(v or 0.0 for v in out) / folds)


def model_quality(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], target: str, *, kinds: Sequence[str] | None = None, folds: int = 3) -> DataFrame:
    """(model, performance_x, performance_y, ratio): cross-validated learners on
    both sides; the ratio is above 1 where the released table does worse (RMSE)
    or better (accuracy)."""
    numeric = is_numeric(original, target)
    rows = []
    for kind in kinds or (("lm", "cart", "rf") if numeric else ("cart", "rf")):
        a, b = (cross_validated(d, id_col, cols, target, kind, folds=folds) for d in (original, released))
        rows.append((kind, a, b, b / a if a else float("nan")))
    return original.sparkSession.createDataFrame(rows, "model string, performance_x double, performance_y double, ratio double")


def model_performance(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], target: str, *, kind: str = "cart", folds: int = 3) -> DataFrame:
    """One row (performance_x, performance_y, difference) of one learner."""
    a, b = (cross_validated(d, id_col, cols, target, kind, folds=folds) for d in (original, released))
    return scalar_row(original.sparkSession, performance_x=a, performance_y=b, difference=b - a)


def feature_importance(original: DataFrame, released: DataFrame, cols: Sequence[str], target: str, *, seed: int = 1) -> DataFrame:
    """(feature, importance_x, importance_y, abs_difference) of forests on both sides."""
    sides = []
    for d in (original, released):
        rows = complete(d, [*cols, target])
        if is_numeric(rows, target):
            model = _fit(rows.withColumn("__y", F.col(target).cast("double")), cols, regressor("rf", "__y", seed))
        else:
            index = StringIndexer(inputCol=target, outputCol="__y", stringOrderType="alphabetAsc").fit(rows)
            model = _fit(index.transform(rows), cols, classifier("rf", "__y", seed))
        nums = [c for c in cols if is_numeric(rows, c)]
        sides.append(dict(zip([*nums, *[c for c in cols if c not in nums]], model.stages[-1].featureImportances.toArray().tolist(), strict=True)))
    out = [(c, sides[0][c], sides[1][c], abs(sides[0][c] - sides[1][c])) for c in cols]
    return original.sparkSession.createDataFrame(out, "feature string, importance_x double, importance_y double, abs_difference double")


def permutation_importance(df: DataFrame, id_col: str, cols: Sequence[str], target: str, *, kind: str = "rf", seed: int = 1) -> DataFrame:
    """(feature, increase): growth of the RMSE when a column is exchanged between
    rows; the exchange pairs rows by two hashed orders within buckets."""
    rows = complete(df, [*cols, target]).select(id_col, *cols, F.col(target).cast("double").alias("__y"))
    model = _fit(rows, cols, regressor(kind, "__y", seed))
    rmse = lambda d: model.transform(d).agg(F.sqrt(F.avg(F.pow(F.col("__y") - F.col("prediction"), 2)))).first()[0]
    base = rmse(rows)
    from pyspark.sql import Window

    bucket = lambda s: F.pmod(F.xxhash64(id_col, F.lit(s)), F.lit(max(1, df.count() // 100_000)))
    out = []
    for n, c in enumerate(cols):
        place = lambda s, b: F.row_number().over(Window.partitionBy(b).orderBy(F.xxhash64(id_col, F.lit(s)), id_col))
        b = bucket(seed)
        left = rows.withColumn("__b", b).withColumn("__r", place(seed + 1, "__b")).drop(c)
        right = rows.withColumn("__b", b).withColumn("__r", place(seed + 2 + n, "__b")).select("__b", "__r", c)
        out.append((c, rmse(left.join(right, ["__b", "__r"])) - base))
    return df.sparkSession.createDataFrame(out, "feature string, increase double")


def subgroup_utility(original: DataFrame, released: DataFrame, group: str, measure: Callable[[DataFrame, DataFrame], float], *, threshold: float = 0.5, min_rows: int = 5) -> DataFrame:
    """(group, n_x, n_y, score, flagged): a measure on each group of both sides."""
    a, b = (d.groupBy(group).agg(F.count(F.lit(1)).alias(n)) for d, n in ((original, "n_x"), (released, "n_y")))
    rows = []
    for r in a.join(b, group).orderBy(group).collect():  # one row a group
        if min(r.n_x, r.n_y) >= min_rows:
            s = float(measure(original.filter(F.col(group) == r[group]), released.filter(F.col(group) == r[group])))
            rows.append((str(r[group]), r.n_x, r.n_y, s, s < threshold))
    return original.sparkSession.createDataFrame(rows, "group string, n_x bigint, n_y bigint, score double, flagged boolean")
