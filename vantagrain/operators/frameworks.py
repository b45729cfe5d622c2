"""The disclosure report over many measures, and the risk-utility map."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.pair import ReleasePair
from . import attribution, cells, copies, distance, distributions, linkage, models, sdc
from .common import MeasureResult, quantiles

FAMILIES = {
    "attribution": ("cap", "tcap", "weap", "disco", "rapid"),
    "similarity": ("dcr", "nndr", "ims", "repu", "drisk", "hitting_rate", "epsilon_identifiability"),
    "models": ("k_anonymity", "l_diversity", "t_closeness", "individual_risk", "suda", "population_uniqueness", "attacker_risk", "delta_presence"),
    "attacks": ("singling_out", "linkability", "nnaa", "domias"),
}


@dataclass(frozen=True)
class Check:
    """A metric's value, what it is compared with, and when it passes."""

    value: Callable[[ReleasePair], tuple[float, float | None]]
    passes: Callable[[float, float | None], str]


def _ratio(limit: float) -> Callable[[float, float | None], str]:
    return lambda v, ref: "PASS" if ref and v / ref <= limit else "WARNING"


def _below(limit: float, inclusive: bool = True) -> Callable[[float, float | None], str]:
    return lambda v, _: "PASS" if (v <= limit if inclusive else v < limit) else "WARNING"


def _k(v: float, _: float | None) -> str:
    return "PASS" if v >= 5 else "WARNING" if v >= 2 else "FAIL"


def _first(df: DataFrame, *names: str) -> tuple:
    row = df.first()
    return tuple(row[n] for n in names)


def _nums(p: ReleasePair) -> list[str]:
    return p.numeric


def checks() -> dict[str, Check]:
    a, s = attribution, sdc
    x, y = (lambda p: p.original), (lambda p: p.released)
    at = lambda p: (p.original, p.released, p.id_col, p.keys, p.target)
    three = lambda p: (p.original, p.released, p.holdout, p.id_col, p.cols)
    one = lambda v: (v, None)
    return {
        "cap": Check(lambda p: _first(a.dcap(*at(p)).summary, "cap", "baseline"), _ratio(1.5)),
        "tcap": Check(lambda p: _first(a.tcap(*at(p)).summary, "tcap_mean", "baseline"), _ratio(1.5)),
        "weap": Check(lambda p: one(*_first(a.weap(y(p), p.id_col, p.keys, p.target).summary, "pct_disclosive")), _below(5)),
        "disco": Check(lambda p: one(*_first(a.disco(*at(p)).summary, "disco_ratio")), _below(1.5)),
        "rapid": Check(lambda p: one(*_first(models.rapid(*at(p), model="rf").summary, "rapid")), _below(0.15, False)),
        "dcr": Check(lambda p: one(*_first(distance.dcr(*three(p)).summary, "dcr_share")), _below(0.55)),
        "nndr": Check(lambda p: one(*_first(distance.nndr(*three(p)).summary, "nndr_ratio")), lambda v, _: "PASS" if v is not None and v >= 0.8 else "WARNING"),
        "ims": Check(lambda p: one(*_first(copies.ims(x(p), y(p), p.id_col, p.cols).summary, "ims")), _below(0.01, False)),
        "repu": Check(lambda p: one(*_first(copies.repu(x(p), y(p), p.id_col, p.cols).summary, "ims")), _below(0.01, False)),
        "drisk": Check(lambda p: one(*_first(distance.drisk_interval(x(p), y(p), p.id_col, _nums(p)).summary, "drisk_interval")), _below(0.05, False)),
        "hitting_rate": Check(lambda p: one(*_first(distance.hitting_rate(x(p), y(p), p.id_col, p.cols).summary, "rate")), _below(0.05, False)),
        "epsilon_identifiability": Check(lambda p: one(*_first(distance.epsilon_identifiability(x(p), y(p), p.id_col, p.cols).summary, "identifiability_rate")), _below(0.1)),
        "k_anonymity": Check(lambda p: one(*_first(s.kanonymity(y(p), p.id_col, p.keys).summary, "k_level")), _k),
        "l_diversity": Check(lambda p: one(*_first(s.ldiversity(y(p), p.keys, p.target).summary, "distinct_l")), lambda v, _: "PASS" if v >= 2 else "WARNING"),
        "t_closeness": Check(lambda p: one(*_first(s.tcloseness(y(p), p.keys, p.target).summary, "t_achieved")), _below(0.2)),
        "individual_risk": Check(lambda p: one(*_first(s.individual_risk(y(p), p.id_col, p.keys).summary, "mean_risk")), _below(0.1, False)),
        "suda": Check(lambda p: one(*_first(s.suda(y(p), p.id_col, p.keys).summary, "mean_dis")), _below(0.1, False)),
        "population_uniqueness": Check(lambda p: one(*_first(s.population_uniqueness(y(p), p.id_col, p.keys).summary, "global_pitman")), _below(0.1)),
        "attacker_risk": Check(lambda p: one(*_first(s.attacker_risk(y(p), p.id_col, p.keys).summary, "prosecutor")), _below(0.1)),
        "delta_presence": Check(lambda p: one(*_first(s.delta_presence(x(p), y(p), p.keys).summary, "pct_violations")), _below(0.0)),
        "nnaa": Check(lambda p: one(*_first(distance.nnaa(*three(p)).summary, "privacy_loss")), _below(0.05, False)),
        "domias": Check(lambda p: one(*_first(distance.domias(*three(p)).summary, "auc")), _below(0.6, False)),
        "linkability": Check(lambda p: one(*_first(distance.linkability(p.original, p.holdout, p.released, p.id_col, p.cols[: len(p.cols) // 2], p.cols[len(p.cols) // 2 :]).summary, "risk")), _below(0.1, False)),
    }


def disclosure_report(pair: ReleasePair, compute: Sequence[str] | str = "all", *, fail_is_high: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, overall): a row per metric, and the overall level.

    ``compute`` names families or metrics.  Metrics whose keys, target or
    holdout the pair lacks are SKIPPED; one that raises is ERROR and does not
    stop the rest.  Overall: LOW without warnings, MEDIUM up to two, else HIGH;
    a FAIL makes it HIGH unless ``fail_is_high`` is false.
    """
    known = checks()
    wanted = list(known) if compute == "all" else [m for c in compute for m in FAMILIES.get(c, (c,)) if m in known]
    needs = {m: "target" for m in ("cap", "tcap", "weap", "disco", "rapid", "l_diversity", "t_closeness")}
    needs |= {m: "holdout" for m in ("dcr", "nndr", "nnaa", "domias", "linkability")}
    keyed = {*FAMILIES["attribution"], *FAMILIES["models"]}
    rows = []
    for m in wanted:
        lacks = (m in keyed and not pair.keys) or (needs.get(m) and getattr(pair, needs[m]) is None)
        if lacks:
            rows.append((m, None, None, None, "SKIPPED"))
            continue
        try:
            value, ref = known[m].value(pair)
            value, ref = (float(v) if v is not None else None for v in (value, ref))
            status = "N/A" if value is None else known[m].passes(value, ref)
            rows.append((m, value, ref, value / ref if value is not None and ref else None, status))
        except Exception as e:  # noqa: BLE001  one metric must not stop the report
            rows.append((m, None, None, None, f"ERROR: {type(e).__name__}"))
    spark = pair.original.sparkSession
    results = spark.createDataFrame(rows, "metric string, value double, reference double, ratio double, status string")
    warn = sum(r[4] == "WARNING" or r[4].startswith("ERROR") for r in rows)
    fail = sum(r[4] == "FAIL" for r in rows)
    level = "HIGH" if (fail and fail_is_high) or warn > 2 else "MEDIUM" if warn else "LOW"
    overall = spark.createDataFrame([(level, sum(r[4] == "PASS" for r in rows), warn, fail)], "overall_risk string, n_pass int, n_warn int, n_fail int")
    return results, overall


def risk_utility_map(scores: DataFrame) -> DataFrame:
    """(release, risk, risk_sd, utility, utility_sd, pareto) from a long table
    (release, kind, measure, value) with kind risk or utility.

    Values are min-max scaled per measure over the releases (0.5 if all are
    equal); composites are means; a release is on the front if none has less or
    equal risk and more or equal utility with one of the two strict.
    """
    per = Window.partitionBy("kind", "measure")
    low, high = F.min("value").over(per), F.max("value").over(per)
    scaled = scores.withColumn("z", F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(0.5))
    comp = scaled.groupBy("release").agg(
        *[f(F.when(F.col("kind") == k, F.col("z"))).alias(f"{k}{s}") for k in ("risk", "utility") for f, s in ((F.avg, ""), (F.stddev_samp, "_sd"))]
    )
    return comp.join(_dominated(comp), "release", "left").withColumn("pareto", F.col("dominated").isNull()).drop("dominated")


def reliability(scores: DataFrame) -> DataFrame:
    """(kind, n_measures, alpha): Cronbach's alpha of the scaled measures."""
    per = Window.partitionBy("kind", "measure")
    low, high = F.min("value").over(per), F.max("value").over(per)
    z = scores.withColumn("z", F.when(high > low, (F.col("value") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5))
    parts = z.groupBy("kind", "measure").agg(F.var_samp("z").alias("v")).groupBy("kind").agg(F.sum("v").alias("parts"), F.count(F.lit(1)).alias("n_measures"))
    whole = z.groupBy("kind", "release").agg(F.sum("z").alias("s")).groupBy("kind").agg(F.var_samp("s").alias("whole"))
    k = F.col("n_measures")
    alpha = F.when((k > 1) & (F.col("whole") > 0), k / F.nullif(k - 1, F.lit(0)) * (1 - F.col("parts") / F.nullif(F.col("whole"), F.lit(0.0))))
    return parts.join(whole, "kind").select("kind", "n_measures", alpha.alias("alpha"))


def _dominated(comp: DataFrame) -> DataFrame:
    """Releases that some other release beats, by one sorted sweep.

    In the order of (risk, -utility) a release is dominated exactly if an
    earlier one has at least its utility and differs from it.  Releases are few:
    one row each.
    """
    rows = comp.select("release", F.round("risk", 12).alias("r"), F.round("utility", 12).alias("u"))
    points = rows.groupBy("r").agg(F.max("u").alias("best")).withColumn("before", F.max("best").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)))
    joined = rows.join(points, "r")
    return joined.filter((F.col("u") < F.col("best")) | (F.coalesce("before", F.lit(float("-inf"))) >= F.col("u"))).select("release", F.lit(True).alias("dominated"))


def run(pair: ReleasePair, name: str, **params) -> MeasureResult:
    """A measure by name, with its arguments taken from the pair's roles.

    ``params`` go to the measure.  Measures of one table judge the release.
    """
    at = (pair.original, pair.released, pair.id_col, pair.keys, pair.target)
    two = (pair.original, pair.released)
    three = (pair.original, pair.released, pair.holdout, pair.id_col, pair.cols)
    y = pair.released
    known: dict[str, Callable[[], MeasureResult]] = {
        "dcap": lambda: attribution.dcap(*at, **params), "tcap": lambda: attribution.tcap(*at, **params),
        "weap": lambda: attribution.weap(y, pair.id_col, pair.keys, pair.target, **params), "disco": lambda: attribution.disco(*at, **params),
        "rapid": lambda: models.rapid(*at, **params), "ims": lambda: copies.ims(*two, pair.id_col, pair.cols, **params), "repu": lambda: copies.repu(*two, pair.id_col, pair.cols, **params),
        "dcr": lambda: distance.dcr(*three, **params), "nndr": lambda: distance.nndr(*three, **params), "nnaa": lambda: distance.nnaa(*three, **params), "domias": lambda: distance.domias(*three, **params),
        "hitting_rate": lambda: distance.hitting_rate(*two, pair.id_col, pair.cols, **params), "epsilon_identifiability": lambda: distance.epsilon_identifiability(*two, pair.id_col, pair.cols, **params),
        "drisk_interval": lambda: distance.drisk_interval(*two, pair.id_col, pair.numeric, **params), "drisk_mahalanobis": lambda: distance.drisk_mahalanobis(*two, pair.id_col, pair.numeric, **params),
        "paired_gower": lambda: distance.paired_gower(*two, pair.id_col, pair.cols, **params), "energy_distance": lambda: distance.energy_distance(*two, pair.id_col, pair.numeric, **params),
        "kanonymity": lambda: sdc.kanonymity(y, pair.id_col, pair.keys, **params), "ldiversity": lambda: sdc.ldiversity(y, pair.keys, pair.target, **params),
        "tcloseness": lambda: sdc.tcloseness(y, pair.keys, pair.target, **params), "suda": lambda: sdc.suda(y, pair.id_col, pair.keys, **params),
        "individual_risk": lambda: sdc.individual_risk(y, pair.id_col, pair.keys, **params), "delta_presence": lambda: sdc.delta_presence(*two, pair.keys, **params),
        "record_linkage": lambda: linkage.record_linkage(*two, pair.id_col, pair.keys, **params),
        "hellinger": lambda: cells.hellinger(*two, pair.categorical, **({"weight_x": pair.weight_original, "weight_y": pair.weight_released} | params)),
        "contingency_fidelity": lambda: cells.contingency_fidelity(*two, pair.categorical, **params), "chisq_utility": lambda: cells.chisq_utility(*two, pair.categorical, **params),
        "ci_proximity": lambda: distributions.ci_proximity(*two, pair.numeric, **({"weight_x": pair.weight_original, "weight_y": pair.weight_released} | params)),
        "correlation_matrices": lambda: distributions.correlation_matrices(*two, pair.numeric, **params), "copula_fidelity": lambda: distributions.copula_fidelity(*two, pair.numeric, **params),
        "tail_fidelity": lambda: distributions.tail_fidelity(*two, pair.numeric, **params), "pmse": lambda: models.pmse(*two, pair.id_col, pair.cols, **params),
        "tstr": lambda: models.tstr(*two, pair.id_col, [c for c in pair.cols if c != pair.target], pair.target, **params),
    }
    if name not in known:
        raise ValueError(f"unknown measure: {name}; known are {', '.join(sorted(known))}")
    return known[name]()


RELEASES_AT_ONCE = 4
RISK = ("dcap", "tcap", "disco", "rapid", "ims", "repu")
UTILITY = ("pmse", "wasserstein", "hellinger", "energy", "ci_proximity")


def map_measures() -> dict[str, tuple[str, Callable[[ReleasePair], float | None]]]:
    """Every measure the map knows: its kind and its value in [0, 1] or so."""
    from . import density as dens

    at = lambda p: (p.original, p.released, p.id_col, p.keys, p.target)
    two = lambda p: (p.original, p.released)
    three = lambda p: (p.original, p.released, p.holdout, p.id_col, p.cols)
    less = lambda v: None if v is None else 1 - v

    def moved(p: ReleasePair) -> float:
        gaps = []
        for c in p.numeric:
            q1, q3 = quantiles(p.original, c, [0.25, 0.75])
            gaps.append(distributions.wasserstein(*two(p), c).first().wasserstein / ((q3 - q1) or 1.0))
        return 1 - min(1.0, sum(gaps) / len(gaps))

    def rapid(p: ReleasePair) -> float:
        model = "lm" if p.target in p.numeric else "logit"
        return models.rapid(*at(p), model=model).summary.first().rapid

    return {
        "dcap": ("risk", lambda p: attribution.dcap(*at(p)).summary.first().cap),
        "tcap": ("risk", lambda p: attribution.tcap(*at(p)).summary.first().tcap_mean),
        "disco": ("risk", lambda p: attribution.disco(*at(p)).summary.first().pct_disco_potential / 100),
        "rapid": ("risk", rapid),
        "ims": ("risk", lambda p: copies.ims(*two(p), p.id_col, p.cols).summary.first().ims),
        "repu": ("risk", lambda p: copies.repu(*two(p), p.id_col, p.cols).summary.first().ims),
        "dcr": ("risk", lambda p: less(distance.dcr(*three(p)).summary.first().dcr_share)),
        "nndr": ("risk", lambda p: less(distance.nndr(*three(p)).summary.first().nndr_ratio)),
        "rf_privacy": ("risk", lambda p: models.rf_privacy(*three(p)).summary.first().max_prox_share),
        "pmse": ("utility", lambda p: 1 - min(1.0, 10 * models.pmse(*two(p), p.id_col, p.cols).summary.first().pmse)),
        "wasserstein": ("utility", moved),
        "hellinger": ("utility", lambda p: cells.hellinger(*two(p), p.categorical).summary.first().utility_score),
        "energy": ("utility", lambda p: distance.energy_distance(*two(p), p.id_col, p.numeric).summary.first().utility_score),
        "ci_proximity": ("utility", lambda p: distributions.ci_proximity(*two(p), p.numeric).summary.first().proximity_mean),
        "mmd": ("utility", lambda p: dens.mmd_exact(*two(p), p.id_col, p.numeric).first().utility_score),
        "tstr": ("utility", lambda p: models.tstr(*two(p), p.id_col, [c for c in p.cols if c != p.target], p.target).summary.first().utility_score),
        "copula": ("utility", lambda p: distributions.copula_fidelity(*two(p), p.numeric).summary.first().utility_score),
        "tail": ("utility", lambda p: distributions.tail_fidelity(*two(p), p.numeric).summary.first().utility_score),
        "contingency": ("utility", lambda p: cells.contingency_fidelity(*two(p), p.categorical).summary.first().utility_score),
    }


_NEEDS = {
    "dcap": ("keys", "target"), "tcap": ("keys", "target"), "disco": ("keys", "target"), "rapid": ("keys", "target"), "tstr": ("target",),
    "dcr": ("holdout",), "nndr": ("holdout",), "rf_privacy": ("holdout",), "wasserstein": ("numeric",), "energy": ("numeric",),
    "ci_proximity": ("numeric",), "mmd": ("numeric",), "copula": ("numeric",), "tail": ("numeric",), "hellinger": ("categorical",), "contingency": ("categorical",),
}


def score_release(pair: ReleasePair, name: str, risk: Sequence[str] = RISK, utility: Sequence[str] = UTILITY) -> list[tuple[str, str, str, float | None]]:
    """Risk and utility measures of one release, as long rows.  A measure for
    which the pair lacks keys, target, holdout or columns is left out."""
    known, out = map_measures(), []
    for m in [*risk, *utility]:
        if m not in known:
            raise ValueError(f"unknown measure: {m}")
        lacks = [need for need in _NEEDS.get(m, ()) if not isinstance(getattr(pair, need), DataFrame) and not getattr(pair, need)]
        if lacks or (m in ("copula",) and len(pair.numeric) < 2) or (m == "contingency" and len(pair.categorical) < 2):
            continue
        value = known[m][1](pair)
        out.append((name, known[m][0], m, None if value is None else float(value)))
    return out


def release_scores(original: DataFrame, releases: dict[str, DataFrame], id_col: str, *, risk: Sequence[str] = RISK, utility: Sequence[str] = UTILITY, **roles) -> DataFrame:
    """(release, kind, measure, value) of every release; some releases are scored
    at once, as a measure is many short jobs that leave most cores idle."""
    one = lambda item: score_release(ReleasePair(original, item[1], id_col, **roles), item[0], risk, utility)
    with ThreadPoolExecutor(RELEASES_AT_ONCE) as pool:
        rows = [r for found in pool.map(one, releases.items()) for r in found]
    return original.sparkSession.createDataFrame(rows, "release string, kind string, measure string, value double")


def rumap(original: DataFrame, releases: dict[str, DataFrame], id_col: str, **roles) -> DataFrame:
    return risk_utility_map(release_scores(original, releases, id_col, **roles))
