"""Attribution risk: what a key match tells an attacker about the target.

Rows with nulls in the keys or the target are left out (``na_rm``), or a null is
a value of its own.  Scores of records whose key occurs nowhere on the other
side are null and do not enter means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .blocks import category_weights, ranges, vectors, within
from .common import MeasureResult, complete, key_join, safe_div, target_bins


def _prepared(original: DataFrame, released: DataFrame, keys: Sequence[str], target: str, cont_bins: int | None, na_rm: bool):
    x, y = (complete(df, [*keys, target], na_rm) for df in (original, released))
    if cont_bins:
        return target_bins([x, y], target, cont_bins)
    return [df.withColumn("_t", F.col(target).cast("string")) for df in (x, y)]


def _per_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, _t, n_kt) and (keys, n_k, n_t): counts by key and target, and by
    key with the number of its targets; the second builds on the first."""
    cells = df.groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("n_kt"))
    return cells, cells.groupBy(*keys).agg(F.sum("n_kt").alias("n_k"), F.count(F.lit(1)).alias("n_t"))


def _baseline(y: DataFrame) -> DataFrame:
    """Share of the commonest target among released rows: one row."""
    by = y.groupBy("_t").agg(F.count(F.lit(1)).alias("n"))
    return by.agg((F.max("n") / F.sum("n")).alias("baseline"))


def cap_scores(
    original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], target: str, cont_bins: int = 10, na_rm: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Per original record (id, cap, n_matches, unique_x, unique_y), and the baseline.

    Both tables are reduced to counts by key and target before they meet, so the
    join moves classes of the released table and never its records.
    """
    x, y = _prepared(original, released, keys, target, cont_bins, na_rm)
    cells, per = _per_key(y, keys)
    own = _per_key(x, keys)[1].select(*keys, (F.col("n_t") == 1).alias("unique_x"))
    scored = key_join(x.select(id_col, *keys, "_t"), per, keys, "left", na_rm)
    scored = key_join(scored, cells, [*keys, "_t"], "left", na_rm)
    scored = key_join(scored, own, keys, "left", na_rm)
    cap = F.when(F.col("n_k").isNotNull(), F.coalesce("n_kt", F.lit(0)) / F.col("n_k"))
    records = scored.select(
        F.col(id_col), cap.alias("cap"), F.coalesce("n_k", F.lit(0)).alias("n_matches"),
        "unique_x", F.coalesce(F.col("n_t") == 1, F.lit(False)).alias("unique_y"),
    )
    return records, _baseline(y)


def dcap(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], target: str, *, cont_bins: int = 10, na_rm: bool = True) -> MeasureResult:
    """Correct attribution probability, and what it is above the baseline."""
    records, baseline = cap_scores(original, released, id_col, keys, target, cont_bins, na_rm)
    found = records.agg(
        F.avg("cap").alias("cap"), F.median("cap").alias("cap_median"), F.count("cap").alias("n_matched"),
        (F.count(F.lit(1)) - F.count("cap")).alias("n_unmatched"), F.count(F.lit(1)).alias("n_total"),
    )
    summary = found.join(baseline).select(
        "cap", "cap_median", (F.col("cap") - F.col("baseline")).alias("dcap"),
        (F.col("cap_median") - F.col("baseline")).alias("dcap_median"), "n_matched", "n_unmatched", "n_total", "baseline",
    )
    return MeasureResult(summary, records)


def tcap(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], target: str, *, cont_bins: int = 10, na_rm: bool = True) -> MeasureResult:
    """Targeted attribution: certain, matched and conditional variants, in per cent."""
    records, baseline = cap_scores(original, released, id_col, keys, target, cont_bins, na_rm)
    matched = F.col("n_matches") > 0
    records = records.withColumns({
        "is_certain": F.coalesce(F.col("unique_x") & F.col("unique_y") & (F.col("cap") == 1), F.lit(False)),
        "is_disclosive": F.col("unique_y") & matched,
        "risk_level": F.when(F.col("cap") >= 0.8, "high").when(F.col("cap") >= 0.5, "medium").when(F.col("cap").isNotNull(), "low"),
    })
    count = lambda c: F.count_if(c)
    found = records.agg(
        F.avg("cap").alias("tcap_mean"), F.max("cap").alias("tcap_max"), F.median("cap").alias("tcap_median"),
        count("is_certain").alias("n_certain"), count(F.col("cap") == 1).alias("n_correct"),
        count(F.col("is_disclosive") & (F.col("cap") == 1)).alias("n_disclosive_correct"),
        count("is_disclosive").alias("n_disclosive"), count(matched).alias("n_matched"), count(~matched).alias("n_unmatched"),
    )
    share = lambda a, b: F.coalesce(100 * safe_div(F.col(a), F.col(b)), F.lit(0.0))
    summary = found.join(baseline).select(
        "tcap_mean", "tcap_max", "tcap_median", share("n_certain", "n_matched").alias("tcap_certain"),
        share("n_correct", "n_matched").alias("tcap_matched"), share("n_disclosive_correct", "n_disclosive").alias("tcap_conditional"),
        "n_certain", "n_disclosive_correct", "n_disclosive", "n_matched", "n_unmatched", "baseline",
    )
    return MeasureResult(summary, records)


def weap(released: DataFrame, id_col: str, keys: Sequence[str], target: str, *, na_rm: bool = True) -> MeasureResult:
    """Attribution within the released table; a numeric target is not binned."""
    y = complete(released, [*keys, target], na_rm).withColumn("_t", F.col(target))
    cells, per = _per_key(y, keys)
    scored = key_join(cells, per, keys, "inner", na_rm).withColumn("weap", F.col("n_kt") / F.col("n_k"))
    records = key_join(y.select(id_col, *keys, "_t"), scored.select(*keys, "_t", "weap"), [*keys, "_t"], "inner", na_rm)
    n = F.sum("n_kt")
    summary = scored.agg(
        (F.sum(F.col("n_kt") * F.col("weap")) / n).alias("weap_mean"),
        F.sum(F.when(F.col("weap") == 1, F.col("n_kt")).otherwise(0)).alias("n_disclosive"),
        (100 * F.sum(F.when(F.col("weap") == 1, F.col("n_kt")).otherwise(0)) / n).alias("pct_disclosive"),
    ).join(per.agg(F.count(F.lit(1)).alias("n_unique_keys"))).join(records.agg(F.median("weap").alias("weap_median")))
    groups = per.select(*keys, F.col("n_k").alias("size"), F.col("n_t").alias("n_unique_targets"), (F.col("n_t") == 1).alias("is_disclosive"))
    return MeasureResult(summary.select("weap_mean", "weap_median", "n_disclosive", "pct_disclosive", "n_unique_keys"), records.select(id_col, "weap"), groups)


def disco(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], target: str, *, na_rm: bool = True) -> MeasureResult:
    """Disclosive correct matches per released record, potential and certain."""
    x, y = _prepared(original, released, keys, target, None, na_rm)
    cells, per = _per_key(x, keys)
    scored = key_join(y.select(id_col, *keys, "_t"), per.select(*keys, (F.col("n_t") == 1).alias("one")), keys, "left", na_rm)
    scored = key_join(scored, cells.select(*keys, "_t", F.lit(True).alias("hit")), [*keys, "_t"], "left", na_rm)
    potential = F.coalesce("hit", F.lit(False))
    records = scored.select(
        id_col, *keys, "_t", F.col("one").isNotNull().alias("key_match"), potential.alias("potential"),
        (potential & F.coalesce("one", F.lit(False))).alias("certain"),
    )
    certain = records.filter("certain").select(*keys, "_t").distinct()
    disclosed = key_join(x.select(*keys, "_t"), certain, [*keys, "_t"], "left_semi", na_rm)
    shares = x.groupBy("_t").agg(F.count(F.lit(1)).alias("n"))
    total = shares.agg(F.sum("n").alias("n_original"), (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("sum_sq"))
    found = records.agg(
        F.count(F.lit(1)).alias("n_synthetic"), F.count_if("potential").alias("n_disco_potential"),
        F.count_if("certain").alias("n_disco_certain"), F.count_if("key_match").alias("n_key_matches"),
    ).join(total).join(disclosed.agg(F.count(F.lit(1)).alias("n_originals_disclosed")))
    base = F.col("n_key_matches") * F.col("sum_sq")
    summary = found.select(
        "n_disco_potential", "n_disco_certain", "n_key_matches", "n_originals_disclosed", "n_synthetic", "n_original",
        F.try_divide(100 * F.col("n_disco_potential"), F.col("n_synthetic")).alias("pct_disco_potential"),
        F.try_divide(100 * F.col("n_disco_certain"), F.col("n_synthetic")).alias("pct_disco_certain"),
        F.try_divide(100 * F.col("n_originals_disclosed"), F.col("n_original")).alias("pct_original_disclosed"),
        base.alias("baseline_disco"), safe_div(F.col("n_disco_potential"), base).alias("disco_ratio"),
    )
    return MeasureResult(summary, records)


def rapid_linear(
    original: DataFrame, released: DataFrame, id_col: str, key: str, target: str, *,
    num_epsilon: float = 10.0, metric: str = "symmetric", delta: float = 0.01,
) -> MeasureResult:
    """Share of originals whose numeric target a line fitted on the released
    table predicts within ``num_epsilon`` (per cent, or units for ``absolute``)."""
    x, y = (complete(df, [key, target]) for df in (original, released))
    line = y.agg(F.regr_slope(target, key).alias("slope"), F.regr_intercept(target, key).alias("intercept"))
    scored = x.select(id_col, F.col(key).cast("double").alias("k"), F.col(target).cast("double").alias("a")).join(F.broadcast(line))
    b = F.col("intercept") + F.col("slope") * F.col("k")
    gap = F.abs(F.col("a") - b)
    error = {
        "symmetric": 200 * gap / (F.abs("a") + F.abs(b) + 2 * delta),
        "stabilised_relative": 100 * gap / (F.abs("a") + delta),
        "absolute": gap,
    }[metric]
    records = scored.select(id_col, "a", b.alias("predicted"), error.alias("error")).withColumn("at_risk", F.col("error") < num_epsilon)
    n, hit = F.count(F.lit(1)), F.count_if("at_risk")
    summary = records.agg(
        F.try_divide(hit, n).alias("rapid"), hit.alias("n_at_risk"), F.try_divide(100 * hit, n).alias("pct_at_risk"), n.alias("n_records"),
        F.avg(F.abs(F.col("a") - F.col("predicted"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("a") - F.col("predicted"), 2))).alias("rmse"),
    )
    level = F.when(F.col("rapid") < 0.05, "LOW").when(F.col("rapid") < 0.15, "MEDIUM").otherwise("HIGH")
    return MeasureResult(summary.withColumn("risk_level", level), records)


def gower_scores(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], target: str, *, threshold: float = 0.1, cont_bins: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """(id, cap, n_matches, one_target) with matches by Gower distance on the
    keys of at most ``threshold``, and the baseline."""
    x, y = _prepared(original, released, keys, target, cont_bins, True)
    spans = ranges([x, y], keys)
    tables = [vectors(d, id_col, keys, spans).join(d.select(F.col(id_col).cast("bigint").alias("id"), F.col("_t").alias("t")), "id") for d in (x, y)]
    found = within(*tables, threshold, category_weights(keys, spans))
    records = found.select("id", F.when(F.col("n") > 0, F.col("n_same") / F.nullif(F.col("n"), F.lit(0))).alias("cap"), F.col("n").alias("n_matches"), "one_target")
    return records, _baseline(y)


def cap_gower(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], target: str, *, threshold: float = 0.1, cont_bins: int = 10) -> MeasureResult:
    """Correct attribution and its targeted variants under near key matches.

    Here a match is certain if all its matches share one target, the true one;
    uniqueness among originals does not enter.
    """
    records, baseline = gower_scores(original, released, id_col, keys, target, threshold=threshold, cont_bins=cont_bins)
    found = records.agg(
        F.avg("cap").alias("cap"), F.median("cap").alias("cap_median"), F.count("cap").alias("n_matched"), F.count_if(F.col("n_matches") == 0).alias("n_unmatched"),
        F.count_if(F.col("one_target") & (F.col("cap") == 1)).alias("n_certain"), F.count_if("one_target").alias("n_disclosive"),
    )
    summary = found.join(baseline).select("cap", "cap_median", (F.col("cap") - F.col("baseline")).alias("dcap"), "n_matched", "n_unmatched", "n_certain", "n_disclosive", "baseline")
    return MeasureResult(summary, records)


def disco_gower(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], target: str, *, threshold: float = 0.1) -> MeasureResult:
    """Disclosive matches of released records under near key matches."""
    records, _ = gower_scores(released, original, id_col, keys, target, threshold=threshold, cont_bins=None)
    records = records.select("id", (F.col("cap") > 0).alias("potential"), (F.col("one_target") & (F.col("cap") == 1)).alias("certain"))
    n = F.count(F.lit(1))
    summary = records.agg(
        F.count_if(F.coalesce("potential", F.lit(False))).alias("n_disco_potential"), F.count_if(F.coalesce("certain", F.lit(False))).alias("n_disco_certain"), n.alias("n_synthetic")
    )
    return MeasureResult(summary, records)
