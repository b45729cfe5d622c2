"""Model-based measures; most have no SQL, those with a closed form do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density as Y, frameworks as W, models as M
from ..operators.common import scalar_row
from ..sources.pair import ReleasePair
from .pairs import CUST, LINE, ORD, PART, rounded

_KEYS = ("c_nationkey", "c_mktsegment")


def _catx(s, d):
    """Orders with a categorical target; every tenth released row copies an original."""
    return [f.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus") for f in ORD.frames(s, d)]


def _rapid_cat(s, d, **k):
    return M.rapid(*_catx(s, d), "o_orderkey", ("o_orderpriority", "o_totalprice"), "o_orderstatus", **k)


def _report(s, d):
    x, y, h = CUST.three(s, d)
    pair = ReleasePair(x, y, "c_custkey", keys=list(_KEYS), target="c_acctbal", cols=["c_nationkey", "c_acctbal", "c_mktsegment"], holdout=h)
    return rounded(W.disclosure_report(pair)[0])


def _releases(s, d):
    df = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    x = df.filter(F.col("o_orderkey") % 4 == 0)
    releases = {
        "independent": df.filter(F.col("o_orderkey") % 4 == 1),
        "copy": x,
        "noisy": x.withColumn("o_totalprice", F.col("o_totalprice") * (0.9 + 0.2 * (F.col("o_orderkey") % 5) / 4)),
        "shifted": df.filter(F.col("o_orderkey") % 4 == 3).withColumn("o_totalprice", F.col("o_totalprice") + 50000),
    }
    roles = {"keys": ["o_orderstatus", "o_orderpriority"], "target": "o_totalprice", "cols": ["o_orderstatus", "o_orderpriority", "o_totalprice"]}
    return x, releases, roles


def _rumap(s, d):
    x, releases, roles = _releases(s, d)
    return rounded(W.rumap(x, releases, "o_orderkey", **roles))


def _reliability(s, d):
    x, releases, roles = _releases(s, d)
    return rounded(W.reliability(W.release_scores(x, releases, "o_orderkey", **roles)))


def _synth(df):
    return df.withColumn("o_totalprice", F.col("o_totalprice") * 1.01)


def _subgroup(s, d):
    from ..operators.distributions import compare_ks

    return rounded(M.subgroup_utility(*ORD.frames(s, d), "o_orderstatus", lambda a, b: 1 - compare_ks(a, b, "o_totalprice").first().ks_statistic, threshold=0.97))


_PK = ("p_brand", "p_type", "p_size")
QUERIES = {
    "rapid_rf_categorical": lambda s, d: rounded(_rapid_cat(s, d, cat_eval="marginal", cat_tau=0.3).summary),
    "rapid_logit": lambda s, d: rounded(_rapid_cat(s, d, model="logit").summary),
    "rapid_cart_numeric": lambda s, d: rounded(M.rapid(*PART.frames(s, d), "p_partkey", _PK, "p_retailprice", model="cart").summary),
    "rapid_gbm": lambda s, d: rounded(M.rapid(*PART.frames(s, d), "p_partkey", ("p_size",), "p_retailprice", model="gbm").summary),
    "rapid_confint": lambda s, d: rounded(M.rapid_confint(M.rapid(*LINE.frames(s, d), "l_orderkey", ("l_quantity",), "l_extendedprice", model="lm").summary)),
    "rapid_missing_median": lambda s, d: rounded(M.rapid(*[f.withColumn("l_extendedprice", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_extendedprice"))) for f in LINE.frames(s, d)], "l_orderkey", ("l_quantity",), "l_extendedprice", model="lm", na_strategy="median").summary.drop("fit")),
    "rapid_missing_constant": lambda s, d: rounded(M.rapid(*[f.withColumn("l_extendedprice", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_extendedprice"))) for f in LINE.frames(s, d)], "l_orderkey", ("l_quantity",), "l_extendedprice", model="lm", na_strategy="constant", na_constant=1000.0).summary.drop("fit")),
    "rapid_bootstrap": lambda s, d: rounded(M.rapid_bootstrap(M.rapid(*CUST.frames(s, d), "c_custkey", _KEYS, "c_acctbal", model="lm").records, "c_custkey", n_boot=50)),
    "rapid_test": lambda s, d: rounded(M.rapid_test(_rapid_cat(s, d, cat_eval="marginal", cat_tau=0.3).records, "o_orderkey", n_permutations=19)),
    "rapid_threshold_curve": lambda s, d: rounded(M.threshold_curve(_rapid_cat(s, d, cat_eval="marginal").records, [k / 20 for k in range(1, 20)])),
    "rapid_contributions": lambda s, d: rounded(M.rapid_contributions(*PART.frames(s, d), "p_partkey", _PK, "p_retailprice", model="lm")),
    "rapid_cross_validation": lambda s, d: rounded(M.rapid_cross_validation(_catx(s, d)[0], _synth, "o_orderkey", ("o_orderpriority", "o_orderstatus"), "o_totalprice", k=3, model="lm")),
    "rapid_risk_factors": lambda s, d: rounded(M.risk_factors(M.rapid(*PART.frames(s, d), "p_partkey", _PK, "p_retailprice", model="lm").records, _PK)),
    "pmse_logit": lambda s, d: rounded(M.pmse(*PART.frames(s, d), "p_partkey", _PK).summary),
    "specks_cart": lambda s, d: rounded(M.pmse(*PART.frames(s, d), "p_partkey", _PK, model="cart").summary),
    "propscore_rf": lambda s, d: rounded(M.pmse(*CUST.frames(s, d), "c_custkey", ("c_nationkey", "c_acctbal", "c_mktsegment"), model="rf").summary),
    "tstr_glm": lambda s, d: rounded(M.tstr(*LINE.frames(s, d), "l_orderkey", ("l_quantity",), "l_extendedprice").summary),
    "tstr_auc": lambda s, d: rounded(M.tstr(*_catx(s, d), "o_orderkey", ("o_totalprice", "o_orderpriority"), "o_orderstatus").summary),
    "mia_classifier": lambda s, d: rounded(M.mia_classifier(*(CUST.three(s, d)[k] for k in (0, 1, 2)), "c_custkey", ("c_nationkey", "c_acctbal", "c_mktsegment"))),
    "rf_privacy": lambda s, d: rounded(M.rf_privacy(*CUST.three(s, d), "c_custkey", ("c_nationkey", "c_acctbal", "c_mktsegment"), trees=10).summary),
    "individual_risk_model": lambda s, d: rounded(M.poisson_individual_risk(CUST.frames(s, d)[1], "c_custkey", _KEYS).summary),
    "model_quality": lambda s, d: rounded(M.model_quality(*PART.frames(s, d), "p_partkey", ("p_size", "p_type"), "p_retailprice", kinds=("lm", "cart"))),
    "feature_importance": lambda s, d: rounded(M.feature_importance(*PART.frames(s, d), _PK, "p_retailprice")),
    "permutation_importance": lambda s, d: rounded(M.permutation_importance(PART.frames(s, d)[0], "p_partkey", ("p_size", "p_type"), "p_retailprice", kind="lm")),
    "subgroup_utility": _subgroup,
    "density_difference": lambda s, d: rounded(Y.density_difference(*CUST.frames(s, d), "c_acctbal").summary),
    "density_kl_2d": lambda s, d: rounded(Y.density_kl_2d(*CUST.frames(s, d), ("c_acctbal", "c_nationkey"))),
    "density_kl_1d": lambda s, d: rounded(Y.density_kl(*CUST.frames(s, d), ("c_acctbal",))),
    "density_kl_3d": lambda s, d: rounded(Y.density_kl(*LINE.frames(s, d), LINE.num[:3], n_grid=20)),
    "robust_correlation": lambda s, d: rounded(scalar_row(s, r=float(Y.robust_correlation(CUST.frames(s, d)[0], CUST.num)[0, 1]))),
    "density_difference_pca": lambda s, d: rounded(Y.density_difference_pca(*LINE.frames(s, d), LINE.num)),
    "compare_pca": lambda s, d: rounded(Y.compare_pca(*LINE.frames(s, d), LINE.num)),
    "compare_embedding": lambda s, d: rounded(Y.compare_embedding(*CUST.frames(s, d), "c_custkey", CUST.num)),
    "robust_outliers": lambda s, d: Y.robust_outliers(CUST.frames(s, d)[0], "c_custkey", CUST.num).groupBy("outlier").count(),
    "dbscan_noise": lambda s, d: Y.dbscan_noise(CUST.frames(s, d)[0].withColumn("b", F.col("c_acctbal") / 500), "c_custkey", ("b", "c_nationkey"), eps=1.0).groupBy("core", "noise").agg(F.count(F.lit(1)).alias("n")),
    "ci_overlap_bootstrap": lambda s, d: rounded(Y.ci_overlap(*CUST.frames(s, d), "c_custkey", lambda f: f.agg(F.median("c_acctbal")).first()[0], rounds=5)),
    "mmd_rational_quadratic": lambda s, d: rounded(Y.mmd_exact(*CUST.frames(s, d), "c_custkey", CUST.num, kernel="rational_quadratic", sigma=1.0)),
    "compare_pca_pair": lambda s, d: rounded(Y.compare_pca(*CUST.frames(s, d), CUST.num).select("component", "variable", F.abs("loading_x").alias("size_x"), F.abs("loading_y").alias("size_y"), "explained_x", "explained_y")),
    "mmd_exact": lambda s, d: rounded(Y.mmd_exact(*CUST.frames(s, d), "c_custkey", CUST.num)),
    "histogram_divergence": lambda s, d: rounded(Y.mutual_information_distance(*CUST.frames(s, d), CUST.num)),
    "mahalanobis_between": lambda s, d: rounded(_mahalanobis(s, d)),
    "disclosure_report": _report,
    "risk_utility_map": _rumap,
    "measure_reliability": _reliability,
    "rapid_threshold_select": lambda s, d: rounded(M.rapid_threshold_select(_rapid_cat(s, d, cat_eval="marginal").records, "o_orderkey", [k / 20 for k in range(1, 20)], n_permutations=19)),
    "model_performance": lambda s, d: rounded(M.model_performance(*PART.frames(s, d), "p_partkey", ("p_size", "p_type"), "p_retailprice")),
}


def _mahalanobis(s, d):
    from ..operators.distributions import mahalanobis_between

    return scalar_row(s, distance=mahalanobis_between(*CUST.frames(s, d), CUST.num))


_Z = "((a.c_nationkey - b.c_nationkey) / sn) ** 2 + ((a.c_acctbal - b.c_acctbal) / sa) ** 2"


def _mmd_sql(kernel: str, sigma: str) -> str:
    """All pairs; the median distance is that of all pooled rows, which is what
    the operator's heuristic looks at as long as they are 2,000 at most."""
    mean = lambda a, b, on: f"(select avg({kernel}) from {a} a, {b} b, s, g{' where a.c_custkey <> b.c_custkey' if on else ''})"
    return f"""with {CUST.sql}, u as (select * from x union all select * from y), s as (select stddev_samp(c_nationkey) as sn, stddev_samp(c_acctbal) as sa from u), g as (select {sigma} as g),
      m as (select {mean('x', 'x', True)} + {mean('y', 'y', True)} - 2 * {mean('x', 'y', False)} as mmd2, g from g)
      select round(mmd2, 6) as mmd2, round(g, 6) as sigma, round(least(1, greatest(0, exp(-greatest(0, mmd2) / g ** 2))), 6) as utility_score from m"""


def _kl_sql(a: str, b: str, grid: int = 50) -> str:
    """Counts on the nearest grid points, smoothed by a product kernel, over all pairs of grid points."""
    cell = lambda c: f"least({grid - 1}, greatest(0, round(({c} - lo_{c}) / st_{c})))::int"
    width = lambda c: f"0.9 * least(stddev_samp({c}), (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.34) * pow(count(*), -0.2) as h_{c}"
    axis = lambda c: f"min({c})::double as lo_{c}, (max({c}) - min({c}))::double / {grid - 1} as st_{c}"
    one = lambda s: f"""h{s} as (select {width(a)}, {width(b)} from {s}), m{s} as (select {cell(a)} as i, {cell(b)} as j, count(*) as n from {s}, ax group by 1, 2),
      d{s} as (select g.i, g.j, greatest(1e-300, sum(n * exp(-0.5 * (st_{a} * (g.i - m.i) / h_{a}) ** 2) * exp(-0.5 * (st_{b} * (g.j - m.j) / h_{b}) ** 2))) as v from g, m{s} m, h{s}, ax group by 1, 2)"""  # noqa: E731
    return f"""with {CUST.sql}, ax as (select {axis(a)}, {axis(b)} from (select * from x union all select * from y)), g as (select i, j from range({grid}) p(i), range({grid}) q(j)), {one('x')}, {one('y')}
      select round(sum(p * ln(p / q)), 6) as kl from (select dx.v / (select sum(v) from dx) as p, dy.v / (select sum(v) from dy) as q from dx join dy using (i, j))"""


def _kl1_sql(c: str, grid: int = 50) -> str:
    """The same in one dimension."""
    one = lambda s: f"""h{s} as (select 0.9 * least(stddev_samp({c}), (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.34) * pow(count(*), -0.2) as h from {s}),
      m{s} as (select least({grid - 1}, greatest(0, round(({c} - lo) / st)))::int as i, count(*) as n from {s}, ax group by 1),
      d{s} as (select g.i, greatest(1e-300, sum(n * exp(-0.5 * (st * (g.i - m.i) / h) ** 2))) as v from g, m{s} m, h{s}, ax group by 1)"""  # noqa: E731
    return f"""with {CUST.sql}, ax as (select min({c})::double as lo, (max({c}) - min({c}))::double / {grid - 1} as st from (select * from x union all select * from y)), g as (select i from range({grid}) p(i)), {one('x')}, {one('y')}
      select round(sum(p * ln(p / q)), 6) as kl from (select dx.v / (select sum(v) from dx) as p, dy.v / (select sum(v) from dy) as q from dx join dy using (i))"""


_U = "('0x' || substr(md5(l_orderkey::varchar || ':1'), 1, 8))::bigint / 4294967296.0"
TSTR_SQL = f"""with {LINE.sql}, t as (select * from x where {_U} < 0.3), r as (select * from x where {_U} >= 0.3),
  f as (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from y), g as (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from r),
  v as (select (select greatest(0, 1 - sum((l_extendedprice - i - s * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*))) from t, f) as a, (select greatest(0, 1 - sum((l_extendedprice - i - s * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*))) from t, g) as b)
  select round(a, 6) as tstr_performance, round(b, 6) as trtr_performance, case when b > 1e-10 then round(a / b, 6) else 'nan'::double end as tstr_ratio,
    case when b > 1e-10 then round(least(1, greatest(0, a / b)), 6) else 'nan'::double end as utility_score, 'r2' as metric from v"""
DBSCAN_SQL = f"""with {CUST.sql}, r as (select c_custkey as id, c_acctbal / 500 as b, c_nationkey as k from x), p as (select a.id, o.id as oid from r a, r o where (a.b - o.b) ** 2 + (a.k - o.k) ** 2 <= 1),
  n as (select id, count(*) >= 5 as core from p group by 1), z as (select distinct p.id from p join n on p.oid = n.id where core)
  select core, z.id is null as noise, count(*) as n from n left join z using (id) group by 1, 2"""
_CORR = lambda s: f"(select corr(c_nationkey, c_acctbal) from {s})"
PCA_SQL = f"""with {CUST.sql} select component, variable, round(sqrt(0.5), 6) as size_x, round(sqrt(0.5), 6) as size_y, round((1 + sign * abs({_CORR('x')})) / 2, 6) as explained_x, round((1 + sign * abs({_CORR('y')})) / 2, 6) as explained_y
  from (select unnest([1, 2])::bigint as component), (select unnest(['c_nationkey', 'c_acctbal']) as variable), lateral (select case component when 1 then 1 else -1 end as sign)"""

SUBGROUP_SQL = f"""with {ORD.sql}, v as (select o_orderstatus as g, o_totalprice as v, sum(a)::double as a, sum(b)::double as b from (select o_orderstatus, o_totalprice, 1 as a, 0 as b from x union all select o_orderstatus, o_totalprice, 0, 1 from y) group by all),
  c as (select *, sum(a) over (partition by g order by v) / sum(a) over (partition by g) as fa, sum(b) over (partition by g order by v) / sum(b) over (partition by g) as fb from v),
  k as (select g, max(abs(fa - fb)) as ks, sum(a) as n_x, sum(b) as n_y from c group by g)
  select g as "group", n_x::bigint as n_x, n_y::bigint as n_y, round(1 - ks, 6) as score, 1 - ks < 0.97 as flagged from k where least(n_x, n_y) >= 5"""


def _missing_sql(fill: str) -> str:
    """Every fourth line's price is null and filled before the fit and the judgement."""
    return f"""with {LINE.sql}, p as (select l_quantity as q, case when l_linenumber % 4 <> 0 then l_extendedprice end as t from x), q as (select l_quantity as q, case when l_linenumber % 4 <> 0 then l_extendedprice end as t from y),
      a as (select q, coalesce(t, {fill.format('p')}) as t from p), b as (select q, coalesce(t, {fill.format('q')}) as t from q), l as (select regr_slope(t, q) as s, regr_intercept(t, q) as i from b),
      r as (select count(*) as n, count(*) filter (200 * abs(t - (i + s * q)) / (abs(t) + abs(i + s * q) + 0.02) < 10) as k from a, l)
      select round(k / n, 6) as rapid, k as n_at_risk, round(100 * k / n, 6) as pct_at_risk, n as n_records from r"""


_MARGIN = "count(*) over (partition by c_nationkey) * count(*) over (partition by c_mktsegment) / count(*) over ()"
_BIN = lambda c, s: f"least(10, greatest(1, ceil(round(({c} - (select min({c}) from {s})) / (((select max({c}) from {s}) - (select min({c}) from {s})) / 10.0), 9))))::int"
SQL = {
    "mmd_exact": _mmd_sql(f"exp(-({_Z}) / (2 * g * g))", f"(select median(sqrt({_Z})) from u a, u b, s where a.c_custkey < b.c_custkey)"),
    "mmd_rational_quadratic": _mmd_sql(f"1 / (1 + ({_Z}) / (2 * g * g))", "1.0::double"),
    "subgroup_utility": SUBGROUP_SQL, "density_kl_1d": _kl1_sql("c_acctbal"), "rapid_missing_median": _missing_sql("(select median(t) from {})"), "rapid_missing_constant": _missing_sql("1000.0"),
    "density_kl_2d": _kl_sql("c_acctbal", "c_nationkey"), "tstr_glm": TSTR_SQL, "dbscan_noise": DBSCAN_SQL, "compare_pca_pair": PCA_SQL,
    "individual_risk_model": f"with {CUST.sql}, f as (select greatest(1, {_MARGIN}) as m from y) select round(avg(1 / m), 6) as mean_risk, round(max(1 / m), 6) as max_risk, count(*) filter (1 / m > 0.1) as n_high_risk, count(*) as n_records from f",
    "histogram_divergence": f"""with {CUST.sql}, b as (select i, j, sum(o)::double as o, sum(r)::double as r from (select {_BIN('c_nationkey', 'x')} as i, {_BIN('c_acctbal', 'x')} as j, 1 as o, 0 as r from x
      union all select {_BIN('c_nationkey', 'y')}, {_BIN('c_acctbal', 'y')}, 0, 1 from y) group by all), n as (select o / sum(o) over () as p, r / sum(r) over () as q from b)
      select round(0.5 * sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end) + 0.5 * sum(case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end), 6) as distance from n""",
    "mahalanobis_between": f"""with {CUST.sql}, m as (select avg(c_nationkey) as a, avg(c_acctbal) as b, var_samp(c_nationkey) as va, var_samp(c_acctbal) as vb, covar_samp(c_nationkey, c_acctbal) as c, count(*) as n from x),
      k as (select avg(c_nationkey) as a, avg(c_acctbal) as b, var_samp(c_nationkey) as va, var_samp(c_acctbal) as vb, covar_samp(c_nationkey, c_acctbal) as c, count(*) as n from y),
      p as (select ((m.n - 1) * m.va + (k.n - 1) * k.va) / (m.n + k.n - 2) as va, ((m.n - 1) * m.vb + (k.n - 1) * k.vb) / (m.n + k.n - 2) as vb, ((m.n - 1) * m.c + (k.n - 1) * k.c) / (m.n + k.n - 2) as c, m.a - k.a as da, m.b - k.b as db from m, k)
      select round(sqrt((vb * da * da - 2 * c * da * db + va * db * db) / (va * vb - c * c)), 6) as distance from p""",
    "rapid_confint": f"""with {LINE.sql}, l as (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from y),
      r as (select count(*) as n, count(*) filter (200 * abs(l_extendedprice - (i + s * l_quantity)) / (abs(l_extendedprice) + abs(i + s * l_quantity) + 0.02) < 10) / count(*) as p from x, l),
      z as (select *, 1.959963984540054 as z from r)
      select round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) as lower, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) as upper from z""",
}
