"""Distance-based risk on customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distance as D
from ..operators.common import quantiles
from .pairs import CUST, LINE, PART, rounded

_COLS = ("c_nationkey", "c_acctbal", "c_mktsegment")


def _rng(sides: str) -> str:
    pool = " union all ".join(f"select * from {s}" for s in sides)
    return f"rg as (select (max(c_acctbal) - min(c_acctbal))::double as ra, (max(c_nationkey) - min(c_nationkey))::double as rn from ({pool}))"


_GOWER = "round((abs(a.c_nationkey - b.c_nationkey) / rn + abs(a.c_acctbal - b.c_acctbal) / ra + (a.c_mktsegment <> b.c_mktsegment)::int) / 3, 9)"

#: Twelve decimals, as the operator rounds: a ratio of distances magnifies what nine leave off.
_FINE = _GOWER.replace(", 9)", ", 12)")


def _d(name: str, a: str, b: str, own: bool = False, dist: str = _GOWER) -> str:
    return f"{name} as (select a.c_custkey as id, b.c_custkey as rid, {dist} as d from {a} a, {b} b, rg {'where a.c_custkey <> b.c_custkey' if own else ''})"


def _euclid(cols: tuple[str, ...]) -> str:
    return "round(sqrt(" + " + ".join(f"((a.{c} - b.{c}) / {r}) ** 2" for c, r in zip(cols, ("rn", "ra"), strict=False)) + "), 9)"


def dcr_sql(dist: str) -> str:
    return f"""with {CUST.sql3}, {_rng('tyh')}, {_d('p', 'y', 't', dist=dist)}, {_d('q', 'y', 'h', dist=dist)}, m as (select * from (select id, min(d) as a from p group by id) join (select id, min(d) as b from q group by id) using (id))
      select round(avg(a), 6) as mean_dcr_train, round(avg(b), 6) as mean_dcr_holdout, round(median(a), 6) as median_dcr_train, round(median(b), 6) as median_dcr_holdout, round(avg(a) / avg(b), 6) as dcr_ratio,
        round(avg((a < b)::int), 6) as dcr_share, count(*) as n_synthetic from m"""


_TWO = "(select id, case when list_min(d) = 0 then 0 else list_sort(d)[1] / nullif(list_sort(d)[2], 0) end as r from (select id, list(d) as d from {} group by id))"
NNDR_SQL = f"""with {CUST.sql3}, {_rng('tyh')}, {_d('p', 'y', 't', dist=_FINE)}, {_d('q', 'y', 'h', dist=_FINE)}, m as (select a.r as a, b.r as b from {_TWO.format('p')} a join {_TWO.format('q')} b using (id))
  select round(avg(a), 6) as mean_nndr_train, round(avg(b), 6) as mean_nndr_holdout, round(median(a), 6) as median_nndr_train, round(median(b), 6) as median_nndr_holdout, round(quantile_cont(a, 0.05), 6) as p5_train,
    round(quantile_cont(b, 0.05), 6) as p5_holdout, round(quantile_cont(a, 0.1), 6) as p10_train, round(quantile_cont(b, 0.1), 6) as p10_holdout, round(quantile_cont(a, 0.05) / quantile_cont(b, 0.05), 6) as nndr_ratio,
    count(*) filter (a < 0.1) as n_suspicious, round(100.0 * count(*) filter (a < 0.1) / count(*), 6) as pct_suspicious from m"""
_HIT = f"with {CUST.sql}, {_rng('xy')}, {_d('p', 'y', 'x')}, m as (select id, min(d) as d from p group by id)"


def _side(n: str, a: str, b: str) -> str:
    return f"{_d('c' + n, a, b)}, {_d('o' + n, a, a, True)}, s{n} as (select avg((c.d > o.d)::int) as v from (select id, min(d) as d from c{n} group by id) c join (select id, min(d) as d from o{n} group by id) o using (id))"


NNAA_SQL = f"""with {CUST.sql3}, {_rng('tyh')}, {_side('1', 't', 'y')}, {_side('2', 'y', 't')}, {_side('3', 'h', 'y')}, {_side('4', 'y', 'h')}, v as (select (select v from s1) as a, (select v from s2) as b, (select v from s3) as c, (select v from s4) as e)
  select round(a, 6) as aa_train_left, round(b, 6) as aa_train_right, round(c, 6) as aa_holdout_left, round(e, 6) as aa_holdout_right, round((a + b) / 2, 6) as aa_train, round((c + e) / 2, 6) as aa_holdout,
    round((c + e) / 2 - (a + b) / 2, 6) as privacy_loss, (c + e) / 2 - (a + b) / 2 <= 0.1 as privacy_pass from v"""
DOMIAS_SQL = f"""with {CUST.sql3}, {_rng('tyh')}, {_d('p1', 't', 'y')}, {_d('p2', 't', 'h')}, {_d('p3', 'h', 'y')}, {_d('p4', 'h', 'h', True)},
  a as (select round((s + 1) / (r + 1), 12) as v from (select id, count(*) filter (d <= 0.1 + 1e-9) as s from p1 group by id) join (select id, count(*) filter (d <= 0.1 + 1e-9) as r from p2 group by id) using (id)),
  b as (select round((s + 1) / (r + 1), 12) as v from (select id, count(*) filter (d <= 0.1 + 1e-9) as s from p3 group by id) join (select id, count(*) filter (d <= 0.1 + 1e-9) as r from p4 group by id) using (id)),
  u as (select avg(case when a.v > b.v then 1 when a.v = b.v then 0.5 else 0 end) as auc from a, b)
  select round(auc, 6) as auc, round((select avg(v) from a), 6) as mean_ratio_train, round((select avg(v) from b), 6) as mean_ratio_holdout, round((select avg(v) from a) / (select avg(v) from b), 6) as memorization_score,
    (select count(*) from a) as n_train, (select count(*) from b) as n_holdout, auc <= 0.6 as privacy_pass from u"""


def _near(name: str, a: str, dist: str, rg: str) -> str:
    return f"{name} as (select id, min_by(rid, (d, rid)) as n from (select a.c_custkey as id, b.c_custkey as rid, {dist} as d from {a} a, y b, {rg}) group by id)"


_AUX, _SEC = "round((abs(a.c_acctbal - b.c_acctbal) / ra + (a.c_mktsegment <> b.c_mktsegment)::int) / 2, 12)", "round(abs(a.c_nationkey - b.c_nationkey) / rn, 12)"
_RT, _RH = _rng("ty").replace("rg as", "rt as"), _rng("hy").replace("rg as", "rh as")
LINK_SQL = f"""with {CUST.sql3}, {_RT}, {_RH}, {_near('a1', 't', _AUX, 'rt')}, {_near('b1', 't', _SEC, 'rt')}, {_near('a2', 'h', _AUX, 'rh')}, {_near('b2', 'h', _SEC, 'rh')},
  v as (select (select count(*) from t) as n, (select count(*) from a1 join b1 using (id) where a1.n = b1.n) as k, (select count(*) from h) as nh, (select count(*) from a2 join b2 using (id) where a2.n = b2.n) as kh)
  select round(k / n, 6) as risk_attack, round(kh / nh, 6) as risk_control, n as n_attacks, k as n_success, kh as n_control_success, round(greatest(0, (k / n - kh / nh) / (1 - kh / nh)), 6) as risk from v"""
def _three_nearest(name: str, a: str, dist: str, rg: str) -> str:
    return f"{name} as (select id, rid as n from (select id, rid, row_number() over (partition by id order by d, rid) as rk from (select a.c_custkey as id, b.c_custkey as rid, {dist} as d from {a} a, y b, {rg})) where rk <= 3)"


LINK3_SQL = LINK_SQL.replace(_near('b1', 't', _SEC, 'rt'), _three_nearest('b1', 't', _SEC, 'rt')).replace(_near('b2', 'h', _SEC, 'rh'), _three_nearest('b2', 'h', _SEC, 'rh'))
SINGLE_SQL = f"""with {CUST.sql3}, m as (select median(c_acctbal) as ma, median(c_nationkey) as mn from y), g as (select y.*, ma, mn from y, m),
  f as (select g.c_custkey as id, (select count(*) from t where t.c_mktsegment = g.c_mktsegment and case when g.c_acctbal > ma then t.c_acctbal >= g.c_acctbal else t.c_acctbal <= g.c_acctbal end and case when g.c_nationkey > mn then t.c_nationkey >= g.c_nationkey else t.c_nationkey <= g.c_nationkey end) as a,
    (select count(*) from h where h.c_mktsegment = g.c_mktsegment and case when g.c_acctbal > ma then h.c_acctbal >= g.c_acctbal else h.c_acctbal <= g.c_acctbal end and case when g.c_nationkey > mn then h.c_nationkey >= g.c_nationkey else h.c_nationkey <= g.c_nationkey end) as b from g),
  v as (select count(*) as n, count(*) filter (a = 1) as k, count(*) filter (b = 1) as kc from f)
  select n as n_attacks, k as n_success, kc as n_control_success, round(k / n, 6) as risk_attack, round(kc / n, 6) as risk_control, round(greatest(0, (k / n - kc / n) / (1 - kc / n)), 6) as risk from v"""


def _draws_sql(n_cols: int) -> str:
    """Each attack uses the columns with the smallest digests."""
    digest = lambda c: f"md5(g.c_custkey::varchar || ':{c}:1')"
    skip = lambda c: f"(({' + '.join(f'({digest(o)} < {digest(c)})::int' for o in _COLS if o != c)}) >= {n_cols})"
    out = SINGLE_SQL
    for t in "th":
        out = out.replace(f"{t}.c_mktsegment = g.c_mktsegment", f"({skip('c_mktsegment')} or {t}.c_mktsegment = g.c_mktsegment)")
        for c, m in (("c_acctbal", "ma"), ("c_nationkey", "mn")):
            case = f"case when g.{c} > {m} then {t}.{c} >= g.{c} else {t}.{c} <= g.{c} end"
            out = out.replace(case, f"({skip(c)} or {case})")
    return out


def _singling(s, d, **params):
    """Every released customer is an attack."""
    t, y, h = CUST.three(s, d)
    med = {c: quantiles(y, c, [0.5])[0] for c in ("c_acctbal", "c_nationkey")}
    return rounded(D.singling_out(t, h, y, "c_custkey", _COLS, med, **params).summary.select("n_attacks", "n_success", "n_control_success", "risk_attack", "risk_control", "risk"))


def _perturbed(s, d):
    df = s.read.parquet(f"{d}/customer.parquet")
    moved = df.withColumns({"c_acctbal": F.col("c_acctbal") + (F.col("c_custkey") % 7 - 3) * 10, "c_nationkey": F.when(F.col("c_custkey") % 10 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))})
    return df, moved


RLNK = "x as (select * from customer), y as (select c_custkey, c_acctbal + (c_custkey % 7 - 3) * 10 as c_acctbal, c_nationkey + (c_custkey % 10 = 0)::int as c_nationkey, c_mktsegment from customer)"
_PNUM = ("p_size", "p_retailprice")
DRISK_SQL = f"""with {PART.sql}, w as (select count(*) as n, {', '.join(f'0.01 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / pow(2 * count(*), 1 / 3) as w_{c}' for c in ('p_size', 'p_retailprice'))} from x),
  r as (select count(*) as k from x, w where exists (select 1 from y where {' and '.join(f'abs(x.{c} - y.{c}) <= w_{c}' for c in _PNUM)})) select round(k / n, 6) as drisk_interval, k as n_at_risk, n as n_original from r, w"""
_ED = "sqrt(((a.c_nationkey - b.c_nationkey) / sn) ** 2 + ((a.c_acctbal - b.c_acctbal) / sa) ** 2)"
ENERGY_SQL = f"""with {CUST.sql}, s as (select stddev_samp(c_nationkey) as sn, stddev_samp(c_acctbal) as sa from (select * from x union all select * from y)),
  v as (select (select avg({_ED}) from x a, y b, s) as xy, (select avg({_ED}) from x a, x b, s where a.c_custkey <> b.c_custkey) as xx, (select avg({_ED}) from y a, y b, s where a.c_custkey <> b.c_custkey) as yy)
  select round(xy, 6) as mean_dist_xy, round(xx, 6) as mean_dist_xx, round(yy, 6) as mean_dist_yy, round(greatest(0, 2 * xy - xx - yy), 6) as energy_distance, round(greatest(0, 2 * xy - xx - yy) / ((xx + yy) / 2), 6) as energy_distance_normalized,
    round(exp(-greatest(0, 2 * xy - xx - yy)), 6) as utility_score from v"""


def _entropy_sql() -> str:
    def h(col: str, num: bool) -> str:
        level = f"least(20, greatest(1, ceil(round(({col} - (select min({col}) from x)) / (((select max({col}) from x) - (select min({col}) from x)) / 20.0), 9))))" if num else col
        return f"(select ln(sum(n)) - sum(n * ln(n)) / sum(n) from (select count(*) as n from x group by {level}))"

    dist = "round(((1 / hn) * abs(a.c_nationkey - b.c_nationkey) / rn + (1 / ha) * abs(a.c_acctbal - b.c_acctbal) / ra + (1 / hm) * (a.c_mktsegment <> b.c_mktsegment)::int) / (1 / hn + 1 / ha + 1 / hm), 9)"
    return f"""with {CUST.sql}, {_rng('xy')}, e as (select {h('c_nationkey', True)} as hn, {h('c_acctbal', True)} as ha, {h('c_mktsegment', False)} as hm),
      p as (select a.c_custkey as id, min({dist}) as d from y a, x b, rg, e group by 1)
      select round(avg((d < 0.05)::int), 6) as identifiability_rate, count(*) filter (d < 0.05) as n_flagged, count(*) as n_synthetic, round(avg(d), 6) as mean_distance from p"""


QUERIES = {
    "dcr_gower": lambda s, d: rounded(D.dcr(*CUST.three(s, d), "c_custkey", _COLS).summary),
    "dcr_euclidean": lambda s, d: rounded(D.dcr(*CUST.three(s, d), "c_custkey", CUST.num, method="euclidean").summary),
    "nndr_gower": lambda s, d: rounded(D.nndr(*CUST.three(s, d), "c_custkey", _COLS).summary),
    "hitting_rate": lambda s, d: rounded(D.hitting_rate(*CUST.frames(s, d), "c_custkey", _COLS).summary),
    "hitting_sweep": lambda s, d: rounded(D.hitting_sweep(D.hitting_rate(*CUST.frames(s, d), "c_custkey", _COLS).records)),
    "epsilon_identifiability": lambda s, d: rounded(D.epsilon_identifiability(*CUST.frames(s, d), "c_custkey", _COLS).summary),
    "nnaa": lambda s, d: rounded(D.nnaa(*CUST.three(s, d), "c_custkey", _COLS).summary),
    "domias": lambda s, d: rounded(D.domias(*CUST.three(s, d), "c_custkey", _COLS).summary),
    "linkability": lambda s, d: rounded(D.linkability(CUST.three(s, d)[0], CUST.three(s, d)[2], CUST.three(s, d)[1], "c_custkey", ("c_acctbal", "c_mktsegment"), ("c_nationkey",)).summary.select("risk_attack", "risk_control", "n_attacks", "n_success", "n_control_success", "risk")),
    "linkability_three_neighbours": lambda s, d: rounded(D.linkability(CUST.three(s, d)[0], CUST.three(s, d)[2], CUST.three(s, d)[1], "c_custkey", ("c_acctbal", "c_mktsegment"), ("c_nationkey",), neighbours=3).summary.select("risk_attack", "risk_control", "n_attacks", "n_success", "n_control_success", "risk")),
    "singling_out": _singling, "singling_out_two_columns": lambda s, d: _singling(s, d, n_cols=2), "singling_out_univariate": lambda s, d: _singling(s, d, n_cols=1),
    "gower_paired": lambda s, d: rounded(D.paired_gower(*_perturbed(s, d), "c_custkey", _COLS).summary),
    "drisk_interval": lambda s, d: rounded(D.drisk_interval(*PART.frames(s, d), "p_partkey", _PNUM).summary),
    "drisk_mahalanobis": lambda s, d: rounded(D.drisk_mahalanobis(*CUST.frames(s, d), "c_custkey", CUST.num).summary),
    "drisk_mahalanobis_classical": lambda s, d: rounded(D.drisk_mahalanobis(*CUST.frames(s, d), "c_custkey", CUST.num, robust=False).summary),
    "energy_distance": lambda s, d: rounded(D.energy_distance(*CUST.frames(s, d), "c_custkey", CUST.num).summary),
    "mmd_rff": lambda s, d: rounded(D.mmd_rff(*LINE.frames(s, d), LINE.num, sigma=2.0)),
    "dcr_null": lambda s, d: rounded(D.dcr_null(D.dcr(*CUST.three(s, d), "c_custkey", _COLS).records, n_null=20)),
}
RMD_SQL = f"""with {CUST.sql}, v as (select var_samp(c_nationkey) as f, var_samp(c_acctbal) as e, covar_samp(c_nationkey, c_acctbal) as c from x),
  p as (select a.c_custkey as id, min(sqrt(greatest(0, (e * (a.c_nationkey - b.c_nationkey) ** 2 - 2 * c * (a.c_nationkey - b.c_nationkey) * (a.c_acctbal - b.c_acctbal) + f * (a.c_acctbal - b.c_acctbal) ** 2) / (e * f - c * c)))) as d from x a, y b, v group by 1)
  select round(avg((d < 2.4477468306808161)::int), 6) as drisk_rmd, round(avg(d), 6) as mean_rmd, count(*) as n_original from p"""

SQL = {
    "drisk_mahalanobis_classical": RMD_SQL,
    "dcr_gower": dcr_sql(_GOWER), "dcr_euclidean": dcr_sql(_euclid(CUST.num)), "nndr_gower": NNDR_SQL,
    "hitting_rate": f"{_HIT} select round(avg((d <= 0.05)::int), 6) as rate, count(*) filter (d <= 0.05) as n_hits, round(avg((d = 0)::int), 6) as rate_at_zero, count(*) as n_synthetic, avg((d <= 0.05)::int) <= 0.1 as privacy_pass from m",
    "hitting_sweep": f"{_HIT} select tau::double as tau, round(avg((d <= tau)::int), 6) as rate from m, (select unnest([0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3]) as tau) group by 1",
    "epsilon_identifiability": _entropy_sql(), "nnaa": NNAA_SQL, "domias": DOMIAS_SQL, "linkability": LINK_SQL, "linkability_three_neighbours": LINK3_SQL, "singling_out": SINGLE_SQL, "singling_out_two_columns": _draws_sql(2), "singling_out_univariate": _draws_sql(1),
    "gower_paired": f"with {RLNK}, {_rng('xy').replace('select * from', 'select c_acctbal, c_nationkey from')}, p as (select {_GOWER.replace('round(', '(', 1).replace(', 9)', ')')} as d from x a join y b using (c_custkey), rg) select round(avg(d), 6) as gower_distance, round(1 - avg(d), 6) as utility_score, count(*) as n_records, 3::bigint as n_variables from p",
    "drisk_interval": DRISK_SQL, "energy_distance": ENERGY_SQL,
}
