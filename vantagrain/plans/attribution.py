"""Attribution and copy measures on the standard pairs."""

from __future__ import annotations

from ..operators import attribution as A, copies as C
from .pairs import CUST, LINE, ORD, PAIRS, PART, Pair, rounded


def _binned(p: Pair, n: int = 10) -> str:
    probs = ", ".join(str(k / n) for k in range(n + 1))
    return f"""br as (select list_sort(list_distinct(list_transform(quantile_cont(v, [{probs}]), lambda q: round(q, 9)))) as b
      from (select {p.target}::double as v from x union all select {p.target}::double as v from y)),
    xt as (select x.*, greatest(1, len(list_filter(b, lambda q: {p.target} > q)))::varchar as t from x, br),
    yt as (select y.*, greatest(1, len(list_filter(b, lambda q: {p.target} > q)))::varchar as t from y, br)"""


def _scores(p: Pair) -> str:
    k, on = ", ".join(p.keys), " and ".join(f"s.{c} = c.{c}" for c in p.keys)
    on2 = " and ".join(f"s.{c} = d.{c}" for c in p.keys)
    on3 = " and ".join(f"s.{c} = e.{c}" for c in p.keys)
    return f"""with {p.sql}, {_binned(p)},
    yc as (select {k}, t, count(*) as n_kt from yt group by all), yk as (select {k}, sum(n_kt) as n_k, count(*) as n_t from yc group by {k}),
    xk as (select {k}, count(distinct t) as n_t from xt group by {k}),
    base as (select max(n) / sum(n) as baseline from (select count(*) as n from yt group by t)),
    sc as (select s.*, case when c.n_k is not null then coalesce(d.n_kt, 0) / c.n_k end as cap, coalesce(c.n_k, 0) as n_matches,
        e.n_t = 1 as ux, coalesce(c.n_t = 1, false) as uy
      from xt s left join yk c on {on} left join yc d on {on2} and s.t = d.t left join xk e on {on3})"""


def dcap_sql(p: Pair) -> str:
    return f"""{_scores(p)} select round(avg(cap), 6) as cap, round(median(cap), 6) as cap_median, round(avg(cap) - any_value(baseline), 6) as dcap,
      round(median(cap) - any_value(baseline), 6) as dcap_median, count(cap) as n_matched, count(*) - count(cap) as n_unmatched, count(*) as n_total,
      round(any_value(baseline), 6) as baseline from sc, base"""


def tcap_sql(p: Pair) -> str:
    return f"""{_scores(p)}, fl as (select *, coalesce(ux and uy and cap = 1, false) as ce, uy and n_matches > 0 as di from sc),
      a as (select avg(cap) as m, max(cap) as mx, median(cap) as md, count(*) filter (ce) as n_certain, count(*) filter (cap = 1) as n_correct,
        count(*) filter (di and cap = 1) as ndc, count(*) filter (di) as nd, count(*) filter (n_matches > 0) as nm, count(*) filter (n_matches = 0) as nu from fl)
      select round(m, 6) as tcap_mean, round(mx, 6) as tcap_max, round(md, 6) as tcap_median,
        round(coalesce(100.0 * n_certain / nullif(nm, 0), 0), 6) as tcap_certain, round(coalesce(100.0 * n_correct / nullif(nm, 0), 0), 6) as tcap_matched,
        round(coalesce(100.0 * ndc / nullif(nd, 0), 0), 6) as tcap_conditional, n_certain, ndc as n_disclosive_correct, nd as n_disclosive,
        nm as n_matched, nu as n_unmatched, round(baseline, 6) as baseline from a, base"""


def weap_sql(p: Pair) -> str:
    k = ", ".join(p.keys)
    return f"""with {p.sql}, w as (select {k}, count(*) over (partition by {k}, {p.target}) / count(*) over (partition by {k}) as weap from y)
      select round(avg(weap), 6) as weap_mean, round(median(weap), 6) as weap_median, count(*) filter (weap = 1) as n_disclosive,
        round(100.0 * count(*) filter (weap = 1) / count(*), 6) as pct_disclosive, count(distinct ({k})) as n_unique_keys from w"""


def disco_sql(p: Pair) -> str:
    k = ", ".join(p.keys)
    on = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in p.keys)
    return f"""with {p.sql}, xc as (select {k}, {p.target} as t, count(*) as n from x group by all), xk as (select {k}, count(*) = 1 as one from xc group by {k}),
      f as (select y.*, xk.one, xc.n is not null as pot from y left join xk on {on('y', 'xk')} left join xc on {on('y', 'xc')} and y.{p.target} = xc.t),
      ce as (select distinct {k}, {p.target} as t from f where pot and one),
      a as (select count(*) as ns, count(*) filter (pot) as np, count(*) filter (pot and one) as nc, count(*) filter (one is not null) as nk from f),
      b as (select count(*) as nod from x semi join ce on {on('x', 'ce')} and x.{p.target} = ce.t),
      s as (select sum(n * n) / (sum(n) * sum(n)) as ss, sum(n)::bigint as n_o from (select count(*) as n from x group by {p.target}))
      select np as n_disco_potential, nc as n_disco_certain, nk as n_key_matches, nod as n_originals_disclosed, ns as n_synthetic, n_o as n_original,
        round(100.0 * np / ns, 6) as pct_disco_potential, round(100.0 * nc / ns, 6) as pct_disco_certain, round(100.0 * nod / n_o, 6) as pct_original_disclosed,
        round(nk * ss, 6) as baseline_disco, round(np / nullif(nk * ss, 0), 6) as disco_ratio from a, b, s"""


def ims_sql(p: Pair, cols: tuple[str, ...], single: bool) -> str:
    k, on = ", ".join(cols), " and ".join(f"o.{c} = r.{c}" for c in cols)
    return f"""with {p.sql}, o as (select {k}, count(*) as nx from x group by {k} {'having count(*) = 1' if single else ''}), r as (select {k}, count(*) as ny from y group by {k}),
      j as (select coalesce(sum(ny), 0)::bigint as ni, coalesce(sum(nx) filter (ny > 0), 0)::bigint as nu, coalesce(sum(nx), 0)::bigint as nt from o left join r on {on}),
      n as (select (select count(*) from y) as ns, (select count(*) from x) as ntr)
      select round(ni / ns, 6) as ims, round(100.0 * ni / ns, 6) as ims_pct, ni as n_identical, nu as n_unique_matched,
        round(case when {'nt' if single else 'ntr'} > 0 then 100.0 * nu / {'nt' if single else 'ntr'} else 0 end, 6) as pct_train_copied,
        ns as n_synthetic, ntr as n_train, ni / ns < 0.01 as privacy_pass from j, n"""


def rapid_sql(p: Pair, key: str, metric: str) -> str:
    err = {"symmetric": "200 * abs(a - b) / (abs(a) + abs(b) + 0.02)", "stabilised_relative": "100 * abs(a - b) / (abs(a) + 0.01)", "absolute": "abs(a - b)"}[metric]
    eps = 1000 if metric == "absolute" else 10
    return f"""with {p.sql}, l as (select regr_slope({p.target}, {key}) as s, regr_intercept({p.target}, {key}) as i from y),
      e as (select a, b, {err} < {eps} as r from (select {p.target}::double as a, i + s * {key} as b from x, l)),
      z as (select count(*) filter (r) / count(*) as rapid, count(*) filter (r) as n_at_risk, count(*) as n, avg(abs(a - b)) as mae, sqrt(avg((a - b) ** 2)) as rmse from e)
      select round(rapid, 6) as rapid, n_at_risk, round(100 * rapid, 6) as pct_at_risk, n as n_records, round(mae, 6) as mae, round(rmse, 6) as rmse,
        case when rapid < 0.05 then 'LOW' when rapid < 0.15 then 'MEDIUM' else 'HIGH' end as risk_level from z"""


_RG = "rg as (select (max(c_nationkey) - min(c_nationkey))::double as rn from (select * from x union all select * from y))"
_NEAR = "round((abs(a.c_nationkey - b.c_nationkey) / rn + (a.c_mktsegment <> b.c_mktsegment)::int) / 2, 9) <= 0.1"


def gower_sql() -> str:
    return f"""with {CUST.sql}, {_binned(CUST)}, {_RG}, base as (select max(n) / sum(n) as baseline from (select count(*) as n from yt group by t)),
      m as (select a.c_custkey as id, count(b.c_custkey) as n, count(b.c_custkey) filter (a.t = b.t) as ns, count(distinct b.t) as nt from xt a cross join rg left join yt b on {_NEAR} group by 1),
      c as (select *, ns / nullif(n, 0) as cap from m)
      select round(avg(cap), 6) as cap, round(median(cap), 6) as cap_median, round(avg(cap) - any_value(baseline), 6) as dcap, count(cap) as n_matched, count(*) filter (n = 0) as n_unmatched,
        count(*) filter (nt = 1 and cap = 1) as n_certain, count(*) filter (nt = 1) as n_disclosive, round(any_value(baseline), 6) as baseline from c, base"""


def disco_gower_sql() -> str:
    return f"""with {CUST.sql}, {_RG}, m as (select a.c_custkey as id, count(b.c_custkey) as n, count(b.c_custkey) filter (a.c_acctbal = b.c_acctbal) as ns, count(distinct b.c_acctbal) as nt
      from y a cross join rg left join x b on {_NEAR} group by 1) select count(*) filter (ns > 0) as n_disco_potential, count(*) filter (nt = 1 and ns = n) as n_disco_certain, count(*) as n_synthetic from m"""


QUERIES, SQL = {}, {}
QUERIES["cap_gower"] = lambda s, d: rounded(A.cap_gower(*CUST.frames(s, d), CUST.id, CUST.keys, CUST.target).summary)
SQL["cap_gower"] = gower_sql()
QUERIES["disco_gower"] = lambda s, d: rounded(A.disco_gower(*CUST.frames(s, d), CUST.id, CUST.keys, CUST.target).summary)
SQL["disco_gower"] = disco_gower_sql()
for _name, _p in PAIRS.items():
    if _name != "line":
        QUERIES[f"dcap_exact_{_name}"] = lambda s, d, p=_p: rounded(A.dcap(*p.frames(s, d), p.id, p.keys, p.target).summary)
        SQL[f"dcap_exact_{_name}"] = dcap_sql(_p)
        QUERIES[f"tcap_exact_{_name}"] = lambda s, d, p=_p: rounded(A.tcap(*p.frames(s, d), p.id, p.keys, p.target).summary)
        SQL[f"tcap_exact_{_name}"] = tcap_sql(_p)
for _name, _p in (("line", LINE), ("part", PART)):
    QUERIES[f"weap_{_name}"] = lambda s, d, p=_p: rounded(A.weap(p.frames(s, d)[1], p.id, p.keys, p.target).summary)
    SQL[f"weap_{_name}"] = weap_sql(_p)
    QUERIES[f"disco_{_name}"] = lambda s, d, p=_p: rounded(A.disco(*p.frames(s, d), p.id, p.keys, p.target).summary)
    SQL[f"disco_{_name}"] = disco_sql(_p)
QUERIES["ims_part"] = lambda s, d: rounded(C.ims(*PART.frames(s, d), PART.id, PART.keys).summary)
SQL["ims_part"] = ims_sql(PART, PART.keys, False)
QUERIES["repu_part"] = lambda s, d: rounded(C.repu(*PART.frames(s, d), PART.id, PART.keys).summary)
SQL["repu_part"] = ims_sql(PART, PART.keys, True)
for _m in ("symmetric", "stabilised_relative", "absolute"):
    QUERIES[f"rapid_lm_{_m}"] = lambda s, d, m=_m: rounded(
        A.rapid_linear(*LINE.frames(s, d), LINE.id, "l_quantity", "l_extendedprice", metric=m, num_epsilon=1000 if m == "absolute" else 10).summary
    )
    SQL[f"rapid_lm_{_m}"] = rapid_sql(Pair("lineitem", "l_orderkey", (), "l_extendedprice", (), ()), "l_quantity", _m)
