"""Privacy models on the standard tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import sdc as S
from .pairs import CUST, LINE, ORD, PART, Pair, rounded


def _ec(p: Pair) -> str:
    return f"with {p.sql}, ec as (select {', '.join(p.keys)}, count(*) as f from y group by all)"


def kanon_sql(p: Pair) -> str:
    return f"""{_ec(p)} select min(f) as k_level, min(f) >= 5 as satisfies_k, coalesce(sum(f) filter (f < 5), 0)::bigint as n_violating,
      round(100.0 * coalesce(sum(f) filter (f < 5), 0) / sum(f), 6) as pct_violating, sum(f)::bigint as n_records, count(*) as n_ec, count(*) filter (f = 1) as n_unique,
      round(100.0 * count(*) filter (f = 1) / sum(f), 6) as pct_unique, round(avg(f), 6) as mean_ec_size, median(f)::double as median_ec_size from ec"""


def kanon_sizes_sql(p: Pair) -> str:
    return f"{_ec(p)} select case when f >= 10 then '10+' else f::varchar end as size, count(*) as n_ec, sum(f)::bigint as n_records from ec group by 1"


def ldiv_sql(p: Pair, s: str) -> str:
    k = ", ".join(p.keys)
    return f"""with {p.sql}, c as (select {k}, {s}, count(*) as n from y group by all), r as (select *, row_number() over (partition by {k} order by n desc, {s}) as r from c),
      e as (select {k}, sum(n) as size, count(*) as dl, ln(sum(n)) - sum(n * ln(n)) / sum(n) as h, max(n) as top, coalesce(sum(n) filter (r >= 2), 0) as rest from r group by {k})
      select min(dl) as distinct_l, round(min(exp(h)), 6) as entropy_l, bool_and(dl >= 2 and top < 2 * rest) as recursive_cl,
        coalesce(sum(size) filter (dl < 2), 0)::bigint as n_violating_distinct, coalesce(sum(size) filter (round(h, 9) < round(ln(2), 9)), 0)::bigint as n_violating_entropy,
        sum(size)::bigint as n_records, count(*) as n_ec, bool_and(dl >= 2) as satisfies_distinct_l, bool_and(round(h, 9) >= round(ln(2), 9)) as satisfies_entropy_l from e"""


def tclose_sql(p: Pair, keys: str, s: str, numeric: bool) -> str:
    head = f"with {p.sql}, c as (select {keys}, {s} as s, count(*) as n from y group by all), z as (select {keys}, sum(n) as size from c group by {keys}), w as (select s, sum(n) as big from c group by s), t as (select sum(big) as total, count(*) as m from w)"
    full = f"g as (select z.*, w.s, w.big, coalesce(c.n, 0) as n, total, m from z cross join w cross join t left join c on {' and '.join(f'z.{k} = c.{k}' for k in keys.split(', '))} and w.s = c.s)"
    if numeric:
        dist = f"""q as (select *, sum(n) over (partition by {keys} order by s) / size as a, sum(big) over (partition by {keys} order by s) / total as b from g),
          e as (select {keys}, any_value(size) as size, case when any_value(m) > 1 then sum(abs(a - b)) / (any_value(m) - 1) else 0 end as d from q group by {keys})"""
    else:
        dist = f"e as (select {keys}, any_value(size) as size, 0.5 * sum(abs(n / size - big / total)) as d from g group by {keys})"
    return f"""{head}, {full}, {dist} select round(max(d), 6) as t_achieved, coalesce(sum(size) filter (round(d, 9) > 0.2), 0)::bigint as n_violating, sum(size)::bigint as n_records,
      count(*) as n_ec, bool_and(round(d, 9) <= 0.2) as satisfies_t, round(100.0 * coalesce(sum(size) filter (round(d, 9) > 0.2), 0) / sum(size), 6) as pct_violating from e"""


def suda_sql(p: Pair, keys: tuple[str, ...]) -> str:
    subsets = [s for r in range(1, len(keys) + 1) for s in combinations(keys, r)]
    flags = ", ".join(f"count(*) over (partition by {', '.join(s)}) = 1 as u{n}" for n, s in enumerate(subsets))
    msu = []
    for n, s in enumerate(subsets):
        below = [f"u{m}" for m, t in enumerate(subsets) if set(t) < set(s)]
        msu.append(f"(u{n}" + (f" and not ({' or '.join(below)})" if below else "") + f")::int as m{n}")
    scale = " + ".join(f"{1 / 2 ** (len(s) - 1)}" for s in subsets)
    score = " + ".join(f"m{n} * {1 / 2 ** (len(s) - 1)}" for n, s in enumerate(subsets))
    sizes = ", ".join(f"sum({' + '.join(f'm{n}' for n, s in enumerate(subsets) if len(s) == r)})::bigint as msu_size_{r}" for r in range(1, len(keys) + 1))
    return f"""with {p.sql}, u as (select *, {flags} from y), m as (select *, {', '.join(msu)} from u), s as (select *, {score} as sc from m)
      select count(*) as n_records, sum({' + '.join(f'm{n}' for n in range(len(subsets)))})::bigint as n_msu, {sizes}, round(avg(sc), 6) as mean_suda, round(max(sc), 6)::double as max_suda,
        round(avg(sc / ({scale})), 6) as mean_dis, round(max(sc / ({scale})), 6)::double as max_dis from s"""


def risk_sql(p: Pair, weight: str | None) -> str:
    est = f"greatest(sum({weight}), 1.0)" if weight else "count(*)::double"
    k = ", ".join(p.keys)
    return f"""with {p.sql}, ec as (select {k}, count(*) as f, least(1.0, 1 / {est}) as risk from y group by {k})
      select round(sum(f * risk) / sum(f), 6) as mean_risk, round(max(risk), 6) as max_risk, coalesce(sum(f) filter (risk > 0.1), 0)::bigint as n_high_risk,
        round(100.0 * coalesce(sum(f) filter (risk > 0.1), 0) / sum(f), 6) as pct_high_risk, sum(f)::bigint as n_records, count(*) filter (f = 1) as n_unique, count(*) as n_ec from ec"""


def popu_sql(p: Pair) -> str:
    return f"""{_ec(p)}, c as (select count(*) filter (f = 1) as f1, count(*) filter (f = 2) as f2, sum(f)::bigint as n from ec),
      a as (select *, greatest(0.01, case when f1 > 0 and f2 > 0 then f1 * f1 / (2.0 * f2) when f1 > 0 then f1 else 1 end) as al from c),
      q as (select *, al / (al + n * 0.01) as pp, pow(0.99, 99) as pz from a)
      select f1 as n_sample_uniques, round(100.0 * f1 / n, 6) as pct_sample_uniques, n as n_records, round(pp, 6) as p_pitman, round(pz, 6) as p_zayatz,
        round(pp * f1 / n, 6) as global_pitman, round(pz * f1 / n, 6) as global_zayatz, round(pp * f1, 6) as n_population_uniques_est, pp * f1 / n <= 0.1 as privacy_pass from q"""


def attacker_sql(p: Pair) -> str:
    return f"""{_ec(p)} select round(count(*) / sum(f), 6) as prosecutor, round(0.01 * count(*) / sum(f), 6) as journalist, round(count(*) / sum(f), 6) as marketer,
      count(*) filter (f = 1) as n_uniques, round(count(*) filter (f = 1) / count(*), 6) as pct_uniques, sum(f)::bigint as n_records, count(*) / sum(f) <= 0.1 as privacy_pass from ec"""


def delta_sql(p: Pair) -> str:
    k, on = ", ".join(p.keys), " and ".join(f"a.{c} = b.{c}" for c in p.keys)
    return f"""with {p.sql}, a as (select {k}, count(*) as f from x group by {k}), b as (select {k}, count(*) as g from y group by {k}),
      e as (select f, least(1.0, coalesce(g, 0) / f) as pr from a left join b on {on}), z as (select count(*) as nf from b anti join a on {on})
      select round(sum(f * pr) / sum(f), 6) as mean_prob, round(min(pr), 6) as min_prob, round(max(pr), 6) as max_prob, coalesce(sum(f) filter (pr < 0.2), 0)::bigint as n_violations_lower,
        coalesce(sum(f) filter (pr > 0.8), 0)::bigint as n_violations_upper, round((coalesce(sum(f) filter (pr < 0.2), 0) + coalesce(sum(f) filter (pr > 0.8), 0)) / sum(f), 6) as pct_violations,
        (coalesce(sum(f) filter (pr < 0.2), 0) + coalesce(sum(f) filter (pr > 0.8), 0)) = 0 as satisfies_delta, sum(f)::bigint as n_original, any_value(nf) as n_fabricated from e, z"""


_Y = lambda p: lambda s, d: p.frames(s, d)[1]
QUERIES = {
    "kanonymity_cust": lambda s, d: rounded(S.kanonymity(_Y(CUST)(s, d), CUST.id, CUST.keys).summary),
    "kanonymity_line": lambda s, d: rounded(S.kanonymity(_Y(LINE)(s, d), LINE.id, LINE.keys).summary),
    "kanonymity_sizes_part": lambda s, d: rounded(S.kanonymity(_Y(PART)(s, d), PART.id, PART.keys).groups),
    "ldiversity_ord": lambda s, d: rounded(S.ldiversity(_Y(ORD)(s, d), ORD.keys, "o_custkey").summary),
    "ldiversity_cust": lambda s, d: rounded(S.ldiversity(_Y(CUST)(s, d), ["c_nationkey"], "c_mktsegment").summary),
    "tcloseness_categorical": lambda s, d: rounded(S.tcloseness(_Y(CUST)(s, d), ["c_nationkey"], "c_mktsegment").summary),
    "tcloseness_numeric": lambda s, d: rounded(S.tcloseness(_Y(LINE)(s, d), ["l_returnflag", "l_linestatus"], "l_quantity").summary),
    "tcloseness_numeric_part": lambda s, d: rounded(S.tcloseness(_Y(PART)(s, d), ["p_brand", "p_type"], "p_retailprice").summary),
    "suda_part": lambda s, d: rounded(S.suda(_Y(PART)(s, d), PART.id, PART.keys).summary),
    "suda_cust": lambda s, d: rounded(S.suda(_Y(CUST)(s, d).withColumn("bal", F.floor(F.col("c_acctbal") / 100)), CUST.id, ["c_nationkey", "c_mktsegment", "bal"]).summary),
    "individual_risk_sample": lambda s, d: rounded(S.individual_risk(_Y(CUST)(s, d), CUST.id, CUST.keys).summary),
    "individual_risk_weighted": lambda s, d: rounded(S.individual_risk(_Y(PART)(s, d), PART.id, PART.keys, weight="p_size").summary),
    "population_uniqueness": lambda s, d: rounded(S.population_uniqueness(_Y(PART)(s, d), PART.id, PART.keys).summary.drop("p_snb")),
    "attacker_risk": lambda s, d: rounded(S.attacker_risk(_Y(CUST)(s, d), CUST.id, CUST.keys).summary),
    "delta_presence": lambda s, d: rounded(S.delta_presence(*CUST.frames(s, d), CUST.keys, delta_min=0.2, delta_max=0.8).summary),
    "high_risk_records": lambda s, d: rounded(S.high_risk_records(S.individual_risk(_Y(CUST)(s, d), CUST.id, CUST.keys).records, CUST.id, threshold=0.3)),
}
_SUDA_CUST = Pair("(select *, floor(c_acctbal / 100) as bal from customer)", "c_custkey", (), "", (), ())
SQL = {
    "kanonymity_cust": kanon_sql(CUST), "kanonymity_line": kanon_sql(LINE), "kanonymity_sizes_part": kanon_sizes_sql(PART),
    "ldiversity_ord": ldiv_sql(ORD, "o_custkey"), "ldiversity_cust": ldiv_sql(Pair("customer", "c_custkey", ("c_nationkey",), "", (), ()), "c_mktsegment"),
    "tcloseness_categorical": tclose_sql(CUST, "c_nationkey", "c_mktsegment", False),
    "tcloseness_numeric": tclose_sql(LINE, "l_returnflag, l_linestatus", "l_quantity", True),
    "tcloseness_numeric_part": tclose_sql(PART, "p_brand, p_type", "p_retailprice", True),
    "suda_part": suda_sql(PART, PART.keys), "suda_cust": suda_sql(_SUDA_CUST, ("c_nationkey", "c_mktsegment", "bal")),
    "individual_risk_sample": risk_sql(CUST, None), "individual_risk_weighted": risk_sql(PART, "p_size"),
    "population_uniqueness": popu_sql(PART), "attacker_risk": attacker_sql(CUST), "delta_presence": delta_sql(CUST),
    "high_risk_records": f"with {CUST.sql}, r as (select c_custkey, count(*) over (partition by c_nationkey, c_mktsegment) as f from y) select c_custkey, f, round(1 / f, 6) as risk from r where 1 / f > 0.3",
}
