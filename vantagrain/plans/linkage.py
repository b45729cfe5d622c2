"""Record linkage on customers: perturbed copies, and small stated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkage as L, linkage_models as LM
from .distance import RLNK, _perturbed
from .pairs import rounded

_KEYS = ("c_nationkey", "c_acctbal", "c_mktsegment")
_RG = "rg as (select (max(c_acctbal) - min(c_acctbal))::double as ra, (max(c_nationkey) - min(c_nationkey))::double as rn from (select c_acctbal, c_nationkey from x union all select c_acctbal, c_nationkey from y))"
_D = "round((abs(a.c_nationkey - b.c_nationkey) / rn + abs(a.c_acctbal - b.c_acctbal) / ra + (a.c_mktsegment <> b.c_mktsegment)::int) / 3, 9)"


def _both(s, d):
    """Every customer and its perturbed copy."""
    return [f.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment") for f in _perturbed(s, d)]


def _one_sided(s, d):
    """The same, blocks of eighty customers; every third is only in the original, every fifth only in the release."""
    x, y = _both(s, d)
    b = F.floor(F.col("c_custkey") / 80)
    return x.withColumn("b", b).filter(b % 5 != 0), y.withColumn("b", b).filter(b % 3 != 0)


def link_sql(dist: str, keep: str, weight: str = "1.0", extra: str = _RG, block: str = "true", digits: int = 6, src: str = RLNK) -> str:
    return f"""with {src}, {extra}, p as (select a.c_custkey as id, b.c_custkey as rid, {dist} as d from x a join y b on {block}, rg),
      r as (select *, min(d) over (partition by id) as mn, rank() over (partition by id order by d) as rk from p), c as (select *, {weight} as w from r where {keep}),
      e as (select id, count(*) as cand_n, sum(w) as wa, coalesce(sum(w) filter (rid = id), 0) as wt, bool_or(rid = id) as ts from c group by id),
      t as (select p.id, (select count(*) from p q where q.id = p.id and q.d < p.d) + 1 as rk from p where p.rid = p.id)
      select x.c_custkey as id, round(coalesce(wt / wa, 0), {digits}) as risk, coalesce(cand_n, 0) as cand_n, coalesce(ts, false) as true_in_set, rk as d_rank from x left join e on e.id = c_custkey left join t on t.id = c_custkey"""


_OUT = ("id", "risk", "cand_n", "true_in_set", "d_rank")
_link = lambda digits=6, **k: lambda s, d: rounded(L.record_linkage(*_both(s, d), "c_custkey", _KEYS, **k).records.select(*_OUT), digits)
_M, _U = {"c_nationkey": 0.9, "c_acctbal": 0.8, "c_mktsegment": 0.95}, {"c_nationkey": 0.1, "c_acctbal": 0.3, "c_mktsegment": 0.2}


def _mad(c: str) -> str:
    return f"(select coalesce(nullif(1.4826 * median(abs({c} - m)), 0), 1) from x, (select median({c}) as m from x))"


_AGREE = ("abs(a.c_nationkey - b.c_nationkey) <= mn_", "abs(a.c_acctbal - b.c_acctbal) <= ma_", "a.c_mktsegment = b.c_mktsegment")


def _estimated_sql() -> str:
    """Agreement rates in true and in other pairs, by comparing all pairs."""
    clip = lambda v: f"case when {v} <= 0 then 0.01 else least(0.99, {v}) end"
    rates = ", ".join(f"{clip(f'avg(({a})::int) filter (a.c_custkey {o} b.c_custkey)')} as {n}{k}" for k, a in enumerate(_AGREE) for n, o in (("m", "="), ("u", "<>")))
    tol = f"tl as (select {_mad('c_nationkey')} as mn_, {_mad('c_acctbal')} as ma_)"
    dist = "round(" + " + ".join(f"case when {a} then -ln(m{k} / u{k}) else -ln((1 - m{k}) / (1 - u{k})) end" for k, a in enumerate(_AGREE)) + ", 9)"
    return link_sql(dist, "d <= 0", extra=f"{tol}, rg as (select any_value(mn_) as mn_, any_value(ma_) as ma_, {rates} from x a, y b, tl)")


def _fs_sql() -> str:
    import math

    def term(c: str, agree: str) -> str:
        return f"case when {agree} then {-math.log(_M[c] / _U[c])!r} else {-math.log((1 - _M[c]) / (1 - _U[c]))!r} end"

    dist = "round(" + " + ".join((term("c_nationkey", "abs(a.c_nationkey - b.c_nationkey) <= mn_"), term("c_acctbal", "abs(a.c_acctbal - b.c_acctbal) <= ma_"), term("c_mktsegment", "a.c_mktsegment = b.c_mktsegment"))) + ", 9)"
    return link_sql(dist, "d <= 0", extra=f"rg as (select {_mad('c_nationkey')} as mn_, {_mad('c_acctbal')} as ma_)")


def _rank_sql() -> str:
    ranks = lambda s: f"(select c_custkey, c_mktsegment, " + ", ".join(f"(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2) / count(*) over () as {c}" for c in ("c_nationkey", "c_acctbal")) + f" from {s})"  # noqa: E731, F541
    dist = "round((abs(a.c_nationkey - b.c_nationkey) + abs(a.c_acctbal - b.c_acctbal) + (a.c_mktsegment <> b.c_mktsegment)::int) / 3, 9)"
    return link_sql(dist, "d = mn", extra="rg as (select 1)").replace("from x a join y b", f"from {ranks('x')} a join {ranks('y')} b")


def _transitions(s):
    rows = [("color", a, b, p) for a, ps in {"R": (0.8, 0.1, 0.1), "G": (0.1, 0.7, 0.2), "B": (0.1, 0.2, 0.7)}.items() for b, p in zip("RGB", ps, strict=True)]
    rows += [("shape", a, b, p) for a, ps in {"C": (0.9, 0.05, 0.05), "S": (0.1, 0.8, 0.1), "T": (0.05, 0.05, 0.9)}.items() for b, p in zip("CST", ps, strict=True)]
    return s.createDataFrame(rows, "var string, from string, to string, p double")


def _pram(s, d):
    """Segments stand for colours and balances for shapes; the release rotates some."""
    df = s.read.parquet(f"{d}/customer.parquet")
    color = lambda k: F.element_at(F.array(*map(F.lit, "RGB")), (k % 3 + 1).cast("int"))
    shape = lambda k: F.element_at(F.array(*map(F.lit, "CST")), (k % 3 + 1).cast("int"))
    i = F.col("c_custkey")
    x = df.select("c_custkey", color(F.col("c_nationkey")).alias("color"), shape(i).alias("shape"))
    y = df.select("c_custkey", color(F.col("c_nationkey") + (i % 5 == 0).cast("int")).alias("color"), shape(i + (i % 7 == 0).cast("int")).alias("shape"))
    return rounded(L.pram_risk(x, y, "c_custkey", ("color", "shape"), _transitions(s)).records)


_TC = "(case when a.color = b.color then (case a.color when 'R' then 0.8 else 0.7 end) when (a.color || b.color) in ('GB', 'BG') then 0.2 else 0.1 end)"
_TS = "(case when a.shape = b.shape then (case a.shape when 'S' then 0.8 else 0.9 end) when a.shape = 'S' then 0.1 else 0.05 end)"
PRAM_SQL = f"""with x as (select c_custkey, ['R', 'G', 'B'][c_nationkey % 3 + 1] as color, ['C', 'S', 'T'][c_custkey % 3 + 1] as shape from customer),
  y as (select c_custkey, ['R', 'G', 'B'][(c_nationkey + (c_custkey % 5 = 0)::int) % 3 + 1] as color, ['C', 'S', 'T'][(c_custkey + (c_custkey % 7 = 0)::int) % 3 + 1] as shape from customer),
  t as (select a.c_custkey as id, {_TC} * {_TS} as p from x a join y b using (c_custkey)),
  yc as (select color, shape, count(*) as n from y group by all), z as (select a.c_custkey as id, sum(b.n * {_TC} * {_TS}) as pa from x a, yc b group by 1)
  , o as (select a.c_custkey as id, {_TC} * {_TS} as po from x a, (select unnest(['R', 'G', 'B']) as color) c, (select unnest(['C', 'S', 'T']) as shape) d, lateral (select c.color as color, d.shape as shape) b),
  e as (select id, sum(po * po / (pa - p + po)) as er from o join t using (id) join z using (id) group by 1)
  select id, round(p, 6) as p_true, round(p / pa, 6) as risk, round(er, 6) as expected_risk from t join z using (id) join e using (id)"""


def _maha(s, d):
    x, y = _both(s, d)
    return rounded(L.record_linkage(x, y, "c_custkey", ("c_nationkey", "c_acctbal"), method="mahalanobis", robust=False).records.select("id", "risk", "cand_n", "true_in_set"))


_MAHA_D = "round(sqrt(greatest(0, (e * (a.c_nationkey - b.c_nationkey) ** 2 - 2 * c * (a.c_nationkey - b.c_nationkey) * (a.c_acctbal - b.c_acctbal) + f * (a.c_acctbal - b.c_acctbal) ** 2) / (e * f - c * c))), 9)"


def _result(s, d, **k):
    return L.record_linkage(*_both(s, d), "c_custkey", _KEYS, **k)


def _inspect(s, d):
    """The candidates of customer 7 and their released values."""
    x, y = _both(s, d)
    return rounded(L.inspect_record(_result(s, d, strategy="topk", k=3), y, "c_custkey", 7)[1].select("rid", "d", "c_acctbal", "c_mktsegment"))


_BASE = link_sql(_D, "d = mn")
_SIDED = RLNK.replace("select * from customer", "select *, c_custkey // 80 as b from customer where (c_custkey // 80) % 5 <> 0").replace("c_mktsegment from customer", "c_mktsegment, c_custkey // 80 as b from customer where (c_custkey // 80) % 3 <> 0")
QUERIES = {
    "linkage_nearest": _link(), "linkage_blocked": _link(block=("c_mktsegment",)), "linkage_threshold": _link(strategy="threshold", tau=0.02),
    "linkage_topk": _link(strategy="topk", k=3), "linkage_topk_softmax": _link(4, strategy="topk", k=3, weighting="softmax", kappa=5.0),
    "linkage_topk_kernel": _link(4, strategy="topk", k=3, weighting="kernel", bandwidth=0.05), "linkage_topk_threshold": _link(strategy="topk_threshold", k=5, tau=0.01),
    "linkage_reverse": _link(direction="reverse"), "linkage_probabilistic": _link(method="probabilistic", m=_M, u=_U), "linkage_rank": _link(method="rank"),
    "linkage_mahalanobis": _maha, "linkage_pram": _pram,
    "linkage_mahalanobis_robust": lambda s, d: rounded(L.record_linkage(*_both(s, d), "c_custkey", ("c_nationkey", "c_acctbal"), method="mahalanobis").summary.drop("privacy_pass")),
    "linkage_one_sided_blocks": lambda s, d: rounded(L.record_linkage(*_one_sided(s, d), "c_custkey", _KEYS, block=("b",)).records.select(*_OUT)),
    "linkage_probabilistic_estimated": _link(method="probabilistic"),
    "linkage_inspect": _inspect,
    "linkage_summary": lambda s, d: rounded(_result(s, d).summary.drop("privacy_pass")),
    "linkage_gini": lambda s, d: rounded(L.gini(_result(s, d).records)),
    "linkage_risk_by_group": lambda s, d: rounded(L.risk_by_group(_result(s, d).records, _both(s, d)[0], "c_custkey", ["c_mktsegment"])),
    "linkage_top_at_risk": lambda s, d: rounded(L.top_at_risk(_result(s, d).records, 10).select("id", "risk")),
    "linkage_baseline": lambda s, d: rounded(L.baseline_linkage(_both(s, d)[0], "c_custkey", _KEYS, _result(s, d))),
    "linkage_bijective": lambda s, d: L.block_assignment(*_both(s, d), "c_custkey", _KEYS, ("c_nationkey", "c_mktsegment")),
    "linkage_predictive": lambda s, d: rounded(LM.predictive_linkage(*_both(s, d), "c_custkey", _KEYS, strategy="topk", k=3, weighting="kernel", bandwidth=0.01).summary),
    "linkage_embedding": lambda s, d: rounded(LM.embedding_linkage(*_both(s, d), "c_custkey", _KEYS).summary),
    "linkage_forest": lambda s, d: rounded(LM.forest_linkage(*_both(s, d), "c_custkey", _KEYS, trees=10).summary),
    "linkage_transport": lambda s, d: rounded(L.block_assignment(*_both(s, d), "c_custkey", _KEYS, ("c_mktsegment",), how="ot")),
}
SQL = {
    "linkage_nearest": _BASE, "linkage_blocked": link_sql(_D, "d = mn", block="a.c_mktsegment = b.c_mktsegment"), "linkage_threshold": link_sql(_D, "d <= 0.02"),
    "linkage_topk": link_sql(_D, "rk <= 3"), "linkage_topk_softmax": link_sql(_D, "rk <= 3", "exp(-5 * d)", digits=4), "linkage_topk_kernel": link_sql(_D, "rk <= 3", "exp(-0.5 * (d / 0.05) ** 2)", digits=4),
    "linkage_topk_threshold": link_sql(_D, "rk <= 5 and d <= 0.01"),
    "linkage_reverse": link_sql(_D, "d = mn").replace("from x a join y b", "from y a join x b"),
    "linkage_probabilistic": _fs_sql(), "linkage_rank": _rank_sql(),
    "linkage_mahalanobis": link_sql(_MAHA_D, "d = mn", extra="rg as (select var_samp(c_nationkey) as f, var_samp(c_acctbal) as e, covar_samp(c_nationkey, c_acctbal) as c from x)").replace(", rk as d_rank from x", " from x"),
    "linkage_pram": PRAM_SQL, "linkage_probabilistic_estimated": _estimated_sql(),
    "linkage_one_sided_blocks": link_sql(_D, "d = mn", block="a.b = b.b", src=_SIDED, extra=_RG),
    "linkage_inspect": f"""with {RLNK}, {_RG}, p as (select b.c_custkey as rid, {_D} as d, b.c_acctbal, b.c_mktsegment from x a, y b, rg where a.c_custkey = 7), r as (select *, rank() over (order by d) as rk from p)
      select rid, round(d, 6) as d, round(c_acctbal, 6) as c_acctbal, c_mktsegment from r where rk <= 3""",
    "linkage_summary": f"select round(avg(risk), 6) as mean_risk, max(risk) as max_risk, count(*) filter (risk > 0.1) as n_high, round(100.0 * count(*) filter (risk > 0.1) / count(*), 6) as pct_high, round(100.0 * count(*) filter (true_in_set) / count(*), 6) as pct_true_in_set, round(avg(cand_n), 6) as mean_candidates, count(*) as n_query from ({link_sql(_D, 'd = mn', digits=15)})",
    "linkage_gini": f"select round(2 * sum(risk * rk) / (count(*) * sum(risk)) - (count(*) + 1) / count(*), 6) as gini from (select risk, row_number() over (order by risk) as rk from ({link_sql(_D, 'd = mn', digits=15)}))",
    "linkage_risk_by_group": f"select c_mktsegment, round(avg(risk), 6) as mean_risk, max(risk) as max_risk, count(*) as n, count(*) filter (risk > 0.1) as n_high, round(100.0 * count(*) filter (risk > 0.1) / count(*), 6) as pct_high from ({link_sql(_D, 'd = mn', digits=15)}) l join customer on l.id = c_custkey group by 1",
    "linkage_top_at_risk": f"select id, risk from ({_BASE}) order by risk desc, id limit 10",
    "linkage_baseline": f"select round(a, 6) as mean_risk, round(b, 6) as baseline_risk, round(1 - a / b, 6) as risk_reduction from (select avg(risk) as a from ({link_sql(_D, 'd = mn', digits=15)})), (select avg(risk) as b from ({link_sql(_D, 'd = mn', digits=15).replace('select c_custkey, c_acctbal + (c_custkey % 7 - 3) * 10 as c_acctbal, c_nationkey + (c_custkey % 10 = 0)::int as c_nationkey, c_mktsegment from customer', 'select * from customer')}))",
}
