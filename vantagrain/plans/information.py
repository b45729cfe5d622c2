"""Information measures over frequencies of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import information as I
from ..operators.cells import shares
from .pairs import CUST, ORD, PART, rounded


def _both(s, d, pair=ORD, cols=("o_orderpriority",)):
    x, y = pair.frames(s, d)
    a, b = shares(x, cols, "a"), shares(y, cols, "b").withColumnsRenamed({c: f"__{c}" for c in cols})
    return a.join(b, [F.col(c) == F.col(f"__{c}") for c in cols])


_AB = f"""with {ORD.sql}, a as (select o_orderpriority as k, count(*) / sum(count(*)) over () as a from x group by 1),
  b as (select o_orderpriority as k, count(*) / sum(count(*)) over () as b from y group by 1), j as (select * from a join b using (k))"""
_P = "with p as (select p_brand, count(*) / sum(count(*)) over () as p from part group by 1)"


def _joint(s, d):
    return shares(s.read.parquet(f"{d}/customer.parquet"), ["c_nationkey", "c_mktsegment"])


_J = "with j as (select c_nationkey as x, c_mktsegment as y, count(*) / sum(count(*)) over () as p from customer group by all)"
_H2 = lambda c: f"(select sum(-p * log2(p)) from (select count(*) / sum(count(*)) over () as p from customer group by {c}))"


def _rlnk(s, d):
    df = s.read.parquet(f"{d}/customer.parquet")
    return df.select(F.col("c_acctbal").alias("x"), (F.col("c_acctbal") + (F.col("c_custkey") % 7 - 3) * 10).alias("y"))


_R = "with r as (select c_acctbal as x, c_acctbal + (c_custkey % 7 - 3) * 10 as y from customer)"
QUERIES = {
    "divergences": lambda s, d: rounded(_both(s, d).agg(
        I.kl_divergence(F.col("a"), F.col("b")).alias("kl"), I.js_divergence(F.col("a"), F.col("b")).alias("js"), I.cross_entropy(F.col("a"), F.col("b")).alias("ce"),
        I.kl_bayes(F.col("a"), F.col("b")).alias("kl_bayes"), I.js_bayes(F.col("a"), F.col("b")).alias("js_bayes")), 9),
    "entropies": lambda s, d: rounded(shares(s.read.parquet(f"{d}/part.parquet"), ["p_brand"]).agg(
        I.renyi_entropy(F.col("p")).alias("renyi"), I.renyi_entropy(F.col("p"), 1).alias("shannon"), I.max_entropy(F.col("p")).alias("hmax"),
        I.min_entropy(F.col("p")).alias("hmin"), I.normalized_entropy(F.col("p")).alias("hnorm"))),
    "conditional_entropy": lambda s, d: rounded(I.conditional_entropy(_joint(s, d), "c_nationkey", "p")),
    "cumulative_entropy": lambda s, d: rounded(I.cumulative_entropy(CUST.frames(s, d)[0], "c_acctbal")),
    "mutual_information": lambda s, d: rounded(I.mutual_information(s.read.parquet(f"{d}/customer.parquet"), "c_nationkey", "c_mktsegment")),
    "conditional_mutual_information": lambda s, d: rounded(I.mutual_information(PART.frames(s, d)[0], "p_brand", "p_type", "p_size").select("mi", "cmi", "cmi_compat")),
    "max_information_leakage": lambda s, d: rounded(I.max_information_leakage(_joint(s, d), "c_nationkey", "c_mktsegment", "p")),
    "information_surprisal": lambda s, d: rounded(_joint(s, d).select("c_nationkey", "c_mktsegment", I.surprisal(F.col("p")).alias("surprisal"))),
    "positive_information_disclosure": lambda s, d: rounded(I.positive_disclosure(*(shares(f, ["o_orderpriority"]) for f in ORD.frames(s, d)), "o_orderpriority", "p")),
    "privacy_score": lambda s, d: rounded(I.privacy_score(s.read.parquet(f"{d}/part.parquet"), "p_size", "p_retailprice", True)),
    "error_statistics": lambda s, d: rounded(I.error_statistics(_rlnk(s, d), "x", "y")),
    "aitchison": lambda s, d: rounded(I.aitchison(_rlnk(s, d), "x", "y"), 9),
}
SQL = {
    "divergences": f"{_AB} select round(sum(a * ln(a / b)), 9) as kl, round(0.5 * sum(a * ln(a / ((a + b) / 2))) + 0.5 * sum(b * ln(b / ((a + b) / 2))), 9) as js, round(-sum(a * ln(b)), 9) as ce, round(count(*) / 2 * ln(avg(a / b) * avg(b / a)), 9) as kl_bayes, round(0.5 * count(*) / 2 * ln(avg(a / ((a + b) / 2)) * avg((a + b) / 2 / a)) + 0.5 * count(*) / 2 * ln(avg(b / ((a + b) / 2)) * avg((a + b) / 2 / b)), 9) as js_bayes from j",
    "entropies": f"{_P} select round(-ln(sum(p * p)), 6) as renyi, round(-sum(p * ln(p)), 6) as shannon, round(ln(count(*)), 6) as hmax, round(-ln(max(p)), 6) as hmin, round(-sum(p * ln(p)) / ln(count(*)), 6) as hnorm from p",
    "conditional_entropy": f"{_J} select round(-sum(p * ln(p / r)), 6) as h from (select *, sum(p) over (partition by x) as r from j)",
    "cumulative_entropy": f"with {CUST.sql} select round(-avg(ln(f)), 6) as h from (select cume_dist() over (order by c_acctbal) as f from x)",
    "mutual_information": f"select round(m, 6) as mi, round(m / hx, 6) as nmi, round(1 - 2 ** (-m), 6) as cpl from (select {_H2('c_nationkey')} as hx, {_H2('c_nationkey')} + {_H2('c_mktsegment')} - {_H2('c_nationkey, c_mktsegment')} as m)",
    "conditional_mutual_information": "with h as (select " + ", ".join(f"(select sum(-p * log2(p)) from (select count(*) / sum(count(*)) over () as p from part where p_partkey % 2 = 0 group by {c})) as {n}" for n, c in (("hx", "p_brand"), ("hy", "p_type"), ("hz", "p_size"), ("hxy", "p_brand, p_type"), ("hxz", "p_brand, p_size"), ("hyz", "p_type, p_size"), ("hxyz", "p_brand, p_type, p_size"))) + ") select round(greatest(0, hx + hy - hxy), 6) as mi, round(hxz + hyz - hz - hxyz, 6) as cmi, round(hxz - hxyz, 6) as cmi_compat from h",
    "max_information_leakage": f"{_J}, hx as (select sum(-px * log2(px)) as h from (select sum(p) as px from j group by x)), g as (select y, sum(-q * log2(q)) as h from (select y, p / sum(p) over (partition by y) as q from j) group by y) select round(max(hx.h - g.h), 6) as leakage from g, hx",
    "information_surprisal": f"{_J} select x as c_nationkey, y as c_mktsegment, round(-log2(p), 6) as surprisal from j",
    "positive_information_disclosure": f"{_AB} select round(max((b - a) / a), 6) as pid from j",
    "privacy_score": "select round(sum(p_size * p_retailprice) / (sum(p_size) * max(p_retailprice)), 6) as score from part",
    "error_statistics": f"{_R} select round(100 * avg(abs((x - y) / nullif(x, 0))), 6) as mape, round(avg(abs(x - y)), 6) as mae, round(avg((x - y) ** 2), 6) as mse, round(sqrt(avg((x - y) ** 2)), 6) as rmse from r",
    "aitchison": f"{_R} select round(sqrt(var_pop(ln(x) - ln(y)) * count(*)) / (2 * count(*)), 9) as ait from r where x > 0 and y > 0",
}
