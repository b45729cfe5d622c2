"""Distributional and dependence measures on the standard pairs."""

from __future__ import annotations

from itertools import combinations

from ..operators import cells as C, distributions as D
from .pairs import CUST, LINE, ORD, PART, Pair, rounded


def _long(side: str, cols: tuple[str, ...]) -> str:
    return " union all ".join(f"select '{c}' as var, {c}::varchar as level from {side}" for c in cols)


def _cells(p: Pair, cols: tuple[str, ...]) -> str:
    return f"""with {p.sql}, lx as ({_long('x', cols)}), ly as ({_long('y', cols)}),
      b as (select var, level, sum(o)::double as o, sum(r)::double as r from (select var, level, 1 as o, 0 as r from lx union all select var, level, 0, 1 from ly) group by var, level),
      n as (select *, sum(o) over (partition by var) as no, sum(r) over (partition by var) as nr from b)"""


def hellinger_sql(p: Pair, cols: tuple[str, ...]) -> str:
    return f"""{_cells(p, cols)}, h as (select var, sqrt(sum((sqrt(o / no) - sqrt(r / nr)) ** 2)) / sqrt(2) as h from n group by var)
      select round(avg(h), 6) as hellinger_mean, round(max(h), 6) as hellinger_max, round(min(h), 6) as hellinger_min, count(*) as n_vars, round(1 - avg(h), 6) as utility_score from h"""


def contingency_sql(p: Pair, cols: tuple[str, ...]) -> str:
    one = lambda side, o, r: " union all ".join(
        f"select '{a}' as var1, '{b}' as var2, {a}::varchar as l1, {b}::varchar as l2, {o} as o, {r} as r from {side}" for a, b in combinations(cols, 2)
    )
    return f"""with {p.sql}, b as (select var1, var2, l1, l2, sum(o)::double as o, sum(r)::double as r from ({one('x', 1, 0)} union all {one('y', 0, 1)}) group by all),
      n as (select *, sum(o) over (partition by var1, var2) as no, sum(r) over (partition by var1, var2) as nr from b)
      select var1, var2, round(0.5 * sum(abs(o / no - r / nr)), 6) as tv from n group by var1, var2"""


def _joint(p: Pair, cols: tuple[str, ...]) -> str:
    k = ", ".join(cols)
    return f"b as (select {k}, sum(o)::double as o, sum(r)::double as r from (select {k}, 1 as o, 0 as r from x union all select {k}, 0, 1 from y) group by {k}), n as (select *, sum(o) over () as no, sum(r) over () as nr from b)"


def chisq_sql(p: Pair, cols: tuple[str, ...]) -> str:
    levels = " * ".join(f"count(distinct {c})" for c in cols)
    return f"""with {p.sql}, {_joint(p, cols)}, e as (select *, greatest(o / no * nr, 1e-10) as e, o / no + 1e-10 as a, r / nr + 1e-10 as q from n),
      z as (select sum((r - e) ** 2 / e) as chi2, count(*) filter (o > 0) - 1 as df, 4 * sum((sqrt(r) - sqrt(e)) ** 2) as ft,
        2 * sum(case when r > 0 then r * ln(r / e) else 0 end) as g, sum(0.5 * a * ln(a / ((a + q) / 2)) + 0.5 * q * ln(q / ((a + q) / 2))) as jsd,
        count(*) as nf, count(*) filter (o = 0) as eo, count(*) filter (r = 0) as er, any_value(no) as n_orig, any_value(nr) as n_synth from e),
      k as (select {levels} as nc from (select * from x union all select * from y))
      select round(chi2, 6) as chi2, df, round((chi2 - df) / n_synth, 6) as vw, round(ft, 6) as ft, round(g, 6) as g, round(jsd, 6) as jsd, nc as n_cells, eo + nc - nf as n_empty_orig,
        er + nc - nf as n_empty_synth, round(100 * exp(-10 * abs((chi2 - df) / n_synth)), 6) as pct_utility, n_orig, n_synth from z, k"""


def gof_sql(p: Pair, col: str, group: str) -> str:
    return f"""with {p.sql}, b as (select {group}, {col}, sum(o)::double as o, sum(r)::double as r from (select {group}, {col}, 1 as o, 0 as r from x union all select {group}, {col}, 0, 1 from y) group by all having sum(o) > 0),
      n as (select *, sum(o) over (partition by {group}) as no, sum(r) over (partition by {group}) as nr, count(*) over (partition by {group}) as k from b)
      select {group}, round(sum((r - o / no * nr) ** 2 / (o / no * nr)), 6) as chi_sq_statistic, any_value(k) - 1 as df,
        round(sqrt(sum((r - o / no * nr) ** 2 / (o / no * nr)) / (any_value(nr) * (any_value(k) - 1))), 6) as cramers_v from n where nr > 0 group by {group}"""


def ks_sql(p: Pair, col: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    part = f"partition by {group}" if group else ""
    return f"""with {p.sql}, v as (select {g}{col} as v, sum(a)::double as a, sum(b)::double as b from (select {g}{col}, 1 as a, 0 as b from x union all select {g}{col}, 0, 1 from y) group by all),
      c as (select *, sum(a) over ({part} order by v) / sum(a) over ({part}) as fa, sum(b) over ({part} order by v) / sum(b) over ({part}) as fb from v)
      select {g}round(max(abs(fa - fb)), 6) as ks_statistic from c {'group by ' + group if group else ''}"""



def wass_sql(p: Pair, col: str, group: str | None) -> str:
    probs = "[" + ", ".join(str(k / 999) for k in range(1000)) + "]"
    g, on = (f"{group}, ", f"using ({group})") if group else ("", "on true")
    by = f"group by {group}" if group else ""
    return f"""with {p.sql}, a as (select {g}quantile_cont({col}, {probs}) as q from x {by}), b as (select {g}quantile_cont({col}, {probs}) as r from y {by})
      select {g}round(list_sum(list_transform(list_zip(q, r), lambda z: abs(z[1] - z[2]))) / 1000, 4) as wasserstein from a join b {on}"""


def tv_sql(p: Pair, col: str, group: str) -> str:
    return f"""with {p.sql}, b as (select {group}, {col}, sum(o)::double as o, sum(r)::double as r from (select {group}, {col}, 1 as o, 0 as r from x union all select {group}, {col}, 0, 1 from y) group by all),
      n as (select *, sum(o) over (partition by {group}) as no, sum(r) over (partition by {group}) as nr from b)
      select {group}, round(0.5 * sum(abs(o / no - r / nr)), 6) as wasserstein from n where no > 0 and nr > 0 group by {group}"""


def moments_sql(p: Pair, cols: tuple[str, ...], group: str) -> str:
    each = lambda side: " union all ".join(f"select {group}, '{c}' as variable, {c}::double as v from {side}" for c in cols)
    return f"""with {p.sql}, v as ({each('x')}), f as (select {group}, variable, count(*)::double as n, avg(v) as m, quantile_cont(v, [0.25, 0.5, 0.75]) as q from v group by all),
      s as (select {group}, variable, sum((v - m) ** 2) as m2, sum((v - m) ** 3) as m3, sum((v - m) ** 4) as m4 from v join f using ({group}, variable) group by all)
      select {group}, variable, n, round(m, 4) as mean, round(sqrt(m2 / (n - 1)), 4) as sd, round(q[2], 4) as median, round(q[3] - q[1], 4) as iqr,
        round(m3 / n / sqrt(m2 / (n - 1)) ** 3, 4) as skewness, round(m4 / n / sqrt(m2 / (n - 1)) ** 4 - 3, 4) as kurtosis from f join s using ({group}, variable)"""


def weighted_sql(p: Pair, col: str, w: str) -> str:
    return f"""with {p.sql}, f as (select sum({w})::double as n, sum({w} * {col}) / sum({w}) as m from x), s as (select sum({w} * ({col} - m) ** 2) as m2, sum({w} * ({col} - m) ** 3) as m3, sum({w} * ({col} - m) ** 4) as m4 from x, f),
      q as (select quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25) as iqr from x),
      r as (select min({col}) as med from (select {col}, sum({w}) over (order by {col}) as rs from x), f where rs >= 0.5 * n)
      select '{col}' as variable, n, round(m, 4) as mean, round(sqrt(m2 / (n - 1)), 4) as sd, med as median, round(iqr, 4) as iqr, round(m3 / n / sqrt(m2 / (n - 1)) ** 3, 4) as skewness,
        round(m4 / n / sqrt(m2 / (n - 1)) ** 4 - 3, 4) as kurtosis from f, s, q, r"""


def freq_sql(p: Pair, cols: tuple[str, ...]) -> str:
    return f"{_cells(p, cols)} select var, level, o, r, round(o / no, 6) as share_x, round(r / nr, 6) as share_y from n"


def corr_sql(p: Pair, cols: tuple[str, ...], spearman: bool) -> str:
    def src(side: str) -> str:
        if not spearman:
            return side
        ranks = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2 as {c}" for c in cols)
        return f"(select {ranks} from {side})"

    rows = " union all ".join(
        f"select '{a}' as var1, '{b}' as var2, (select corr({a}, {b}) from {src('x')}) as corr_x, (select corr({a}, {b}) from {src('y')}) as corr_y" for a, b in combinations(cols, 2)
    )
    return f"with {p.sql}, c as ({rows}) select var1, var2, round(corr_x, 6) as corr_x, round(corr_y, 6) as corr_y, round(abs(corr_x - corr_y), 6) as diff from c"


def corr_summary_sql(p: Pair, cols: tuple[str, ...]) -> str:
    rows = " union all ".join(f"select abs((select corr({a}, {b}) from x) - (select corr({a}, {b}) from y)) as d" for a, b in combinations(cols, 2))
    return f"with {p.sql}, c as ({rows}) select round(avg(d), 6) as mean_diff, round(max(d), 6) as max_diff, round(median(d), 6) as median_diff, round(sqrt(2 * sum(d * d)), 6) as frobenius from c"


def multi_sql(p: Pair, cols: tuple[str, ...]) -> str:
    rows = " union all ".join(
        f"select '{a}' as var1, '{b}' as var2, (select covar_samp({a}, {b}) from x) as vx, (select covar_samp({a}, {b}) from y) as vy, (select corr({a}, {b}) from x) as cx, (select corr({a}, {b}) from y) as cy"
        for a, b in combinations(cols, 2)
    )
    return f"""with {p.sql}, c as ({rows}) select var1, var2, round(vx, 4) as cov_x, round(vy, 4) as cov_y, round(vx - vy, 4) as cov_diff, round(cx, 4) as cor_x, round(cy, 4) as cor_y, round(cx - cy, 4) as cor_diff from c"""


def mixed_sql(p: Pair, num: tuple[str, ...], cat: tuple[str, ...]) -> str:
    def v(side: str, a: str, b: str) -> str:
        return f"""(select sqrt(greatest(0, sum(n * n * t / (na * nb)) - any_value(t)) / (any_value(t) * (least(any_value(ka), any_value(kb)) - 1))) from (
          select n::double as n, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over ()::double as t, (select count(distinct {a}) from {side}) as ka,
          (select count(distinct {b}) from {side}) as kb from (select {a} as a, {b} as b, count(*) as n from {side} group by all)))"""

    def eta(side: str, c: str, n: str) -> str:
        return f"(select sqrt(sum(k * (m - g) ** 2) / (sum(k * (m - g) ** 2) + sum(k * v))) from (select count(*) as k, avg({n}) as m, var_pop({n}) as v, (select avg({n}) from {side}) as g from {side} group by {c}))"

    rows = [f"select '{a}' as var1, '{b}' as var2, {v('x', a, b)} as p, {v('y', a, b)} as q" for a, b in combinations(cat, 2)]
    rows += [f"select '{c}' as var1, '{n}' as var2, {eta('x', c, n)} as p, {eta('y', c, n)} as q" for c in cat for n in num]
    return f"with {p.sql}, r as ({' union all '.join(rows)}) select var1, var2, round(p, 6) as assoc_x, round(q, 6) as assoc_y from r"


def ci_sql(p: Pair, cols: tuple[str, ...], sizes: str = "") -> str:
    """The t quantile of a large sample is passed as Cornish-Fisher terms of the normal one."""
    z = 1.959963984540054
    t = f"({z} + ({z}**3 + {z}) / (4.0 * (n - 1)) + (5 * {z}**5 + 16 * {z}**3 + 3 * {z}) / (96.0 * (n - 1) ** 2))"
    each = " union all ".join(
        f"select '{c}' as variable, a.m as m1, b.m as m2, a.m - a.h as l1, a.m + a.h as u1, b.m - b.h as l2, b.m + b.h as u2 from (select avg({c}) as m, {t.replace('n - 1', f'count({c}) - 1')} * stddev_samp({c}) / sqrt(count({c})) as h from x) a, "
        f"(select avg({c}) as m, {t.replace('n - 1', f'count({c}) - 1')} * stddev_samp({c}) / sqrt(count({c})) as h from y) b"
        for c in cols
    )
    return f"""with {p.sql}, e as ({each}), o as (select *, greatest(0, least(u1, u2) - greatest(l1, l2)) / (greatest(u1, u2) - least(l1, l2)) as ov, abs(m1 - m2) / abs(m1) as re from e)
      select variable, round(m1, 4) as mean_x, round(m2, 4) as mean_y, round(ov, 4) as overlap, round(re, 4) as relative_error, round((ov + 1 / (1 + re)) / 2, 4) as proximity, l2 <= m1 and m1 <= u2 as contains_orig_mean from o"""


def outlier_sql(p: Pair, cols: tuple[str, ...], method: str) -> str:
    def one(side: str, c: str) -> str:
        if method == "zscore":
            lim = f"select avg({c}) - 3 * stddev_samp({c}) as lo, avg({c}) + 3 * stddev_samp({c}) as hi from {side}"
        else:
            lim = f"select quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi from {side}"
        return f"(select count(*) filter ({c} < lo or {c} > hi) as k, count(*) as n from {side}, ({lim}))"

    rows = " union all ".join(f"select '{c}' as variable, a.k as n_outliers_x, 100.0 * a.k / a.n as px, b.k as n_outliers_y, 100.0 * b.k / b.n as py from {one('x', c)} a, {one('y', c)} b" for c in cols)
    return f"with {p.sql}, r as ({rows}) select variable, n_outliers_x, round(px, 6) as pct_outliers_x, n_outliers_y, round(py, 6) as pct_outliers_y from r"


def pmse_sql(p: Pair, cols: tuple[str, ...]) -> str:
    return f"""with {p.sql}, {_joint(p, cols)}, e as (select o, r, o + r as n, r / (o + r) as pr, nr / (no + nr) as c from n),
      z as (select sum(n * (pr - c) ** 2) / sum(n) as pmse, sum(case when pr > 0.5 then r when pr < 0.5 then o else n / 2 end) / sum(n) as po, count(*) as k, any_value(c) as c, sum(n) as n from e)
      select round(pmse, 6) as pmse, round((k - 1) * (1 - c) ** 2 * c / n, 6) as pmse_null, round(pmse / ((k - 1) * (1 - c) ** 2 * c / n), 6) as pmse_ratio,
        round((pmse - (k - 1) * (1 - c) ** 2 * c / n) / (sqrt(2 * (k - 1) * (1 - c) ** 4 * c * c) / n), 6) as s_pmse, round(100 * po, 6) as po50, round(c, 6) as c, k, n from z"""


def hist_sql(p: Pair, col: str, bins: int) -> str:
    return f"""with {p.sql}, m as (select min({col}) as lo, (max({col}) - min({col})) / {bins} as w from (select {col} from x union all select {col} from y)),
      b as (select least({bins}, greatest(1, ceil(({col} - lo) / w)))::bigint as bin, sum(a)::double as a, sum(b)::double as b from (select {col}, 1 as a, 0 as b from x union all select {col}, 0, 1 from y), m group by 1)
      select bin, round(lo + (bin - 1) * w, 4) as lower, round(a / (sum(a) over () * w), 9) as density_x, round(b / (sum(b) over () * w), 9) as density_y from b, m"""


def box_sql(p: Pair, col: str, group: str) -> str:
    return f"""with {p.sql}, q as (select {group}, quantile_cont({col}, [0.25, 0.5, 0.75]) as q from x group by 1), j as (select x.{group}, {col} as v, q, {col} between q[1] - 1.5 * (q[3] - q[1]) and q[3] + 1.5 * (q[3] - q[1]) as i from x join q using ({group}))
      select {group}, min(v) filter (i) as lower_whisker, round(any_value(q)[1], 4) as q1, round(any_value(q)[2], 4) as median, round(any_value(q)[3], 4) as q3, max(v) filter (i) as upper_whisker, count(*) filter (not i) as n_out from j group by 1"""


def ecdf_sql(p: Pair, col: str) -> str:
    return f"""with {p.sql}, v as (select {col}::double as v, sum(a)::double as a, sum(b)::double as b from (select {col}, 1 as a, 0 as b from x union all select {col}, 0, 1 from y) group by 1)
      select v, round(sum(a) over (order by v) / sum(a) over (), 6) as ecdf_x, round(sum(b) over (order by v) / sum(b) over (), 6) as ecdf_y from v"""


def tail_sql(p: Pair, cols: tuple[str, ...]) -> str:
    probs = [0.95 + (1 - 0.95) * k / 49 for k in range(50)] + [(1 - 0.95) * k / 49 for k in range(50)]
    text = "[" + ", ".join(map(repr, probs)) + "]"
    rows = " union all ".join(
        f"""select '{c}' as variable, list_sum(list_transform(list_zip(quantile_cont_x, quantile_cont_y), lambda z: abs(z[1] - z[2]))) / 100 / iqr as qq from
        (select quantile_cont({c}, {text}) as quantile_cont_x, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as iqr from x), (select quantile_cont({c}, {text}) as quantile_cont_y from y)"""
        for c in cols
    )
    return f"with {p.sql}, r as ({rows}) select variable, round(qq, 6) as qq_divergence from r"


def copula_sql(p: Pair, cols: tuple[str, ...], grid: int) -> str:
    steps = ", ".join(f"greatest(1, ceil(round((rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2) / (count(*) over () + 1) * {grid}, 9)))::int as {c}" for c in cols)
    ctes, rows = [f"sx as (select {steps} from x)", f"sy as (select {steps} from y)", f"g as (select i, j from range(1, {grid + 1}) a(i), range(1, {grid + 1}) b(j))"], []
    for n, (a, b) in enumerate(combinations(cols, 2)):
        for s in "xy":
            ctes.append(f"c{n}{s} as (select i, j, (select count(*) from s{s} where {a} <= i and {b} <= j) / (select count(*) from s{s}) as c from g)")
        rows.append(f"select '{a}' as var1, '{b}' as var2, avg((p.c - q.c) ** 2) as v from c{n}x p join c{n}y q using (i, j)")
    return f"with {p.sql}, {', '.join(ctes)}, r as ({' union all '.join(rows)}) select var1, var2, round(v, 9) as cvm from r"


def regr_sql(p: Pair, x: str, y: str) -> str:
    fit = lambda s: f"(select regr_slope({y}, {x}) as b, regr_intercept({y}, {x}) as a, regr_syy({y}, {x}) * (1 - regr_r2({y}, {x})) / (regr_count({y}, {x}) - 2) as s2, regr_sxx({y}, {x}) as sxx, regr_count({y}, {x}) as n, regr_avgx({y}, {x}) as ax from {s})"
    return f"""with {p.sql}, p as (select * from {fit('x')}), q as (select * from {fit('y')}),
      r as (select 'slope' as term, p.b as e1, q.b as e2, sqrt(p.s2 / p.sxx) as s1, sqrt(q.s2 / q.sxx) as s2 from p, q union all
        select 'intercept', p.a, q.a, sqrt(p.s2 * (1 / p.n + p.ax ** 2 / p.sxx)), sqrt(q.s2 * (1 / q.n + q.ax ** 2 / q.sxx)) from p, q)
      select term, round(e1, 4) as estimate_x, round(e2, 4) as estimate_y, round(s1, 4) as se_x, round(s2, 4) as se_y, round(e2 - e1, 4) as bias, round((e2 - e1) / s1, 4) as std_bias from r"""


def hellinger_weighted_sql(p: Pair, cols: tuple[str, ...], w: str) -> str:
    one = lambda side, o, r: " union all ".join(f"select '{c}' as var, {c}::varchar as level, {o} as o, {r} as r from {side}" for c in cols)
    return f"""with {p.sql}, b as (select var, level, sum(o)::double as o, sum(r)::double as r from ({one('x', w, 0)} union all {one('y', 0, w)}) group by all),
      n as (select *, sum(o) over (partition by var) as no, sum(r) over (partition by var) as nr from b), h as (select var, sqrt(sum((sqrt(o / no) - sqrt(r / nr)) ** 2)) / sqrt(2) as h from n group by var)
      select round(avg(h), 6) as hellinger_mean, round(max(h), 6) as hellinger_max, round(min(h), 6) as hellinger_min, count(*) as n_vars, round(1 - avg(h), 6) as utility_score from h"""


def gof_weighted_sql(p: Pair, col: str, group: str, w: str) -> str:
    return gof_sql(p, col, group).replace(f"select {group}, {col}, 1 as o, 0 as r from x", f"select {group}, {col}, {w} as o, 0 as r from x").replace(f"select {group}, {col}, 0, 1 from y", f"select {group}, {col}, 0, {w} from y")


def wass_weighted_sql(p: Pair, col: str, w: str) -> str:
    """A weighted quantile is the quantile of rows repeated by their weight."""
    probs = "[" + ", ".join(str(k / 999) for k in range(1000)) + "]"
    many = lambda s: f"(select quantile_cont(v, {probs}) from (select {col} as v, unnest(range({w}::bigint)) from {s}))"
    return f"with {p.sql} select round(list_sum(list_transform(list_zip({many('x')}, {many('y')}), lambda z: abs(z[1] - z[2]))) / 1000, 4) as wasserstein"


def ci_weighted_sql(p: Pair, cols: tuple[str, ...], w: str) -> str:
    out = ci_sql(p, cols)
    for c in cols:
        for side in "xy":
            mean = f"(select sum({w} * {c}) / sum({w}) from {side})"
            out = out.replace(f"(select avg({c}) as m, ", f"(select {mean} as m, ", 1)
            out = out.replace(f"stddev_samp({c})", f"sqrt(sum({w} * ({c} - {mean}) ** 2) / sum({w}))", 1)
    return out


def multi_weighted_sql(p: Pair, cols: tuple[str, ...], w: str) -> str:
    mean = lambda s, c: f"(select sum({w} * {c}) / sum({w}) from {s})"
    cov = lambda s, a, b: f"(select sum({w} * ({a} - {mean(s, a)}) * ({b} - {mean(s, b)})) / (sum({w}) - 1) from {s})"
    cor = lambda s, a, b: f"{cov(s, a, b)} / sqrt({cov(s, a, a)} * {cov(s, b, b)})"
    rows = " union all ".join(f"select '{a}' as var1, '{b}' as var2, {cov('x', a, b)} as vx, {cov('y', a, b)} as vy, {cor('x', a, b)} as cx, {cor('y', a, b)} as cy" for a, b in combinations(cols, 2))
    return f"with {p.sql}, c as ({rows}) select var1, var2, round(vx, 4) as cov_x, round(vy, 4) as cov_y, round(vx - vy, 4) as cov_diff, round(cx, 4) as cor_x, round(cy, 4) as cor_y, round(cx - cy, 4) as cor_diff from c"


def ecdf_weighted_sql(p: Pair, col: str, w: str) -> str:
    return ecdf_sql(p, col).replace(f"select {col}, 1 as a, 0 as b from x", f"select {col}, {w} as a, 0 as b from x").replace(f"select {col}, 0, 1 from y", f"select {col}, 0, {w} from y")


def regr_two_sql(p: Pair, a: str, b: str, y: str) -> str:
    """Two predictors by their normal equations."""
    fit = lambda s: f"""(select *, i * 0 as z, my - b1 * ma - b2 * mb as b0, (vy - b1 * cay - b2 * cby) * (n - 1) / (n - 3) as s2 from (select *, (vb * cay - cab * cby) / d as b1, (va * cby - cab * cay) / d as b2 from
      (select *, va * vb - cab * cab as d, 1 as i from (select count(*) as n, avg({a}) as ma, avg({b}) as mb, avg({y}) as my, var_samp({a}) as va, var_samp({b}) as vb, var_samp({y}) as vy,
        covar_samp({a}, {b}) as cab, covar_samp({a}, {y}) as cay, covar_samp({b}, {y}) as cby from {s}))))"""  # noqa: E731
    term = lambda name, e, se: f"select '{name}' as term, (select {e} from p) as e1, (select {e} from q) as e2, (select sqrt({se}) from p) as s1, (select sqrt({se}) from q) as s2"
    rows = [term("intercept", "b0", "s2 * (1 / n + (ma * ma * vb - 2 * ma * mb * cab + mb * mb * va) / d / (n - 1))"), term(a, "b1", "s2 * vb / d / (n - 1)"), term(b, "b2", "s2 * va / d / (n - 1)")]
    return f"""with {p.sql}, p as {fit('x')}, q as {fit('y')}, r as ({' union all '.join(rows)})
      select term, round(e1, 4) as estimate_x, round(e2, 4) as estimate_y, round(s1, 4) as se_x, round(s2, 4) as se_y, round(e2 - e1, 4) as bias, round((e2 - e1) / s1, 4) as std_bias from r"""


HILL_SQL = f"""with {ORD.sql}, t as (select o_totalprice as v, row_number() over (order by o_totalprice) as rn, count(*) over () as n from x where o_totalprice > (select quantile_cont(o_totalprice, 0.95) from x) and o_totalprice > 0),
  r as (select v as r, floor(sqrt(n)) as k from t where rn = n - floor(sqrt(n))) select round(any_value(k) / sum(ln(v / r)), 6) as hill from t, r where v > r"""
HUBER_SQL = f"""with recursive {CUST.sql}, m as (select median(c_acctbal) as med from x), s as (select med, 1.4826 * (select median(abs(c_acctbal - (select med from m))) from x) as mad from m),
  it as (select 0 as i, med as mu, false as done from s union all
    select i + 1, avg(greatest(mu - 1.5 * mad, least(mu + 1.5 * mad, c_acctbal))), abs(avg(greatest(mu - 1.5 * mad, least(mu + 1.5 * mad, c_acctbal))) - mu) < 1e-6 * any_value(mad) from it, s, x where not done and i < 50 group by i, mu)
  select round(mu, 6) as huber, round(mad, 6) as mad from it, s order by i desc limit 1"""


def missing_sql(p: Pair, cols: tuple[str, ...]) -> str:
    rows = " union all ".join(f"select '{c}' as var, a.m as n_missing_x, a.m / a.n as px, b.m as n_missing_y, b.m / b.n as py from (select count(*) filter ({c} is null) as m, count(*) as n from x) a, (select count(*) filter ({c} is null) as m, count(*) as n from y) b" for c in cols)
    return f"with {p.sql}, r as ({rows}) select var, n_missing_x, round(px, 6) as prop_missing_x, n_missing_y, round(py, 6) as prop_missing_y from r"


_NULLS = Pair("(select c_custkey, nullif(c_nationkey, 7) as c_nationkey, case when c_custkey % 13 <> 0 then c_acctbal end as c_acctbal, c_mktsegment from customer)", "c_custkey", (), "", (), ())


def _nulls(s, d):
    from pyspark.sql import functions as F

    return [
        f.withColumns({"c_nationkey": F.nullif("c_nationkey", F.lit(7)), "c_acctbal": F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal"))}) for f in CUST.frames(s, d)
    ]


_NC = ("c_nationkey", "c_acctbal", "c_mktsegment")
QUERIES = {
    "hellinger_ord": lambda s, d: rounded(C.hellinger(*ORD.frames(s, d), ORD.cat).summary),
    "hellinger_part": lambda s, d: rounded(C.hellinger(*PART.frames(s, d), ("p_brand", "p_type", "p_size")).summary),
    "contingency_fidelity": lambda s, d: rounded(C.contingency_fidelity(*PART.frames(s, d), ("p_brand", "p_type", "p_size")).groups),
    "chisq_utility": lambda s, d: rounded(C.chisq_utility(*ORD.frames(s, d), ORD.cat).summary),
    "chisq_gof": lambda s, d: rounded(C.chisq_gof(*ORD.frames(s, d), "o_orderpriority", ["o_orderstatus"])),
    "ks_ord": lambda s, d: rounded(D.compare_ks(*ORD.frames(s, d), "o_totalprice").drop("p_value")),
    "ks_by_group": lambda s, d: rounded(D.compare_ks(*ORD.frames(s, d), "o_totalprice", ["o_orderstatus"]).drop("p_value")),
    "wasserstein_line": lambda s, d: rounded(D.wasserstein(*LINE.frames(s, d), "l_extendedprice"), 4),
    "wasserstein_by_group": lambda s, d: rounded(D.wasserstein(*LINE.frames(s, d), "l_extendedprice", ["l_returnflag"]), 4),
    "wasserstein_nominal": lambda s, d: rounded(D.wasserstein_nominal(*ORD.frames(s, d), "o_orderpriority", ["o_orderstatus"])),
    "moments_by_group": lambda s, d: rounded(D.moments(LINE.frames(s, d)[0], ("l_quantity", "l_extendedprice"), ["l_returnflag"]), 4),
    "moments_weighted": lambda s, d: rounded(D.moments(LINE.frames(s, d)[0], ("l_extendedprice",), (), "l_quantity"), 4),
    "category_frequencies": lambda s, d: rounded(D.means_frequencies(*ORD.frames(s, d), ("o_totalprice",), ORD.cat)[1]),
    "correlation_pearson": lambda s, d: rounded(D.correlation_matrices(*LINE.frames(s, d), LINE.num).groups),
    "correlation_spearman": lambda s, d: rounded(D.correlation_matrices(*LINE.frames(s, d), LINE.num[:3], "spearman").groups),
    "correlation_summary": lambda s, d: rounded(D.correlation_matrices(*LINE.frames(s, d), LINE.num).summary),
    "mixed_associations": lambda s, d: rounded(D.mixed_associations(*PART.frames(s, d), PART.num, PART.cat)),
    "multivariate_statistics": lambda s, d: rounded(D.multivariate_statistics(*LINE.frames(s, d), LINE.num), 4),
    "ci_proximity": lambda s, d: rounded(D.ci_proximity(*LINE.frames(s, d), LINE.num).groups.drop("lower_x", "upper_x", "lower_y", "upper_y"), 4),
    "outliers_zscore": lambda s, d: rounded(D.compare_outliers(*LINE.frames(s, d), LINE.num)),
    "outliers_iqr": lambda s, d: rounded(D.compare_outliers(*PART.frames(s, d), PART.num, method="iqr")),
    "missing_percentage": lambda s, d: rounded(C.missing_values(*_nulls(s, d), _NC)),
    "missing_patterns": lambda s, d: C.missing_patterns(_nulls(s, d)[0], _NC),
    "density_histogram": lambda s, d: rounded(D.density_histogram(*LINE.frames(s, d), "l_extendedprice").drop("upper"), 9).selectExpr("bin", "round(lower, 4) as lower", "density_x", "density_y"),
    "boxplot": lambda s, d: rounded(D.boxplot_stats(LINE.frames(s, d)[0], "l_extendedprice", ["l_returnflag"]), 4),
    "ecdf": lambda s, d: rounded(D.ecdf_table(*CUST.frames(s, d), "c_acctbal")),
    "ecdf_by_group": lambda s, d: rounded(D.ecdf_table(*CUST.frames(s, d), "c_acctbal", ["c_mktsegment"])),
    "hill_tail_index": lambda s, d: rounded(D.one_row(CUST.frames(s, d)[0], hill=D.hill_estimator(ORD.frames(s, d)[0], "o_totalprice"))),
    "deviation_by_group": lambda s, d: rounded(D.group_deviation(CUST.frames(s, d)[0], "c_acctbal", ["c_mktsegment"])),
    "huber_location": lambda s, d: rounded(D.one_row(CUST.frames(s, d)[0], huber=D.huber(CUST.frames(s, d)[0], "c_acctbal"), mad=D.median_absolute_deviation(CUST.frames(s, d)[0], "c_acctbal"))),
    "tail_fidelity": lambda s, d: rounded(D.tail_fidelity(*LINE.frames(s, d), ("l_quantity", "l_extendedprice")).groups),
    "copula_fidelity": lambda s, d: rounded(D.copula_fidelity(*CUST.frames(s, d), CUST.num, n_grid=20).groups, 9),
    "regression_fidelity": lambda s, d: rounded(D.regression_fidelity(*LINE.frames(s, d), "l_quantity", "l_extendedprice").groups.drop("ci_overlap", "sig_agree"), 4),
    "hellinger_weighted": lambda s, d: rounded(C.hellinger(*PART.frames(s, d), PART.cat, weight_x="p_size", weight_y="p_size").summary),
    "chisq_gof_weighted": lambda s, d: rounded(C.chisq_gof(*LINE.frames(s, d), "l_linestatus", ["l_returnflag"], weight_x="l_quantity", weight_y="l_quantity")),
    "wasserstein_weighted": lambda s, d: rounded(D.wasserstein(*LINE.frames(s, d), "l_extendedprice", weight_x="l_quantity", weight_y="l_quantity"), 4),
    "ci_proximity_weighted": lambda s, d: rounded(D.ci_proximity(*LINE.frames(s, d), LINE.num[1:], weight_x="l_quantity", weight_y="l_quantity").groups.drop("lower_x", "upper_x", "lower_y", "upper_y"), 4),
    "multivariate_weighted": lambda s, d: rounded(D.multivariate_statistics(*LINE.frames(s, d), LINE.num[1:], weight_x="l_quantity", weight_y="l_quantity"), 4),
    "ecdf_weighted": lambda s, d: rounded(D.ecdf_table(*PART.frames(s, d), "p_retailprice", weight_x="p_size", weight_y="p_size")),
    "regression_two_predictors": lambda s, d: rounded(D.regression_fidelity(*LINE.frames(s, d), ("l_quantity", "l_discount"), "l_extendedprice").groups.drop("ci_overlap", "sig_agree"), 4),
    "pmse_saturated": lambda s, d: rounded(C.saturated_pmse(*PART.frames(s, d), ("p_brand", "p_type")).summary),
}
SQL = {
    "hellinger_ord": hellinger_sql(ORD, ORD.cat), "hellinger_part": hellinger_sql(PART, ("p_brand", "p_type", "p_size")),
    "contingency_fidelity": contingency_sql(PART, ("p_brand", "p_type", "p_size")), "chisq_utility": chisq_sql(ORD, ORD.cat),
    "chisq_gof": gof_sql(ORD, "o_orderpriority", "o_orderstatus"), "ks_ord": ks_sql(ORD, "o_totalprice", None), "ks_by_group": ks_sql(ORD, "o_totalprice", "o_orderstatus"),
    "wasserstein_line": wass_sql(LINE, "l_extendedprice", None), "wasserstein_by_group": wass_sql(LINE, "l_extendedprice", "l_returnflag"),
    "wasserstein_nominal": tv_sql(ORD, "o_orderpriority", "o_orderstatus"), "moments_by_group": moments_sql(LINE, ("l_quantity", "l_extendedprice"), "l_returnflag"),
    "moments_weighted": weighted_sql(LINE, "l_extendedprice", "l_quantity"), "category_frequencies": freq_sql(ORD, ORD.cat), "correlation_pearson": corr_sql(LINE, LINE.num, False),
    "correlation_spearman": corr_sql(LINE, LINE.num[:3], True), "correlation_summary": corr_summary_sql(LINE, LINE.num), "mixed_associations": mixed_sql(PART, PART.num, PART.cat),
    "multivariate_statistics": multi_sql(LINE, LINE.num), "ci_proximity": ci_sql(LINE, LINE.num), "outliers_zscore": outlier_sql(LINE, LINE.num, "zscore"),
    "outliers_iqr": outlier_sql(PART, PART.num, "iqr"), "missing_percentage": missing_sql(_NULLS, _NC),
    "missing_patterns": f"with {_NULLS.sql} select concat({', '.join(f'''case when {c} is null then 'M' else 'O' end''' for c in _NC)}) as pattern, count(*) as n from x group by 1",
    "density_histogram": hist_sql(LINE, "l_extendedprice", 30), "boxplot": box_sql(LINE, "l_extendedprice", "l_returnflag"), "ecdf": ecdf_sql(CUST, "c_acctbal"),
    "ecdf_by_group": f"""with {CUST.sql}, v as (select c_mktsegment, c_acctbal::double as v, sum(a)::double as a, sum(b)::double as b from (select c_mktsegment, c_acctbal, 1 as a, 0 as b from x union all select c_mktsegment, c_acctbal, 0, 1 from y) group by 1, 2)
      select c_mktsegment, v, round(sum(a) over (partition by c_mktsegment order by v) / sum(a) over (partition by c_mktsegment), 6) as ecdf_x, round(sum(b) over (partition by c_mktsegment order by v) / sum(b) over (partition by c_mktsegment), 6) as ecdf_y from v""",
    "hellinger_weighted": hellinger_weighted_sql(PART, PART.cat, "p_size"), "chisq_gof_weighted": gof_weighted_sql(LINE, "l_linestatus", "l_returnflag", "l_quantity"),
    "wasserstein_weighted": wass_weighted_sql(LINE, "l_extendedprice", "l_quantity"), "ci_proximity_weighted": ci_weighted_sql(LINE, LINE.num[1:], "l_quantity"),
    "multivariate_weighted": multi_weighted_sql(LINE, LINE.num[1:], "l_quantity"), "ecdf_weighted": ecdf_weighted_sql(PART, "p_retailprice", "p_size"),
    "regression_two_predictors": regr_two_sql(LINE, "l_quantity", "l_discount", "l_extendedprice"), "hill_tail_index": HILL_SQL, "huber_location": HUBER_SQL,
    "deviation_by_group": f"with {CUST.sql}, m as (select c_mktsegment, median(c_acctbal) as median from x group by 1) select c_mktsegment, round(any_value(median), 6) as median, round(1.4826 * median(abs(c_acctbal - median)), 6) as mad from x join m using (c_mktsegment) group by 1",
    "tail_fidelity": tail_sql(LINE, ("l_quantity", "l_extendedprice")), "copula_fidelity": copula_sql(CUST, CUST.num, 20),
    "regression_fidelity": regr_sql(LINE, "l_quantity", "l_extendedprice"), "pmse_saturated": pmse_sql(PART, ("p_brand", "p_type")),
}
