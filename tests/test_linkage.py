"""Linkage by block against plain comparison, and quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantagrain.operators import common, density, distance, linkage


def brute(x, y, k=None, tau=None):
    """(risk, cand_n, d_rank) of each id by Gower distance within its block."""
    values = [r["v"] for r in x + y]
    span = max(values) - min(values)
    out = {}
    for a in x:
        near = [(round((abs(a["v"] - b["v"]) / span + (a["s"] != b["s"])) / 2, 12), b["id"]) for b in y if b["b"] == a["b"]]
        if not near:
            out[a["id"]] = (0.0, 0, None)
            continue
        ds = sorted(d for d, _ in near)
        limit = tau if tau is not None else ds[min(k or 1, len(ds)) - 1]
        kept = [i for d, i in near if d <= limit]
        true = next((d for d, i in near if i == a["id"]), None)
        out[a["id"]] = (round(1 / len(kept), 9) if a["id"] in kept else 0.0, len(kept), None if true is None else 1 + sum(d < true for d in ds))
    return out


def rows(rng, n, blocks):
    return [{"id": i, "v": float(rng.integers(0, 30)), "s": "uvw"[rng.integers(0, 3)], "b": f"b{rng.choice(blocks)}"} for i in range(n)]


@pytest.mark.parametrize("params", [{}, {"strategy": "topk", "k": 4}, {"strategy": "threshold", "tau": 0.1}])
@pytest.mark.parametrize("size", [2048, 7])
def test_blocks_on_one_side_only(spark, monkeypatch, params, size):
    """Blocks that one table lacks, blocks cut into parts, and many ties."""
    rng = np.random.default_rng(5)
    x, y = rows(rng, 150, [0, 1, 2, 3]), rows(rng, 140, [2, 3, 4, 5])
    for a, b in zip(x, y, strict=False):
        if rng.random() < 0.5 and a["b"] in ("b2", "b3"):
            b |= {"v": a["v"], "s": a["s"], "b": a["b"]}
    kind = "id bigint, v double, s string, b string"
    frames = [spark.createDataFrame([tuple(r[c] for c in ("id", "v", "s", "b")) for r in t], kind) for t in (x, y)]
    monkeypatch.setattr(linkage, "BLOCK_ROWS", size)
    found = linkage.record_linkage(*frames, "id", ("v", "s"), block=("b",), **params)
    got = {r.id: (round(r.risk, 9), r.cand_n, r.d_rank) for r in found.records.collect()}
    assert got == brute(x, y, params.get("k"), params.get("tau"))
    pairs = {r.id: r.n for r in found.params["pairs_of"](F.lit(True)).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert pairs == {i: n for i, (_, n, _) in got.items() if n}


def test_all_blocks_on_one_side(spark):
    kind = "id bigint, v double, b string"
    x, y = (spark.createDataFrame([(i, float(i), b) for i in range(4)], kind) for b in "az")
    for block in (("b",), ()):
        records = linkage.record_linkage(x, y, "id", ("v",), block=block).records.collect()
        assert len(records) == 4 and all((r.cand_n == 0) == bool(block) for r in records)
    assert linkage.record_linkage(x.limit(0), y, "id", ("v",), block=("b",)).records.count() == 0


def test_agreement_rates_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = [(i, float(rng.integers(0, 9)), "pq"[rng.integers(0, 2)] if i % 7 else None) for i in range(60)]
    y = [(i, v + (i % 5 == 0) * 4, s) for i, v, s in x]
    frames = [spark.createDataFrame(t, "id bigint, v double, s string") for t in (x, y)]
    m, u = linkage.agreement_rates(*frames, "id", ("v", "s"))
    v = np.array([r[1] for r in x])
    tol = 1.4826 * np.median(np.abs(v - np.median(v)))
    for c, k, agrees in (("v", 1, lambda a, b: abs(a - b) <= tol), ("s", 2, lambda a, b: a == b)):
        pairs = [(a[0] == b[0], agrees(a[k], b[k])) for a in x for b in y if a[k] is not None and b[k] is not None]
        for rates, same in ((m, True), (u, False)):
            share = np.mean([g for e, g in pairs if e == same])
            assert rates[c] == pytest.approx(min(0.99, share) if share > 0 else 0.01)


def test_many_quantiles_without_the_percentile_aggregate(spark):
    """A thousand probabilities, groups, nulls, ties and a value that most rows share."""
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(size=900)] + [("b", 5.0)] * 400 + [("b", float(v)) for v in rng.integers(0, 9, 100)] + [(None, 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [k / 999 for k in range(1000)]
    got = {r.g: r.q for r in common.group_quantiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, q in got.items():
        assert q == pytest.approx(list(np.quantile([v for h, v in rows if h == g], probs)))
    assert common.quantiles(df, "v", probs) == pytest.approx(list(np.quantile([v for _, v in rows if v is not None], probs)))
    assert common.group_quantiles(df, "v", [0.5, 0.1], ["g"], max_rows=0).filter("g = 'a'").first().q == pytest.approx(list(np.quantile([v for h, v in rows if h == "a"], [0.5, 0.1])))


def test_concentration_over_all_rows_resists_outliers(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.multivariate_normal([0, 0], [[2, 1], [1, 3]], 3000), rng.normal(40, 1, (900, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id bigint, a double, b double")
    mean, cov = density.concentrated_covariance(df, ("a", "b"), sample=300)
    whole_mean, whole_cov = density.robust_covariance(points)  # the same search in numpy, over all rows
    assert np.allclose(mean, whole_mean, atol=0.1) and np.allclose(cov, whole_cov, rtol=0.1)
    assert np.abs(mean).max() < 0.2 and np.linalg.det(np.cov(points.T)) > 50 * np.linalg.det(cov)
    flags = density.robust_outliers(df, "id", ("a", "b")).filter("outlier").select("id").collect()
    assert sum(r.id >= 3000 for r in flags) == 900 and len(flags) < 1200


def test_random_features_and_distance_sums(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(80, 2)), rng.normal(1, 1, (70, 2))
    frames = [spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(t)], "id bigint, p double, q double") for t in (a, b)]
    row = distance.energy_distance(*frames, "id", ("p", "q")).summary.first()
    both = np.vstack([a, b])
    z = (both - both.mean(axis=0)) / both.std(axis=0, ddof=1)
    gap = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)).sum()
    x, y = z[:80], z[80:]
    assert row.mean_dist_xy == pytest.approx(gap(x, y) / 5600) and row.mean_dist_xx == pytest.approx(gap(x, x) / (80 * 79))
    omega = np.random.default_rng(1)
    w, phase = omega.normal(0, 0.5, (2, 500)), omega.uniform(0, 2 * np.pi, 500)
    want = 2 / 500 * ((np.cos(x @ w + phase).mean(axis=0) - np.cos(y @ w + phase).mean(axis=0)) ** 2).sum()
    assert distance.mmd_rff(*frames, ("p", "q"), sigma=2.0).first().mmd2 == pytest.approx(want, rel=1e-4)
