"""Composite frameworks, densities, geometry and streaming on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantagrain.operators import attribution, density, frameworks, models
from vantagrain.sources import ReleasePair, read_table
from vantagrain.streaming import class_sizes, k_level_sink


def test_pareto_front(spark):
    rows = [("a", 0.1, 0.9), ("b", 0.2, 0.8), ("c", 0.5, 0.95), ("d", 0.1, 0.9), ("e", 0.1, 0.2), ("f", 0.6, 0.95)]
    scores = spark.createDataFrame([(n, k, k, v) for n, r, u in rows for k, v in (("risk", r), ("utility", u))], "release string, kind string, measure string, value double")
    front = {r.release for r in frameworks.risk_utility_map(scores).filter("pareto").collect()}
    beats = lambda p, q: p[1] <= q[1] and p[2] >= q[2] and p[1:] != q[1:]
    assert front == {q[0] for q in rows if not any(beats(p, q) for p in rows)}


def test_report_skips_and_survives_errors(spark):
    x = spark.createDataFrame([(n, "ab"[n % 2], float(n)) for n in range(40)], "id bigint, k string, v double")
    results, overall = frameworks.disclosure_report(ReleasePair(x, x, "id", keys=["k"], target="v"), ["cap", "ims", "dcr", "k_anonymity"])
    status = {r.metric: r.status for r in results.collect()}
    assert status["dcr"] == "SKIPPED" and status["ims"] == "WARNING" and status["k_anonymity"] == "PASS"
    assert overall.first().overall_risk in ("MEDIUM", "HIGH")


def test_density_against_the_formula(spark):
    values = np.random.default_rng(1).normal(size=200)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    grid = np.linspace(-2, 2, 9)
    want = np.exp(-0.5 * ((grid[:, None] - values[None, :]) / 0.4) ** 2).sum(axis=1) / (200 * 0.4 * math.sqrt(2 * math.pi))
    assert density.density(df, "v", grid, bw=0.4) == pytest.approx(want, rel=1e-4)


def test_density_based_noise_against_brute_force(spark):
    pts = np.random.default_rng(2).normal(size=(120, 2)) * 2
    df = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(pts)], "id bigint, a double, b double")
    got = {r.id: (r.core, r.noise) for r in density.dbscan_noise(df, "id", ["a", "b"], eps=0.7, min_points=5).collect()}
    near = ((pts[:, None] - pts[None]) ** 2).sum(axis=2) <= 0.49
    core = near.sum(axis=1) >= 5
    assert got == {n: (bool(core[n]), not bool((near[n] & core).any())) for n in range(120)}


def test_robust_covariance_resists_outliers():
    rng = np.random.default_rng(0)
    pts = np.concatenate((rng.normal(size=(200, 2)), np.full((20, 2), 50.0)))
    mean, cov = density.robust_covariance(pts)
    assert np.abs(mean).max() < 0.4 and np.abs(cov - np.eye(2)).max() < 0.6


def test_linear_attribute_prediction_agrees_with_the_closed_form(spark):
    rng = np.random.default_rng(3)
    rows = [(n, float(v), float(3 * v + rng.normal())) for n, v in enumerate(rng.uniform(1, 9, 80))]
    df = spark.createDataFrame(rows, "id bigint, k double, t double")
    x, y = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    a = models.rapid(x, y, "id", ["k"], "t", model="lm").summary.first()
    b = attribution.rapid_linear(x, y, "id", "k", "t").summary.first()
    assert a.n_at_risk == b.n_at_risk and a.fit == pytest.approx(b.rmse)


def test_reading_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, k string")
    for form in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / f"t.{form}")
        df.write.format(form).options(**({"header": True} if form == "csv" else {})).save(path)
        assert [tuple(r) for r in read_table(spark, path).select("id", "k").collect()] == [(1, "a")]


def test_streamed_class_sizes(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").write.parquet(src)
    stream = class_sizes(spark.readStream.schema("k string").parquet(src), ["k"])
    query = stream.writeStream.outputMode("complete").foreachBatch(k_level_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("epoch")).first()
    assert (row.k_level, row.n_records, row.n_ec, row.n_unique) == (1, 3, 2, 1)
