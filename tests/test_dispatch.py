"""Measures by name, printed results, conversions, and the map's measures."""

import pytest
from pyspark.sql import functions as F

from vantagrain.operators import frameworks, ranks
from vantagrain.sources import ReleasePair


@pytest.fixture(scope="module")
def pair(spark):
    rows = [(i, i % 3, "ab"[i % 2], float(i * 7 % 40), "xyz"[i * 5 % 3]) for i in range(240)]
    x = spark.createDataFrame(rows, "id bigint, k int, c string, v double, t string")
    y = x.withColumn("v", F.col("v") + F.col("id") % 5)
    h = x.withColumn("id", F.col("id") + 1000).withColumn("v", F.col("v") + 1)
    return ReleasePair(x, y, "id", keys=["k", "c"], target="t", cols=["k", "c", "v", "t"], holdout=h)


def test_measures_by_name(pair):
    for name in ("dcap", "ims", "dcr", "suda", "record_linkage", "hellinger", "ci_proximity", "tail_fidelity"):
        assert frameworks.run(pair, name).summary.count() == 1
    assert frameworks.run(pair, "kanonymity", k=2).summary.first().k_level == 40
    with pytest.raises(ValueError, match="unknown measure"):
        frameworks.run(pair, "nothing")


def test_results_as_text(pair):
    found = frameworks.run(pair, "hellinger")
    assert "hellinger_mean" in found.text() and "var" in found.text()
    assert "#" in frameworks.run(pair, "record_linkage").plot("risk", bins=5)


def test_pandas_both_ways(spark, pair):
    tables = pair.to_pandas()
    back = ReleasePair.from_pandas(spark, tables["original"], tables["released"], "id", keys=["k"])
    assert back.original.count() == 240 and set(tables) == {"original", "released", "holdout"}


def test_every_measure_of_the_map(pair):
    some = ["dcap", "tcap", "disco", "ims", "repu", "dcr", "nndr"], ["wasserstein", "hellinger", "energy", "ci_proximity", "mmd", "copula", "tail", "contingency"]
    rows = frameworks.score_release(pair, "r", *some)
    assert {m for _, _, m, _ in rows} == {*some[0], *some[1]}
    assert all(0 <= v <= 1 for _, _, m, v in rows if m not in ("nndr",))
    alone = ReleasePair(pair.original, pair.released, "id", cols=["v"])
    assert {m for _, _, m, _ in frameworks.score_release(alone, "r", *some)} == {"ims", "repu", "wasserstein", "energy", "ci_proximity", "mmd", "tail"}


def test_p_value_expression_equals_the_function(spark):
    rows = [(d / 50, n, m) for d in range(0, 50, 3) for n, m in ((10, 12), (400, 90), (5000, 5000))]
    df = spark.createDataFrame(rows, "d double, n bigint, m bigint").withColumn("p", ranks.ks_p_column(F.col("d"), F.col("n"), F.col("m")))
    for r in df.collect():
        assert r.p == pytest.approx(ranks.ks_p_value(r.d, r.n, r.m), abs=1e-12)


def test_missing_values_groups_and_two_way_terms(spark):
    """Strategies for nulls, withheld groups, permutations and interactions."""
    import numpy as np

    from vantagrain.operators import cells, models

    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.normal()), "ab"[rng.integers(0, 2)]) for i in range(400)]
    x = spark.createDataFrame([(i, a, b, c, 2 * a + b if i % 9 else None) for i, a, b, c in rows], "id bigint, a double, b double, c string, t double")
    counts = {s: models.rapid(x, x, "id", ("a", "b"), "t", model="lm", na_strategy=s).summary.first().n_records for s in ("complete", "drop", "median", "constant")}
    assert counts == {"complete": 355, "drop": 355, "median": 400, "constant": 400}
    lost = {r.key: r.delta_rapid for r in models.rapid_contributions(x, x, "id", ("a", "b", "c"), "t", groups={"both": ["a", "b"]}, model="lm").collect()}
    assert set(lost) == {"a", "b", "c", "both"} and lost["both"] >= lost["b"] > lost["c"]
    with pytest.raises(ValueError, match="group"):
        models.rapid_contributions(x, x, "id", ("a", "b"), "t", groups={"all": ["a", "b"]}, model="lm")
    # equal margins, another dependence: only the product tells the sides apart
    y = spark.createDataFrame([(i, a, abs(b) * (1 if a > 0 else -1), c) for i, a, b, c in rows], "id bigint, a double, b double, c string")
    one = models.pmse(x.drop("t"), y, "id", ["a", "b", "c"], n_perm=3).summary.first()
    two = models.pmse(x.drop("t"), y, "id", ["a", "b", "c"], max_order=2).summary.first()
    assert two.pmse > 3 * one.pmse and 0 < one.perm_p <= 1
    assert models.pmse(x.drop("t"), y, "id", ["a", "b"], breaks={"a": 4}).summary.first().pmse > 0
    fits = [cells.chisq_gof_simulated(x, d, "c", rounds=500).first() for d in (x, x.filter("c = 'a'"))]
    assert fits[0].p_value == 1 and fits[1].p_value < 0.01
