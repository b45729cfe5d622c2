"""Micro tables with answers worked by hand, invariants and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantagrain.functions import information as info
from vantagrain.operators import attribution, blocks, cells, common, copies, distance, distributions, linkage, ranks, sdc
from vantagrain.sources import ReleasePair


def table(spark, rows, schema):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"id bigint, {schema}")


def test_tcap_kinds_first_table(spark):
    x = table(spark, [("A", "T1"), ("A", "T2"), ("B", "T1"), ("B", "T1"), ("C", "T1")], "k string, t string")
    y = table(spark, [("A", "T1"), ("A", "T2"), ("B", "T1"), ("C", "T1")], "k string, t string")
    found = attribution.tcap(x, y, "id", ["k"], "t")
    row = found.summary.first()
    assert sorted(r.cap for r in found.records.collect()) == [0.5, 0.5, 1, 1, 1]
    assert (row.n_certain, row.n_disclosive) == (3, 3)
    assert (row.tcap_certain, row.tcap_matched, row.tcap_conditional) == (60, 60, 100)


def test_tcap_kinds_second_table(spark):
    x = table(spark, [("A", "T1"), ("A", "T1"), ("A", "T2"), ("B", "T2"), ("D", "T3"), ("D", "T4")], "k string, t string")
    y = table(spark, [("A", "T1"), ("B", "T2"), ("D", "T3"), ("D", "T4")], "k string, t string")
    row = attribution.tcap(x, y, "id", ["k"], "t").summary.first()
    assert (row.n_certain, row.n_disclosive_correct, row.n_disclosive) == (1, 3, 4)
    assert (round(row.tcap_certain, 2), row.tcap_matched, row.tcap_conditional) == (16.67, 50, 75)


def test_identical_tables(spark):
    rows = [(f"k{n}", float(n), "ab"[n % 2]) for n in range(10)]
    x = table(spark, rows, "k string, v double, c string")
    assert attribution.dcap(x, x, "id", ["k"], "v").summary.first().cap == 1
    assert copies.ims(x, x, "id", ["k", "v", "c"]).summary.first().ims == 1
    assert cells.hellinger(x, x, ["k", "c"]).summary.first().hellinger_mean == pytest.approx(0)
    assert distance.paired_gower(x, x, "id", ["v", "c"]).summary.first().gower_distance == 0
    assert distributions.compare_ks(x, x, "v").first().ks_statistic == 0


def test_disjoint_categories(spark):
    x, y = table(spark, [("a",), ("b",)], "c string"), table(spark, [("d",), ("e",)], "c string")
    assert cells.hellinger(x, y, ["c"]).summary.first().hellinger_mean == pytest.approx(1)


def test_equivalence_classes(spark):
    unique = table(spark, [(f"k{n}",) for n in range(10)], "k string")
    row = sdc.kanonymity(unique, "id", ["k"]).summary.first()
    assert (row.k_level, row.n_unique, row.satisfies_k) == (1, 10, False)
    assert sdc.individual_risk(unique, "id", ["k"]).summary.first().mean_risk == 1
    assert sdc.suda(unique, "id", ["k"]).summary.first().n_msu == 10
    same = table(spark, [("z",)] * 7, "k string")
    assert sdc.kanonymity(same, "id", ["k"]).summary.first().k_level == 7
    assert sdc.suda(same, "id", ["k"]).summary.first().max_suda == 0


def test_nulls_are_dropped_or_kept(spark):
    df = table(spark, [("a",), (None,), (None,)], "k string")
    assert sdc.kanonymity(df, "id", ["k"]).summary.first().n_records == 1
    row = sdc.kanonymity(df, "id", ["k"], na_rm=False).summary.first()
    assert (row.n_records, row.n_ec, row.k_level) == (3, 2, 1)
    found = attribution.cap_scores(df.withColumn("t", F.lit("x")), df.withColumn("t", F.lit("x")), "id", ["k"], "t", na_rm=False)[0]
    assert {r.cap for r in found.collect()} == {1.0}


def test_nndr_of_a_copied_repeated_row(spark):
    t = table(spark, [(1.0,), (1.0,), (1.0,), (9.0,)], "v double")
    y = table(spark, [(1.0,)], "v double")
    h = table(spark, [(2.0,), (5.0,)], "v double")
    assert distance.nndr(t, y, h, "id", ["v"]).records.first().nndr_train == 0


def test_nearest_against_brute_force_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 20)), "abc"[rng.integers(0, 3)]) for _ in range(60)]
    a = table(spark, rows[:25], "v double, c string")
    b = table(spark, rows[25:], "v double, c string")
    spans = blocks.ranges([a, b], ["v", "c"])
    va, vb = (blocks.vectors(d, "id", ["v", "c"], spans) for d in (a, b))
    found = {r.id: r for r in blocks.nearest(va, vb, cat_weights=[0.5], radius=0.2, block_rows=7).collect()}
    for i, (v, c) in enumerate(rows[:25]):
        d = [round(abs(v - w) / spans["v"] / 2 + 0.5 * (c != e), 12) for w, e in rows[25:]]
        r = found[i]
        assert (r.d1, r.d2) == (pytest.approx(sorted(d)[0]), pytest.approx(sorted(d)[1]))
        assert r.d1_id == d.index(min(d)) and r.n_within == sum(x <= 0.2 for x in d) and r.sum_d == pytest.approx(sum(d))


def test_linkage_worked_example(spark):
    rows = [(30, "M", "A"), (40, "M", "B"), (50, "F", "A"), (60, "F", "B"), (70, "M", "A"), (80, "F", "B")]
    x = table(spark, rows, "age int, sex string, city string")
    swapped = [(60 if n == 1 else 40 if n == 3 else a, s, c) for n, (a, s, c) in enumerate(rows)]
    y = table(spark, swapped, "age int, sex string, city string")
    found = {r.id: r for r in linkage.record_linkage(x, y, "id", ["age", "sex", "city"]).records.collect()}
    assert found[0].risk == 1 and found[0].d_true == 0
    assert found[3].risk == 0.5 and found[3].cand_n == 2 and found[3].d_true == pytest.approx(0.1333, abs=1e-4)


def test_fellegi_sunter_worked_example(spark):
    x = table(spark, [("M", "N", "A"), ("F", "S", "B"), ("M", "E", "C"), ("F", "W", "A"), ("M", "N", "D")], "sex string, region string, job string")
    y = table(spark, [("M", "N", "A"), ("F", "S", "B"), ("F", "E", "C"), ("F", "N", "B"), ("M", "S", "D")], "sex string, region string, job string")
    m, u = {"sex": 0.95, "region": 0.80, "job": 0.85}, {"sex": 0.50, "region": 0.25, "job": 0.10}
    found = {r.id: r for r in linkage.record_linkage(x, y, "id", ["sex", "region", "job"], method="probabilistic", m=m, u=u).records.collect()}
    assert found[0].risk == 1 and -found[0].d_true == pytest.approx(3.945, abs=1e-3)


def test_pram_worked_example(spark):
    from vantagrain.plans.linkage import _transitions

    x = table(spark, [("R", "C"), ("G", "S"), ("B", "T"), ("R", "C"), ("G", "T")], "color string, shape string")
    y = table(spark, [("R", "C"), ("B", "S"), ("B", "T"), ("G", "S"), ("G", "T")], "color string, shape string")
    found = {r.id: r for r in linkage.pram_risk(x, y, "id", ["color", "shape"], _transitions(spark)).records.collect()}
    assert found[0].p_true == pytest.approx(0.72) and found[0].risk == pytest.approx(0.9730, abs=1e-4)
    assert found[3].p_true == pytest.approx(0.005) and found[3].risk == pytest.approx(0.0068, abs=1e-4)


def test_assignment_and_transport():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(20):
        c = rng.random((5, 6))
        to = linkage.assign_bijective(c)
        best = min(sum(c[i, p[i]] for i in range(5)) for p in permutations(range(6), 5))
        assert sum(c[i, to[i]] for i in range(5)) == pytest.approx(best)
    plan = linkage.sinkhorn(rng.random((4, 4)), max_iter=2000)
    assert plan.sum(axis=0) == pytest.approx(np.full(4, 0.25), abs=1e-4)


def test_quantiles_by_refinement_equal_the_aggregate(spark):
    rng = np.random.default_rng(5)
    values = [float(v) for v in np.concatenate((rng.normal(size=500), np.full(300, 1.5), rng.integers(0, 5, 200)))] + [float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").unionByName(spark.createDataFrame([(None,)], "v double"))
    probs = [0, 0.1, 0.25, 0.333, 0.5, 0.9, 1]
    want = np.quantile(values[:-1], probs)
    assert common.quantiles(df, "v", probs) == pytest.approx(list(want))
    assert common.quantiles(df, "v", probs, max_rows=0) == pytest.approx(list(want))
    assert common.quantiles(df.limit(0), "v", probs) == []


def test_running_sums_do_not_depend_on_buckets(spark):
    df = spark.createDataFrame([(float(v), v % 3 + 1) for v in range(50)], "v double, n bigint")
    one = ranks.running(df, "v", ["n"]).orderBy("v").collect()
    many = ranks.running(df, "v", ["n"], bucket_rows=7).orderBy("v").collect()
    assert [(r.v, r.run_n) for r in one] == [(r.v, r.run_n) for r in many]


def test_auc_with_ties(spark):
    p, n = (spark.createDataFrame([(float(v),) for v in vs], "v double") for vs in ([1, 2, 2], [0, 2]))
    assert ranks.auc(p, n, "v").first().auc == pytest.approx((1 + 0 + 1 + 0.5 + 1 + 0.5) / 6)


def test_divergence_of_equal_distributions_and_zero_terms(spark):
    df = spark.createDataFrame([(0.0, 0.2), (0.5, 0.3), (0.5, 0.5)], "a double, b double")
    row = df.agg(info.kl_divergence(F.col("a"), F.col("b")).alias("kl"), info.kl_divergence(F.col("a"), F.col("a")).alias("zero")).first()
    assert row.kl == pytest.approx(0.5 * np.log(0.5 / 0.3)) and row.zero == 0


def test_permanent():
    assert info.permanent([[1, 1], [1, 1]]) == 2
    assert info.system_anonymity_level([[1, 1, 1]] * 3) == pytest.approx(1)
    assert info.system_anonymity_level([[1, 0], [0, 1]]) == 0


def test_drisk_band_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    xs, ys = rng.normal(size=(80, 2)), rng.normal(size=(90, 2))
    x, y = (table(spark, [tuple(map(float, r)) for r in v], "a double, b double") for v in (xs, ys))
    found = distance.drisk_interval(x, y, "id", ["a", "b"], outlier_par=2.0)
    w = [found.params["widths"][c] for c in "ab"]
    want = {i for i, p in enumerate(xs) if any(abs(p[0] - q[0]) <= w[0] and abs(p[1] - q[1]) <= w[1] for q in ys)}
    assert {r.id for r in found.records.collect()} == want


def test_pair_validation(spark):
    x, y = spark.createDataFrame([(1, "a")], "id int, k string"), spark.createDataFrame([(1, 2)], "id int, k int")
    with pytest.raises(ValueError, match="different class"):
        ReleasePair(x, y, "id")
    with pytest.raises(ValueError, match="No common"):
        ReleasePair(x, y.select("id"), "id")
    pair = ReleasePair(x, x, "id", keys=["k"]).with_holdout(0.5)
    assert pair.original.count() + pair.holdout.count() == 1


def test_empty_tables(spark):
    x = table(spark, [("a", 1.0)], "k string, v double")
    none = x.limit(0)
    assert sdc.kanonymity(none, "id", ["k"]).summary.first().n_ec == 0
    assert copies.ims(x, none, "id", ["k"]).summary.first().n_identical == 0
    assert attribution.dcap(x, none, "id", ["k"], "v").summary.first().n_unmatched == 1
