"""Many equal records, tiles, and blocks of any size: whole results with less work."""

import numpy as np
import pyarrow as pa
import pytest

from vantagrain.operators import blocks, distance, lines, linkage, places

SPEC = {"kind": "gower", "na": "ignore", "null": 0, "num_w": [1.0, 1.0], "cat_w": [1.0]}


@pytest.mark.parametrize("k", [1, 3])
def test_tiles_leave_out_only_references_that_cannot_matter(k):
    rng = np.random.default_rng(k)
    side = lambda n: (rng.random((n, 2)), rng.integers(1, 6, (n, 1)))
    va, vb = side(2000), side(3000)
    a, b = pa.table({"block": np.zeros(2000, np.int64)}), pa.table({"r_block": np.zeros(3000, np.int64)})
    every, reach, met = linkage._distances(va, vb, SPEC), np.full(2000, 0.005), 0
    seen = np.zeros(2000, int)
    for ia, ib in linkage._blocks(a, b, va, vb, SPEC, reach, k):
        seen[ia] += 1
        met += len(ia) * len(ib)
        left = np.setdiff1d(np.arange(3000), ib)
        far = np.maximum(0.005, np.sort(every[ia], axis=1)[:, k - 1])
        assert (every[np.ix_(ia, left)] > far[:, None]).all()
    assert (seen == 1).all() and met < 2000 * 3000 / 4


def test_equal_records_meet_once(spark, monkeypatch):
    x = spark.range(400).selectExpr("id", "cast(id % 4 as double) v", "string(id % 2) s")
    y = spark.range(400).selectExpr("id", "cast((id + int(id % 5 = 0)) % 4 as double) v", "string(id % 2) s")
    met, deal = [], linkage._deal
    monkeypatch.setattr(linkage, "_deal", lambda a, b: met.append((a.count(), b.count())) or deal(a, b))
    got = {r.id: (r.risk, r.cand_n, r.d_rank) for r in linkage.record_linkage(x, y, "id", ("v", "s")).records.collect()}
    assert met and max(max(m) for m in met) <= 16
    xs, ys = x.collect(), y.collect()
    for a in xs:
        ds = [round((abs(a.v - b.v) / 3 + (a.s != b.s)) / 2, 12) for b in ys]
        best = [b.id for b, d in zip(ys, ds, strict=True) if d == min(ds)]
        assert got[a.id] == (1 / len(best) if a.id in best else 0.0, len(best), 1 + sum(d < ds[a.id] for d in ds))


def test_inspecting_a_record_meets_no_other(spark, monkeypatch):
    x = spark.range(50).selectExpr("id", "cast(id as double) v")
    met, deal = [], linkage._deal
    found = linkage.record_linkage(x, x, "id", ("v",))
    monkeypatch.setattr(linkage, "_deal", lambda a, b: met.append(a.count()) or deal(a, b))
    assert [r.rid for r in found.params["pairs_of"](linkage.F.col("id") == 7).collect()] == [7]
    assert met == [1, 1]


def test_nearest_without_itself_among_copies(spark, monkeypatch):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 12, 150).astype(float)
    df = spark.createDataFrame([(i, [float(v) / 12], []) for i, v in enumerate(values)], "id bigint, nums array<double>, cats array<bigint>")
    dealt, deal = [], blocks._dealt
    monkeypatch.setattr(blocks, "_dealt", lambda a, b, *more: dealt.append(a.count()) or deal(a, b, *more))
    for own in (False, True):
        found = {r.id: r for r in blocks.nearest(df, df, radius=0.1, not_self=own, block_rows=5).collect()}
        for i, v in enumerate(values):
            d = sorted((round(abs(v / 12 - w / 12), 12), j) for j, w in enumerate(values) if not (own and i == j))
            r = found[i]
            assert (r.d1, r.d1_id, r.d2, r.n_refs) == (d[0][0], d[0][1], d[1][0], 150 - own)
            assert r.n_within == sum(e <= 0.1 for e, _ in d) and r.sum_d == pytest.approx(sum(e for e, _ in d))
    assert dealt == [12, 12]


@pytest.mark.parametrize("n,m", [(30, 30), (20, 33), (33, 20), (1, 9), (9, 1)])
def test_assignment_of_numbers_is_the_cheapest(n, m):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 40, n).astype(float), rng.integers(0, 40, m).astype(float)
    cost = np.abs(x[:, None] - y[None, :])
    total = []
    for to in (linkage.assign_sorted(x, y), linkage.assign_bijective(cost)):
        used = to[to >= 0]
        assert len(used) == len(set(used)) == min(n, m)
        total.append(cost[np.flatnonzero(to >= 0), used].sum())
    assert total[0] == total[1]


def test_assignment_of_blocks_above_the_limit(spark):
    x = spark.range(40).selectExpr("id", "cast(id * 7 % 40 as double) v", "cast(id % 3 as double) w", "'b' b")
    for keys in (("v",), ("v", "w")):
        found = linkage.block_assignment(x, x, "id", keys, ("b",), max_block=10).collect()
        assert len(found) == 40 and all(r.id == r.rid for r in found)


def test_transport_between_classes_equals_that_between_records(spark):
    rng = np.random.default_rng(8)
    rows = lambda: [(i, float(rng.integers(0, 6)), "pq"[rng.integers(0, 2)], "b") for i in range(60)]
    x, y = rows(), rows()
    frames = [spark.createDataFrame(t, "id bigint, v double, s string, b string") for t in (x, y)]
    got = {r.id: r.p for r in linkage.block_assignment(*frames, "id", ("v", "s"), ("b",), how="ot", max_block=10).collect()}
    span = max(r[1] for r in x + y) - min(r[1] for r in x + y)
    cost = np.round(np.array([[(abs(a[1] - b[1]) / span + (a[2] != b[2])) / 2 for b in y] for a in x]), 12)
    plan = linkage.sinkhorn(cost) * 60
    assert [got[i] for i in range(60)] == pytest.approx(list(np.minimum(1, plan.diagonal())), rel=1e-6)
    ones = np.ones(60, int)
    assert linkage.transport_potentials(linkage.Costs((cost * 0, cost[:, :0]), (cost * 0, cost[:, :0]), SPEC | {"num_w": [1.0] * 60, "cat_w": []}), ones, ones)[2] == 1.0


def transport_side(rng, n, nulls, spread):
    """Classes of two numbers and a category, and their counts; ``spread``: few numbers are far away."""
    x = np.where(rng.random(n) < 0.02, rng.random(n), rng.random(n) * 1e-4) if spread else rng.integers(0, 900, n) / 900
    nums, cats = np.column_stack([rng.integers(0, 3, n) * (1e-4 if spread else 0.4), x]), rng.integers(1, 2 if spread else 3, (n, 1))
    if nulls:
        nums[rng.random((n, 2)) < 0.1] = np.nan
        cats[rng.random(n) < 0.1] = 0
    v, _, counts = lines.alike((nums, cats))
    return v, counts + rng.integers(0, 3, len(counts))


def exact_costs(a, b):
    """Costs without rounding, over the columns that neither row lacks."""
    d = np.concatenate([np.abs(a[0][:, None] - b[0][None]), np.where((a[1][:, None] == 0) | (b[1][None] == 0), np.nan, a[1][:, None] != b[1][None])], axis=2)
    known = (~np.isnan(d)).sum(axis=2)
    return np.where(known, np.nansum(d, axis=2) / np.maximum(known, 1), 1.0)


@pytest.mark.parametrize("nulls", [False, True])
@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("listed", [1_000_000, 3000])
def test_transport_along_a_number_equals_that_of_all_pairs(monkeypatch, nulls, spread, listed):
    monkeypatch.setattr(lines, "_LISTED", listed)
    rng = np.random.default_rng(4)
    (a, n_a), (b, n_b) = transport_side(rng, 300, nulls, spread), transport_side(rng, 250, nulls, spread)
    cost, found = exact_costs(a, b), lines.Lines(a, b, SPEC)
    every = np.repeat(np.repeat(cost, n_a, axis=0), n_b, axis=1)
    median = found.median_positive(n_a.astype(float), n_b.astype(float))
    assert median == pytest.approx(np.median(every[every > 0]), rel=1e-9)
    assert (found.highest > lines._PLAIN * 0.05 * median) == spread
    f, g = found.potentials(n_a.astype(float), n_b.astype(float), 0.05 * median, 100, 1e-8)
    plan = linkage.sinkhorn(every, epsilon=0.05 * median)[np.cumsum(n_a) - 1][:, np.cumsum(n_b) - 1]
    assert np.exp((f[:, None] + g - cost) / (0.05 * median)) == pytest.approx(plan, rel=1e-6, abs=1e-15)
    f, g, _ = linkage.transport_potentials(cost, n_a, n_b, epsilon=0.05 * median)
    assert np.exp((f[:, None] + g - cost) / (0.05 * median)) == pytest.approx(plan, rel=1e-6, abs=1e-15)


def test_transport_of_a_large_block_reads_no_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    side = lambda: lines.alike((np.column_stack([rng.integers(0, 25, 20_000) / 25, rng.random(20_000)]), np.ones((20_000, 1), np.int64)))
    (a, _, n_a), (b, _, n_b) = side(), side()
    monkeypatch.setattr(linkage.Costs, "__getitem__", None)
    f, g, eps = linkage.transport_potentials(linkage.Costs(a, b, SPEC, rounded=False), n_a, n_b, max_iter=5)
    some = tuple(v[::997] for v in b)
    plan = np.exp((f[:, None] + g[::997] - exact_costs(a, some)) / eps)
    assert n_a @ plan == pytest.approx(np.full(len(some[0]), 1 / n_b.sum()))


def test_energy_of_one_number_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 50, 300) / 7, rng.normal(3, 2, 200)
    frames = [spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "id bigint, v double") for t in (a, b)]
    monkeypatch.setattr(blocks, "_dealt", None)
    row = distance.energy_distance(*frames, "id", ("v",)).summary.first()
    s = np.concatenate([a, b]).std(ddof=1)
    gap = lambda p, q: np.abs(p[:, None] - q[None]).sum() / s
    assert row.mean_dist_xy == pytest.approx(gap(a, b) / 60000) and row.mean_dist_xx == pytest.approx(gap(a, a) / (300 * 299))


def test_releases_are_scored_at_once(spark, monkeypatch):
    import threading

    from vantagrain.operators import frameworks

    met = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(frameworks, "score_release", lambda pair, name, *_: met.wait() < 0 or [(name, "risk", "m", 1.0)])
    df = spark.range(3).selectExpr("id", "id v", "id w")
    scores = frameworks.release_scores(df, {"a": df, "b": df}, "id", keys=["v"], target="w", cols=["v", "w"])
    assert [r.release for r in scores.collect()] == ["a", "b"]


@pytest.mark.parametrize(("how", "nulls"), [({"direction": "reverse"}, False), ({"strategy": "topk", "k": 3}, False), ({"strategy": "threshold", "tau": 0.01}, False), ({}, True)])
def test_large_blocks_meet_by_place(spark, monkeypatch, how, nulls):
    rng = np.random.default_rng(5)
    n, met, find = 600, [], linkage.candidates
    rows = [(i, None if nulls and i % 97 == 0 else float(rng.integers(0, 2000)) / 4, float(rng.integers(0, 9)), "pqr"[rng.integers(0, 3)]) for i in range(n)]
    moved = [(i, v if v is None else v + (i % 5 - 2) / 2, w + (i % 10 == 0), s) for i, v, w, s in rows if i % 13]
    x, y = (spark.createDataFrame(r, "id bigint, v double, w double, s string") for r in (rows, moved))
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 32)
    monkeypatch.setattr(linkage, "PLACED_ROWS", 100, raising=False)
    monkeypatch.setattr(places, "CELL_ROWS", 32)
    monkeypatch.setattr(linkage, "candidates", lambda a, b, *more: met.append(a.count() / a.select("id").distinct().count()) or find(a, b, *more))
    got = {r.id: r for r in linkage.record_linkage(x, y, "id", ("v", "w", "s"), **how).records.collect()}
    assert met[0] < 6  # a query goes to the cells in its reach, not to each of 16 parts
    a, b = (moved, rows) if "direction" in how else (rows, moved)
    spans = [max(c) - min(c) for c in ([r[k] for r in rows + moved if r[k] is not None] for k in (1, 2))]

    def distance(p, q):
        parts = [None if u is None or v is None else abs(u - v) / span for u, v, span in zip(p[1:3], q[1:3], spans, strict=True)] + [float(p[3] != q[3])]
        return round(sum(d for d in parts if d is not None) / sum(d is not None for d in parts), 9)

    for p in a:
        ds = {q[0]: distance(p, q) for q in b}
        limit = how.get("tau") or sorted(ds.values())[how.get("k", 1) - 1]
        kept = [i for i, d in ds.items() if d <= limit]
        true = ds.get(p[0])
        rank = None if true is None else 1 + sum(d < true for d in ds.values())
        r = got[p[0]]
        assert (r.cand_n, r.true_in_set, r.d_rank) == (len(kept), p[0] in kept, rank) and r.risk == pytest.approx((p[0] in kept) / max(1, len(kept)))


def test_gini_reads_its_records_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for t in batches:
            read.add(t.num_rows)
            yield t

    records = spark.range(40).selectExpr("cast(id % 4 as double) risk").mapInArrow(count, "risk double")
    assert linkage.gini(records).first().gini == pytest.approx(2 * sum((10 * k + 5.5) * 10 * k for k in range(4)) / (40 * 60) - 41 / 40)
    assert read.value == 40


def test_domias_meets_each_vector_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = lambda n: [(i, float(rng.integers(0, 60)), "ab"[rng.integers(0, 2)]) for i in range(n)]
    t, y, h = [*rows(89), (89, 200.0, "a")], rows(140), rows(70)  # with copies, ids that tables share, one without neighbours
    frames = [spark.createDataFrame(r, "id bigint, v double, s string") for r in (t, y, h)]
    read, dealt, deal = spark.sparkContext.accumulator(0), [], blocks._dealt

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def watched(queries, refs, left, right, rows):
        a, b = deal(queries, refs, left, right, 30)
        dealt.append(a.count())
        return a.mapInArrow(count, a.schema), b

    monkeypatch.setattr(blocks, "_dealt", watched)
    result = distance.domias(*frames, "id", ("v", "s"), radius=0.1)
    got = result.summary.first()
    assert len(dealt) == 1 and read.value == dealt[0]
    pool = [r[1] for r in t + y + h]
    near = lambda p, q: sum(round((abs(p[1] - r[1]) / (max(pool) - min(pool)) + (p[2] != r[2])) / 2, 9) <= 0.1 + 1e-9 for r in q)
    a = [(near(p, y) + 1) / (near(p, h) + 1) for p in t]
    b = [(near(p, y) + 1) / near(p, h) for p in h]  # without itself
    auc = np.mean([(round(u, 12) > round(v, 12)) + 0.5 * (round(u, 12) == round(v, 12)) for u in a for v in b])
    assert (got.auc, got.mean_ratio_train, got.mean_ratio_holdout) == pytest.approx((auc, np.mean(a), np.mean(b)))
    assert (got.n_train, got.n_holdout) == (90, 70)
    assert [r.ratio for r in result.records.orderBy("id").collect()] == pytest.approx(a)


def test_domias_without_a_table(spark):
    rows = spark.range(5).selectExpr("id", "cast(id as double) v")
    none = rows.filter("id < 0")
    for t, y, h, n in ((rows, none, rows, (0, 0)), (rows, rows, none, (0, 0)), (none, rows, rows, (0, 5)), (rows, rows, rows.filter("id = 0"), (5, 0))):
        got = distance.domias(t, y, h, "id", ("v",)).summary.first()
        assert (got.auc, got.n_train, got.n_holdout) == (None, *n)


def test_linkage_meets_its_candidates_once(spark, monkeypatch):
    x = spark.range(60).selectExpr("id", "cast(id as double) v")
    read, find = spark.sparkContext.accumulator(0), linkage.candidates

    def count(batches):
        for t in batches:
            read.add(t.num_rows)
            yield t

    def watched(*args):
        found = find(*args)
        return found.mapInArrow(count, found.schema)

    monkeypatch.setattr(linkage, "candidates", watched)
    assert linkage.record_linkage(x, x, "id", ("v",)).summary.first().mean_risk == 1.0
    assert read.value == 60
