"""Record linkage risk: can released records be matched to their originals?

Records are paired by id in truth.  For every query record the attacker's
candidate set among the released records of its block is found, and the risk is
the weight of the true record in it.  Distances are evaluated block against
block in numpy; a task returns a few numbers for a record (its least distances
and how many have them, or counts and weights within a threshold), never pairs.
Records with equal keys are one class, met once with its count, and tiles of
references that are too far to matter are left out by their bounds.  Large
blocks are dealt by place: a query first learns from its own cell how far its
candidates can be, and then meets the cells within that distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.shipping import ship
from ..functions.special import chi2_ppf
from .blocks import Tiles, classes, keyed, pieces, ranges, spread
from .common import MeasureResult, is_numeric, key_join, kept as held
from .density import concentrated_covariance
from .distributions import covariance, median_absolute_deviation
from .lines import Lines, alike
from .places import Boxes, located, placed
from .ranks import average_ranks, running

#: Rows of a part of a block; parts of very large blocks are larger, up to MOST_ROWS,
#: since a row travels once for each part of the other side.
BLOCK_ROWS = 2048
MOST_ROWS = 65_536
#: References up to which a block is met without tiles.
_FEW = 512
#: References and queries from which a block is dealt by place.
PLACED_ROWS = 16_384
_SLACK = 1e-9
_BANDS = (0.05, 0.1, 0.2, 0.5)


def _distance(a: tuple, b: tuple, spec: dict) -> np.ndarray:
    """Distances of (numbers, category hashes) that broadcast against each other;
    the last axis holds the columns."""
    num_a, cat_a = a
    num_b, cat_b = b
    shape = np.broadcast_shapes(num_a.shape[:-1], num_b.shape[:-1])
    if spec["kind"] == "fs":
        out = np.zeros(shape)
        for k in range(num_a.shape[-1]):
            agree = np.abs(num_a[..., k] - num_b[..., k]) <= spec["tolerance"][k]
            out -= np.where(agree, *spec["num_lr"][k])
        for k in range(cat_a.shape[-1]):
            out -= np.where(cat_a[..., k] == cat_b[..., k], *spec["cat_lr"][k])
        return np.round(out, 12)
    if spec["kind"] == "mahalanobis":
        d = np.sqrt(sum((num_a[..., k] - num_b[..., k]) ** 2 for k in range(num_a.shape[-1]))) / spec["scale"]
        if cat_a.shape[-1]:
            share = num_a.shape[-1] / (num_a.shape[-1] + cat_a.shape[-1])
            miss = np.mean([cat_a[..., k] != cat_b[..., k] for k in range(cat_a.shape[-1])], axis=0)
            d = share * np.minimum(d, 1) + (1 - share) * miss
        return np.round(d, 12)
    total = np.zeros(shape)
    if not (np.isnan(num_a).any() or np.isnan(num_b).any() or (cat_a == spec["null"]).any() or (cat_b == spec["null"]).any()):
        # without nulls the weights are those of the columns
        for k, w in enumerate(spec["num_w"]):
            total += w * np.abs(num_a[..., k] - num_b[..., k])
        for k, w in enumerate(spec["cat_w"]):
            total += w * (cat_a[..., k] != cat_b[..., k])
        every = sum([*spec["num_w"], *spec["cat_w"]])
        return np.round(total / every, 12) if every > 0 else np.ones(shape)
    weight = np.zeros(shape)
    fill = {"match": 0.0, "mismatch": 1.0}.get(spec["na"])
    parts = [(np.abs(num_a[..., k] - num_b[..., k]), w) for k, w in enumerate(spec["num_w"])]
    for k, w in enumerate(spec["cat_w"]):
        # null categories carry the hash of null, given with the block's spec
        miss = (cat_a[..., k] == spec["null"]) | (cat_b[..., k] == spec["null"])
        parts.append((np.where(miss, np.nan, cat_a[..., k] != cat_b[..., k]), w))
    for d, w in parts:
        known = ~np.isnan(d)
        if fill is None:
            total += w * np.where(known, d, 0.0)
            weight += w * known
        else:
            total += w * np.where(known, d, fill)
            weight += w
    return np.round(np.divide(total, weight, out=np.ones(shape), where=weight > 0), 12)


def _distances(a: tuple, b: tuple, spec: dict) -> np.ndarray:
    """All distances between two small blocks."""
    return _distance(tuple(v[:, None, :] for v in a), tuple(v[None, :, :] for v in b), spec)


def _vectors(df: DataFrame, id_col: str, nums: Sequence, cats: Sequence[str], block: Sequence[str]) -> DataFrame:
    """(id, block, nums, cats): nulls are NaN and the fixed hash 0."""
    numbers = [F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in nums]
    levels = [F.when(F.col(c).isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.col(c).cast("string"))) for c in cats]
    where = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in block]) if block else F.lit(0).cast("bigint")
    return df.select(
        F.col(id_col).cast("bigint").alias("id"), where.alias("block"),
        (F.array(*numbers) if numbers else F.array().cast("array<double>")).alias("nums"),
        (F.array(*levels) if levels else F.array().cast("array<bigint>")).alias("cats"),
    )


def _deal(queries: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with group columns (g0, g1, g2, g3): every query meets every
    reference of its block in one group.

    Blocks of at most BLOCK_ROWS on either side travel once, several to a group;
    only larger ones are cut, and only their rows are copied, as often as the
    other side has parts.  A block that one side lacks has no candidates.
    """
    n = F.count(F.lit(1))
    sizes = queries.groupBy("block").agg(n.alias("n_q")).join(refs.groupBy("block").agg(n.alias("n_r")), "block")
    cells = max(1, -(-queries.count() // BLOCK_ROWS))
    size = lambda c: F.least(F.lit(MOST_ROWS), F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.col(c) / 16)))
    parts = lambda c: F.ceil(F.col(c) / size(c))
    sizes = sizes.select("block", parts("n_q").alias("p_q"), parts("n_r").alias("p_r"))
    large = (F.col("p_q") > 1) | (F.col("p_r") > 1)
    group = F.when(large, F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(cells)))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("bigint")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    left = queries.join(sizes, "block").select("*", large.alias("g0"), group.alias("g1"), own("p_q").alias("g2"), every("p_r").alias("g3"))
    right = refs.join(sizes, "block").select("*", large.alias("g0"), group.alias("g1"), own("p_r").alias("g3"), every("p_q").alias("g2"))
    right = right.drop("p_q", "p_r")
    return left.drop("p_q", "p_r"), right.toDF(*[f"r_{c}" for c in right.columns])


def _matrix(col: pa.ChunkedArray, rows: np.ndarray | None = None, n: int = 0, fill: float = 0) -> np.ndarray:
    """A column of equally long lists as a matrix; absent rows hold ``fill``."""
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if rows is None:
        return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)
    some = int(rows.sum())
    out = np.full((n, len(flat) // some if some else 0), fill, flat.dtype)
    if some:
        out[rows] = flat.reshape(some, -1)
    return out


def _bound(apart: np.ndarray, miss: np.ndarray, spec: dict) -> np.ndarray:
    """Least distance that these least differences allow, if no value is null."""
    n_cats = len(spec.get("cat_w", ())) if spec["kind"] == "gower" else spec.get("n_cats", 0)
    known = miss if miss.shape[-1] == n_cats else np.zeros((*apart.shape[:-1], n_cats))
    if spec["kind"] == "mahalanobis":
        d = np.sqrt((apart**2).sum(axis=-1)) / spec["scale"]
        if n_cats:
            share = apart.shape[-1] / (apart.shape[-1] + n_cats)
            d = share * np.minimum(d, 1) + (1 - share) * known.mean(axis=-1)
        return d - _SLACK
    every = sum([*spec["num_w"], *spec["cat_w"]])
    return (apart @ np.array(spec["num_w"], float) + known @ np.array(spec["cat_w"], float)) / (every or 1) - _SLACK


def _blocks(a: pa.Table, b: pa.Table, va: tuple, vb: tuple, spec: dict, reach: np.ndarray, k: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of both tables in each block that both have, a bounded number of pairs at once.

    Left out are references that are farther from all these queries than the
    ``reach`` of each of them and than its ``k`` nearest.
    """
    ka, kb = a["block"].to_numpy(), b["r_block"].to_numpy()
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    scale = spec["num_w"] if spec["kind"] == "gower" else ()
    for key in np.intersect1d(ka, kb):
        ia = oa[np.searchsorted(ka, key, "left", sorter=oa) : np.searchsorted(ka, key, "right", sorter=oa)]
        ib = ob[np.searchsorted(kb, key, "left", sorter=ob) : np.searchsorted(kb, key, "right", sorter=ob)]
        qa, qb = tuple(v[ia] for v in va), tuple(v[ib] for v in vb)
        nulls = any(np.isnan(v).any() for v in (qa[0], qb[0])) or any((v == spec.get("null")).any() for v in (qa[1], qb[1]))
        if spec["kind"] == "fs" or nulls or len(ib) <= _FEW:
            for part in pieces(ia, len(ib)):
                yield part, ib
            continue
        tb = Tiles(*qb, scale)
        # queries of like reach share a tile, as the farthest decides what it meets
        half = float(np.median(reach[ia])) if np.isfinite(reach[ia]).all() else 0.0
        band = np.digitize(reach[ia], [2 * half, 8 * half]) if half > 0 else np.zeros(len(ia), int)
        tiles = []
        for level in np.unique(band):
            some = np.flatnonzero(band == level)
            cut = Tiles(*(v[some] for v in qa), scale)
            tiles += [(cut, n, some[rows]) for n, rows in enumerate(cut.rows)]
        for ta, n, tile in tiles:
            least = _bound(*ta.gaps(n, tb), spec)
            far = reach[ia[tile]].max()
            if k and k < len(ib):
                nearest = np.argsort(least, kind="stable")
                first = nearest[: 1 + int(np.searchsorted(np.cumsum([len(tb.rows[t]) for t in nearest]), k))]
                some = np.concatenate([tb.rows[t] for t in first])
                d = _distances(tuple(v[tile] for v in qa), tuple(v[some] for v in qb), spec)
                far = max(far, np.partition(d, k - 1, axis=1)[:, k - 1].max())
            elif k:
                far = np.inf
            near = np.flatnonzero(least <= far)
            if len(near):
                some = ib[np.concatenate([tb.rows[t] for t in near])]
                for part in pieces(ia[tile], len(some)):
                    yield part, some
            else:
                yield ia[tile], ib[:0]


def _weigh(d: np.ndarray, weighting: str, kappa: float, bandwidth: float) -> np.ndarray:
    if weighting == "softmax":
        return np.exp(-kappa * d)
    return np.exp(-0.5 * (d / bandwidth) ** 2) if weighting == "kernel" else np.ones_like(d)


_FOUND = "id bigint, d_true double, n_less bigint, n bigint, w double, d_min double, ds array<double>, ns array<bigint>"


def candidates(left: DataFrame, right: DataFrame, spec: dict, strategy: str, k: int, tau: float, weigh: tuple) -> DataFrame:
    """A row for each query and part of its block, made of dealt tables; a
    reference stands for ``r_n`` equal ones.

    ``n``, ``w`` and ``d_min`` are the count, weight and least distance of the
    references within ``tau`` (threshold); ``ds`` and ``ns`` the least distances
    and how many references have them (the other strategies: the nearest, or the
    ``k`` nearest with ties).  Both merge over parts without any pair of records.
    """
    ship(left.sparkSession)
    kept = k if strategy.startswith("topk") else 1
    least_of = 0 if strategy == "threshold" else kept

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("id", "d_true", "n_less", "n", "w", "d_min", "ds", "ns", "len")}
        if a.num_rows and b.num_rows:
            va, vb = (_matrix(a["nums"]), _matrix(a["cats"])), (_matrix(b["r_nums"]), _matrix(b["r_cats"]))
            has = a["true_nums"].is_valid().to_numpy()
            vt = _matrix(a["true_nums"], has, a.num_rows, np.nan), _matrix(a["true_cats"], has, a.num_rows)
            ids, many = a["id"].to_numpy(), b["r_n"].to_numpy()
            true = np.full(a.num_rows, np.nan)
            if has.any():
                true[has] = _distance(tuple(v[has] for v in va), tuple(v[has] for v in vt), spec)
            far = np.where(np.isnan(true), -np.inf, true)
            far = np.maximum(far, tau) if strategy == "threshold" else far
            known = "reach" in a.column_names
            for ia, ib in _blocks(a, b, va, vb, spec, a["reach"].to_numpy() if known else far, 0 if known else least_of):
                d = _distances(tuple(v[ia] for v in va), tuple(v[ib] for v in vb), spec)
                n = many[ib].astype(float)
                out["id"].append(ids[ia])
                out["d_true"].append(true[ia])
                out["n_less"].append((d < true[ia][:, None]) @ n)
                if strategy == "threshold":
                    near = d <= tau
                    out["n"].append(near @ n)
                    out["w"].append(np.where(near, _weigh(d, *weigh), 0.0) @ n)
                    out["d_min"].append(d.min(axis=1, initial=np.inf))
                    out["len"].append(np.zeros(len(ia), np.int64))
                    continue
                for c in ("n", "w", "d_min"):
                    out[c].append(np.zeros(len(ia), np.int64 if c == "n" else float))
                m = min(kept, len(ib))
                out["len"].append(np.full(len(ia), m))
                if not m:
                    continue
                at = np.argpartition(d, m - 1, axis=1)[:, :m] if m > 1 else d.argmin(axis=1)[:, None]
                least = np.take_along_axis(d, at, axis=1)
                order = np.argsort(least, axis=1)
                least = np.take_along_axis(least, order, axis=1)
                last = least[:, -1]
                counts = n[np.take_along_axis(at, order, axis=1)]
                tied = least == last[:, None]
                counts[tied] = 0
                counts[np.arange(len(ia)), tied.argmax(axis=1)] = (d == last[:, None]) @ n
                out["ds"].append(least.ravel())
                out["ns"].append(counts.ravel())
        join = lambda c, kind: np.concatenate(out[c]).astype(kind) if out[c] else np.zeros(0, kind)
        ends = pa.array(np.concatenate(([0], np.cumsum(join("len", np.int64)))), pa.int32())
        true = join("d_true", float)
        columns = {c: pa.array(join(c, np.int64)) for c in ("id", "n_less", "n")}
        columns |= {"d_true": pa.array(true, mask=np.isnan(true)), "w": pa.array(join("w", float)), "d_min": pa.array(join("d_min", float))}
        columns |= {c: pa.ListArray.from_arrays(ends, pa.array(join(c, kind))) for c, kind in (("ds", float), ("ns", np.int64))}
        names = ["id", "d_true", "n_less", "n", "w", "d_min", "ds", "ns"]
        return pa.table([columns[c] for c in names], names)

    groups = [f"g{n}" for n in range(4)]
    theirs = [f"r_{g}" for g in groups]
    return spread(left, groups).groupBy(*groups).cogroup(spread(right, theirs).groupBy(*theirs)).applyInArrow(run, _FOUND)


def _reaching(queries: DataFrame, refs: DataFrame, boxes: dict[int, Boxes], spec: dict, k: int, tau: float) -> DataFrame:
    """The located queries with ``reach`` and ``cell``, a row for each cell that
    they must meet: one with references as near as the true record, the ``k``
    nearest (of which the own cell tells a bound) or ``tau`` (where k is 0)."""
    columns = queries.columns
    scale = spec["num_w"] if spec["kind"] == "gower" else ()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return a.append_column("reach", pa.array([], pa.float64()))
        va, has = (_matrix(a["nums"]), _matrix(a["cats"])), a["true_nums"].is_valid().to_numpy()
        vt = _matrix(a["true_nums"], has, a.num_rows, np.nan), _matrix(a["true_cats"], has, a.num_rows)
        true = np.full(a.num_rows, -np.inf)
        if has.any():
            true[has] = np.nan_to_num(_distance(tuple(v[has] for v in va), tuple(v[has] for v in vt), spec), nan=np.inf)
        near = np.full(a.num_rows, np.inf if k else tau)
        if k and k <= b.num_rows:
            vb = _matrix(b["r_nums"]), _matrix(b["r_cats"])
            ta, tb = Tiles(*va, scale), Tiles(*vb, scale)
            for n, tile in enumerate(ta.rows):
                first = np.argsort(_bound(*ta.gaps(n, tb), spec), kind="stable")
                first = first[: 1 + int(np.searchsorted(np.cumsum([len(tb.rows[t]) for t in first]), k))]
                some = np.concatenate([tb.rows[t] for t in first])
                for part in pieces(tile, len(some)):
                    d = _distances(tuple(v[part] for v in va), tuple(v[some] for v in vb), spec)
                    near[part] = np.partition(d, k - 1, axis=1)[:, k - 1]
        box, rows, cells, reaches = boxes[a["block"][0].as_py()], [], [], []
        for part in pieces(np.arange(a.num_rows), len(box.n)):
            v = tuple(c[part] for c in va)
            if k:  # a cell of k references that is wholly within a distance bounds it too
                wholly = np.where(box.n >= k, _bound(*box.spans(*v), spec) + 3 * _SLACK, np.inf)
                near[part] = np.minimum(near[part], wholly.min(axis=1))
            reach = np.maximum(near[part], true[part])
            i, j = np.nonzero(_bound(*box.gaps(*v), spec) <= reach[:, None])
            rows.append(part[i])
            cells.append(box.cell[j])
            reaches.append(reach[i])
        out = a.take(pa.array(np.concatenate(rows)))
        out = out.set_column(columns.index("cell"), "cell", pa.array(np.concatenate(cells)))
        return out.append_column("reach", pa.array(np.concatenate(reaches)))

    by = ["block", "cell"]
    theirs = refs.select(*[F.col(c).alias(f"r_{c}") for c in refs.columns])
    schema = StructType([*queries.schema, StructField("reach", DoubleType())])
    return spread(queries, by).groupBy(*by).cogroup(spread(theirs, [f"r_{c}" for c in by]).groupBy("r_block", "r_cell")).applyInArrow(run, schema)


def _found(queries: DataFrame, refs: DataFrame, spec: dict, strategy: str, k: int, tau: float, weigh: tuple) -> DataFrame:
    """``candidates`` of all queries: large blocks by place, others in parts."""
    how = (spec, strategy, k, tau, weigh)
    scale = np.array(spec["num_w"], float) if spec["kind"] == "gower" else np.ones(spec.get("n_nums", 0))
    sizes: dict[int, int] = {}
    if len(scale):
        odd = F.exists("nums", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
        odd = odd | F.array_contains("cats", F.lit(0).cast("bigint")) if spec["kind"] == "gower" else odd
        n, many = [F.count(F.lit(1)), F.count_if(odd)], F.lit(PLACED_ROWS)
        mine, theirs = (d.groupBy("block").agg(n[0].alias(f"n_{s}"), n[1].alias(f"odd_{s}")) for d, s in ((queries, "q"), (refs, "r")))
        large = mine.join(theirs, "block").filter((F.col("n_q") >= many) & (F.col("n_r") - F.col("odd_r") >= many)).collect()  # few, as each is large
        sizes = {r["block"]: r["n_r"] - r["odd_r"] for r in large}
    if not sizes:
        return candidates(*_deal(queries, refs), *how)
    n_cats = len(spec["cat_w"]) if spec["kind"] == "gower" else spec["n_cats"]
    inside = F.col("block").isin(list(sizes))
    cells, cut, boxes = placed(refs.filter(inside & ~odd), sizes, scale, n_cats)
    kept = located(queries.filter(inside & ~odd), cells)
    met = _reaching(kept, cut, boxes, spec, 0 if strategy == "threshold" else k if strategy.startswith("topk") else 1, tau)
    place = lambda d: d.withColumns({"g0": F.lit(True), "g1": F.col("block"), "g2": F.col("cell"), "g3": F.lit(0).cast("bigint")})
    right = place(cut)
    found = candidates(place(met), right.toDF(*[f"r_{c}" for c in right.columns]), *how)
    # what has a null, and what the large blocks do not have, meets in parts as ever
    if not queries.filter(~inside | odd).isEmpty():
        found = found.unionAll(candidates(*_deal(queries.filter(~inside | odd), refs), *how))
    if any(r["odd_r"] for r in large):
        found = found.unionAll(candidates(*_deal(queries.filter(inside & ~odd), refs.filter(inside & odd)), *how))
    return found


def _pairs_within(left: DataFrame, right: DataFrame, spec: dict) -> DataFrame:
    """(id, rid, d): the references within each query's own ``reach``."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if a.num_rows and b.num_rows:
            va, vb = (_matrix(a["nums"]), _matrix(a["cats"])), (_matrix(b["r_nums"]), _matrix(b["r_cats"]))
            ids, rids, reach = a["id"].to_numpy(), b["r_id"].to_numpy(), a["reach"].to_numpy()
            for ia, ib in _blocks(a, b, va, vb, spec, reach):
                d = _distances(tuple(v[ia] for v in va), tuple(v[ib] for v in vb), spec)
                i, j = np.nonzero(d <= reach[ia][:, None])
                for k, part in enumerate((ids[ia][i], rids[ib][j], d[i, j])):
                    out[k].append(part)
        kinds = (np.int64, np.int64, float)
        return pa.table([pa.array(np.concatenate(o) if o else np.zeros(0, t)) for o, t in zip(out, kinds, strict=True)], ["id", "rid", "d"])

    groups = [f"g{n}" for n in range(4)]
    theirs = [f"r_{g}" for g in groups]
    return spread(left, groups).groupBy(*groups).cogroup(spread(right, theirs).groupBy(*theirs)).applyInArrow(run, "id bigint, rid bigint, d double")


def agreement_rates(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str]) -> tuple[dict[str, float], dict[str, float]]:
    """(m, u): how often a key agrees in true pairs, and in all other pairs.

    Numbers agree within the original's median absolute deviation (a tenth of
    the range if that is zero).  Pairs with a null are left out; rates of zero
    or one become 0.01 and 0.99.  Other pairs are counted from the counts of
    values on both sides, over all rows and without making a pair.
    """
    nums = [c for c in keys if is_numeric(original, c)]
    tolerance = _tolerances(original, released, nums)
    theirs = released.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{c}") for c in keys])
    both = original.select(id_col, *keys).join(theirs, F.col(id_col) == F.col("__id"))
    agrees = {c: F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance[c] if c in tolerance else F.col(c).cast("string") == F.col(f"__{c}").cast("string") for c in keys}
    row = both.agg(*[f(agrees[c]).alias(f"{n}{k}") for k, c in enumerate(keys) for n, f in (("n", F.count), ("a", F.count_if))]).first()
    rate = lambda a, n: min(0.99, a / n) if n and a > 0 else 0.01
    m, u = {}, {}
    for k, c in enumerate(keys):
        known, agree = row[f"n{k}"], row[f"a{k}"]
        sizes = [d.select(F.count(c)).first()[0] for d in (original, released)]
        if c in tolerance:
            v = F.col(c).cast("double")
            ends = [original.select((v + s * tolerance[c]).alias("v"), F.lit(n).alias("kind")) for s, n in ((1, 1), (-1, 2))]
            values = released.select(v.alias("v"), F.lit(0).alias("kind")).unionByName(ends[0]).unionByName(ends[1]).filter("v is not null")
            counts = values.groupBy("v").agg(*[F.count_if(F.col("kind") == n).alias(name) for n, name in enumerate(("y", "high", "low"))])
            every = running(counts, "v", ["y"]).agg(F.sum(F.col("high") * F.col("run_y") - F.col("low") * (F.col("run_y") - F.col("y")))).first()[0] or 0
        else:
            one = [d.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias(n)) for d, n in ((original, "a"), (released, "b"))]
            every = one[0].join(one[1], "v").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
        m[c], u[c] = rate(agree, known), rate(every - agree, sizes[0] * sizes[1] - known)
    return m, u


def _tolerances(x: DataFrame, y: DataFrame, nums: Sequence[str]) -> dict[str, float]:
    spans = ranges([x, y], nums) if nums else {}
    return {c: median_absolute_deviation(x, c) or 0.1 * (spans[c] or 1.0) for c in nums}


def _spec(x: DataFrame, y: DataFrame, keys: Sequence[str], method: str, weights, na: str, m, u, robust: bool = True):
    nums = [c for c in keys if is_numeric(x, c)]
    cats = [c for c in keys if c not in nums]
    w = weights or dict.fromkeys(keys, 1.0)
    base = {"kind": "gower", "na": na, "null": 0, "num_w": [w[c] for c in nums], "cat_w": [w[c] for c in cats]}
    if method == "deterministic":
        spans = ranges([x, y], keys)
        scaled = [F.col(c) / spans[c] if spans[c] else F.when(F.col(c).isNotNull(), F.lit(0.0)) for c in nums]
        return (x, scaled), (y, scaled), cats, base
    if method == "rank":
        sides = []
        for df in (x, y):
            n, out = df.count(), df
            for c in nums:
                ranks = average_ranks(df, c).select(F.col("v").alias("__v"), (F.col("rank") / n).alias(f"__rank_{c}"))
                out = out.join(ranks, F.col(c).cast("double") == F.col("__v"), "left").drop("__v")
            sides.append((out, [F.col(f"__rank_{c}") for c in nums]))
        return sides[0], sides[1], cats, base
    if method == "probabilistic":
        lr = lambda c: (math.log(m[c] / u[c]), math.log((1 - m[c]) / (1 - u[c])))
        tol = list(_tolerances(x, y, nums).values())
        spec = {"kind": "fs", "tolerance": tol, "num_lr": [lr(c) for c in nums], "cat_lr": [lr(c) for c in cats]}
        plain = [F.col(c) for c in nums]
        return (x, plain), (y, plain), cats, spec
    if method == "mahalanobis":
        cov = concentrated_covariance(x, nums)[1] if robust and len(nums) > 1 else covariance(x, nums)[1]
        root = np.linalg.cholesky(np.linalg.pinv(cov) + 1e-15 * np.eye(len(nums)))
        turned = [reduce(lambda a, b: a + b, [F.col(c).cast("double") * float(root[i, j]) for i, c in enumerate(nums)]) for j in range(len(nums))]
        spec = {"kind": "mahalanobis", "scale": math.sqrt(2 * chi2_ppf(0.975, len(nums))), "n_nums": len(nums), "n_cats": len(cats)}
        return (x, turned), (y, turned), cats, spec
    raise ValueError(f"unknown method: {method}")


def record_linkage(
    original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], *, method: str = "deterministic", strategy: str = "nearest",
    k: int = 5, tau: float = 0.1, weighting: str = "uniform", kappa: float = 2.0, bandwidth: float = 0.1, block: Sequence[str] = (),
    weights: dict[str, float] | None = None, na_anon: str = "ignore", m: dict[str, float] | None = None, u: dict[str, float] | None = None,
    fs_threshold: float = 0.0, direction: str = "forward", risk_threshold: float = 0.1, robust: bool = True,
) -> MeasureResult:
    """Linkage risk per record.

    ``method``: deterministic (Gower), rank (Gower on ranks), probabilistic
    (Fellegi-Sunter log ratios; ``m`` and ``u`` are estimated if not given, see
    ``agreement_rates``; numeric agreement within the original's median absolute
    deviation), mahalanobis (by the minimum covariance determinant, or with
    ``robust`` false the covariance).  ``strategy``: nearest, threshold, topk,
    topk_threshold, all with ties; probabilistic links are the records with a
    log ratio of at least ``fs_threshold``.  ``weighting`` of the candidates:
    uniform, softmax or kernel (Gaussian).  ``direction`` reverse makes released
    records the queries.  Null keys follow ``na_anon`` in the Gower methods; a
    null block value is a block; a record whose block the other table lacks has
    no candidates and risk zero.  Ids must be unique.
    """
    if direction == "reverse":
        original, released = released, original
    if method == "probabilistic" and (m is None or u is None):
        rates = agreement_rates(original, released, id_col, keys)
        m, u = m or rates[0], u or rates[1]
    (x, xn), (y, yn), cats, spec = _spec(original, released, keys, method, weights, na_anon, m, u, robust)
    if method == "probabilistic":
        strategy, tau = "threshold", -fs_threshold
    refs = _vectors(y, id_col, yn, cats, block)
    true = refs.select(F.col("id").alias("t_id"), F.col("block").alias("t_block"), F.col("nums").alias("true_nums"), F.col("cats").alias("true_cats"))
    queries = _vectors(x, id_col, xn, cats, block)
    queries = queries.join(true, (F.col("id") == F.col("t_id")) & (F.col("block") == F.col("t_block")), "left").drop("t_id", "t_block")
    score = lambda d: {"uniform": F.lit(1.0), "softmax": F.exp(-kappa * d), "kernel": F.exp(-0.5 * F.pow(d / bandwidth, 2))}[weighting]
    by = ["block", "nums", "cats"]
    kinds = held(classes(keyed(refs, by), by).withColumnRenamed("cid", "id").drop("_h", "_g"))

    def merge(some: DataFrame) -> DataFrame:
        """(id, and what its candidates come to) of these queries; records with equal
        keys, whose true records are equal too, are one query."""
        mine = [*by, "true_nums", "true_cats"]
        some = keyed(some, mine)
        alike = held(classes(some, mine).withColumnRenamed("cid", "id"))
        found = _found(alike.drop("n", "_h", "_g"), kinds, spec, strategy, k, tau, (weighting, kappa, bandwidth))
        one = [F.max("d_true").alias("d_true"), F.sum("n_less").alias("n_less")]
        if strategy == "threshold":
            merged = found.groupBy("id").agg(*one, F.sum("n").alias("cand_n"), F.sum("w").alias("w_all"), F.min("d_min").alias("d_min"), F.lit(float(tau)).alias("reach"))
        else:
            # of each part at most k distances: the list of a record is as long as its parts are many
            lists = held(found.groupBy("id").agg(*one, F.array_sort(F.flatten(F.collect_list(F.arrays_zip("ds", "ns")))).alias("all")))
            places = lists.select("id", F.explode("all").alias("p")).select("id", F.col("p.ds").alias("d"), F.col("p.ns").alias("n")).groupBy("id", "d").agg(F.sum("n").alias("n")).filter("n > 0")
            per = Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
            ranked = places.withColumn("ahead", F.coalesce(F.sum("n").over(per), F.lit(0)))
            kept = ranked.filter(F.col("ahead") < (k if strategy.startswith("topk") else 1))
            kept = kept.filter(F.col("d") <= tau) if strategy == "topk_threshold" else kept
            sums = kept.groupBy("id").agg(F.sum("n").alias("cand_n"), F.sum(F.col("n") * score(F.col("d"))).alias("w_all"), F.min("d").alias("d_min"), F.max("d").alias("reach"))
            merged = key_join(lists.drop("all"), sums, ["id"], "left")
        known = alike.select("_h", "_g", "id").join(merged, "id", "left").drop("id")
        return some.select("id", "_h", "_g").join(known, ["_h", "_g"]).drop("_h", "_g")

    inside = F.coalesce(F.col("d_true") <= F.col("reach"), F.lit(False))
    scored = merge(queries).withColumn("true_in_set", inside)
    w_true = F.when(F.col("true_in_set"), score(F.col("d_true"))).otherwise(0.0)
    scored = scored.withColumn("risk", F.coalesce(F.when(F.col("w_all") > 0, w_true / F.col("w_all")), F.lit(0.0)))
    band = F.lit("very high")
    for limit, name in reversed(list(zip(_BANDS, ("very low", "low", "medium", "high"), strict=True))):
        band = F.when(F.col("risk") <= limit, name).otherwise(band)
    d_min = F.when(F.coalesce("cand_n", F.lit(0)) > 0, F.col("d_min"))
    records = scored.select(
        "id", "risk", F.coalesce("cand_n", F.lit(0)).alias("cand_n"), "true_in_set", "d_true", d_min.alias("d_min"),
        F.when(F.col("d_true").isNotNull(), F.col("n_less") + 1).alias("d_rank"), band.alias("risk_band"),
    )

    def pairs_of(which: Column) -> DataFrame:
        """(id, rid, d): the candidates of the records for which ``which`` holds."""
        some = queries.filter(which)
        some = key_join(some, merge(some).select("id", "reach").filter("reach is not null"), ["id"], "inner")
        return _pairs_within(*_deal(some, refs), spec)

    return MeasureResult(linkage_summary(records, risk_threshold), records, params={"pairs_of": pairs_of})


def linkage_summary(records: DataFrame, risk_threshold: float = 0.1) -> DataFrame:
    n = F.count(F.lit(1))
    return records.agg(
        F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"), F.count_if(F.col("risk") > risk_threshold).alias("n_high"),
        F.try_divide(100 * F.count_if(F.col("risk") > risk_threshold), n).alias("pct_high"), F.try_divide(100 * F.count_if("true_in_set"), n).alias("pct_true_in_set"),
        F.avg("cand_n").alias("mean_candidates"), (F.avg("risk") <= risk_threshold).alias("privacy_pass"), n.alias("n_query"),
    )


def gini(records: DataFrame, col: str = "risk") -> DataFrame:
    """One row (gini) of a non-negative column; 0 if it sums to zero."""
    values = held(records.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    ranked = running(values, "v", ["n"])  # reads them more than once
    # ranks of n equal values sum to n times their average rank
    s = F.sum(F.col("v") * F.col("n") * (F.col("run_n") - (F.col("n") - 1) / 2))
    total, n = F.sum(F.col("v") * F.col("n")), F.sum("n")
    return ranked.agg(F.when(total > 0, 2 * s / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"))


def pram_risk(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], transitions: DataFrame) -> MeasureResult:
    """Linkage under known transition probabilities (var, from, to, p).

    The probability that an original became a released record is a product over
    keys; the risk is that of the true record over the sum for all released
    ones, ``expected_risk`` its mean over the transitions.  Records with equal keys are one class, so classes meet and records do
    not.
    """
    xs = original.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_x"))
    ys = released.groupBy(*[F.col(c).alias(f"r_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("n_y"))
    both = xs.withColumn("p", F.lit(1.0))
    for n, c in enumerate(keys):  # grow classes by one key at a time along the possible transitions
        steps = transitions.filter(F.col("var") == c).select(F.col("from").alias(f"f{n}"), F.col("to").alias(f"r_{c}"), F.col("p").alias(f"q{n}")).filter(f"q{n} > 0")
        both = both.join(steps, F.col(c) == F.col(f"f{n}")).withColumn("p", F.col("p") * F.col(f"q{n}")).drop(f"f{n}", f"q{n}")
    met = both.join(ys, [f"r_{c}" for c in keys])
    total = met.groupBy(*keys).agg(F.sum(F.col("p") * F.col("n_y")).alias("p_all"))
    mine = original.select(F.col(id_col).alias("id"), *keys).join(released.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"r_{c}") for c in keys]), F.col("id") == F.col("__id")).drop("__id")
    probs = both.select(*keys, *[f"r_{c}" for c in keys], "p").withColumnsRenamed({c: f"k_{c}" for c in keys}).withColumnsRenamed({f"r_{c}": f"kr_{c}" for c in keys})
    on = [F.col(c) == F.col(f"k_{c}") for c in keys] + [F.col(f"r_{c}") == F.col(f"kr_{c}") for c in keys]
    scored = key_join(mine.join(probs, on, "left").drop(*[f"k_{c}" for c in keys], *[f"kr_{c}" for c in keys]), total, keys, "left")
    p, every = F.coalesce("p", F.lit(0.0)), F.coalesce("p_all", F.lit(0.0))
    scored = scored.withColumns({"p_true": p, "s": F.round(every - p, 15)})
    # the risk expected over what the record could have become, the others as they are
    cases = key_join(scored.select(*keys, "s").distinct(), both.select(*keys, "p"), keys, "inner")
    expected = cases.groupBy(*keys, "s").agg(F.sum(F.col("p") * F.col("p") / (F.col("s") + F.col("p"))).alias("expected_risk"))
    scored = key_join(scored, expected, [*keys, "s"], "left")
    records = scored.select("id", "p_true", F.when(every > 0, F.col("p_true") / every).otherwise(0.0).alias("risk"), "expected_risk")
    summary = records.agg(
        F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"), F.avg("p_true").alias("mean_p_true"),
        F.avg("expected_risk").alias("mean_expected_risk"), F.count(F.lit(1)).alias("n_query"),
    )
    return MeasureResult(summary, records)


def top_at_risk(records: DataFrame, n: int = 10) -> DataFrame:
    return records.orderBy(F.desc("risk"), "id").limit(n)


def risk_by_group(records: DataFrame, table: DataFrame, id_col: str, group: Sequence[str], threshold: float = 0.1) -> DataFrame:
    joined = records.join(table.select(F.col(id_col).alias("__id"), *group), F.col("id") == F.col("__id"))
    return joined.groupBy(*group).agg(
        F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("risk") > threshold).alias("n_high"), (100 * F.count_if(F.col("risk") > threshold) / F.count(F.lit(1))).alias("pct_high"),
    )


def merge_per_record(records: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """The table with the risk columns of its records beside."""
    return table.join(records, table[id_col].cast("bigint") == records["id"], "left").drop(records["id"])


def inspect_record(result: MeasureResult, released: DataFrame, id_col: str, record_id: int) -> tuple[DataFrame, DataFrame]:
    """One record's risk, and its candidates with their released values."""
    pairs = result.params["pairs_of"](F.col("id") == record_id)
    return result.records.filter(F.col("id") == record_id), pairs.join(released, F.col("rid") == released[id_col].cast("bigint")).drop("id")


def baseline_linkage(original: DataFrame, id_col: str, keys: Sequence[str], result: MeasureResult, **params) -> DataFrame:
    """One row: mean risk, that of the original against itself, and the reduction."""
    base = record_linkage(original, original, id_col, keys, **params).summary.select(F.col("mean_risk").alias("baseline_risk"))
    return result.summary.select("mean_risk").join(base).withColumn("risk_reduction", 1 - F.col("mean_risk") / F.col("baseline_risk"))


class Costs:
    """Distances of two sides that are computed when they are read, row by row or
    some rows at once, so that no matrix is held."""

    def __init__(self, a: tuple, b: tuple, spec: dict, rounded: bool = True):
        self.a, self.b, self.spec, self.shape, self.parts = a, b, spec, (len(a[0]), len(b[0])), None
        every = sum([*spec["num_w"], *spec["cat_w"]])
        if not rounded and every > 0 and not any(np.isnan(v[0]).any() or (v[1] == spec["null"]).any() for v in (a, b)):
            # only columns that differ, with their weights in the numbers
            moves = lambda k, n: len(a[k]) and len(b[k]) and ((a[k][:, n] != a[k][0, n]).any() or (b[k][:, n] != a[k][0, n]).any())
            nums = [(a[0][:, n] * (w / every), b[0][:, n] * (w / every)) for n, w in enumerate(spec["num_w"]) if moves(0, n)]
            self.parts = nums, [(a[1][:, n], b[1][:, n], w / every) for n, w in enumerate(spec["cat_w"]) if moves(1, n)]

    @property
    def T(self) -> Costs:  # noqa: N802
        return Costs(self.b, self.a, self.spec, self.parts is None)

    def __getitem__(self, at: int | slice) -> np.ndarray:
        if not isinstance(at, slice):
            return _distance(tuple(v[at] for v in self.a), self.b, self.spec)
        if self.parts is None:
            return _distances(tuple(v[at] for v in self.a), self.b, self.spec)
        out = np.zeros((len(self.a[0][at]), self.shape[1]))
        for x, y in self.parts[0]:
            d = np.subtract.outer(x[at], y)
            out += np.abs(d, out=d)
        for x, y, w in self.parts[1]:
            out += w * np.not_equal.outer(x[at], y)
        return out


def assign_sorted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cheapest one-to-one assignment of numbers by absolute difference: the
    ``y`` of each ``x``, -1 for those left over.

    Some cheapest assignment keeps the order of both sides, so that dynamic
    programming finds it; a bit for each (x, y that may be its own) is kept.
    """
    if len(x) > len(y):
        back = assign_sorted(y, x)
        out = np.full(len(x), -1)
        out[back] = np.arange(len(y))
        return out
    ox, oy = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    n, spare = len(x), len(y) - len(x)
    xs, ys = x[ox], y[oy]
    # cost[s]: the first rows placed with at most s numbers passed over
    cost, taken = np.zeros(spare + 1), np.zeros((n, spare // 8 + 1), np.uint8)
    for i in range(n):
        own = cost + np.abs(ys[i : i + spare + 1] - xs[i])
        cost = np.minimum.accumulate(own)
        taken[i] = np.packbits(own == cost)
    out, s = np.full(n, -1), spare
    for i in range(n - 1, -1, -1):
        bits = np.unpackbits(taken[i])[: s + 1]
        s = int(np.flatnonzero(bits)[-1])
        out[ox[i]] = oy[i + s]
    return out


def assign_bijective(cost: np.ndarray | Costs) -> np.ndarray:
    """Column of each row in the cheapest one-to-one assignment (Hungarian
    method with potentials); -1 for rows left over when there are more rows."""
    n, m = cost.shape
    if n > m:
        back = assign_bijective(cost.T)
        out = np.full(n, -1)
        out[back] = np.arange(m)
        return out
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], at = row, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[at]:
            used[at] = True
            i = match[at]
            reduced = cost[i - 1] - u[i] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = at
            free = np.where(used[1:], np.inf, least[1:])
            to = int(free.argmin()) + 1
            step = free[to - 1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            at = to
        while at:
            match[at], at = match[way[at]], way[at]
    out = np.full(n, -1)
    out[match[1:][match[1:] > 0] - 1] = np.flatnonzero(match[1:] > 0)
    return out


def sinkhorn(cost: np.ndarray, *, epsilon: float | None = None, max_iter: int = 100, tol: float = 1e-8) -> np.ndarray:
    """Entropic transport plan with uniform margins; epsilon defaults to 5 % of
    the median positive cost.  Worked in logarithms."""
    n, m = cost.shape
    positive = cost[cost > 0]
    eps = epsilon or (0.05 * float(np.median(positive)) if positive.size else 1.0)
    f, g = np.zeros(n), np.zeros(m)
    la, lb = -math.log(n), -math.log(m)

    def soft(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(max_iter):
        f = eps * (la - soft((g[None, :] - cost) / eps, 1))
        new = eps * (lb - soft((f[:, None] - cost) / eps, 0))
        done = np.abs(new - g).max() < tol
        g = new
        if done:
            break
    return np.exp((f[:, None] + g[None, :] - cost) / eps)


def transport_potentials(cost: np.ndarray | Costs, rows: np.ndarray, cols: np.ndarray, *, epsilon: float | None = None, max_iter: int = 100, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, float]:
    """(f, g, epsilon) of ``sinkhorn`` where row i stands for ``rows[i]`` equal ones
    and column j for ``cols[j]``: the plan of two records is exp((f + g - cost) / epsilon).

    ``Costs`` in which one number has most of the different values are summed along
    that number (``Lines``); others are read some rows at a time, once in an
    iteration, and above four million not kept.
    """
    n, m = float(rows.sum()), float(cols.sum())
    wa, wb = rows.astype(float), cols.astype(float)
    lines = Lines.fit(cost.a, cost.b, cost.spec) if isinstance(cost, Costs) else None
    if not lines and isinstance(cost, Costs) and len(wa) * len(wb) <= 4_000_000:
        cost = np.vstack([cost[p[0] : p[-1] + 1] for p in pieces(np.arange(len(wa)), len(wb))])
    step = max(1, 100_000 // len(wb))
    chunks = [slice(at, at + step) for at in range(0, len(wa), step)]
    few = lines and lines.cells[0] * lines.cells[1] * 5000 <= len(wa) * len(wb)
    eps = epsilon or 0.05 * (lines.median_positive(wa, wb) if few else _median_positive(cost, wa, wb, chunks)) or 1.0
    if lines:
        return *lines.potentials(wa, wb, eps, max_iter, tol), eps
    f, g = np.zeros(len(wa)), np.zeros(len(wb))
    la, lb = -math.log(n), -math.log(m)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        for _ in range(max_iter):
            top, sums = np.zeros(len(wb)), np.zeros(len(wb))
            for at in chunks:
                z = cost[at] * (-1 / eps)
                z += (f[at] / eps)[:, None]
                z += (g / eps)[None, :]
                e = np.exp(z)
                r = e @ wb
                sound = bool(np.isfinite(r).all() and (r > 1e-200).all())
                if sound:
                    new = f[at] + eps * (la - np.log(r))
                    part = (wa[at] * np.exp((new - f[at]) / eps)) @ e
                else:
                    high = z.max(axis=1)
                    new = f[at] + eps * (la - high - np.log(np.exp(z - high[:, None]) @ wb))
                    # rows then sum to 1 / n, so that no exponential is large
                    part = wa[at] @ np.exp(z + ((new - f[at]) / eps)[:, None])
                low = ~(part > 1e-200)
                if low.any():  # columns that underflow, in logarithms
                    z += ((new - f[at]) / eps)[:, None]
                    here = z[:, low] + np.log(wa[at])[:, None]
                    peak = here.max(axis=0)
                    both = np.where(sums[low] > 0, np.maximum(top[low], peak), peak)
                    scaled = np.exp(here - both).sum(axis=0)
                    sums[low] = np.where(sums[low] > 0, sums[low] * np.exp(top[low] - both), 0.0) + scaled
                    top[low] = both
                fine = ~low
                back = fine & (top != 0)
                sums[back] *= np.exp(top[back])
                top[back] = 0.0
                sums[fine] += part[fine]
                f[at] = new
            shift = eps * (lb - top - np.log(sums))
            g = g + shift
            if np.abs(shift).max() < tol:
                break
    return f, g, eps


def _median_positive(cost: np.ndarray | Costs, wa: np.ndarray, wb: np.ndarray, chunks: Sequence[slice]) -> float:
    """The exact median of the positive costs of all pairs of records; 0 without any."""
    bins, high = 1 << 16, max(float(cost[at].max()) for at in chunks)
    if high <= 0:
        return 0.0
    place = lambda c: np.minimum((c * (bins / high)).astype(np.int64), bins - 1)
    counts = np.zeros(bins)
    for at in chunks:
        c = cost[at]
        w = np.where(c > 0, wa[at, None] * wb[None, :], 0.0)
        counts += np.bincount(place(c).ravel(), w.ravel(), bins)
    total, below = counts.sum(), np.cumsum(counts)
    ranks = ((total - 1) // 2, total // 2)
    of = [int(np.searchsorted(below, r, "right")) for r in ranks]
    values: dict[float, float] = {}
    for at in chunks:
        c = cost[at]
        k = place(c)
        i, j = np.nonzero(((k == of[0]) | (k == of[1])) & (c > 0))
        found, which = np.unique(c[i, j], return_inverse=True)
        for v, w in zip(found.tolist(), np.bincount(which, wa[at][i] * wb[j]).tolist(), strict=True):
            values[v] = values.get(v, 0.0) + w
    order = np.array(sorted(values))
    # ranks within the bins read: all before the first, and none between two neighbours
    first = below[of[0]] - counts[of[0]]
    runs = first + np.cumsum([values[v] for v in order])
    return float(np.mean([order[np.searchsorted(runs, r, "right")] for r in ranks]))


def block_assignment(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], block: Sequence[str], *, how: str = "bijective", max_block: int = 4000) -> DataFrame:
    """(id, rid, p): one-to-one or transport matching within blocks.

    One-to-one matching of a block whose records differ in one number follows
    the order of that number (``assign_sorted``); of others, costs are held for
    blocks of up to ``max_block`` records and computed row by row for larger
    ones.  Transport is solved between classes of equal records, along the number
    with the most values where that is less work than all pairs of classes.
    """
    (x, xn), (y, yn), cats, spec = _spec(original, released, keys, "deterministic", None, "ignore", None, None)
    left, right = _vectors(x, id_col, xn, cats, block), _vectors(y, id_col, yn, cats, block)
    right = right.toDF(*[f"r_{c}" for c in right.columns])
    ship(original.sparkSession)

    def table(ids: np.ndarray, rids: np.ndarray, p: np.ndarray) -> pa.Table:
        return pa.table([pa.array(ids.astype(np.int64)), pa.array(rids.astype(np.int64)), pa.array(p.astype(float))], ["id", "rid", "p"])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return table(np.zeros(0), np.zeros(0), np.zeros(0))
        a, b = a.sort_by("id"), b.sort_by("r_id")
        va, vb = (_matrix(a["nums"]), _matrix(a["cats"])), (_matrix(b["r_nums"]), _matrix(b["r_cats"]))
        ids, rids = a["id"].to_numpy(), b["r_id"].to_numpy()
        if how == "bijective":
            nums, levels = np.vstack([va[0], vb[0]]), np.vstack([va[1], vb[1]])
            differ = np.flatnonzero((nums != nums[0]).any(axis=0))
            if len(differ) <= 1 and not np.isnan(nums).any() and not (levels != levels[0]).any():
                # a distance is a fixed multiple of the difference of this number
                k = int(differ[0]) if len(differ) else 0
                to = assign_sorted(*(v[0][:, k] if v[0].shape[1] else np.zeros(len(v[1])) for v in (va, vb)))
            else:
                whole = max(len(ids), len(rids)) <= max_block
                costs = Costs(va, vb, spec)
                to = assign_bijective(np.vstack([costs[p[0] : p[-1] + 1] for p in pieces(np.arange(len(ids)), len(rids))]) if whole else costs)
            return table(ids[to >= 0], rids[to[to >= 0]], np.ones(int((to >= 0).sum())))
        (ca, at_a, n_a), (cb, at_b, n_b) = alike(va), alike(vb)
        f, g, eps = transport_potentials(Costs(ca, cb, spec, rounded=False), n_a, n_b)
        same, i, j = np.intersect1d(ids, rids, return_indices=True)
        own = _distance(tuple(v[i] for v in va), tuple(v[j] for v in vb), spec)
        return table(same, same, np.minimum(1.0, np.exp((f[at_a[i]] + g[at_b[j]] - own) / eps) * len(ids)))

    return left.groupBy("block").cogroup(right.groupBy("r_block")).applyInArrow(run, "id bigint, rid bigint, p double")
