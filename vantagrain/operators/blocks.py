"""Distances between all rows of two tables, block by block.

Nearest neighbours under mixed-type distances have no key to join on.  Both
tables are dealt into blocks of bounded size; each pair of blocks is one numpy
task that returns a few numbers per row (least two distances, nearest id, count
within a radius, sum), and these partial results are merged by row.  Blocks are
as large as the cores allow, up to BLOCK_ROWS, since a row travels once for each
block of the other side; a task holds the vectors of two blocks and a bounded
part of their distances.  Rows with equal vectors are one class, met once with
its count, and a task cuts its classes into tiles of near ones, so that tiles
which cannot hold a neighbour are left out by their bounds, without changing a
result.  What is left is at worst the product of the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.shipping import ship
from .common import is_numeric

BLOCK_ROWS = 65_536
_CELLS = 1_000_000
#: Rows of a tile, and how far rounding may move a distance over its bound.
TILE = 128
_SLACK = 1e-9


def ranges(frames: Sequence[DataFrame], cols: Sequence[str]) -> dict[str, float]:
    """Range of each numeric column over all frames; 0 if constant or empty."""
    nums = [c for c in cols if is_numeric(frames[0], c)]
    if not nums:
        return {}
    pooled = reduce(DataFrame.unionByName, [f.select(*nums) for f in frames])
    row = pooled.agg(*[(F.max(c) - F.min(c)).cast("double").alias(f"r{k}") for k, c in enumerate(nums)]).first()
    return {c: row[f"r{k}"] or 0.0 for k, c in enumerate(nums)}


def minima(frames: Sequence[DataFrame], cols: Sequence[str]) -> dict[str, float]:
    pooled = reduce(DataFrame.unionByName, [f.select(*cols) for f in frames])
    row = pooled.agg(*[F.min(c).cast("double").alias(f"m{k}") for k, c in enumerate(cols)]).first()
    return {c: row[f"m{k}"] or 0.0 for k, c in enumerate(cols)}


def gower_vector(df: DataFrame, cols: Sequence[str], spans: dict[str, float], weights: dict[str, float] | None = None) -> tuple[Column, Column]:
    """(numbers scaled by range and weight, hashes of categories) of a row.

    Weights are scaled to sum to one, so that distances add up.
    """
    w = weights or dict.fromkeys(cols, 1.0)
    total = sum(w[c] for c in cols) or 1.0
    nums = [F.col(c).cast("double") * ((w[c] / total / spans[c]) if spans[c] else 0.0) for c in cols if c in spans]
    cats = [F.xxhash64(F.col(c).cast("string")) for c in cols if c not in spans]
    empty = F.array().cast("array<double>"), F.array().cast("array<bigint>")
    return (F.array(*nums) if nums else empty[0]).alias("nums"), (F.array(*cats) if cats else empty[1]).alias("cats")


def category_weights(cols: Sequence[str], spans: dict[str, float], weights: dict[str, float] | None = None) -> list[float]:
    w = weights or dict.fromkeys(cols, 1.0)
    total = sum(w[c] for c in cols) or 1.0
    return [w[c] / total for c in cols if c not in spans]


def _dealt(queries: DataFrame, refs: DataFrame, left: Sequence[str], right: Sequence[str], block_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with block columns (qb, rb); the references' names begin with ``r_``."""
    n_q, n_r = queries.count(), refs.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    size = block_rows or min(BLOCK_ROWS, max(512, int((n_q * n_r / (2 * cores)) ** 0.5)))
    p_q, p_r = (max(1, -(-n // size)) for n in (n_q, n_r))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n).cast("bigint"))
    a = queries.select(*left, block(p_q).alias("qb"), every(p_r).alias("rb"))
    b = refs.select(*right, block(p_r).alias("rb"), every(p_q).alias("qb"))
    # new column identities, so that a table can meet itself
    return a, b.toDF(*[f"r_{c}" for c in b.columns])


def _stack(t: pa.Table, col: str) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return t[col].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _gower(a: tuple, b: tuple, weights: np.ndarray) -> np.ndarray:
    """Sums of absolute differences and weighted mismatches of (nums, cats) that broadcast."""
    d = np.zeros(np.broadcast_shapes(a[0].shape[:-1], b[0].shape[:-1]))
    for k in range(a[0].shape[-1]):
        d += np.abs(a[0][..., k] - b[0][..., k])
    for k in range(a[1].shape[-1]):
        d += weights[k] * (a[1][..., k] != b[1][..., k])
    return d


class Tiles:
    """Rows (numbers, category hashes) cut into tiles of near rows, with their boxes.

    A tile has one combination of categories, unless there are too many of them;
    then the categories bound nothing (``cats`` is None).
    """

    def __init__(self, nums: np.ndarray, cats: np.ndarray, scale: Sequence[float] = (), rows: int = 0):
        rows = rows or TILE
        n, scale = len(nums), np.array(scale if len(scale) else [1.0] * nums.shape[1], float)
        order, starts = np.arange(n), [0]
        if cats.shape[1] and n:
            order = np.lexsort(cats.T)
            starts = [0, *(np.flatnonzero((cats[order][1:] != cats[order][:-1]).any(axis=1)) + 1)]
        split = len(starts) * 16 <= max(n, 16 * rows)
        todo = np.split(order, starts[1:]) if split else [np.arange(n)]
        self.rows: list[np.ndarray] = []
        while todo:
            part = todo.pop()
            if not len(part):
                continue
            if len(part) > rows and nums.shape[1]:
                spread = (nums[part].max(axis=0) - nums[part].min(axis=0)) * scale
                if (widest := int(spread.argmax())) >= 0 and spread[widest] > 0:
                    part = part[np.argpartition(nums[part, widest], len(part) // 2)]
                    todo += [part[: len(part) // 2], part[len(part) // 2 :]]
                    continue
            self.rows += [part[at : at + rows] for at in range(0, len(part), rows)]
        self.low = np.array([nums[r].min(axis=0) for r in self.rows]).reshape(len(self.rows), nums.shape[1])
        self.high = np.array([nums[r].max(axis=0) for r in self.rows]).reshape(len(self.rows), nums.shape[1])
        self.cats = np.array([cats[r[0]] for r in self.rows]).reshape(len(self.rows), cats.shape[1]) if split else None

    def gaps(self, k: int, other: Tiles) -> tuple[np.ndarray, np.ndarray]:
        """Least difference of each number, and whether each category differs, from
        tile ``k`` to all tiles of ``other``."""
        apart = np.maximum(0.0, np.maximum(other.low - self.high[k], self.low[k] - other.high))
        if self.cats is None or other.cats is None:
            return apart, np.zeros((len(other.rows), 0))
        return apart, self.cats[k] != other.cats

    def spans(self, k: int, other: Tiles) -> np.ndarray:
        """Greatest difference of each number from tile ``k`` to all tiles of ``other``."""
        return np.maximum(other.high - self.low[k], self.high[k] - other.low)


def pieces(rows: np.ndarray, n: int) -> list[np.ndarray]:
    """``rows`` in parts that give a bounded number of distances to ``n`` others."""
    step = max(1, _CELLS // max(1, n))
    return [rows[at : at + step] for at in range(0, len(rows), step)]


def keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with (_h, _g), 128 bits of hash of the columns ``by``, by which equal rows meet."""
    return df.withColumns({"_h": F.xxhash64(*by), "_g": F.xxhash64(F.lit(7), *by)})


def classes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each combination of the columns ``by`` of a ``keyed`` table:
    (_h, _g, by, cid, n), with the least id and the number of its rows."""
    return df.groupBy("_h", "_g").agg(*[F.any_value(c).alias(c) for c in by], F.min("id").alias("cid"), F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``df`` by its groups in as many tasks as keep the cores busy: the rows are
    few bytes and much work, so that adaptive execution would merge them."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *groups)


def nearest(
    queries: DataFrame,
    refs: DataFrame,
    *,
    metric: str = "gower",
    cat_weights: Sequence[float] = (),
    radius: float | None = None,
    not_self: bool = False,
    sums: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """For tables (id, nums, cats): (id, d1, d1_id, d2, n_within, sum_d, n_refs).

    ``metric`` is gower (sum of absolute differences of the scaled numbers and
    weighted mismatches) or euclidean (of the numbers).  Distances are rounded
    to 12 decimals, so ties are ties; ``d1_id`` is the least id at ``d1``.
    ``not_self`` leaves out a row itself where ``refs`` is the queries' own table
    (ids must be unique).  d1 and d2 are null where there are not that many
    references.  ``sum_d`` needs every distance and is null with ``sums`` false.
    """
    ship(queries.sparkSession)
    by = ["nums", "cats"]
    queries, refs = keyed(queries, by), keyed(refs, by)
    mine, theirs = classes(queries, by), classes(refs, by)
    if not_self:  # where the least id of a class is the query, the second stands in
        others = refs.join(theirs.select(F.col("cid").alias("id")), "id", "left_anti").groupBy("_h", "_g").agg(F.min("id").alias("cid2"))
        theirs = theirs.join(others, ["_h", "_g"], "left")
    else:
        theirs = theirs.withColumn("cid2", F.lit(None).cast("bigint"))
    left, right = _dealt(mine.withColumnRenamed("cid", "id"), theirs.withColumnRenamed("cid", "id"), ["id", *by], ["id", "cid2", "n", *by], block_rows)
    weights = np.array(cat_weights, float)
    euclid = metric == "euclidean"
    schema = "id bigint, d array<double>, rid array<bigint>, rid2 array<bigint>, n array<bigint>, n_within bigint, sum_d double, n_refs bigint"
    names = ["id", "d", "rid", "rid2", "n", "n_within", "sum_d", "n_refs"]

    def distances(q: tuple, b: tuple) -> np.ndarray:
        if not euclid:
            return np.round(_gower(tuple(v[:, None, :] for v in q), tuple(v[None, :, :] for v in b), weights), 12)
        d = np.zeros((len(q[0]), len(b[0])))
        for k in range(q[0].shape[1]):
            d += (q[0][:, k, None] - b[0][None, :, k]) ** 2
        return np.round(np.sqrt(d), 12)

    def bound(apart: np.ndarray, miss: np.ndarray) -> np.ndarray:
        total = np.sqrt((apart**2).sum(axis=1)) if euclid else apart.sum(axis=1)
        return total + (miss @ weights if miss.shape[1] and not euclid else 0.0)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in [*names, "len"]}
        if a.num_rows and b.num_rows:
            b = b.sort_by("r_id")
            va, vb = (_stack(a, "nums"), _stack(a, "cats")), (_stack(b, "r_nums"), _stack(b, "r_cats"))
            ids, rid, n = a["id"].to_numpy(), b["r_id"].to_numpy(), b["r_n"].to_numpy()
            rid2 = b["r_cid2"].fill_null(-1).to_numpy()
            sure = not (np.isnan(va[0]).any() or np.isnan(vb[0]).any())
            ta, tb = Tiles(*va), Tiles(*vb)
            held = np.array([n[r].sum() for r in tb.rows])
            for k, tile in enumerate(ta.rows):
                apart, miss = ta.gaps(k, tb)
                least = bound(apart, miss) - _SLACK if sure else np.full(len(tb.rows), -np.inf)
                whole = np.zeros(len(tb.rows), bool)
                if radius is not None and sure and (tb.cats is not None and ta.cats is not None or not len(weights)):
                    # tiles wholly within the radius count without a distance
                    whole = bound(ta.spans(k, tb), miss) + _SLACK <= radius
                q = tuple(v[tile] for v in va)
                three = np.argsort(least, kind="stable")
                first = three[: 1 + int(np.searchsorted(np.cumsum([len(tb.rows[t]) for t in three]), 3))]
                some = np.concatenate([tb.rows[t] for t in first])
                d = distances(q, tuple(v[some] for v in vb))
                reach = np.partition(d, 2, axis=1)[:, 2].max() if len(some) > 2 else np.inf
                near = least <= reach
                every = sums or not sure
                wide = np.ones_like(near) if every else near | (~whole & (least <= radius)) if radius is not None else near
                within_whole = 0 if every else int(held[whole & ~wide].sum())
                cols = np.sort(np.concatenate([tb.rows[t] for t in np.flatnonzero(wide)]))
                m = min(3, len(cols))
                for part in pieces(tile, len(cols)):
                    d = distances(tuple(v[part] for v in va), tuple(v[cols] for v in vb))
                    out["n_within"].append(((d <= radius) @ n[cols].astype(float)).astype(np.int64) + within_whole if radius is not None else np.zeros(len(part), np.int64))
                    out["sum_d"].append(d @ n[cols].astype(float) if sums else np.full(len(part), np.nan))
                    best = np.zeros((len(part), m), np.int64)
                    value = np.zeros((len(part), m))
                    at = np.arange(len(part))
                    for j in range(m):  # the least id first among equal distances
                        best[:, j] = d.argmin(axis=1)
                        value[:, j] = d[at, best[:, j]]
                        d[at, best[:, j]] = np.inf
                    of = cols[best]
                    out["id"].append(ids[part])
                    out["len"].append(np.full(len(part), m))
                    for c, v in (("d", value), ("rid", rid[of]), ("rid2", rid2[of]), ("n", n[of])):
                        out[c].append(v.ravel())
            out["n_refs"] = [np.full(sum(map(len, out["id"])), n.sum())]
        join = lambda c, kind: np.concatenate(out[c]).astype(kind) if out[c] else np.zeros(0, kind)
        ends = pa.array(np.concatenate(([0], np.cumsum(join("len", np.int64)))), pa.int32())
        lists = {c: pa.ListArray.from_arrays(ends, pa.array(join(c, float if c == "d" else np.int64))) for c in ("d", "rid", "rid2", "n")}
        plain = {c: pa.array(join(c, float if c == "sum_d" else np.int64)) for c in ("id", "n_within", "sum_d", "n_refs")}
        return pa.table([(lists | plain)[c] for c in names], names)

    parts = spread(left, ["qb", "rb"]).groupBy("qb", "rb").cogroup(spread(right, ["r_qb", "r_rb"]).groupBy("r_qb", "r_rb")).applyInArrow(run, schema)
    # three classes a block at most, of which three stay
    places = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "rid", "rid2", "n")))), 1, 3)
    merged = parts.groupBy("id").agg(places.alias("p"), F.sum("n_within").alias("n_within"), F.sum("sum_d").alias("sum_d"), F.sum("n_refs").alias("n_refs"))
    rows = queries.select("id", "_h", "_g").join(mine.select("_h", "_g", F.col("cid").alias("own")).join(merged.withColumnRenamed("id", "own"), "own"), ["_h", "_g"])
    one = F.lit(1 if not_self else 0)
    less = lambda e: F.when(e["rid"] == F.col("own"), one).otherwise(0) if not_self else F.lit(0)
    swap = lambda e: F.when((e["rid"] == F.col("id")) & (e["rid"] == F.col("own")), e["rid2"]).otherwise(e["rid"]) if not_self else e["rid"]
    left_over = F.array_sort(F.filter(F.transform("p", lambda e: F.struct(e["d"].alias("d"), swap(e).alias("rid"), (e["n"] - less(e)).alias("n"))), lambda e: e["n"] > 0))
    rows = rows.withColumn("p", left_over)
    first, second = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    own = one.cast("bigint")
    n_within = F.col("n_within") - own if radius is not None else F.col("n_within")
    return rows.select(
        "id", first["d"].alias("d1"), first["rid"].alias("d1_id"), F.when(first["n"] > 1, first["d"]).otherwise(second["d"]).alias("d2"),
        n_within.alias("n_within"), (F.col("sum_d") if sums else F.lit(None).cast("double")).alias("sum_d"), (F.col("n_refs") - own).alias("n_refs"),
    )


def pooled(frames: dict[str, DataFrame]) -> DataFrame:
    """The different vectors of tables (nums, cats): (_h, _g, nums, cats, and under
    each table's name how many of its rows have it)."""
    marked = [d.select("nums", "cats", *[F.lit(int(n == name)).cast("bigint").alias(n) for n in frames]) for name, d in frames.items()]
    by = ["nums", "cats"]
    return keyed(reduce(DataFrame.unionByName, marked), by).groupBy("_h", "_g").agg(*[F.any_value(c).alias(c) for c in by], *[F.sum(n).alias(n) for n in frames])


def counts_within(queries: DataFrame, refs: DataFrame, radius: float, own: Sequence[str], sides: Sequence[str], cat_weights: Sequence[float] = (), block_rows: int | None = None) -> DataFrame:
    """For ``pooled`` tables with counts ``own`` and ``sides``: (_h, _g, own, sides,
    all_<side>), the references of each side within a Gower radius of a vector, and all of them."""
    ship(queries.sparkSession)
    keys, every = ["id", "_g", *own], [f"all_{c}" for c in sides]
    left, right = _dealt(queries.withColumnRenamed("_h", "id"), refs.withColumnRenamed("_h", "id"), [*keys, "nums", "cats"], [*sides, "nums", "cats"], block_rows)
    weights = np.array(cat_weights, float)
    bound = lambda apart, miss: apart.sum(axis=1) + (miss @ weights if miss.shape[1] else 0.0)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = np.zeros((a.num_rows if b.num_rows else 0, len(sides)))
        n = np.stack([b[f"r_{c}"].to_numpy() for c in sides], axis=1).astype(float)
        if a.num_rows and b.num_rows:
            va, vb = (_stack(a, "nums"), _stack(a, "cats")), (_stack(b, "r_nums"), _stack(b, "r_cats"))
            sure = not (np.isnan(va[0]).any() or np.isnan(vb[0]).any())
            ta, tb = Tiles(*va), Tiles(*vb)
            held = np.stack([n[r].sum(axis=0) for r in tb.rows])
            known = ta.cats is not None and tb.cats is not None or not len(weights)
            for k, tile in enumerate(ta.rows):
                near, whole = np.ones(len(tb.rows), bool), np.zeros(len(tb.rows), bool)
                if sure:
                    near = bound(*ta.gaps(k, tb)) - _SLACK <= radius
                if sure and known:  # tiles wholly within the radius count without a distance
                    whole = bound(ta.spans(k, tb), ta.gaps(k, tb)[1]) + _SLACK <= radius
                found[tile] = held[whole].sum(axis=0)
                some = np.flatnonzero(near & ~whole)
                if len(some):
                    cols = np.concatenate([tb.rows[t] for t in some])
                    for part in pieces(tile, len(cols)):
                        d = np.round(_gower(tuple(v[part][:, None, :] for v in va), tuple(v[cols][None, :, :] for v in vb), weights), 12)
                        found[part] += (d <= radius) @ n[cols]
        kept = a.select(keys) if b.num_rows else a.select(keys).slice(0, 0)
        for k, c in enumerate(sides):
            kept = kept.append_column(c, pa.array(found[:, k].astype(np.int64)))
        for k, c in enumerate(every):
            kept = kept.append_column(c, pa.array(np.full(len(found), int(n[:, k].sum()), np.int64)))
        return kept

    schema = ", ".join(f"{c} bigint" for c in [*keys, *sides, *every])
    parts = spread(left, ["qb", "rb"]).groupBy("qb", "rb").cogroup(spread(right, ["r_qb", "r_rb"]).groupBy("r_qb", "r_rb")).applyInArrow(run, schema)
    return parts.withColumnRenamed("id", "_h").groupBy("_h", "_g").agg(*[F.any_value(c).alias(c) for c in own], *[F.sum(c).alias(c) for c in [*sides, *every]])


def kernel_sum(queries: DataFrame, refs: DataFrame, sigma: float, block_rows: int | None = None, kernel: str = "gaussian") -> float:
    """Sum of a Gaussian or rational quadratic kernel over all pairs of rows of
    tables (id, nums)."""
    of = {"gaussian": lambda d2: np.exp(d2 / (-2 * sigma**2)), "rational_quadratic": lambda d2: 1 / (1 + d2 / (2 * sigma**2))}[kernel]
    return _pair_sum(queries, refs, of, block_rows)


def distance_sum(queries: DataFrame, refs: DataFrame, block_rows: int | None = None) -> float:
    """Sum of the Euclidean distance over all pairs of rows of tables (id, nums);
    of single numbers from running counts, without a pair."""
    one = queries.select(F.size("nums").alias("k")).first()
    if one and one.k == 1:
        return _gap_sum(*(d.select(F.get("nums", F.lit(0)).alias("v")) for d in (queries, refs)))
    return _pair_sum(queries, refs, np.sqrt, block_rows)


def _gap_sum(a: DataFrame, b: DataFrame) -> float:
    """Sum of the absolute difference over all pairs of two tables of numbers (v):
    between neighbours of both, the pairs that their gap parts."""
    from .ranks import running

    sides = a.select("v", F.lit(1.0).alias("a"), F.lit(0.0).alias("b")).unionAll(b.select("v", F.lit(0.0).alias("a"), F.lit(1.0).alias("b")))
    counts = sides.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not n.a or not n.b:
        return 0.0
    # |x - y| summed is v times the signed count of numbers on the other side below and above
    below_b, below_a = F.col("run_b") - F.col("b"), F.col("run_a") - F.col("a")
    term = F.col("a") * F.col("v") * (below_b - (n.b - F.col("run_b"))) + F.col("b") * F.col("v") * (below_a - (n.a - F.col("run_a")))
    return float(running(counts, "v", ["a", "b"]).agg(F.sum(term)).first()[0])


def _pair_sum(queries: DataFrame, refs: DataFrame, of: Callable[[np.ndarray], np.ndarray], block_rows: int | None) -> float:
    """Sum of a function of the squared distance over all pairs, block against block."""
    ship(queries.sparkSession)
    left, right = _dealt(queries, refs, ["nums"], ["nums"], block_rows)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        total = 0.0
        if a.num_rows and b.num_rows:
            num_a, num_b = _stack(a, "nums"), _stack(b, "r_nums")
            step = max(1, _CELLS // len(num_b))
            for at in range(0, len(num_a), step):
                part = num_a[at : at + step]
                d2 = np.zeros((len(part), len(num_b)))
                for k in range(part.shape[1]):
                    d2 += (part[:, k, None] - num_b[None, :, k]) ** 2
                total += float(of(d2).sum())
        return pa.table({"s": pa.array([total])})

    parts = spread(left, ["qb", "rb"]).groupBy("qb", "rb").cogroup(spread(right, ["r_qb", "r_rb"]).groupBy("r_qb", "r_rb")).applyInArrow(run, "s double")
    return float(parts.agg(F.sum("s")).first()[0] or 0.0)


def vectors(df: DataFrame, id_col: str, cols: Sequence[str], spans: dict[str, float], weights: dict[str, float] | None = None) -> DataFrame:
    """Table (id, nums, cats) for Gower distances."""
    nums, cats = gower_vector(df, cols, spans, weights)
    return df.select(F.col(id_col).cast("bigint").alias("id"), nums, cats)


def minmax_vectors(df: DataFrame, id_col: str, cols: Sequence[str], spans: dict[str, float], lows: dict[str, float]) -> DataFrame:
    """Table (id, nums, cats) of columns scaled to [0, 1]; constants become 0."""
    nums = [(F.col(c).cast("double") - lows[c]) / spans[c] if spans[c] else F.lit(0.0) for c in cols]
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.array(*nums).alias("nums"), F.array().cast("array<bigint>").alias("cats"))


def within(queries: DataFrame, refs: DataFrame, radius: float, cat_weights: Sequence[float], block_rows: int | None = None) -> DataFrame:
    """For tables (id, nums, cats, t): (id, n, n_same, one_target), the references
    within a Gower radius, those with the query's target, and whether all share
    one target."""
    ship(queries.sparkSession)
    columns = ["id", "nums", "cats", F.xxhash64("t").alias("t")]
    left, right = _dealt(queries, refs, columns, columns, block_rows)
    weights = np.array(cat_weights, float)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        if a.num_rows and b.num_rows:
            va, vb = (_stack(a, "nums"), _stack(a, "cats")), (_stack(b, "r_nums"), _stack(b, "r_cats"))
            ids, t_a, t_b = a["id"].to_numpy(), a["t"].to_numpy(), b["r_t"].to_numpy()
            step = max(1, _CELLS // len(t_b))
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                hit = np.round(_gower(tuple(v[part][:, None, :] for v in va), tuple(v[None, :, :] for v in vb), weights), 9) <= radius
                low = np.where(hit, t_b[None, :], np.iinfo(np.int64).max).min(axis=1)
                high = np.where(hit, t_b[None, :], np.iinfo(np.int64).min).max(axis=1)
                for k, v in enumerate((ids[part], hit.sum(axis=1), (hit & (t_a[part, None] == t_b[None, :])).sum(axis=1), low, high)):
                    out[k].append(v)
        return pa.table([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in out], ["id", "n", "n_same", "low", "high"])

    parts = spread(left, ["qb", "rb"]).groupBy("qb", "rb").cogroup(spread(right, ["r_qb", "r_rb"]).groupBy("r_qb", "r_rb")).applyInArrow(run, "id bigint, n bigint, n_same bigint, low bigint, high bigint")
    merged = parts.groupBy("id").agg(F.sum("n").alias("n"), F.sum("n_same").alias("n_same"), F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.select("id", "n", "n_same", ((F.col("n") > 0) & (F.col("low") == F.col("high"))).alias("one_target"))


def rank_of(queries: DataFrame, refs: DataFrame, cat_weights: Sequence[float], block_rows: int | None = None) -> DataFrame:
    """For tables (id, nums, cats), the queries also with (rid, r_nums, r_cats), a
    reference of each: (id, n), the references that come before that one in the
    order of Gower distance and id."""
    ship(queries.sparkSession)
    mine = [*["id", "nums", "cats", "rid"], F.col("r_nums").alias("own_nums"), F.col("r_cats").alias("own_cats")]
    left, right = _dealt(queries, refs, mine, ["id", "nums", "cats"], block_rows)
    weights = np.array(cat_weights, float)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if a.num_rows and b.num_rows:
            va, own, vb = ((_stack(t, n), _stack(t, c)) for t, n, c in ((a, "nums", "cats"), (a, "own_nums", "own_cats"), (b, "r_nums", "r_cats")))
            ids, rid, oid, counts = a["id"].to_numpy(), a["rid"].to_numpy(), b["r_id"].to_numpy(), np.zeros(a.num_rows, np.int64)
            limit = np.round(_gower(va, own, weights), 12)
            step = max(1, _CELLS // len(oid))
            for at in range(0, a.num_rows, step):
                q = slice(at, at + step)
                d = np.round(_gower(tuple(v[q][:, None, :] for v in va), tuple(v[None, :, :] for v in vb), weights), 12)
                counts[q] = ((d < limit[q, None]) | ((d == limit[q, None]) & (oid[None, :] < rid[q, None]))).sum(axis=1)
        return pa.table({"id": pa.array(ids), "n": pa.array(counts)})

    parts = spread(left, ["qb", "rb"]).groupBy("qb", "rb").cogroup(spread(right, ["r_qb", "r_rb"]).groupBy("r_qb", "r_rb")).applyInArrow(run, "id bigint, n bigint")
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


def predicate_counts(attacks: DataFrame, refs: DataFrame, block_rows: int | None = None) -> DataFrame:
    """For attacks (id, nums, above, cats, num_used, cat_used) and refs (id, nums,
    cats): (id, n), the references that fulfil all used conditions of an attack.

    A number must be at least the attack's where ``above`` is 1, else at most; a
    category must be equal.  A comparison with NaN fails.
    """
    ship(attacks.sparkSession)
    mine = ["id", "nums", "above", "cats", "num_used", "cat_used"]
    left, right = _dealt(attacks, refs, mine, ["id", "nums", "cats"], block_rows)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if a.num_rows and b.num_rows:
            nums, above, cats, num_used, cat_used = (_stack(a, c) for c in mine[1:])
            num_b, cat_b = _stack(b, "r_nums"), _stack(b, "r_cats")
            ids, counts = a["id"].to_numpy(), np.zeros(a.num_rows, np.int64)
            step = max(1, _CELLS // len(num_b))
            for at in range(0, a.num_rows, step):
                q = slice(at, at + step)
                good = np.ones((len(ids[q]), b.num_rows), bool)
                for k in range(nums.shape[1]):
                    v, w = nums[q, k, None], num_b[None, :, k]
                    good &= np.where(above[q, k, None] == 1, w >= v, w <= v) | (num_used[q, k, None] == 0)
                for k in range(cats.shape[1]):
                    good &= (cats[q, k, None] == cat_b[None, :, k]) | (cat_used[q, k, None] == 0)
                counts[q] = good.sum(axis=1)
        return pa.table({"id": pa.array(ids), "n": pa.array(counts)})

    parts = spread(left, ["qb", "rb"]).groupBy("qb", "rb").cogroup(spread(right, ["r_qb", "r_rb"]).groupBy("r_qb", "r_rb")).applyInArrow(run, "id bigint, n bigint")
    return parts.groupBy("id").agg(F.sum("n").alias("n"))
