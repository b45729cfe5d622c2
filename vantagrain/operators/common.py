"""Primitives that the measures share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType


@dataclass(frozen=True)
class MeasureResult:
    """What a measure found: one summary row, a row per record, a row per group."""

    summary: DataFrame
    records: DataFrame | None = None
    groups: DataFrame | None = None
    params: dict = field(default_factory=dict)

    def plot_data(self, column: str, bins: int = 30) -> DataFrame:
        """Histogram of a records column: the data behind a plot."""
        return histogram(self.records, column, bins)

    def text(self, rows: int = 10) -> str:
        """The summary, one line for each value, and the first rows of the groups."""
        found = self.summary.first()
        lines = [f"{name}: {value:.6g}" if isinstance(value, float) else f"{name}: {value}" for name, value in (found.asDict() if found else {}).items()]
        if self.groups is not None:
            names = self.groups.columns
            lines += ["", "  ".join(names)]
            for r in self.groups.orderBy(*[c for c, t in self.groups.dtypes if not t.startswith(("map", "array", "struct"))][:2]).limit(rows).collect():
                lines.append("  ".join(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r))
        return "\n".join(lines)

    def show(self, rows: int = 10) -> None:
        print(self.text(rows))

    def plot(self, column: str, bins: int = 30, width: int = 50) -> str:
        """A histogram of a records column drawn with characters."""
        cells = self.plot_data(column, bins).orderBy("bin").collect()  # one row a bin
        top = max((c.n for c in cells), default=1)
        return "\n".join(f"{c.lower:>12.4g} {'#' * max(1, round(width * c.n / top))} {c.n}" for c in cells)


def complete(df: DataFrame, cols: Sequence[str], na_rm: bool = True) -> DataFrame:
    """Rows without null or NaN in ``cols``; with ``na_rm`` false all rows, in
    which a null is a level of its own."""
    return df.na.drop(subset=list(cols)) if na_rm else df


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, NumericType)


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ValueError(f"No complete cases in {what}")


def scalar_row(spark: SparkSession, **values) -> DataFrame:
    """One row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and held on the executors' disks until the session
    frees it.  The mark keeps another plan over the same path, whose files may
    have changed since, from reading it."""
    return df.withColumn("__kept", F.lit(uuid.uuid4().hex)).persist(StorageLevel.DISK_ONLY).drop("__kept")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


#: Row count and number of probabilities up to which the exact percentile
#: aggregate is used; its buffer holds the distinct values of a group.  Beyond
#: them the same quantiles are read off running counts.
PERCENTILE_ROWS = 2_000_000
PERCENTILE_PROBS = 16


def quantiles(df: DataFrame, col: str, probs: Sequence[float], max_rows: int | None = None) -> list[float]:
    """Exact quantiles with linear interpolation between order statistics.
    Empty: no values."""
    row = group_quantiles(df, col, probs, max_rows=max_rows).first()
    return list(row.q) if row else []


def group_quantiles(df: DataFrame, col: str, probs: Sequence[float], within: Sequence[str] = (), max_rows: int | None = None, weight: str | None = None) -> DataFrame:
    """(within, q): exact quantiles of each group, in the order of ``probs``;
    groups without a value are left out, and a null is a group.  A row counts
    ``weight`` times; rows without a positive weight do not count.

    Beyond PERCENTILE_ROWS rows or PERCENTILE_PROBS probabilities the quantiles
    come from running counts of the distinct values: order statistics are looked
    up by their rank in an equi-join on steps of ranks, so no task holds a group
    and the cost does not grow with the number of probabilities.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1).cast("bigint")
    values = df.select(*within, F.col(col).cast("double").alias("v"), w.alias("w")).filter("v is not null and not isnan(v) and w > 0")
    limit = PERCENTILE_ROWS if max_rows is None else max_rows
    if not weight and len(probs) <= PERCENTILE_PROBS and limit and values.limit(limit + 1).count() <= limit:
        return values.groupBy(*within).agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).filter("q is not null")
    from .ranks import running

    names = [f"g{k}" for k in range(len(within))]
    rows = values.toDF(*names, "v", "w")
    n = F.sum("w")
    counts = running(rows.groupBy(*names, "v").agg(n.alias("n")), "v", ["n"], names)
    totals = rows.groupBy(*names).agg(n.alias("all")).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("all") / len(probs)))).filter("all > 0")
    at = F.col("p") * (F.col("all") - 1)
    low = F.floor(at)
    wanted = totals.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("k", "p")).select(*names, "k", "step", (at - low).alias("part"), F.explode(F.array((low + 1).cast("double"), F.least(low + 2, F.col("all")).cast("double"))).alias("rank"))
    # rank r is the first value whose running count reaches r
    wanted = wanted.withColumn("s", F.floor(F.col("rank") / F.col("step")))
    sizes = totals.select(*[F.col(g).alias(f"t_{g}") for g in names], F.col("step").alias("width"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}{g}").eqNullSafe(F.col(f"{b}{g}")) for g in names], F.lit(True))
    first, last = F.col("run_n") - F.col("n"), F.col("run_n")
    spans = counts.join(sizes, same("", "t_")) if names else counts.join(F.broadcast(sizes))  # one row without groups
    spans = spans.select(*[F.col(g).alias(f"v_{g}") for g in names], "v", first.alias("first"), last.alias("last"), F.explode(F.sequence(F.floor(first / F.col("width")), F.floor(last / F.col("width")))).alias("v_s"))
    met = wanted.join(spans, same("", "v_") & (F.col("s") == F.col("v_s")) & (F.col("first") < F.col("rank")) & (F.col("rank") <= F.col("last")))
    lo, hi = F.min("v"), F.max("v")
    found = met.groupBy(*names, "k").agg((lo + (hi - lo) * F.max("part")).alias("x"))
    lists = found.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("q"))  # as many as probabilities
    return lists.toDF(*within, "q")


def pooled_breaks(frames: Sequence[DataFrame], col: str, n_bins: int) -> list[float]:
    """Distinct pooled quantiles at k / n_bins, rounded to nine decimals."""
    pooled = reduce(DataFrame.unionAll, [f.select(F.col(col).cast("double").alias("v")) for f in frames])
    return sorted({round(q, 9) for q in quantiles(pooled, "v", [k / n_bins for k in range(n_bins + 1)])})


def bin_of(col: str | Column, breaks: Sequence[float]) -> Column:
    """Number of the right-closed bin, the first closed on both sides; null for
    null.  A single break makes a single bin."""
    c = F.col(col) if isinstance(col, str) else col
    above = reduce(lambda a, b: a + b, [(c > b).cast("int") for b in breaks], F.lit(0))
    return F.when(c.isNotNull(), F.greatest(F.lit(1), above))


def target_bins(frames: Sequence[DataFrame], target: str, n_bins: int) -> list[DataFrame]:
    """The frames with column ``_t``: the target, binned if it is numeric."""
    if is_numeric(frames[0], target):
        breaks = pooled_breaks(frames, target, n_bins)
        return [f.withColumn("_t", bin_of(target, breaks).cast("string")) for f in frames]
    return [f.withColumn("_t", F.col(target).cast("string")) for f in frames]


def same(left: Sequence[str], right: Sequence[str], na_rm: bool = True) -> Column:
    """Equality of column tuples; null-safe where null is a level."""
    terms = [F.col(a) == F.col(b) if na_rm else F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)]
    return reduce(lambda a, b: a & b, terms)


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", na_rm: bool = True) -> DataFrame:
    """Join on key tuples; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = left.join(renamed, same(keys, [f"__{k}" for k in keys], na_rm), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over the column's range: (bin, lower, upper, n)."""
    low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n bigint")
    width = (high - low) / bins or 1.0
    place = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col(col) - low) / width))).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (low + (F.col("bin") - 1) * width).alias("lower"), (low + F.col("bin") * width).alias("upper"), "n")
