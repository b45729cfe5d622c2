"""Identical records: copies of originals among released rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .common import MeasureResult, complete, key_join


def identical_match_share(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], *, singletons_only: bool = False, na_rm: bool = True) -> MeasureResult:
    """Share of released rows equal to an original row on ``cols``.

    With ``singletons_only`` just originals whose combination is unique count.
    Both tables meet as distinct combinations with counts, so a combination held
    by very many rows is one row of the join.
    """
    x, y = complete(original, cols, na_rm), complete(released, cols, na_rm)
    own = x.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_x"))
    if singletons_only:
        own = own.filter("n_x = 1")
    theirs = y.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_y"))
    both = key_join(own, theirs, cols, "left", na_rm)
    totals = y.agg(F.count(F.lit(1)).alias("n_synthetic")).join(x.agg(F.count(F.lit(1)).alias("n_train")))
    found = both.agg(
        F.coalesce(F.sum("n_y"), F.lit(0)).alias("n_identical"),
        F.coalesce(F.sum(F.when(F.col("n_y") > 0, F.col("n_x"))), F.lit(0)).alias("n_unique_matched"),
        F.coalesce(F.sum("n_x"), F.lit(0)).alias("n_unique_train"),
    )
    of = F.col("n_unique_train") if singletons_only else F.col("n_train")
    ims = F.try_divide("n_identical", "n_synthetic")
    summary = found.join(totals).select(
        ims.alias("ims"), (100 * ims).alias("ims_pct"), "n_identical", "n_unique_matched",
        F.when(of > 0, 100 * F.col("n_unique_matched") / of).otherwise(0.0).alias("pct_train_copied"),
        "n_synthetic", "n_train", (ims < 0.01).alias("privacy_pass"),
    )
    records = key_join(y.select(id_col, *cols), own, cols, "left", na_rm)
    return MeasureResult(summary, records.select(id_col, F.coalesce("n_x", F.lit(0)).alias("match_count")))


def ims(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], *, na_rm: bool = True) -> MeasureResult:
    return identical_match_share(original, released, id_col, cols, na_rm=na_rm)


def repu(original: DataFrame, released: DataFrame, id_col: str, cols: Sequence[str], *, uniques_only: bool = True, na_rm: bool = True) -> MeasureResult:
    """Replicated uniques: released rows equal to a unique original."""
    return identical_match_share(original, released, id_col, cols, singletons_only=uniques_only, na_rm=na_rm)
