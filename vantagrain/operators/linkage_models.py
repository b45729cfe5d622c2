"""Record linkage on what a model makes of the keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .common import MeasureResult
from .linkage import linkage_summary, record_linkage
from .models import _features, forest_leaves, propensities


def predictive_linkage(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], **params) -> MeasureResult:
    """Linkage by the distance of propensities to be released (logit)."""
    scores = propensities(original, released, id_col, keys).select("id", "origin", F.round("p", 12).alias("propensity"))
    sides = [d.join(scores.filter(F.col("origin") == k).select(F.col("id").alias(id_col), "propensity"), id_col) for k, d in ((0, original), (1, released))]
    return record_linkage(*sides, id_col, ["propensity"], **params)


def embedding_linkage(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], *, size: int = 3, **params) -> MeasureResult:
    """Linkage in a linear latent space: principal components of the scaled
    numbers and one-hot categories of both tables."""
    both = original.select(id_col, *keys, F.lit(0).alias("__side")).unionByName(released.select(id_col, *keys, F.lit(1).alias("__side"))).na.drop()
    steps = [*_features(both, keys), StandardScaler(inputCol="__x", outputCol="__s", withMean=True), PCA(k=size, inputCol="__s", outputCol="__p")]
    made = Pipeline(stages=steps).fit(both).transform(both)
    zs = [F.round(F.get(vector_to_array("__p"), F.lit(k)), 9).alias(f"z{k}") for k in range(size)]
    sides = [made.filter(F.col("__side") == k).select(id_col, *zs) for k in (0, 1)]
    return record_linkage(*sides, id_col, [f"z{k}" for k in range(size)], **params)


def forest_linkage(original: DataFrame, released: DataFrame, id_col: str, keys: Sequence[str], *, trees: int = 20, seed: int = 1, risk_threshold: float = 0.1) -> MeasureResult:
    """Linkage to the released records of greatest forest proximity.

    Records in the same leaf of every tree are one class; classes meet on shared
    leaves and records are only counted.
    """
    leaves = forest_leaves({"x": original, "y": released}, id_col, keys, trees=trees, seed=seed)
    signs = leaves.groupBy("source", "id").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("tree", "leaf")))).alias("sig")).cache()
    cells = leaves.join(signs, ["source", "id"]).select("source", "sig", "tree", "leaf").distinct()
    x, y = (cells.filter(F.col("source") == s).select(F.col("sig").alias(f"{s}_sig"), "tree", "leaf") for s in "xy")
    shared = x.join(y, ["tree", "leaf"]).groupBy("x_sig", "y_sig").agg(F.count(F.lit(1)).alias("s"))
    best = shared.groupBy("x_sig").agg(F.max("s").alias("top"))
    top = shared.join(best, "x_sig").filter("s = top").select("x_sig", "y_sig")
    sizes = signs.filter("source = 'y'").groupBy(F.col("sig").alias("y_sig")).agg(F.count(F.lit(1)).alias("k"))
    counts = top.join(sizes, "y_sig").groupBy("x_sig").agg(F.sum("k").alias("cand_n"))
    mine = signs.filter("source = 'x'").select("id", F.col("sig").alias("x_sig")).join(signs.filter("source = 'y'").select("id", F.col("sig").alias("y_sig")), "id", "left")
    hit = top.withColumn("true_in_set", F.lit(True))
    records = mine.join(hit, ["x_sig", "y_sig"], "left").join(counts, "x_sig", "left").select(
        "id", F.coalesce("true_in_set", F.lit(False)).alias("true_in_set"), F.coalesce("cand_n", F.lit(0)).alias("cand_n")
    )
    records = records.withColumn("risk", F.when(F.col("true_in_set"), 1 / F.col("cand_n")).otherwise(0.0))
    return MeasureResult(linkage_summary(records, risk_threshold), records)
