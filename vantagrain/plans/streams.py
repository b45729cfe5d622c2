"""Class sizes kept by a stream, and the measures that follow from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming import class_sizes


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/customer.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    name = f"classes_{uuid.uuid4().hex}"
    query = class_sizes(rows.filter("c_custkey % 2 = 1"), ["c_nationkey", "c_mktsegment"]).writeStream.outputMode("complete")
    query.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).agg(F.min("f").alias("k_level"), F.sum("f").alias("n_records"), F.count(F.lit(1)).alias("n_ec"))


_SQL = "select c_nationkey, c_mktsegment, count(*) as f from customer where c_custkey % 2 = 1 group by all"
QUERIES = {"stream_class_sizes": _sizes, "stream_k_anonymity": _k}
SQL = {"stream_class_sizes": _SQL, "stream_k_anonymity": f"select min(f) as k_level, sum(f)::bigint as n_records, count(*) as n_ec from ({_SQL})"}
