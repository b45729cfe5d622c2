"""The standard pairs over the driver tables, in Spark and in SQL.

Even keys are the original, odd keys the released table; with a holdout,
key % 4 = 0 is training and key % 4 = 2 the holdout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Pair:
    table: str
    id: str
    keys: tuple[str, ...]
    target: str
    num: tuple[str, ...]
    cat: tuple[str, ...]

    def frames(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return df.filter(F.col(self.id) % 2 == 0), df.filter(F.col(self.id) % 2 == 1)

    def three(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Training, released, holdout."""
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return df.filter(F.col(self.id) % 4 == 0), df.filter(F.col(self.id) % 2 == 1), df.filter(F.col(self.id) % 4 == 2)

    @property
    def sql(self) -> str:
        return f"x as (select * from {self.table} where {self.id} % 2 = 0), y as (select * from {self.table} where {self.id} % 2 = 1)"

    @property
    def sql3(self) -> str:
        return (
            f"t as (select * from {self.table} where {self.id} % 4 = 0), y as (select * from {self.table} where {self.id} % 2 = 1), "
            f"h as (select * from {self.table} where {self.id} % 4 = 2)"
        )


CUST = Pair("customer", "c_custkey", ("c_nationkey", "c_mktsegment"), "c_acctbal", ("c_nationkey", "c_acctbal"), ("c_mktsegment",))
ORD = Pair("orders", "o_orderkey", ("o_orderstatus", "o_orderpriority"), "o_totalprice", ("o_totalprice",), ("o_orderstatus", "o_orderpriority"))
LINE = Pair("lineitem", "l_orderkey", ("l_returnflag", "l_linestatus", "l_quantity"), "l_discount", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus"))
PART = Pair("part", "p_partkey", ("p_brand", "p_type", "p_size"), "p_retailprice", ("p_size", "p_retailprice"), ("p_brand", "p_type"))
PAIRS = {"ord": ORD, "cust": CUST, "part": PART, "line": LINE}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, and without negative zero, for comparison."""
    out = [(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else (F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c)) for c, t in df.dtypes]
    return df.select(*out)
