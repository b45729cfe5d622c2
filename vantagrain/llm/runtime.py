"""Session helpers shared by the operators: the shared folder, written
intermediate tables, and shipping this package to Python workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.shipping import ship

__all__ = ["bare", "delete", "drop_written", "named", "new_path", "place", "row_keys", "scratch", "shared_dir", "ship", "written"]

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the cluster's ``spark.checkpoint.dir``.  Only where the session has
    none and runs on one machine (tests, a laptop) a folder of our own is made
    and set; on a cluster its absence is an error, since each executor would
    write to its own disk.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        given = "file://" + tempfile.mkdtemp(prefix="vantagrain-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/vantagrain/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages
    before, and Python stages that several branches read run once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete this application's intermediate tables from the shared folder, and
    with them all results not yet read that rest on them."""
    delete(spark, f"{shared_dir(spark)}/vantagrain/{spark.sparkContext.applicationId}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on any Hadoop file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of tables written inside; on leaving, all but the last are deleted.

    The last must be a result that was written out, since a DataFrame that still
    rests on one of the others could no longer be read.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
    for path in made[:-1]:
        delete(spark, path)


def bare(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns renamed by position (c0, c1, ...), so that no
    name of the input can clash with those an operator adds."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> Column:
    """The column of ``bare(docs)`` that was ``name``."""
    return F.col(f"c{docs.columns.index(name)}")


def named(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``names`` by position."""
    return rows.toDF(*names)


def row_keys(i: Column, text: Column) -> list[Column]:
    """(_k1, _k2): 128 bits that tell rows of different id or text apart."""
    return [F.xxhash64(text, i).alias("_k1"), F.xxhash64(F.lit(1), i, text).alias("_k2")]
