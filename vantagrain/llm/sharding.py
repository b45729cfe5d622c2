"""Weighted rendezvous hashing of record keys over shards.

A key draws a number for every shard from a digest of the key and the shard, and
goes to the shard with the largest ``-weight / ln(number)``.  Shards do not know
of each other: with one more shard a key either stays or goes to the new one, so
growth from n to n+1 equal shards moves one key in n+1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_SPAN = float(1 << 52)


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the key and the shard: 52 bits of an MD5."""
    return (F.conv(F.substring(_digest(key, shard), 1, 13), 16, 10).cast("double") + 0.5) / _SPAN


def _digest(key: Column, shard: int) -> Column:
    return F.md5(F.concat(key, F.lit(f":{shard}")))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a string key; the lower one on the (never seen) tie."""
    if len(set(weights)) == 1:  # the larger draw wins: its digits decide
        scores = [F.substring(_digest(key, n), 1, 13) for n in range(len(weights))]
    else:
        scores = [-w / F.log(draw(key, n)) if w > 0 else F.lit(-1.0) for n, w in enumerate(weights)]
    ranked = [F.struct(s.alias("s"), F.lit(-n).alias("n")) for n, s in enumerate(scores)]
    return (-F.array_max(F.array(*ranked)).getField("n")).cast("int")


def assign(
    docs: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    *,
    weights: list[float] | None = None,
    n_shards: int = 16,
    chunk_rows: int = 200_000,
) -> DataFrame:
    """A place for every row: the key column, ``size``, ``text_crc32``,
    ``shard``, ``slot`` and ``grown_shard`` (with one more shard, of mean weight).

    ``size`` is the UTF-8 length of the text plus one, ``text_crc32`` its
    unsigned CRC-32; a null text is empty for both.  ``weights`` gives a shard's
    share, ``n_shards`` equal ones by default.  Slots run from 0 without gaps in
    each shard, ordered by (digest of the key, key, size, text_crc32).  A null
    key is a key like any other and comes first among equal digests.  Rows with
    equal key, size and CRC are interchangeable and take consecutive slots;
    other columns take no part; an empty table gives an empty result.

    Slots need no sort of a whole shard: rows are dealt by the first bits of the
    key's digest into chunks of about ``chunk_rows``, numbered within, and
    shifted by the sizes of the chunks before.
    """
    weights = list(weights) if weights else [1.0] * n_shards
    if any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must not be negative and not all be zero")
    grown = [*weights, sum(weights) / len(weights)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key_col}`").alias("_key"),
        (F.octet_length(text).cast("bigint") + 1).alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
    )
    # equal rows are one row from here on: a key with a third of all rows costs one
    counted = rows.groupBy("_key", "_size", "_crc").agg(F.count(F.lit(1)).alias("_n"))
    name = F.coalesce(F.col("_key").cast("string"), F.lit(""))
    chunks = max(1, -(-docs.count() // chunk_rows))  # a count that Parquet answers from footers
    placed = counted.withColumn("_md5", F.md5(name)).select("*", shard_of(name, weights).alias("_shard"), shard_of(name, grown).alias("_grown"))
    dealt = placed.withColumn(
        "_chunk", F.floor(F.conv(F.substring("_md5", 1, 13), 16, 10).cast("double") / _SPAN * chunks).cast("bigint")
    )
    inner = Window.partitionBy("_shard", "_chunk").orderBy("_md5", F.col("_key").asc_nulls_first(), "_size", "_crc")
    local = dealt.withColumn("_before", F.sum("_n").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    sums = dealt.groupBy("_shard", "_chunk").agg(F.sum("_n").alias("_rows"))
    ahead = Window.partitionBy("_shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_shard", "_chunk", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_shift"))
    joined = local.join(shifts, ["_shard", "_chunk"])
    # copies of a row come out in runs of bounded length
    runs = joined.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / 10_000))))
    last = F.least(F.col("_n") - 1, (F.col("_run") + 1) * 10_000 - 1)
    each = runs.withColumn("_k", F.explode(F.sequence(F.col("_run") * 10_000, last)))
    return each.select(
        F.col("_key").alias(key_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        (F.col("_shift") + F.col("_before") + F.col("_k")).cast("bigint").alias("slot"),
        F.col("_grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", *, weights: list[float] | None = None, n_shards: int = 16) -> None:
    """Write the rows as Parquet with a folder for each shard.

    Rows are dealt by shard and a second digest, so no task holds a whole shard.
    """
    weights = list(weights) if weights else [1.0] * n_shards
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))
    docs.withColumn("shard", shard_of(key, weights)).write.partitionBy("shard").parquet(path)
