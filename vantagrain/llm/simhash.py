"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a
text's word shingles.  Two fingerprints within ``radius`` differing bits must
share a table: give bit i of the fingerprint the vector m(i) of radius+1 bits,
and let table a (any non-zero vector) keep the bits with odd <m(i), a>.  A set
of at most ``radius`` differing positions spans less than the whole space, so
some a is orthogonal to all of it: in that table the two agree.  With radius 4
there are 31 tables that keep 32 bits each.

Equal fingerprints are one node, so copies cost one row each and no pairs.  A
bucket of up to ``bucket_limit`` fingerprints is paired and verified (with ten
billion different texts a bucket of 32 kept bits holds two or three by chance in
each of the 31 tables, which the verification drops).  The fingerprints of larger buckets (clusters of near copies) are linked through the
points within ``radius``/2 of them instead: two fingerprints are within radius
exactly if such points coincide, and a point links its fingerprints as a star,
so no cluster is ever paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .graph import components
from .runtime import bare, place, ship, written

_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text; 0 if it has no word."""
    words = text.lower().split() if text else []
    n = len(words) - shingle + 1
    if not words:
        return 0
    flat = b" ".join(words)
    if n < 1:
        n, hashes = 1, iter((xxh64_intdigest(flat, seed),))
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        slices = map(slice, starts[:n].tolist(), ends[shingle - 1 :].tolist())
        hashes = map(xxh64_intdigest, map(flat.__getitem__, slices), repeat(seed))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):  # bounded memory however long the text
        part = np.fromiter(hashes, "<u8", min(_CHUNK, n - at))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def table_masks(radius: int) -> list[int]:
    """The bit masks of the covering family, as unsigned 64-bit numbers."""
    vectors = [i % (1 << (radius + 1)) for i in range(64)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & a).bit_count() & 1)
        for a in range(1, 1 << (radius + 1))
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _row, _t): the id, a hash of all columns, and the text's bytes."""
    rows = bare(docs)
    return rows.select(place(docs, id_col).cast("bigint").alias("_id"), F.xxhash64(*rows.columns).alias("_row"), place(docs, text_col).cast("binary").alias("_t"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(_id, _row, _fp): one row for each row of ``docs``; _row hashes all its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(2)), "<u8", b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["_id", "_row", "_fp"]
            )

    ship(docs.sparkSession)
    return keyed(docs, id_col, text_col).mapInArrow(run, "_id bigint, _row bigint, _fp bigint")


def links(nodes: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints ``_fp`` within radius.

    Every pair in a small bucket is there; in large buckets, stars with the same
    components.  All links are true ones.
    """
    masks = table_masks(radius)
    keys = [F.xxhash64(F.lit(i), F.col("_fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    rows = nodes.select("_fp", F.explode(F.array(*keys)).alias("_key"))
    buckets = rows.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("_fp").alias("u"), F.max("_fp").alias("v")
    ).filter("n > 1")
    buckets = written(buckets, "simhash-buckets")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    twos = buckets.filter("n = 2").select("u", "v").filter(near)
    some = rows.join(buckets.filter(F.col("n").between(3, bucket_limit)).select("_key"), "_key")
    some = written(some, "simhash-small")
    pairs = (
        some.select("_key", F.col("_fp").alias("u"))
        .join(some.select("_key", F.col("_fp").alias("v")), "_key")
        .filter("u > v")
        .filter(near)
        .select("u", "v")
    )
    many = rows.join(buckets.filter(F.col("n") > bucket_limit).select("_key"), "_key").select("_fp").distinct()
    return twos.union(pairs).union(_stars(many, radius)).distinct()


def _stars(nodes: DataFrame, radius: int) -> DataFrame:
    """Links through shared points within half the radius (upwards on one side).

    Any two words at distance d <= radius have a point within ceil(radius/2) of
    both.  A point has at most C(64, <= half) fingerprints, whatever the input.
    """
    half = (radius + 1) // 2
    flips = [_signed(sum(1 << i for i in c)) for r in range(half + 1) for c in combinations(range(64), r)]
    by = np.array(flips, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 256):
                part = fps[at : at + 256]
                points = (part[:, None] ^ by[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.repeat(part, len(by)))], names=["p", "u"])

    points = nodes.repartition("_fp").mapInArrow(run, "p bigint, u bigint")
    groups = points.groupBy("p").agg(F.collect_set("u").alias("us"))
    stars = groups.filter(F.size("us") > 1).select(F.explode("us").alias("u"), F.array_min("us").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius  # an odd radius overshoots by one
    return stars.filter("u <> v").filter(near).distinct()


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, seed: int, bucket_limit: int
) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _row, _fp), and the label (_fp, _root, _comp) of every fingerprint."""
    if radius not in (0, 2, 4, 6):
        raise ValueError("radius must be 0, 2, 4 or 6")
    rows = written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fingerprints")
    nodes = written(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), "simhash-nodes")
    return rows, labels(nodes, links(nodes.select("_fp"), radius, bucket_limit))


def labels(nodes: DataFrame, found: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(_fp, _root, _comp) of every node (_fp, _least) under the links (u, v), or
    their components where these are known."""
    roots = roots if roots is not None else written(components(found), "simhash-roots")
    linked = nodes.join(roots, nodes["_fp"] == roots["node"])
    comps = linked.groupBy("root").agg(F.min("_least").alias("_comp"))
    known = linked.join(comps, "root").select("_fp", F.col("root").alias("_root"), "_comp")
    label = nodes.join(known, "_fp", "left").select(
        "_fp", F.coalesce("_root", "_fp").alias("_root"), F.coalesce("_comp", "_least").alias("_comp")
    )
    return written(label, "simhash-labels")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 4,
    radius: int = 4,
    seed: int = 42,
    bucket_limit: int = 64,
) -> DataFrame:
    """Near-duplicate components of all rows of ``docs``.

    Returns a row for each input row: the id column, ``fingerprint`` (16 hex
    digits) and ``component_id``, the smallest id that links lead to (itself
    included).  Null, empty and white-space texts have fingerprint zero, which
    links like any other; repeated rows come back repeated and are linked; a
    null id is never a smallest id, and ``component_id`` is null only if the
    whole component has no id; other columns take no part; an empty table gives
    an empty result.
    """
    rows, label = _grouped(docs, id_col, text_col, shingle, radius, seed, bucket_limit)
    return rows.join(label, "_fp", "left").select("_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")), "_comp").toDF(id_col, "fingerprint", "component_id")


def keep_one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int | None = None,
    radius: int = 4,
    similarity: float | None = None,
    seed: int = 42,
    bucket_limit: int = 64,
) -> DataFrame:
    """``docs`` without near duplicates: of each component one row stays, that
    with the smallest id (nulls last); among rows that share the id, the one
    with the smallest hash of all columns; of wholly equal rows, one.  Columns,
    of whatever name, and values stay as they are; see near_duplicates for null
    and empty texts.

    Texts are linked if their fingerprints of four-word shingles differ in at
    most ``radius`` bits; with ``similarity``, also if their sets of five-word
    shingles have at least that Jaccard similarity.  A similarity of 0.8 is some
    ten of 64 bits, up to eighteen, for which a covering family would need 2**19
    tables; these further candidates come from minimum hashes (see ``jaccard``)
    and each is verified on the sets.
    """
    if similarity is None:
        rows, label = _grouped(docs, id_col, text_col, shingle or 4, radius, seed, bucket_limit)
        return keep_best(docs, rows, label, id_col)
    from .jaccard import grouped

    prints, near = _grouped(docs, id_col, text_col, 4, radius, seed, bucket_limit)
    rows, label = grouped(docs, id_col, text_col, shingle or 5, similarity, seed)
    return keep_best(docs, rows, _joined(rows, label, prints, near), id_col)


def _joined(rows: DataFrame, label: DataFrame, others: DataFrame, other_label: DataFrame) -> DataFrame:
    """``label`` with the roots that rows of one component of the others connect."""
    root = lambda r, l, n: r.join(l, "_fp").select("_row", F.col("_root").alias(n)).distinct()
    both = root(rows, label, "_a").join(root(others, other_label, "_b"), "_row").select("_a", "_b").distinct()
    least = both.groupBy("_b").agg(F.min("_a").alias("v"), F.max("_a").alias("w")).filter("v <> w").select("_b", "v")
    links = both.join(least, "_b").filter("_a <> v").select(F.col("_a").alias("u"), "v").distinct()
    found = written(components(written(links, "simhash-joined")), "simhash-joined-roots")
    return label.join(found, label["_root"] == found["node"], "left").select("_fp", F.coalesce("root", "_root").alias("_root"))


def keep_best(docs: DataFrame, rows: DataFrame, label: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` that stand for a component."""
    order = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row")
    best = rows.join(label, "_fp").groupBy("_root").agg(F.min(order).alias("_best"))
    best = best.select("_best._id", "_best._row")
    copies = rows.join(best, (rows["_id"].eqNullSafe(best["_id"])) & (rows["_row"] == best["_row"]), "left_semi")
    copies = copies.groupBy("_id", "_row").agg(F.count(F.lit(1)).alias("_n"))
    copies = written(copies, "simhash-kept")
    once, again = copies.filter("_n = 1"), copies.filter("_n > 1")
    kept = _only(docs, once, id_col)
    # wholly equal rows are rare: only they pass through a grouping of full rows
    return kept.union(_only(docs, again, id_col).dropDuplicates()).toDF(*docs.columns)


def _only(docs: DataFrame, keys: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``bare(docs)`` with these keys."""
    rows = bare(docs)
    i, row = place(docs, id_col).cast("bigint"), F.xxhash64(*rows.columns)
    return rows.join(keys, i.eqNullSafe(F.col("_id")) & (row == F.col("_row")), "left_semi")
