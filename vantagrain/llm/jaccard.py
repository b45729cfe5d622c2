"""Near-duplicate groups by the Jaccard similarity of word shingles, for
``simhash.keep_one_of_each`` where a similarity is asked for.

Two texts are linked if their sets of distinct word shingles have a Jaccard
similarity of at least ``similarity``.  Candidates share one of ``bands`` keys,
each made of ``width`` minimum hashes: with 40 bands of 6, a pair at exactly 0.8
shares none with a chance of 5e-6, a pair at 0.85 with 6e-9.  Every link is
verified on the whole sets, so there are no false ones.

Equal sets are one node, and bands with the same members are verified once.  A
band of up to ``SMALL`` members is one group of a task: a text is compared with
the groups found so far until one takes it, so near copies cost about a
comparison a text and never a row a pair.  In a larger band every member is
first compared with one of them, in a join; bands whose members are then all
connected are done, which a cluster of near copies is at once.  What remains is
cut into parts of ``PART`` members, and parts meet in pairs, so that no task holds
more than two parts however large a cluster is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .graph import components
from .runtime import ship, written
from .simhash import keyed, labels
from .words import U, mix

_CHUNK = 1024
SMALL = 1024
PART = 256


def shingles(text: bytes | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one."""
    words = text.lower().split() if text else []
    n = len(words) - size + 1
    if not words:
        return np.zeros(0, U)
    flat = b" ".join(words)
    if n < 1:
        return np.array([xxh64_intdigest(flat, seed)], U)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    slices = map(slice, starts[:n].tolist(), ends[size - 1 :].tolist())
    return np.unique(np.fromiter(map(xxh64_intdigest, map(flat.__getitem__, slices), repeat(seed)), U, n))


def set_hash(found: np.ndarray) -> int:
    return xxh64_intdigest(found.tobytes(), 0)


def band_keys(found: np.ndarray, bands: int, width: int, seed: int = 42) -> np.ndarray:
    """A key for each band: the hash of its minimum hashes."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, bands * width, dtype=U) * U(2) + U(1)
    fold = rng.integers(0, 1 << 63, (bands, width), dtype=U) * U(2) + U(1)
    least = np.full(bands * width, ~U(0))
    for at in range(0, len(found), _CHUNK):
        part = found[at : at + _CHUNK]
        np.minimum(least, (part[:, None] * odd[None, :]).min(axis=0), out=least)
    return mix((mix(least.reshape(bands, width)) * fold).sum(axis=1, dtype=U) + np.arange(bands, dtype=U))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same >= similarity * (len(a) + len(b) - same) - 1e-9


def spanning(sets: dict[int, np.ndarray], similarity: float, roots: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """True links that connect all that links connect; nodes that share a root
    are connected already."""
    groups: list[tuple[list[int], set[int]]] = []
    links = []
    for u in sorted(sets):
        root = roots[u] if roots else u
        mine, known, rest = [u], {root}, []
        for g in groups:
            members, have = g
            v = None if root in have else next((v for v in members if alike(sets[u], sets[v], similarity)), None)
            if root not in have and v is None:
                rest.append(g)
                continue
            if v is not None:
                links.append((u, v))
            mine = members + mine if len(members) >= len(mine) else mine + members
            known = known | have
        groups = [(mine, known), *rest]
    return links


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _nodes(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, width: int, seed: int) -> DataFrame:
    """(_id, _row, _fp, _keys): one row for each row; _fp is the hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = np.zeros(b.num_rows, U), np.zeros((b.num_rows, bands), U)
            for k, t in enumerate(b.column(2)):
                found = shingles(t.as_py(), shingle, seed)
                fps[k], keys[k] = set_hash(found), band_keys(found, bands, width, seed)
            lists = pa.ListArray.from_arrays(np.arange(0, bands * b.num_rows + 1, bands, dtype=np.int32), _signed(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _signed(fps), lists], names=["_id", "_row", "_fp", "_keys"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "_id bigint, _row bigint, _fp bigint, _keys array<bigint>")


def _sets(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(_fp, _set): the sets of the texts ``_t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), shingle, seed) for t in b.column(0)]
            fps = np.fromiter(map(set_hash, found), U, len(found))
            yield pa.RecordBatch.from_arrays([_signed(fps), pa.array([f.tobytes() for f in found], pa.binary())], names=["_fp", "_set"])

    return texts.mapInArrow(run, "_fp bigint, _set binary")


def _spanned(members: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """(u, v): links among the members (keys, _fp, _root, _set) of each group, whose size is bounded."""

    def run(group: pa.Table) -> pa.Table:
        fps = group.column("_fp").to_pylist()
        sets = {k: np.frombuffer(s.as_py(), U) for k, s in zip(fps, group.column("_set"), strict=True)}
        found = spanning(sets, similarity, dict(zip(fps, group.column("_root").to_pylist(), strict=True)))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return members.groupBy(*keys).applyInArrow(run, "u bigint, v bigint")


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v) those that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [alike(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U), similarity) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one, two = (sets.select(F.col("_fp").alias(n), F.col("_set").alias(f"_{n}")) for n in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "_u", "_v").mapInArrow(run, "u bigint, v bigint")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(_key, _fp, _root) of the bands whose members do not all share a root."""
    known = roots.select(F.col("node").alias("_fp"), F.col("root").alias("_known"))
    marked = members.select("_key", "_fp").join(known, "_fp", "left").select("_key", "_fp", F.coalesce("_known", "_fp").alias("_root"))
    open_ = marked.groupBy("_key").agg(F.min("_root").alias("a"), F.max("_root").alias("b")).filter("a <> b").select("_key")
    return written(marked.join(open_, "_key"), "jaccard-open")


def _starred(members: DataFrame, sets: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(u, v): links of one member of each band with all others of another root;
    it is nearly always the same in all bands of a cluster."""
    centre = members.groupBy("_key").agg(F.min(F.struct(F.xxhash64("_fp", F.lit(turn)), "_fp", "_root")).alias("c"))
    pairs = members.join(centre.select("_key", F.col("c._fp").alias("v"), F.col("c._root").alias("r")), "_key").filter("_root <> r")
    return _compared(pairs.select(F.col("_fp").alias("u"), "v").distinct(), sets, similarity)


def _verified(members: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """(u, v): links that connect the members (_key, _fp) of each band as all pairs
    would; and their components, if these are known by then."""
    known = members.join(sizes, "_key").withColumn("_root", F.col("_fp"))
    small = known.filter(F.col("n") <= SMALL).join(sets, "_fp").select("_key", "_fp", "_root", "_set")
    found = written(_spanned(small, ["_key"], similarity).distinct(), "jaccard-links")
    large = written(known.filter(F.col("n") > SMALL).select("_key", "_fp", "_root"), "jaccard-large")
    if large.isEmpty():
        return found, None
    for turn in range(2):
        found = written(found.union(_starred(large, sets, similarity, turn)), "jaccard-links")
        roots = written(components(found), "jaccard-roots")
        large = _open(large, roots)
        if large.isEmpty():
            return found, roots
    parts = large.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / PART).alias("p"))
    own = F.pmod(F.xxhash64("_fp", F.lit(7)), F.col("p"))
    dealt = large.join(parts, "_key").withColumn("a", own).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("p") - 1)))
    dealt = dealt.select("_key", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "_fp", "_root").join(sets, "_fp")
    return written(found.union(_spanned(dealt, ["_key", "i", "j"], similarity)).distinct(), "jaccard-links"), None


def grouped(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8, seed: int = 42, bands: int = 40, width: int = 6
) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _row, _fp), and the label (_fp, _root, _comp) of every set."""
    ship(docs.sparkSession)
    made = written(_nodes(docs, id_col, text_col, shingle, bands, width, seed), "jaccard-rows")
    rows = made.select("_id", "_row", "_fp")
    nodes = written(made.groupBy("_fp").agg(F.min("_id").alias("_least"), F.any_value("_keys").alias("_keys")), "jaccard-nodes")
    banded = nodes.select("_fp", F.explode("_keys").alias("_key"))
    found = banded.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("_fp").alias("a"), F.max("_fp").alias("b"), F.bit_xor(F.xxhash64("_fp")).alias("x"), F.bit_xor(F.xxhash64("_fp", F.lit(1))).alias("y")
    )
    unlike = written(found.filter("n > 1").groupBy("n", "a", "b", "x", "y").agg(F.min("_key").alias("_key")).select("_key", "n"), "jaccard-bands")
    members = written(banded.join(unlike.select("_key"), "_key"), "jaccard-members")
    # one row holds the text of a set
    holders = rows.join(members.select("_fp").distinct(), "_fp", "left_semi").groupBy("_fp").agg(F.min("_row").alias("_r")).select("_r").distinct()
    texts = keyed(docs, id_col, text_col).join(holders, F.col("_row") == F.col("_r"), "left_semi").dropDuplicates(["_row"]).select("_t")
    sets = written(_sets(texts, shingle, seed), "jaccard-sets")
    found, roots = _verified(members, unlike, sets, similarity)
    return rows, labels(nodes.select("_fp", "_least"), found, roots)
