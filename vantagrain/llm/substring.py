"""Removal of repeated word windows (exact substring deduplication).

A window is ``width`` consecutive words of one row.  A word goes if some window
that covers it has a word sequence that also starts earlier: in a row before
this one, or earlier in the same row.  Rows are ordered by id, those that share
an id by a hash of id and text; rows of equal id and text are one row here and
get one result.

Windows are compared between rows by 128-bit Rabin-Karp hashes counted in Spark
(inside a row by 64 bits).  Not all of them travel.  Every window has an anchor,
the least hash among the ``gram``-word sequences inside it; equal windows have
equal anchors, and neighbouring windows share theirs, so a text has far fewer
anchors than windows.  Only windows whose anchor occurs twice anywhere can
repeat, and only those are shuffled, the first of equal ones taken map-side, so a
passage in a third of all rows costs one row per task.  Rows whose whole word
sequence equals that of an earlier row are settled by one digest and send no
windows.  What is found goes back by id and a hash of the text: a list is never
longer than the text it is about, however many rows share an id or have none.
Where ids alone do not order the rows, they are numbered by a sort across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh3_128_digest

from .runtime import bare, named, place, ship, written
from .words import BASES, U, covered, sliding_min, windows, word_hashes

_LAST = (1 << 63) - 1
_BATCH = 512


def _sequence(words: list[bytes]) -> np.ndarray:
    """128-bit digest of a word sequence as two signed numbers."""
    return np.frombuffer(xxh3_128_digest(b" ".join(words)), "<i8")


def _anchor_of_windows(hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    grams = windows(hashes, gram)
    return grams, sliding_min(grams, width - gram + 1)


def _anchors(hashes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Anchors of a row, each once; twice if its words recur in the row."""
    grams, least = _anchor_of_windows(hashes, width, gram)
    own = np.unique(least)
    values, counts = np.unique(grams, return_counts=True)
    return np.concatenate((own, np.intersect1d(own, values[counts > 1], assume_unique=True)))


def _candidates(hashes: np.ndarray, width: int, gram: int, repeated: np.ndarray) -> np.ndarray:
    """Starts of the windows whose anchor is among the (sorted) repeated ones."""
    _, least = _anchor_of_windows(hashes, width, gram)
    at = np.minimum(np.searchsorted(repeated, least), len(repeated) - 1)
    return np.flatnonzero(repeated[at] == least)


def _first_starts(hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether it is the first of its value."""
    first = np.zeros(len(hashes), bool)
    first[np.unique(hashes, return_index=True)[1]] = True
    return first


def _sorted(values: pa.Scalar) -> np.ndarray:
    """A null or a list of signed numbers as sorted unsigned ones."""
    if not values.is_valid or not len(values.values):
        return np.zeros(0, U)
    return np.sort(values.values.to_numpy(zero_copy_only=False).view(U))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """(_id, _k): what orders the rows of ``bare(docs)``; null ids come last."""
    i = F.coalesce(place(docs, id_col).cast("bigint"), F.lit(_LAST))
    return [i.alias("_id"), F.xxhash64(place(docs, text_col).cast("binary"), i).alias("_k")]


def _ordered(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``_o``, a number in the order of (_id, _k): the id itself
    if no two texts share one."""
    shared = scanned.groupBy("_id").agg(F.min("_k").alias("a"), F.max("_k").alias("b")).filter("a < b")
    if shared.isEmpty():
        return scanned.withColumn("_o", F.col("_id"))
    units = scanned.select("_id", "_k").distinct().repartitionByRange("_id", "_k").sortWithinPartitions("_id", "_k")
    units = written(units.withColumn("_o", F.monotonically_increasing_id()), "substring-order")
    return written(scanned.join(units, ["_id", "_k"]), "substring-ordered")


def _scan(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """(_id, _k, _s1, _s2, _anchors) of the rows that have a window at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, _BATCH) for whole in batches for at in range(0, whole.num_rows, _BATCH)):
            at, seqs, lists = [], [], []
            for k, text in enumerate(b.column(2)):
                words = (text.as_py() or b"").split()
                if len(words) < width:
                    continue
                at.append(k)
                seqs.append(_sequence(words))
                lists.append(_anchors(word_hashes(words), width, gram).view(np.int64))
            if at:
                seq = np.stack(seqs)
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                anchors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                keys = [b.column(c).take(pa.array(at)) for c in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(seq[:, 0].copy()), pa.array(seq[:, 1].copy()), anchors], names=["_id", "_k", "_s1", "_s2", "_anchors"]
                )

    return rows.mapInArrow(run, "_id bigint, _k bigint, _s1 bigint, _s2 bigint, _anchors array<bigint>")


def _windows_of(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(_h1, _h2, _o): the candidate windows of rows (_o, _t, _anchors), each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, _BATCH) for whole in batches for at in range(0, whole.num_rows, _BATCH)):
            ones, twos, owners = [], [], []
            for o, text, repeated in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                words = (text.as_py() or b"").split()
                if len(words) < width:
                    continue
                hashes = word_hashes(words)
                at = _candidates(hashes, width, gram, _sorted(repeated))
                one = windows(hashes, width, BASES[0])[at]
                first = _first_starts(one)
                ones.append(one[first])
                twos.append(windows(hashes, width, BASES[1])[at][first])
                owners.append(np.full(len(ones[-1]), o))
            if ones:
                arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (ones, twos, owners)]
                yield pa.RecordBatch.from_arrays(arrays, names=["_h1", "_h2", "_o"])

    return texts.mapInArrow(run, "_h1 bigint, _h2 bigint, _o bigint")


def _cut(rows: DataFrame, text_at: int, width: int, gram: int) -> DataFrame:
    """Apply the findings in the last three columns to the text at ``text_at``."""
    fields = rows.schema.fields[:-3]
    out = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, _BATCH) for whole in batches for at in range(0, whole.num_rows, _BATCH)):
            copied, anchors, firsts = b.columns[-3:]
            kept, n_words, n_removed = [], [], []
            for text, again, own, first in zip(b.column(text_at), copied, anchors, firsts, strict=True):
                words = text.as_py().encode().split() if text.is_valid else []
                n = len(words)
                gone = np.zeros(n, bool)
                own = _sorted(own) if n >= width else own
                if again.as_py():
                    gone[:] = True
                elif n >= width and len(own):
                    hashes = word_hashes(words)
                    at = _candidates(hashes, width, gram, own)
                    one = windows(hashes, width, BASES[0])[at]
                    stay = np.isin(one, _sorted(first)) & _first_starts(one)
                    gone = covered(at[~stay], width, n)
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                if not gone.any():
                    kept.append(text.as_py())
                else:
                    kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            arrays = list(b.columns[:-3])
            arrays[text_at] = pa.array(kept, arrays[text_at].type)
            arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*out, "_n_words", "_n_removed"])

    return rows.mapInArrow(run, StructType([*fields, StructField("_n_words", LongType()), StructField("_n_removed", LongType())]))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 20,
    gram: int = 5,
) -> DataFrame:
    """``docs`` without repeated windows, and ``_n_words`` and ``_n_removed``.

    Every input row comes back, with all its columns; a text from which words
    went is its kept words joined by one space, any other text is unchanged.
    Windows are judged on the input.  Null and empty texts and texts of fewer
    than ``width`` words keep all.  Rows with a null id come after all others;
    rows that share an id (or have none) are ordered by a hash of id and text,
    and rows of equal id and text get equal results, never each other's repeat.
    An empty table gives an empty result.  The text must be a string column;
    input columns of the two added names are replaced, all other names are free.
    """
    ship(docs.sparkSession)
    docs = docs.drop("_n_words", "_n_removed")
    text_at = docs.columns.index(text_col)
    keys = ["_id", "_k"]
    keyed = bare(docs).select("*", *_keyed(docs, id_col, text_col))
    texts = keyed.select(*keys, F.col(f"c{text_at}").cast("binary").alias("_t"))
    scanned = _ordered(written(_scan(texts, width, gram), "substring-anchors"))
    least = scanned.groupBy("_s1", "_s2").agg(F.min("_o").alias("_first"), F.max("_o").alias("_last"))
    least = written(least.filter("_first < _last").drop("_last"), "substring-copied")
    marked = scanned.join(least, ["_s1", "_s2"], "left").withColumn("_copied", F.coalesce(F.col("_o") > F.col("_first"), F.lit(False)))
    copied = written(marked.filter("_copied").select(*keys).distinct(), "substring-copies")
    anchors = marked.filter("not _copied").select("_o", *keys, F.explode("_anchors").alias("_a"))
    twice = anchors.groupBy("_a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_a")
    shared = anchors.join(twice, "_a").groupBy("_o", *keys).agg(F.collect_set("_a").alias("_anchors"))
    shared = written(shared, "substring-shared")
    found = _windows_of(texts.join(shared, keys).select("_o", "_t", "_anchors"), width, gram)
    firsts = found.groupBy("_h1", "_h2").agg(F.min("_o").alias("_o"))
    firsts = written(firsts.groupBy("_o").agg(F.collect_set("_h1").alias("_firsts")), "substring-firsts")
    known = shared.join(firsts, "_o", "left").select(*keys, F.lit(False).alias("_copied"), "_anchors", "_firsts")
    none = F.lit(None).cast("array<bigint>")
    known = known.union(copied.select(*keys, F.lit(True), none, none))
    judged = keyed.join(known, keys, "left").drop(*keys)
    return named(_cut(judged, text_at, width, gram), [*docs.columns, "_n_words", "_n_removed"])
