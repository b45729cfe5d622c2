"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

A document holds a copy of a test item if words of it align with the item to a
score of at least ``min_score`` of the item's with itself.  Seeds are word pairs
that an item has at a distance of one or two words, and no copy can do without
them: an alignment of M matched words and E edits scores 2M - E >= 2 * min_score
* n for an item of n words; where two consecutive matches are more than one word
apart on either side, that costs two edits or more; hence at least
``min_score * n - 1`` consecutive matches are such pairs on both sides.  So at
least that many positions of the item begin a pair that the document has too,
and of any ``s`` positions all but the missing rest do.

1. Scan.  The pairs of every document that the items may hold (a Bloom filter of
   fixed size) are written with their positions.
2. Seeds.  Pairs are counted over all documents; an item's seeds are the rarest
   ``seed_share`` of its positions, by rank and not by a limit.  Items too short
   for pairs are found by their single words.
3. Join.  Hits meet items on seeds; a stretch of a document with fewer different
   positions than an alignment must have there is no candidate.
4. Align.  Local alignment scores each candidate; insertions, deletions and
   replaced words cost a little, so edited and paraphrased copies score too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest

from .runtime import bare, named, place, row_keys, ship, written
from .words import BASES, U, mix, word_hashes

_WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words in a cell of the grid by which passages travel to their alignments.
CELL = 256


def tokens(text: str | None) -> list[str]:
    """Lower-case words without punctuation."""
    return _WORD.findall((text or "").lower())


def seeds_at(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs one and two words apart that begin at each word (the
    last one or two words have none)."""
    turned = hashes * U(BASES[0])
    return mix(turned[:-1] + hashes[1:]), mix(turned[:-2] + hashes[2:])


class Bloom:
    """Two bits for each hash in a bitmap of fixed size."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = U(64 - (len(bits) * 8 - 1).bit_length())
        self._table: np.ndarray | None = None

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).view(np.int64)

    def _second(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * U(0xC2B2AE3D27D4EB4F)) >> self.shift).view(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for p in (self._first(hashes), self._second(hashes)):
            np.bitwise_or.at(self.bits, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Where the hashes are that may have been added."""
        if self._table is None:  # a byte for a bit, to look up
            self._table = np.unpackbits(self.bits, bitorder="little").view(bool)
        at = np.flatnonzero(self._table[self._first(hashes)])
        return at[self._table[self._second(hashes[at])]]


def _next_row(up: np.ndarray, word: int, passage: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The table's row of an item's word; linear gap cost makes it a running maximum."""
    best = np.zeros(len(up), np.int64)
    best[1:] = np.maximum(up[:-1] + np.where(passage == word, MATCH, MISMATCH), up[1:] + GAP)
    np.maximum(best, 0, out=best)
    return np.maximum.accumulate(best + steps) - steps


def align(item: list, passage: list) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: (score, matched words, start, end) in the passage.

    Of the best alignments the one that ends first in the passage, then in the
    item, counts; on the way back a pair goes before a skipped word of the item
    and that before one of the passage.  Memory is linear in the passage, and the
    way back keeps one row in about the square root of the item's length.
    """
    m, n = len(item), len(passage)
    if not m or not n:
        return 0, 0, 0, 0
    code: dict = {}
    a = np.array([code.setdefault(w, len(code)) for w in item])
    b = np.array([code.setdefault(w, len(code)) for w in passage])
    steps = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    top, where = row.copy(), row.copy()
    for i in range(1, m + 1):
        row = _next_row(row, a[i - 1], b, steps)
        better = row > top
        top[better], where[better] = row[better], i
    score = int(top.max())
    if not score:
        return 0, 0, 0, 0
    end = int(np.flatnonzero(top == score)[0])
    # an alignment with a positive score spans fewer than 3m words, and so does any that it ties with
    base = max(0, end - 6 * m)
    b, steps = b[base:end], steps[: end - base + 1]
    i, j, matched = int(where[end]), end - base, 0
    every = math.isqrt(i) + 1
    kept, row = [np.zeros(len(b) + 1, np.int64)], np.zeros(len(b) + 1, np.int64)
    for k in range(1, i):
        row = _next_row(row, a[k - 1], b, steps)
        if k % every == 0:
            kept.append(row)
    while True:
        first = (i - 1) // every
        table = [kept[first]]
        for k in range(first * every, i):
            table.append(_next_row(table[-1], a[k], b, steps))
        low = first * every
        while i > low and table[i - low][j] > 0:
            here, above = table[i - low], table[i - low - 1]
            same = a[i - 1] == b[j - 1]
            if here[j] == above[j - 1] + (MATCH if same else MISMATCH):
                matched += int(same)
                i, j = i - 1, j - 1
            elif here[j] == above[j] + GAP:
                i -= 1
            else:
                j -= 1
        if i == 0 or table[i - low][j] == 0:
            return score, matched, base + j, base + end - base


def reach(n: int, min_score: float) -> int:
    """Words of a document that an alignment which counts can span."""
    return math.ceil((3 - 2 * min_score) * n + 1e-9)


def needed(n: int, min_score: float, min_matched: int) -> tuple[bool, int]:
    """Whether an item of n words has pairs as seeds (else single words), and
    how many of its positions a copy must have."""
    pairs = math.ceil(min_score * n - 1 - 1e-9)
    if n > 2 and pairs > 0:
        return True, pairs
    return False, max(math.ceil(min_score * n - 1e-9), min(min_matched, n), 1)


def _items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(_item, _t, _n, _words): the items with an id and a word; _t tells word sequences apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (w := tokens(t))]
            if rows:
                words = [" ".join(w) for _, w in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in rows], pa.int64()),
                        pa.array(np.array([xxh3_64_intdigest(w) for w in words], U).view(np.int64)),
                        pa.array([len(w) for _, w in rows], pa.int64()),
                        pa.array(words),
                    ],
                    names=["_item", "_t", "_n", "_words"],
                )

    known = bare(items).select(place(items, item_id).cast("bigint").alias("_item"), place(items, item_text).cast("string").alias("_text"))
    return known.filter("_item is not null").mapInArrow(run, "_item bigint, _t bigint, _n bigint, _words string").distinct()


def _item_grams(texts: DataFrame, min_score: float, min_matched: int, seed_share: float) -> DataFrame:
    """(_t, _at, _g, _reach, _seeds, _least): the grams that begin at each
    position of each item, how many of the positions are seeds, and how many of
    those a copy must have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split(" ")
                n = len(words)
                by_pairs, least = needed(n, min_score, min_matched)
                hashes = word_hashes(words)
                near, far = seeds_at(hashes)
                grams = np.concatenate((near, far)) if by_pairs else mix(hashes)
                at = np.concatenate((np.arange(len(near)), np.arange(len(far)))) if by_pairs else np.arange(n)
                most = n - 1 if by_pairs else n
                seeds = min(most, max(math.ceil(seed_share * most), most - least + 1))
                full = lambda v: pa.array(np.full(len(grams), v, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [full(t), pa.array(at), pa.array(grams.view(np.int64)), full(reach(n, min_score)), full(seeds), full(least - (most - seeds))],
                    names=["_t", "_at", "_g", "_reach", "_seeds", "_least"],
                )

    return texts.select("_t", "_words").mapInArrow(run, "_t bigint, _at bigint, _g bigint, _reach bigint, _seeds bigint, _least bigint")


def _bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of a column of hashes, made on the executors and OR-ed word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(np.zeros(bits // 8, np.uint8))
        for b in batches:
            bloom.add(b.column(0).to_numpy(zero_copy_only=False).view(U))
        words = bloom.bits.view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    parts = hashes.mapInArrow(run, "at bigint, bits bigint")
    found = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, "<i8")
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _k1, _k2, _text) of every row; rows of equal id and text share the keys."""
    i, text = place(docs, id_col).cast("bigint"), place(docs, text_col).cast("string")
    return bare(docs).select(i.alias("_id"), *row_keys(i, text), text.alias("_text"))


def _hits(rows: DataFrame, bits: np.ndarray, single: bool) -> DataFrame:
    """(_id, _k1, _k2, _pos, _grams): where a row has possible grams, as two lists."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(shared.value)
        for b in batches:
            at, where, what = [], [], []
            for k, text in enumerate(b.column(3)):
                words = tokens(text.as_py())
                if not words:
                    continue
                hashes = word_hashes(words)
                kinds = (mix(hashes), *seeds_at(hashes)) if single else seeds_at(hashes)
                found = [(bloom.find(g), g) for g in kinds]
                if any(len(p) for p, _ in found):
                    at.append(k)
                    where.append(np.concatenate([p for p, _ in found]))
                    what.append(np.concatenate([g[p] for p, g in found]))
            if at:
                ends = pa.array(np.cumsum([0, *map(len, where)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).take(pa.array(at)) for c in range(3)),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(where), pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(what).view(np.int64))),
                    ],
                    names=["_id", "_k1", "_k2", "_pos", "_grams"],
                )

    return rows.mapInArrow(run, "_id bigint, _k1 bigint, _k2 bigint, _pos array<int>, _grams array<bigint>")


def _likely(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose first key a bitmap of keys holds; it proposes and a join decides."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(shared.value)
        for b in batches:
            yield b.take(pa.array(bloom.find(b.column(1).to_numpy().view(U))))

    return rows.mapInArrow(run, rows.schema)


def _cells(rows: DataFrame) -> DataFrame:
    """(_k1, _k2, _cell, _part): the wanted cells of rows (_k1, _k2, _wanted, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (wanted, text) in enumerate(zip(b.column(2).to_pylist(), b.column(3), strict=True)):
                words = tokens(text.as_py())
                some = [c for c in sorted(wanted) if c * CELL < len(words)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([b.column(c)[k].as_py()] * len(some), pa.int64()) for c in (0, 1)),
                        pa.array(some, pa.int64()),
                        pa.array([" ".join(words[c * CELL : (c + 1) * CELL]) for c in some], pa.string()),
                    ],
                    names=["_k1", "_k2", "_cell", "_part"],
                )

    return rows.select("_k1", "_k2", "_wanted", "_text").mapInArrow(run, "_k1 bigint, _k2 bigint, _cell bigint, _part string")


def _aligned(pairs: DataFrame) -> DataFrame:
    """(_k1, _k2, _t, _n, _score, _matched, _start, _end) of candidates
    (_k1, _k2, _t, _parts, _words); positions are those in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for parts, words in zip(b.column(3), b.column(4), strict=True):
                cells = parts.as_py()
                item = words.as_py().split(" ")
                passage = [w for c in cells for w in c["_part"].split(" ")]
                score, matched, start, end = align(item, passage)
                base = cells[0]["_cell"] * CELL
                rows.append((len(item), score, matched, base + start, base + end))
            found = np.array(rows, np.int64).reshape(-1, 5)
            arrays = [*b.columns[:3], *(pa.array(found[:, k].copy()) for k in range(5))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_k1", "_k2", "_t", "_n", "_score", "_matched", "_start", "_end"])

    kinds = ", ".join(f"{c} bigint" for c in ("_k1", "_k2", "_t", "_n", "_score", "_matched", "_start", "_end"))
    return pairs.select("_k1", "_k2", "_t", "_parts", "_words").mapInArrow(run, kinds)


def _matches(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, *,
    seed_share: float, min_score: float, min_matched: int, bloom_bits: int,
) -> DataFrame:
    """(_id, _k1, _k2, _item, _part, ...): aligned passages that count as copies."""
    if not 0 < min_score <= 1:
        raise ValueError("min_score must be above 0 and at most 1")
    ship(docs.sparkSession)
    known = written(_items(items, item_id, item_text), "decontam-items")
    texts = known.select("_t", "_words").distinct()
    grams = written(_item_grams(texts, min_score, min_matched, seed_share), "decontam-grams")
    shortest = known.agg(F.min("_n")).first()[0] or 1
    single = not needed(shortest, min_score, min_matched)[0]  # if any item has single words as seeds, the shortest has
    rows = _keyed(docs, id_col, text_col)
    hits = written(_hits(rows, _bloom(grams.select("_g"), bloom_bits), single), "decontam-hits")

    seen = hits.select(F.explode("_grams").alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_count"))
    counted = grams.join(seen, "_g", "left")
    positions = counted.groupBy("_t", "_at", "_seeds").agg(F.sum(F.coalesce("_count", F.lit(0))).alias("_count"))
    item = Window.partitionBy("_t").orderBy("_count", "_at")  # the positions of one item
    rare = positions.withColumn("_rank", F.row_number().over(item)).filter("_rank <= _seeds and _count > 0").select("_t", "_at")
    seeds = written(grams.join(rare, ["_t", "_at"]).select("_g", "_t", "_at", "_reach", "_least").distinct(), "decontam-seeds")

    each = hits.select("_k1", "_k2", F.explode(F.arrays_zip("_pos", "_grams")).alias("_x")).select("_k1", "_k2", F.col("_x._pos").alias("_pos"), F.col("_x._grams").alias("_g"))
    # any stretch as long as an alignment lies in one of the overlapping blocks of twice that length
    block = F.floor(F.col("_pos") / F.col("_reach"))
    met = each.join(seeds, "_g").select("_k1", "_k2", "_t", "_at", "_reach", "_least", F.explode(F.array(block - 1, block)).alias("_block"))
    places = met.distinct().groupBy("_k1", "_k2", "_t", "_reach", "_least", "_block").agg(F.count(F.lit(1)).alias("_have"))
    able = places.filter("_have >= _least")
    first = F.greatest(F.lit(0), F.floor((F.col("_block") - 1) * F.col("_reach") / CELL))
    cells = F.sequence(first, F.floor(((F.col("_block") + 3) * F.col("_reach") - 1) / CELL))
    able = written(able.select("_k1", "_k2", "_t", "_block", F.explode(cells).alias("_cell")), "decontam-candidates")

    wanted = able.groupBy("_k1", "_k2").agg(F.collect_set("_cell").alias("_wanted"))  # no more than the row's own cells
    likely = _likely(rows, _bloom(able.select("_k1").distinct(), bloom_bits))  # so that few texts are shuffled
    parts = written(_cells(likely.join(wanted, ["_k1", "_k2"])).distinct(), "decontam-passages")
    passages = able.join(parts, ["_k1", "_k2", "_cell"]).groupBy("_k1", "_k2", "_t", "_block").agg(
        F.sort_array(F.collect_list(F.struct("_cell", "_part"))).alias("_parts")  # as many as an item's reach asks for
    )
    share = F.col("_score") / (MATCH * F.col("_n"))
    good = _aligned(passages.join(texts, "_t")).withColumn("_part", share).filter(
        (F.col("_part") >= min_score - 1e-9) & (F.col("_matched") >= F.least(F.lit(min_matched), F.col("_n")))
    )
    ids = hits.select("_id", "_k1", "_k2").distinct()
    good = written(good, "decontam-found")
    return good.join(ids, ["_k1", "_k2"]).join(known.select("_item", "_t"), "_t")


def find_copies(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    *,
    seed_share: float = 0.75,
    min_score: float = 0.5,
    min_matched: int = 5,
    bloom_bits: int = 1 << 23,
) -> DataFrame:
    """(row, item) pairs in which the row holds a copy of the test item.

    Returns the row id, ``item_id``, ``score`` (alignment score as a share of
    the item's with itself), ``matched`` (words), ``item_words``, ``doc_from``
    and ``doc_to`` (the aligned words of the lower-cased text without
    punctuation, from 0, end excluded): one row for each pair, its best passage,
    of equally good ones that which ends first.  A pair counts from
    ``min_score`` on and with ``min_matched`` words, or all words of a shorter
    item; every such pair is found, whatever ``seed_share``, which only sets how
    many hits are joined against how many candidates are aligned.

    Null and empty texts on either side and items without an id match nothing;
    rows that share an id, and items that share one, give one row for each
    (id, item id); empty tables give an empty result; other columns, of whatever
    name, take no part.
    """
    found = _matches(
        docs, items, id_col, text_col, item_id, item_text, seed_share=seed_share, min_score=min_score, min_matched=min_matched, bloom_bits=bloom_bits,
    )
    best = F.struct("_part", (-F.col("_end")).alias("_to"), "_matched", "_n", "_start")
    out = found.groupBy("_id", "_item").agg(F.max(best).alias("_b")).select(
        "_id", "_item", F.round("_b._part", 6), "_b._matched", "_b._n", "_b._start", -F.col("_b._to")
    )
    return named(out, [id_col, item_id if item_id != id_col else "item_id", "score", "matched", "item_words", "doc_from", "doc_to"])


def drop_copies(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    *,
    seed_share: float = 0.75,
    min_score: float = 0.5,
    min_matched: int = 5,
    bloom_bits: int = 1 << 23,
) -> DataFrame:
    """``docs`` without the rows that hold a copy of a test item; see find_copies."""
    found = _matches(
        docs, items, id_col, text_col, item_id, item_text, seed_share=seed_share, min_score=min_score, min_matched=min_matched, bloom_bits=bloom_bits,
    )
    gone = written(found.select("_k1", "_k2").distinct(), "decontam-rows")
    i, text = place(docs, id_col).cast("bigint"), place(docs, text_col).cast("string")
    marked = bare(docs).select("*", *row_keys(i, text))
    return named(marked.join(gone, ["_k1", "_k2"], "left_anti").drop("_k1", "_k2"), docs.columns)
