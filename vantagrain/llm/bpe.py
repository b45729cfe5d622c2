"""Byte-level BPE encoding by speculation and verification, and decoding.

Speculate: a word is cut greedily into the longest vocabulary entries.  Verify:
the cut is the BPE result exactly if every token encodes to itself and every
two neighbours, merged on their own, stay those two tokens.  Verdicts on pairs
are looked up for a whole batch of new words at once in sorted arrays; only
pairs never seen are merged to find out.  Words that fail are merged exactly.

Texts are cut into words by the byte-level pattern.  A space with no white space
beside it always begins a word, so most texts are cut at spaces and line ends
with string methods, and each distinct piece is analysed once per task.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .runtime import bare, named, place, ship

#: The pre-tokenisation pattern of byte-level BPE.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space other than space and line feed, and the mark used in cutting.
_UNUSUAL = re.compile(r"[^\S \n]|\x00")
_MAX_CACHE = 1 << 19
_MAX_PAIRS = 1 << 20
_NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for the vocabulary file at ``path``.

    The file must hold byte-level BPE without normaliser, prefix space or
    post-processor; truncation and padding in it are not used.  Added tokens that
    match whole words only or strip blanks beside them are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("the file must hold byte-level BPE without prefix space")
        if spec["normalizer"] or spec["post_processor"] or spec["model"].get("ignore_merges"):
            raise ValueError("normalisers, post-processors and ignored merges are not supported")
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with single_word, lstrip or rstrip are not supported")
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        self.vocab = {raw[t]: i for t, i in spec["model"]["vocab"].items() if t in raw}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(chain(self.vocab.values(), self.special.values()))
        self.token = [b""] * size
        for t, i in self.vocab.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.longest = max(map(len, self.vocab))
        self.rank: dict[tuple[int, int], int] = {}  # of a pair of ids
        self.merged: list[int] = []  # by rank
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (raw[x] for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[self.vocab[a], self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        self.bytes_id = [self.vocab[bytes([b])] for b in range(256)]
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._self = np.full(size, -1, np.int8)  # -1 unknown, else whether a token encodes to itself
        self._pairs = np.zeros(0, np.int64)  # sorted pairs with a verdict
        self._fits = np.zeros(0, bool)
        self._clear()

    def _clear(self) -> None:
        self._piece: dict[str, int] = {}  # piece -> its row below
        self._start, self._length, self._flat = array("q"), array("q"), array("I")

    # exact merging

    def merge(self, word: bytes) -> list[int]:
        """BPE of one word by its definition: the lowest rank first, leftmost first."""
        ids = [self.bytes_id[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.rank.get
        ranks = [get(p, _NEVER) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < _NEVER:
            at = ranks.index(best)
            ids[at : at + 2] = (self.merged[best],)
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), _NEVER)
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n: a heap of merges over a linked list of tokens."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.rank.get
        heap = [(r, at) for at, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := get(p, _NEVER)) < _NEVER]
        heapify(heap)
        while heap:
            best, at = heappop(heap)
            to = after[at]
            if ids[at] < 0 or to < 0 or get((ids[at], ids[to])) != best:
                continue  # one of the two has been merged meanwhile
            ids[at], ids[to] = self.merged[best], -1
            after[at] = after[to]
            if after[to] >= 0:
                before[after[to]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0 and (r := get((ids[left], ids[after[left]]), _NEVER)) < _NEVER:
                    heappush(heap, (r, left))
        return [i for i in ids if i >= 0]

    # speculation and verification

    def _greedy(self, word: bytes) -> list[int]:
        out, at, n, vocab, most = [], 0, len(word), self.vocab, self.longest
        while at < n:
            end = min(n, at + most)
            while (i := vocab.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def _own(self, ids: np.ndarray) -> np.ndarray:
        """Whether each token encodes to itself."""
        for i in np.unique(ids[self._self[ids] < 0]).tolist():
            self._self[i] = self.merge(self.token[i]) == [i]
        return self._self[ids] == 1

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether left and right stay themselves when encoded together."""
        keys = left.astype(np.int64) << 32 | right
        new = np.setdiff1d(keys, self._pairs)
        if len(new):
            if len(self._pairs) + len(new) > _MAX_PAIRS:  # bounded whatever the texts
                self._pairs, self._fits = np.zeros(0, np.int64), np.zeros(0, bool)
                new = np.unique(keys)
            fits = [self.merge(self.token[k >> 32] + self.token[k & 0xFFFFFFFF]) == [k >> 32, k & 0xFFFFFFFF] for k in new.tolist()]
            at = np.searchsorted(self._pairs, new)
            self._pairs, self._fits = np.insert(self._pairs, at, new), np.insert(self._fits, at, fits)
        return self._fits[np.searchsorted(self._pairs, keys)]

    def words(self, words: list[bytes]) -> list[list[int]]:
        """BPE of each word."""
        if not words:
            return []
        out = [self._greedy(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        bad = np.zeros(len(out), bool)
        bad[owner[~self._own(flat)]] = True
        inner = owner[1:] == owner[:-1]
        fits = self._compatible(flat[:-1][inner], flat[1:][inner])
        bad[owner[1:][inner][~fits]] = True
        for k in np.flatnonzero(bad).tolist():
            out[k] = self.merge(words[k])
        return out

    # texts

    def _cut(self, text: str) -> list[str]:
        """Pieces that begin where words begin; joined they are the text."""
        if (
            "  " in text or "\n\n" in text or " \n" in text or "\n " in text
            or text[0].isspace() or text[-1].isspace() or _UNUSUAL.search(text)
        ):
            return PATTERN.findall(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _learn(self, pieces: set[str]) -> None:
        if len(self._piece) > _MAX_CACHE:
            self._clear()
        new = pieces.difference(self._piece)
        cut = {p: PATTERN.findall(p) for p in new}
        words = list(set(chain.from_iterable(cut.values())).difference(self._piece))
        for word, ids in zip(words, self.words([w.encode() for w in words]), strict=True):
            self._add(word, ids)
        for piece, parts in cut.items():
            if len(parts) != 1:
                rows = [self._piece[p] for p in parts]
                self._add(piece, [i for r in rows for i in self._flat[self._start[r] : self._start[r] + self._length[r]]])

    def _add(self, piece: str, ids: list[int]) -> None:
        self._piece[piece] = len(self._start)
        self._start.append(len(self._flat))
        self._length.append(len(ids))
        self._flat.extend(ids)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text, as unsigned 32-bit numbers."""
        cuts: list[list[str]] = []  # runs of ordinary text, of all texts
        plans: list[list[int | str]] = []  # of each text: a run's number or a special token
        for text in texts:
            plan: list[int | str] = []
            special = self.cut_special and text and self.cut_special.search(text)
            for part in self.cut_special.split(text) if special else (text,):
                if part and special and part in self.special:
                    plan.append(part)
                elif part:
                    plan.append(len(cuts))
                    cuts.append(self._cut(part))
            plans.append(plan)
        self._learn(set().union(*cuts))
        start, length, flat = (np.frombuffer(x, d) for x, d in ((self._start, "<i8"), (self._length, "<i8"), (self._flat, "<u4")))
        counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
        rows = np.fromiter(map(self._piece.__getitem__, chain.from_iterable(cuts)), np.int64, int(counts.sum()))
        sizes = length[rows]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(start[rows] - ends[:-1], sizes)
        at += np.arange(len(at))
        every = flat[at]
        edge = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        del start, length, flat  # views lock the arrays they show
        out = []
        for plan in plans:
            runs = [np.array([self.special[p]], "<u4") if isinstance(p, str) else every[edge[p] : edge[p + 1]] for p in plan]
            out.append(runs[0] if len(runs) == 1 else np.concatenate(runs) if runs else np.zeros(0, "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids, special tokens included."""
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(1)
def codec_of(path: str) -> Codec:
    """One codec for a worker process, so that its tasks share what it has learnt."""
    return Codec(path)


def encode(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    *,
    batch: int = 256,
    digests: bool = False,
) -> DataFrame:
    """``docs`` with the tokens of every whole text.

    Adds ``input_ids`` (array<int>) and ``decoded``; with ``digests`` instead
    ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit
    numbers) and ``decoded_sha256`` (of the decoded text in UTF-8), which bounds
    a row whatever its text.  Null texts count as empty: no ids.  Rows, repeated
    ones too, come back one for one; input columns of the added names are
    replaced, other names are free; an empty table gives an empty result.
    Executors must see ``path``.
    """
    from pyspark.sql.types import LongType

    ship(docs.sparkSession)
    if digests:
        extra = [("n_tokens", LongType(), pa.int64()), ("ids_sha256", StringType(), pa.string()), ("decoded_sha256", StringType(), pa.string())]
    else:
        extra = [("input_ids", ArrayType(IntegerType()), pa.list_(pa.int32())), ("decoded", StringType(), pa.string())]
    added = [e[0] for e in extra]
    kept = [k for k, c in enumerate(docs.columns) if c not in added]
    rows = bare(docs).select(*[f"c{k}" for k in kept], place(docs, text_col).cast("string").alias("_text"))
    carried = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                found: list[list] = [[] for _ in extra]
                for ids in codec.encode_batch(b.column(b.num_columns - 1).to_pylist()):
                    text = codec.decode(ids)
                    if digests:
                        row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    else:
                        row = (ids.view("<i4"), text)
                    for k, v in enumerate(row):
                        found[k].append(v)
                arrays = [pa.array(f, e[2]) for f, e in zip(found, extra, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*carried, *added])

    schema = StructType([*rows.schema.fields[:-1], *[StructField(e[0], e[1]) for e in extra]])
    return named(rows.mapInArrow(run, schema), [*[docs.columns[k] for k in kept], *added])


def decode(rows: DataFrame, path: str, ids_col: str = "input_ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_col``; a null array gives an empty text."""
    ship(rows.sparkSession)
    kept = [k for k, c in enumerate(rows.columns) if c != out_col]
    given = bare(rows).select(*[f"c{k}" for k in kept], place(rows, ids_col).alias("_ids"))
    carried = given.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in batches:
            texts = [codec.decode(np.array(x or [], np.int64)) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*carried, out_col])

    schema = StructType([*given.schema.fields[:-1], StructField(out_col, StringType())])
    return named(given.mapInArrow(run, schema), [*[rows.columns[k] for k in kept], out_col])
