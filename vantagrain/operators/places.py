"""Cells of near rows, so that large tables meet by place and not part by part.

The cells of a block are the leaves of a k-d tree over a bounded sample of its
references; any row has exactly one cell, whatever the sample was, and the boxes
of the cells are those of all their rows.  So cuts and sample decide only how
much is met, never a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: References of a cell, most cells of a block, sampled rows of a cell and of all.
CELL_ROWS = 4096
MOST_CELLS = 1024
_SAMPLE = 64
_SAMPLED = 200_000


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


class Cells:
    """Trees over (block, category hashes, numbers): each leaf is a cell."""

    def __init__(self, block: np.ndarray, nums: np.ndarray, cats: np.ndarray, scale: np.ndarray, parts: dict[int, int]):
        self.n = 0
        self.trees: dict[int, tuple[dict[tuple, object] | None, object]] = {}
        for b, cells in parts.items():
            rows = np.flatnonzero(block == b)
            most = max(1, -(-len(rows) // cells))
            levels, at = np.unique(cats[rows], axis=0, return_inverse=True) if cats.shape[1] and len(rows) else (np.zeros((1, 0)), np.zeros(len(rows), int))
            rest = self._leaf()
            if len(levels) <= cells:
                kinds = {tuple(v.tolist()): self._cut(nums[rows[at.ravel() == k]], scale, most) for k, v in enumerate(levels)}
                self.trees[b] = kinds, rest
            else:  # too many combinations: they part nothing
                self.trees[b] = None, self._cut(nums[rows], scale, most)

    def _leaf(self) -> int:
        self.n += 1
        return self.n - 1

    def _cut(self, nums: np.ndarray, scale: np.ndarray, most: int):
        if len(nums) > most:
            spread = (nums.max(axis=0) - nums.min(axis=0)) * scale
            c = int(spread.argmax())
            if spread[c] > 0:
                values = np.sort(nums[:, c])
                cut = values[len(values) // 2]
                cut = cut if cut > values[0] else values[np.searchsorted(values, cut, "right")]
                low = nums[:, c] < cut
                return c, float(cut), self._cut(nums[low], scale, most), self._cut(nums[~low], scale, most)
        return self._leaf()

    def locate(self, block: np.ndarray, nums: np.ndarray, cats: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block), np.int64)

        def walk(tree, rows: np.ndarray) -> None:
            while not isinstance(tree, int) and len(rows):
                c, cut, left, right = tree
                low = nums[rows, c] < cut
                walk(left, rows[low])
                tree, rows = right, rows[~low]
            out[rows] = tree if isinstance(tree, int) else 0

        for b in np.unique(block):
            rows = np.flatnonzero(block == b)
            kinds, rest = self.trees[int(b)]
            if kinds is None:
                walk(rest, rows)
                continue
            levels, at = np.unique(cats[rows], axis=0, return_inverse=True) if cats.shape[1] else (np.zeros((1, 0)), np.zeros(len(rows), int))
            for k, v in enumerate(levels):
                walk(kinds.get(tuple(v.tolist()), rest), rows[at.ravel() == k])
        return out


def located(df: DataFrame, cells: Cells) -> DataFrame:
    """``df`` (block, nums, cats, ..) with the number of each row's cell."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                cell = cells.locate(t["block"].to_numpy(zero_copy_only=False), matrix(t["nums"]), matrix(t["cats"]))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell)], [*t.schema.names, "cell"])

    return df.mapInArrow(run, StructType([*df.schema, StructField("cell", LongType())]))


class Boxes:
    """The boxes of one block's cells: bounds of the numbers, and the category
    hashes where all rows agree."""

    def __init__(self, found: list, n_nums: int, n_cats: int):
        of = lambda name, n, kind: np.array([[r[f"{name}{k}"] for k in range(n)] for r in found], kind).reshape(len(found), n)
        self.cell = np.array([r["cell"] for r in found], np.int64)
        self.n = np.array([r["n"] for r in found], np.int64)
        self.low, self.high = of("low", n_nums, float), of("high", n_nums, float)
        self.cats = of("first", n_cats, np.int64)
        self.one = self.cats == of("last", n_cats, np.int64)

    def gaps(self, nums: np.ndarray, cats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least differences of numbers and categories of each row to each box."""
        v = nums[:, None, :]
        return np.maximum(0.0, np.maximum(self.low - v, v - self.high)), (cats[:, None, :] != self.cats) & self.one

    def spans(self, nums: np.ndarray, cats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest differences."""
        v = nums[:, None, :]
        return np.maximum(self.high - v, v - self.low), (cats[:, None, :] != self.cats) | ~self.one


def placed(refs: DataFrame, sizes: dict[int, int], scale: np.ndarray, n_cats: int) -> tuple[Cells, DataFrame, dict[int, Boxes]]:
    """Cells for these references (block, nums, cats) of blocks of these sizes, the
    references with their cells, and each block's boxes."""
    parts = {b: min(MOST_CELLS, max(1, -(-n // CELL_ROWS))) for b, n in sizes.items()}
    rows = max(8, min(_SAMPLE, _SAMPLED // sum(parts.values())))
    share = min(1.0, rows * sum(parts.values()) / sum(sizes.values()))
    some = refs.select("block", "nums", "cats").sample(share, seed=1).toArrow()  # rows * cells at most, nearly
    nums, cats = matrix(some["nums"]), matrix(some["cats"])
    nums = nums if nums.shape[1] else np.zeros((some.num_rows, len(scale)))
    cells = Cells(some["block"].to_numpy(), nums, cats, scale, parts)
    refs = located(refs, cells)
    n_nums = len(scale)
    ends = [f(F.get(c, F.lit(k))).alias(f"{name}{k}") for c, n, pair in (("nums", n_nums, ((F.min, "low"), (F.max, "high"))), ("cats", n_cats, ((F.min, "first"), (F.max, "last")))) for f, name in pair for k in range(n)]
    found: dict[int, list] = {b: [] for b in sizes}
    for r in refs.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect():  # a row for each cell
        found[r["block"]].append(r)
    return cells, refs, {b: Boxes(f, n_nums, n_cats) for b, f in found.items()}
