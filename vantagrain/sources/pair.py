"""An original table, a released one, and the roles of their columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType


def read_table(spark: SparkSession, where: str, form: str | None = None, **options) -> DataFrame:
    """A table from a path (Parquet, ORC, CSV with header, JSON, by ``form`` or
    the path's ending) or, without a slash or ending, from the catalog."""
    if form is None:
        form = next((k for k in ("parquet", "orc", "csv", "json") if where.rstrip("/").endswith("." + k)), None)
        if form is None and "/" not in where:
            return spark.read.options(**options).table(where)
        form = form or "parquet"
    if form == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.format(form).options(**options).load(where)


@dataclass(frozen=True)
class ReleasePair:
    """Roles are checked on schemas only; no job runs until a measure does."""

    original: DataFrame
    released: DataFrame
    id_col: str
    keys: list[str] = field(default_factory=list)
    target: str | None = None
    cols: list[str] = field(default_factory=list)
    weight_original: str | None = None
    weight_released: str | None = None
    holdout: DataFrame | None = None

    def __post_init__(self) -> None:
        left, right = dict(self.original.dtypes), dict(self.released.dtypes)
        roles = {self.id_col, self.weight_original, self.weight_released}
        if not self.cols:
            common = [c for c in self.original.columns if c in right and c not in roles]
            object.__setattr__(self, "cols", common)
        if not self.cols:
            raise ValueError("No common variables")
        wanted = [*self.cols, *self.keys, *([self.target] if self.target else [])]
        for side, have in (("original", left), ("released", right)):
            missing = [c for c in wanted if c not in have]
            if missing:
                raise ValueError(f"missing in {side}: {', '.join(missing)}")
        for c in wanted:
            if left[c] != right[c]:
                raise ValueError(f"{c} has different class: {left[c]} and {right[c]}")
        if self.target in self.keys:
            raise ValueError("the target must not be a key")

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.cols if isinstance(self.original.schema[c].dataType, NumericType)]

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.cols if c not in self.numeric]

    def with_holdout(self, fraction: float = 0.5, seed: int = 1, at_least: int = 1) -> ReleasePair:
        """Cut a reproducible holdout off the original, by a hash of the id.

        It has ``max(at_least, floor(n * fraction))`` rows in expectation: the
        cut is at the same share of hash values, so no sort is needed.
        """
        if not 0 < fraction < 1:
            raise ValueError("holdout_fraction must lie in (0, 1)")
        share = F.pmod(F.xxhash64(self.id_col, F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
        return replace(self, original=self.original.filter(share >= fraction), holdout=self.original.filter(share < fraction))

    @classmethod
    def from_paths(cls, spark: SparkSession, original: str, released: str, id_col: str, **roles) -> ReleasePair:
        return cls(read_table(spark, original), read_table(spark, released), id_col, **roles)

    @classmethod
    def from_pandas(cls, spark: SparkSession, original, released, id_col: str, **roles) -> ReleasePair:
        """From two pandas tables; both need the id column."""
        return cls(spark.createDataFrame(original), spark.createDataFrame(released), id_col, **roles)

    def to_pandas(self) -> dict:
        """The tables as pandas, for small ones; the holdout only if there is one."""
        tables = {"original": self.original, "released": self.released, "holdout": self.holdout}
        return {name: df.toPandas() for name, df in tables.items() if df is not None}
