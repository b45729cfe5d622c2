"""Quality rules as a short-circuit cascade.

A rule rejects a text on the strength of some measures.  Measures differ in cost
by two orders of magnitude and rules differ in how much they reject, so the
order matters when a text needs only a verdict.  On a sample the cascade finds
what each rule reads and rejects, and takes as the next rule the one with the
most rejections for its cost among the texts that the rules before let pass;
measures that an earlier rule has read cost nothing.  Costs come from COST, a
table of what each measure takes for a word and for a byte, not from a clock, so
one table always gives one order.  A text leaves at its first rejection.  The
verdict is the conjunction of all rules and does not depend on the order;
``reason``, the first rule that rejects, does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import bare, named, place, ship
from .words import covered, windows, word_hashes

_SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"


class Text:
    """One text; each measure is computed once, when it is first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""
        self._known: dict[str, float] = {}
        self._words: list[bytes] | None = None
        self.asked: set[str] = set()

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    def __getitem__(self, measure: str) -> float:
        self.asked.add(measure)
        if measure not in self._known:
            self._known[measure] = MEASURES[measure](self)
        return self._known[measure]


def _word_chars(t: Text) -> int:
    return len(t.raw.translate(None, _SPACE).decode())


def _n_symbols(t: Text) -> int:
    return len(t.raw) - len(t.raw.translate(None, SYMBOLS))


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.raw.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _repeat_words(t: Text, k: int = 8) -> int:
    """Words in k-word windows found twice or more, the first included."""
    n = len(t.words)
    if n <= k:
        return 0
    hashes = windows(word_hashes(t.words), k)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    suspects = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])
    seen: dict[tuple, list[int]] = {}  # hashes only propose; words decide
    for at in suspects.tolist():
        seen.setdefault(tuple(t.words[at : at + k]), []).append(at)
    starts = np.array([at for found in seen.values() if len(found) > 1 for at in found], np.int64)
    return int(covered(starts, k, n).sum())


def _upper_share(t: Text) -> float:
    """Share of capitals among the ASCII letters; 0 without letters."""
    lower = sum(map(t.raw.count, _LOWER))
    upper = sum(map(t.raw.count, _UPPER))
    return upper / max(1, lower + upper)


_LOWER = [bytes([c]) for c in range(97, 123)]
_UPPER = [bytes([c]) for c in range(65, 91)]

MEASURES: dict[str, Callable[[Text], float]] = {
    "n_words": lambda t: len(t.words),
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_lines": lambda t: sum(1 for x in t.raw.split(b"\n") if x.strip(_SPACE)),
    "n_shouts": lambda t: t.raw.count(b"!!"),
    "upper_share": _upper_share,
    "n_stutters": lambda t: sum(map(eq, t.words, t.words[1:])),
    "n_distinct_words": lambda t: len(set(t.words)),
}
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Rules of the base verdict.
BASE = (
    Rule("few_words", lambda t: t["n_words"] < 20),
    Rule("repeated_windows", lambda t: 100 * t["n_repeat_words"] > 30 * t["n_words"]),
)
#: Rules of the method's own.
OWN = (
    Rule("symbols", lambda t: t["n_symbols"] > 0.2 * t["n_words"]),
    Rule("shouting", lambda t: t["n_shouts"] > 0.3 * t["n_words"]),
    Rule("capitals", lambda t: t["upper_share"] > 0.6),
    Rule("word_length", lambda t: not 2 <= t["word_chars"] / max(1, t["n_words"]) <= 25),
    Rule("repeated_lines", lambda t: t["n_dup_lines"] > 0.5 * t["n_lines"]),
    Rule("stutter", lambda t: t["n_stutters"] > 0.3 * t["n_words"]),
    Rule("few_distinct", lambda t: t["n_words"] >= 50 and t["n_distinct_words"] < 0.1 * t["n_words"] ** 0.9),
)


#: Nanoseconds that a measure takes for a byte of text and for a word, roughly.
COST: dict[str, tuple[float, float]] = {
    "n_words": (2, 20), "word_chars": (3, 0), "n_symbols": (2, 0), "n_dup_lines": (2, 3), "n_repeat_words": (2, 400),
    "n_lines": (2, 3), "n_shouts": (1, 0), "upper_share": (30, 0), "n_stutters": (2, 45), "n_distinct_words": (2, 60),
}


def plan(
    docs: DataFrame,
    text_col: str = "text",
    rules: tuple[Rule, ...] = BASE + OWN,
    sample_rows: int = 500,
    sample_bytes: int = 1 << 20,
) -> list[int]:
    """Order of ``rules`` by rejections for their cost on at most ``sample_rows`` rows.

    The rows are those with the least hash of all columns, of texts of at most
    ``sample_bytes`` each, so that the driver's memory is bounded and every task
    keeps no more than a few: the sample sets an order, never a verdict.  On
    equal yields (rules that reject nothing go last) the cheaper rule comes
    first, then the one given first; an empty table keeps the given order.
    """
    rows, text = bare(docs), place(docs, text_col).cast("binary")
    some = rows.select(text.alias("_t"), F.xxhash64(*rows.columns).alias("_h")).filter(F.coalesce(F.octet_length("_t"), F.lit(0)) <= sample_bytes)
    share = docs.count() // (4 * sample_rows)  # of a large table only one row in so many is compared
    some = some.filter(F.pmod(F.xxhash64("_h"), F.lit(max(1, share))) == 0)
    sample = [Text(bytes(r._t or b"")) for r in some.orderBy("_h", "_t").limit(sample_rows).collect()]
    return order_of([(r, r.rejects) for r in rules], sample) if sample else list(range(len(rules)))


def order_of(rules: list[tuple[Rule, Callable[[Text], bool]]], sample: list[Text]) -> list[int]:
    """The cascade's order on the texts of a sample."""
    gone: list[list[bool]] = []
    reads: list[list[set[str]]] = []
    for _, rejects in rules:
        hit, read = [], []
        for t in sample:
            t.asked = set()
            hit.append(rejects(t))
            read.append(t.asked)
        gone.append(hit)
        reads.append(read)
    price = [{m: c[0] * len(t.raw) + c[1] * len(t.words) for m, c in COST.items()} for t in sample]
    left, known, out = set(range(len(sample))), [set() for _ in sample], []
    while len(out) < len(rules):
        best = None
        for k in (k for k in range(len(rules)) if k not in out):
            cost = sum(price[i].get(m, 0.0) for i in left for m in reads[k][i] - known[i])
            yields = sum(gone[k][i] for i in left) / max(cost, 1.0)
            if best is None or (-yields, cost) < best[0]:
                best = ((-yields, cost), k)
        k = best[1]
        out.append(k)
        for i in left:
            known[i] |= reads[k][i]
        left = {i for i in left if not gone[k][i]}
    return out


def judge(
    docs: DataFrame,
    text_col: str = "text",
    *,
    base: tuple[Rule, ...] = BASE,
    own: tuple[Rule, ...] = OWN,
    report: bool = True,
    sample_rows: int = 500,
    prefix: str = "",
    batch: int = 512,
) -> DataFrame:
    """``docs`` with a verdict on every whole text.

    Adds ``base_failed`` (some base rule rejects), ``kept`` (no rule rejects)
    and ``reason`` (the rule that rejected first, null if kept).  With
    ``report`` the measures in REPORTED are added too and base rules are always
    evaluated; without it a text leaves at its first rejection, and
    ``base_failed`` is null where an own rule came first.

    Null texts count as empty; an empty text has no words and fails the base;
    repeated rows get equal verdicts; an empty table gives an empty result.
    ``prefix`` goes before the added names; input columns of these names are
    replaced (the text may be one of them), other names are free.
    """
    ship(docs.sparkSession)
    first = [*base]
    order = plan(docs, text_col, tuple(own) if report else (*base, *own), sample_rows)
    rules = [*own] if report else [*base, *own]
    cascade = [rules[k] for k in order]
    n_base = {id(r) for r in first}
    added = [*(REPORTED if report else ()), "base_failed", "kept", "reason"]
    names = [prefix + a for a in added]
    stay = [k for k, c in enumerate(docs.columns) if c not in names]
    rows = bare(docs).select(*[f"c{k}" for k in stay], place(docs, text_col).cast("binary").alias("_text"))
    carried = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, batch) for whole in batches for at in range(0, whole.num_rows, batch)):
            found: dict[str, list] = {a: [] for a in added}
            for raw in b.column(b.num_columns - 1):
                t = Text(raw.as_py())
                failed: bool | None = None
                reason = None
                if report:
                    for m in REPORTED:
                        found[m].append(t[m])
                    reason = next((r.name for r in first if r.rejects(t)), None)
                    failed = reason is not None
                if reason is None:
                    hit = next((r for r in cascade if r.rejects(t)), None)
                    reason = hit.name if hit else None
                    if not report:
                        failed = False if hit is None else (True if id(hit) in n_base else None)
                found["base_failed"].append(failed)
                found["kept"].append(reason is None)
                found["reason"].append(reason)
            arrays = [*b.columns[:-1], *(pa.array(found[a], kinds[a]) for a in added)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *added])

    kinds = {m: pa.int64() for m in REPORTED} | {"base_failed": pa.bool_(), "kept": pa.bool_(), "reason": pa.string()}
    from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

    sparks = {pa.int64(): LongType(), pa.bool_(): BooleanType(), pa.string(): StringType()}
    schema = StructType([*rows.schema.fields[:-1], *[StructField(a, sparks[kinds[a]]) for a in added]])
    return named(rows.mapInArrow(run, schema), [*[docs.columns[k] for k in stay], *names])


def keep_good(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The rows that no rule rejects, with their columns as they are.

    Only the verdict is needed here, so the whole cascade short-circuits.
    """
    judged = judge(bare(docs), f"c{docs.columns.index(text_col)}", report=False, prefix="_q_", **params)
    return named(judged.filter("_q_kept").drop("_q_base_failed", "_q_kept", "_q_reason"), docs.columns)
