"""Chat formatting: transcripts parsed by a hidden Markov model, then rendered.

``recover_turns`` parses the lines of flat transcripts.  The hidden state of a
line is the role that speaks and whether the line begins a turn or goes on with
it; what is seen are a speaker marker and features of the line.
``recover_roles`` does the same for segments that are known to be whole turns:
their states are roles alone.  Start, transition and emission probabilities are
counted on labelled conversations; the most likely states are found by Viterbi.

Viterbi is run in blocks.  A block of segments is a matrix of best scores from
any state to any state, and blocks compose by the max-plus product, so a
conversation of any length is solved in levels: products upwards, then paths
downwards between states that the level above has fixed.  No task holds more
than ``BLOCK`` segments of one conversation at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .runtime import bare, named, place, ship, written

ROLES = ("system", "user", "assistant")
START = len(ROLES)
BLOCK = 512
#: Speaker markers of common transcript formats, lower case.
MARKERS = {
    "system": r"(?:<\|im_start\|>system|<\|system\|>|\[system\]|#+ *system|system *:|instructions? *:)",
    "user": r"(?:<\|im_start\|>user|<\|user\|>|\[user\]|#+ *(?:user|human)|(?:user|human|question|q) *:)",
    "assistant": r"(?:<\|im_start\|>assistant|<\|assistant\|>|\[assistant\]|#+ *(?:assistant|response)|(?:assistant|ai|bot|answer|a) *:)",
}
_ANY = "|".join(MARKERS.values())


def features(text: Column) -> dict[str, tuple[Column, int]]:
    """Feature columns of a segment and the number of values of each."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.lower(F.ltrim(text))
    marker = F.lit(0)
    for n, role in enumerate(ROLES, 1):
        marker = F.when(F.regexp_like(low, F.lit("^" + MARKERS[role])), n).otherwise(marker)
    length = F.length(text)
    lines = length - F.length(F.replace(text, F.lit("\n")))
    return {
        "marker": (marker, 4),
        "length": (F.least(F.floor(F.log2(length + 1)), F.lit(15)).cast("int"), 16),
        "lines": (F.least(lines, F.lit(7)).cast("int"), 8),
        "asks": (F.contains(text, F.lit("?")).cast("int"), 2),
        "lists": (F.regexp_like(text, F.lit(r"(?m)^\s*(?:[-*•]|\d+[.)]) ")).cast("int"), 2),
        "code": (F.contains(text, F.lit("```")).cast("int"), 2),
    }


def fit(labelled: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, smooth: float = 0.5) -> dict:
    """Log probabilities, counted over all rows of ``labelled`` with a known role.

    The counts that reach the driver are one number for each role and feature
    value and for each pair of roles.  Rows that share a turn number count the
    least of their roles in transitions.
    """
    known = labelled.filter(F.col(f"`{role_col}`").isin(*ROLES))
    made = features(F.col(f"`{text_col}`"))
    rows = known.select(F.col(f"`{role_col}`").alias("r"), *[c.alias(name) for name, (c, _) in made.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).cast("int").alias("v")) for n in made]))
    counts = rows.select("r", pairs.alias("x")).groupBy("r", "x.f", "x.v").count().collect()
    emit = {n: np.full((len(ROLES), k), smooth) for n, (_, k) in made.items()}
    for row in counts:
        emit[row.f][ROLES.index(row.r), row.v] += row["count"]
    turns = known.groupBy(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").cast("bigint").alias("t")).agg(F.min(F.col(f"`{role_col}`")).alias("r"))
    follow = turns.select("c", (F.col("t") + 1).alias("t"), F.col("r").alias("b"))
    moves = turns.join(follow, ["c", "t"], "left").groupBy("r", F.coalesce("b", F.lit("")).alias("b")).count().collect()
    step = np.full((START + 1, len(ROLES)), smooth)
    for row in moves:  # no turn before it: a start, or a gap in the numbers
        step[ROLES.index(row.b) if row.b else START, ROLES.index(row.r)] += row["count"]
    logs = lambda a: np.log(a / a.sum(axis=1, keepdims=True))
    return {"step": logs(step), "emit": {n: logs(a) for n, a in emit.items()}}


def _matrix(w: list[float], step: np.ndarray) -> np.ndarray:
    """Scores from the state before to the state at an item; the last state is the start."""
    n = len(step)
    if len(w) == n * n:
        return np.array(w).reshape(n, n)
    m = np.full((n, n), -np.inf)
    m[:, :-1] = step + np.array(w)
    return m


def product(items: list[list[float]], step: np.ndarray) -> np.ndarray:
    """Best scores through all items, from any state to any state."""
    out = _matrix(items[0], step)
    for w in items[1:]:
        out = (out[:, :, None] + _matrix(w, step)[None, :, :]).max(axis=1)
    return out


def path(items: list[list[float]], step: np.ndarray, enter: int, leave: int | None) -> list[int]:
    """The best state at each item, after ``enter``, ending in ``leave`` if given;
    on ties the lower state, from the end backwards."""
    score = np.full(len(step), -np.inf)
    score[enter] = 0.0
    back = []
    for w in items:
        every = score[:, None] + _matrix(w, step)
        back.append(every.argmax(axis=0))
        score = every.max(axis=0)
    states = [int(score.argmax()) if leave is None else leave]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _solve(items: DataFrame, step: np.ndarray) -> DataFrame:
    """(c, at, enter, leave) for items (c, at, w): the states before and at each."""
    blocks = items.groupBy("c", F.floor(F.col("at") / BLOCK).alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("at", "w"))).alias("items")
    )
    blocks = written(blocks, "chat-blocks")
    one = blocks.groupBy("c").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter("lo < hi").isEmpty()
    if one:
        bounds = blocks.select("c", "b", "items", F.lit(len(step) - 1).alias("enter"), F.lit(-1).alias("leave"))
    else:

        def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ms = [product([x["w"] for x in row], step).ravel() for row in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ms, pa.list_(pa.float64()))], names=["c", "at", "w"])

        higher = blocks.select("c", "b", "items").mapInArrow(up, "c bigint, at bigint, w array<double>")
        fixed = _solve(higher, step).select(F.col("c").alias("c2"), F.col("at").alias("b2"), "enter", "leave")
        same = F.col("c").eqNullSafe(F.col("c2")) & (F.col("b") == F.col("b2"))
        bounds = blocks.join(fixed, same).select("c", "b", "items", "enter", "leave")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cs, ats, before, here = [], [], [], []
            for c, items, enter, leave in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                states = path([x["w"] for x in items], step, enter, None if leave < 0 else leave)
                cs += [c] * len(items)
                ats += [x["at"] for x in items]
                before += [enter, *states[:-1]]
                here += states
            yield pa.RecordBatch.from_arrays(
                [pa.array(cs, pa.int64()), pa.array(ats, pa.int64()), pa.array(before, pa.int32()), pa.array(here, pa.int32())],
                names=["c", "at", "enter", "leave"],
            )

    return bounds.mapInArrow(down, "c bigint, at bigint, enter int, leave int")


def _evidence(text: Column, model: dict, line: bool = False) -> list[Column]:
    """The log probability of what is seen, in each state."""
    made = line_features(text) if line else features(text)
    out = []
    for state in range(len(model["step"]) - 1):
        terms = [F.element_at(F.array(*[F.lit(float(x)) for x in model["emit"][n][state]]), col.cast("int") + 1) for n, (col, _) in made.items()]
        out.append(sum(terms[1:], terms[0]))
    return out


def _summed(rows: DataFrame, c: Column, at: Column, evidence: list[Column]) -> DataFrame:
    """(c, at, w): the evidence of rows that share a place adds up."""
    each = rows.select(c.alias("c"), at.alias("at"), *[e.alias(f"e{s}") for s, e in enumerate(evidence)])
    return each.groupBy("c", "at").agg(F.array(*[F.round(F.sum(f"e{s}"), 9) for s in range(len(evidence))]).alias("w"))


def recover_roles(segments: DataFrame, model: dict, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``segments`` with ``recovered_role``, ``opens`` (it has a marker, or its
    role differs from the one before) and ``rendered``.

    Segments of a conversation are ordered by their turn number; those that
    share one are versions of one segment: their evidence adds up and they get
    one role.  Null turn numbers share one place before all others; rows with a
    null conversation id are one conversation; null and empty texts are segments
    without marker and of length zero.  On ties the role that ROLES names first
    wins, from the end backwards.  Rows come back one for one, repeated ones
    too; input columns of the added names are replaced, other names are free; an
    empty table gives an empty result.  Ids and turn numbers must be integers.
    """
    ship(segments.sparkSession)
    segments = segments.drop("recovered_role", "opens", "rendered")
    rows, text = bare(segments), place(segments, text_col).cast("string")
    c, turn = place(segments, conv_col).cast("bigint"), place(segments, turn_col).cast("bigint")
    least = (rows.agg(F.min(turn)).first()[0] or 0) - 1
    t = F.coalesce(turn, F.lit(least))
    found = written(_summed(rows, c, t, _evidence(text, model)), "chat-segments")
    shifted = found.withColumn("at", F.col("at") - least)  # from 0, so that blocks of blocks end in one
    states = _solve(shifted, model["step"]).select("c", (F.col("at") + least).alias("at"), "enter", "leave")
    every = rows.join(states, c.eqNullSafe(F.col("c")) & (t == F.col("at")))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("leave") + 1)
    opens = (F.col("enter") != F.col("leave")) | (features(text)["marker"][0] > 0)
    return named(every.select(*rows.columns, role, opens, render(role, text)), [*segments.columns, "recovered_role", "opens", "rendered"])


def line_features(text: Column) -> dict[str, tuple[Column, int]]:
    """Feature columns of a line: those of a segment but for the number of lines,
    and whether the line is blank."""
    made = features(text)
    del made["lines"]
    blank = F.trim(F.coalesce(text.cast("string"), F.lit(""))) == ""
    return made | {"blank": (blank.cast("int"), 2)}


def transcript_lines(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, unmarked: int = 4
) -> DataFrame:
    """(conv_id, line, text, role, begins): conversations as the lines of flat
    transcripts.

    A conversation uses one of four marker styles, by a hash of its id; about
    one turn in ``unmarked`` has no marker.  Lines are numbered in the order of
    turns, with gaps (a null turn comes first); every line of a turn is there,
    blank ones too, and a null text is one blank line.  Role and ``begins`` are
    the truth, for fitting and measuring.
    """
    rows, role = bare(conversations), F.lower(place(conversations, role_col))
    conv, turn = place(conversations, conv_col).cast("bigint"), place(conversations, turn_col).cast("bigint")
    name = F.initcap(role)
    style = F.pmod(F.xxhash64(conv), F.lit(4))
    marker = (
        F.when(style == 0, F.concat(name, F.lit(": ")))
        .when(style == 1, F.concat(F.lit("### "), name, F.lit("\n")))
        .when(style == 2, F.concat(F.lit("["), F.upper(role), F.lit("] ")))
        .otherwise(F.concat(F.lit("<|"), role, F.lit("|>\n")))
    )
    bare_turn = (F.pmod(F.xxhash64(conv, turn), F.lit(unmarked)) == 0) | ~role.isin(*ROLES) | role.isNull()
    flat = F.concat(F.when(bare_turn, "").otherwise(marker), F.coalesce(place(conversations, text_col).cast("string"), F.lit("")))
    cut = rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), F.posexplode(F.split(flat, "\n")).alias("k", "text"))
    first = F.coalesce(F.col("turn"), F.lit(-(1 << 31)))
    return cut.select("conv_id", (first * (1 << 31) + F.col("k")).alias("line"), "text", "role", (F.col("k") == 0).alias("begins"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (c, at, ...), distinct in (c, at), with ``i``: their rank in c from 0.

    Rows are sorted across tasks, so that no task holds a whole conversation; one
    number for each task reaches the driver.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange("c", "at").sortWithinPartitions("c", "at").withColumn("m", F.monotonically_increasing_id())
    dealt = written(dealt, "chat-numbered").withColumn("part", F.shiftright("m", 33))
    ends, shifts = 0, []
    for part, n in sorted(dealt.groupBy("part").count().collect()):
        shifts.append((part, ends))
        ends += n
    at = dealt.join(spark.createDataFrame(shifts, "part bigint, shift bigint"), "part").withColumn("g", F.col("shift") + F.col("m").bitwiseAND((1 << 33) - 1))
    starts = at.groupBy(F.col("c").alias("c0")).agg(F.min("g").alias("g0"))
    return at.join(starts, F.col("c").eqNullSafe(F.col("c0"))).withColumn("i", F.col("g") - F.col("g0")).drop("m", "part", "shift", "g", "c0", "g0")


def _running(items: DataFrame) -> DataFrame:
    """(c, i, n): the sum of v up to and with i, for rows (c, i, v) with i dense
    from 0; in blocks, and in blocks of blocks."""
    cut = items.withColumn("b", F.floor(F.col("i") / BLOCK))
    inner = Window.partitionBy("c", "b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("n", F.sum("v").over(inner))
    sums = written(cut.groupBy("c", "b").agg(F.sum("v").alias("v")), "chat-sums")
    if sums.filter("b > 0").isEmpty():
        return local.select("c", "i", "n")
    before = _running(sums.select("c", F.col("b").alias("i"), "v")).select(F.col("c").alias("c1"), (F.col("i") + 1).alias("b1"), F.col("n").alias("n1"))
    met = local.join(before, F.col("c").eqNullSafe(F.col("c1")) & (F.col("b") == F.col("b1")), "left")
    return met.select("c", "i", (F.col("n") + F.coalesce("n1", F.lit(0))).alias("n"))


def fit_turns(labelled: DataFrame, conv_col: str, line_col: str, role_col: str, begins_col: str, text_col: str, smooth: float = 0.5) -> dict:
    """Log probabilities of the states (role, begins or goes on), counted over all
    lines of ``labelled`` with a known role.

    A line goes on only with the role before it; the counts that reach the
    driver are one number for each state and feature value and for each pair of
    states.  Of lines that share a number the least state counts in transitions.
    """
    ship(labelled.sparkSession)
    rows, role, text = bare(labelled), place(labelled, role_col), place(labelled, text_col)
    state = F.array_position(F.array(*map(F.lit, ROLES)), role).cast("int") * 2 - F.when(place(labelled, begins_col), 2).otherwise(1)
    known = rows.filter(role.isin(*ROLES))
    made = line_features(text)
    seen = known.select(state.alias("r"), *[col.alias(name) for name, (col, _) in made.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).cast("int").alias("v")) for n in made]))
    n_states = 2 * len(ROLES)
    emit = {n: np.full((n_states, k), smooth) for n, (_, k) in made.items()}
    for r in seen.select("r", pairs.alias("x")).groupBy("r", "x.f", "x.v").count().collect():
        emit[r.f][r.r, r.v] += r["count"]
    at = F.coalesce(place(labelled, line_col).cast("bigint"), F.lit(-(1 << 62)))
    lines = known.groupBy(place(labelled, conv_col).cast("bigint").alias("c"), at.alias("at")).agg(F.min(state).alias("r"))
    lines = written(_numbered(lines), "chat-labelled")
    ahead = lines.select(F.col("c").alias("c1"), (F.col("i") + 1).alias("i1"), F.col("r").alias("b"))
    met = lines.join(ahead, F.col("c").eqNullSafe(F.col("c1")) & (F.col("i") == F.col("i1")), "left")
    step = np.zeros((n_states + 1, n_states))
    for b in range(n_states + 1):
        for r in range(n_states):
            step[b, r] = smooth if r % 2 == 0 or (b < n_states and b // 2 == r // 2) else 0.0
    for r in met.groupBy("r", F.coalesce("b", F.lit(n_states)).alias("b")).count().collect():
        if step[r.b, r.r]:
            step[r.b, r.r] += r["count"]
    with np.errstate(divide="ignore"):
        logs = lambda a: np.log(a / a.sum(axis=1, keepdims=True))
        return {"step": logs(step), "emit": {n: logs(a) for n, a in emit.items()}}


def recover_turns(lines: DataFrame, model: dict, conv_col: str = "conv_id", line_col: str = "line", text_col: str = "text") -> DataFrame:
    """``lines`` with ``recovered_role``, ``turn_no`` (from 0 in a conversation),
    ``opens``, ``closes`` and ``rendered``.

    The rendered lines of a conversation, one after the other, are its canonical
    transcript: the line that opens a turn carries the role's header in place of
    a speaker marker, the one that closes it the end mark, and lines between keep
    their text, blank ones too.  Lines are ordered by their number, which may
    have gaps; those that share one are versions of one line and get one state.
    Null numbers share one place before all others; rows with a null conversation
    id are one conversation; null and empty texts are blank lines.  On ties the
    role that ROLES names first wins, from the end backwards.  Rows come back one
    for one, repeated ones too; input columns of the added names are replaced,
    other names are free; an empty table gives an empty result.  Ids and line
    numbers must be integers.
    """
    ship(lines.sparkSession)
    added = ["recovered_role", "turn_no", "opens", "closes", "rendered"]
    lines = lines.drop(*added)
    rows, text = bare(lines), place(lines, text_col).cast("string")
    c, at = place(lines, conv_col).cast("bigint"), F.coalesce(place(lines, line_col).cast("bigint"), F.lit(-(1 << 62)))
    found = written(_numbered(_summed(rows, c, at, _evidence(text, model, line=True))), "chat-lines")
    states = _solve(found.select("c", F.col("i").alias("at"), "w"), model["step"])
    states = written(states.select("c", F.col("at").alias("i"), "leave", F.expr("int(leave % 2 = 0)").alias("v")), "chat-states")
    turns = _running(states.select("c", "i", "v"))
    after = states.select(F.col("c").alias("c1"), (F.col("i") - 1).alias("i1"), F.col("v").alias("next"))
    known = found.select("c", "at", "i").join(states.withColumnRenamed("c", "c2").withColumnRenamed("i", "i2"), F.col("c").eqNullSafe(F.col("c2")) & (F.col("i") == F.col("i2")))
    known = known.join(turns.select(F.col("c").alias("c3"), F.col("i").alias("i3"), "n"), F.col("c").eqNullSafe(F.col("c3")) & (F.col("i") == F.col("i3")))
    known = known.join(after, F.col("c").eqNullSafe(F.col("c1")) & (F.col("i") == F.col("i1")), "left")
    known = known.select("c", "at", "leave", (F.col("n") - 1).alias("turn"), (F.col("v") == 1).alias("opens"), (F.coalesce("next", F.lit(1)) == 1).alias("closes"))
    every = rows.join(written(known, "chat-turns"), c.eqNullSafe(F.col("c")) & (at == F.col("at")))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.floor(F.col("leave") / 2).cast("int") + 1)
    body = F.when(F.col("opens"), _unmarked(text)).otherwise(F.coalesce(text, F.lit("")))
    head = F.when(F.col("opens"), F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))).otherwise("")
    tail = F.when(F.col("closes"), "<|im_end|>\n").when(F.col("opens") & (body == ""), "").otherwise("\n")
    return named(every.select(*rows.columns, role, "turn", "opens", "closes", F.concat(head, body, tail)), [*lines.columns, *added])


def _unmarked(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)^\s*(?:{_ANY})\s*:?\s*", ""))


def render(role: Column, text: Column) -> Column:
    """One canonical turn; the speaker marker, if any, is replaced by the role's."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), _unmarked(text), F.lit("<|im_end|>\n"))


def lines_of(transcripts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, text): the lines of flat transcripts, numbered, blank ones
    too; a transcript without a word has none."""
    text = place(transcripts, text_col).cast("string")
    some = bare(transcripts).filter(F.regexp_like(text, F.lit(r"\S")))
    return some.select(place(transcripts, id_col).alias("conv_id"), F.posexplode(F.split(text, "\n")).alias("turn", "text"))
