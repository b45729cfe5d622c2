"""Transcript parsing against plain counting and a plain Viterbi search."""

import math
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantagrain.llm import chat
from vantagrain.llm.queries import op5_chat, table

DATA = "/root/testdata/sf0.01"
SIZES = {"marker": 4, "length": 16, "asks": 2, "lists": 2, "code": 2, "blank": 2}


def features(text):
    low = text.lstrip(" ").lower()
    marker = 0
    for n, role in enumerate(chat.ROLES, 1):
        if re.match(chat.MARKERS[role], low):
            marker = n
    return {
        "marker": marker, "length": min(15, math.floor(math.log2(len(text) + 1))), "asks": int("?" in text),
        "lists": int(bool(re.search(r"(?m)^\s*(?:[-*•]|\d+[.)]) ", text))), "code": int("```" in text), "blank": int(not text.strip(" ")),
    }


def brute_fit(convs, smooth=0.5):
    emit = {n: np.full((6, k), smooth) for n, k in SIZES.items()}
    step = np.array([[smooth if r % 2 == 0 or (b < 6 and b // 2 == r // 2) else 0 for r in range(6)] for b in range(7)])
    for lines in convs:
        before = 6
        for _, text, role, begins in lines:
            state = 2 * chat.ROLES.index(role) + (0 if begins else 1)
            for n, v in features(text).items():
                emit[n][state, v] += 1
            step[before, state] += 1
            before = state
    with np.errstate(divide="ignore"):
        logs = lambda a: np.log(a / a.sum(axis=1, keepdims=True))
        return {"step": logs(step), "emit": {n: logs(a) for n, a in emit.items()}}


def brute_states(texts, model):
    score, back = np.full(7, -np.inf), []
    score[6] = 0
    for t in texts:
        w = [round(sum(model["emit"][n][s][v] for n, v in features(t).items()), 9) for s in range(6)]
        every = score[:, None] + chat._matrix(w, model["step"])
        back.append(every.argmax(axis=0))
        score = every.max(axis=0)
    states = [int(score.argmax())]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1]


def by_conversation(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.line):
        out.setdefault(r.conv_id, []).append(r)
    return out


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_query_equals_plain_search(spark):
    convs = by_conversation(op5_chat(spark, DATA).collect())
    given = by_conversation(chat.transcript_lines(table(spark, DATA, "conversations")).collect())
    assert {c: [r.line for r in rows] for c, rows in convs.items()} == {c: [r.line for r in rows] for c, rows in given.items()}
    plain = {c: [(r.line, r.text, r.role, r.begins) for r in rows] for c, rows in given.items()}
    model = brute_fit([plain[c] for c, rows in convs.items() if not rows[0].held_out])
    right = total = 0
    for c, rows in convs.items():
        states = brute_states([t for _, t, _, _ in plain[c]], model)
        assert [r.recovered_role for r in rows] == [chat.ROLES[s // 2] for s in states]
        assert [r.opens for r in rows] == [s % 2 == 0 for s in states]
        assert [r.turn_no for r in rows] == (np.cumsum([s % 2 == 0 for s in states]) - 1).tolist()
        assert [r.closes for r in rows] == [r.opens for r in rows[1:]] + [True]
        whole = "".join(r.rendered for r in rows)
        turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", whole, re.S)
        assert len(turns) == rows[-1].turn_no + 1 and [t[0] for t in turns] == [r.recovered_role for r in rows if r.opens]
        if rows[0].held_out:
            right += sum((r.recovered_role, r.opens) == (r.role, r.begins) for r in rows)
            total += len(rows)
    print(right, total)
    assert total > 50 and right / total > 0.8


def conversations(spark):
    rows = []
    for c in range(80):
        for k in range(2 + c % 3):
            rows += [(c, 2 * k, "user", f"What about {k}?"), (c, 2 * k + 1, "assistant", "A long answer with many words. " * 9 + "\n\n```\ncode\n```\nAnd more.")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_turns_keep_their_lines_whatever_the_block(spark, monkeypatch):
    lines = chat.transcript_lines(conversations(spark), unmarked=1 << 30)  # every turn has its marker
    model = chat.fit_turns(lines.filter("conv_id % 5 <> 0"), "conv_id", "line", "role", "begins", "text")
    got = by_conversation(chat.recover_turns(lines, model).collect())
    for rows in got.values():
        turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", "".join(r.rendered for r in rows), re.S)
        assert [t[0] for t in turns] == ["user", "assistant"] * (len(turns) // 2)
        assert all("\n\n```\ncode\n```\nAnd more." in body for role, body in turns if role == "assistant")
    monkeypatch.setattr(chat, "BLOCK", 2)
    again = by_conversation(chat.recover_turns(lines, model).collect())
    flat = lambda x: {c: [(r.line, r.recovered_role, r.turn_no, r.opens, r.closes, r.rendered) for r in rows] for c, rows in x.items()}
    assert flat(again) == flat(got)


def test_one_conversation_with_most_lines(spark):
    """Ranks and running turn numbers across tasks and blocks."""
    lines = spark.range(3000).select(F.lit(1).cast("bigint").alias("conv_id"), (F.col("id") * 7 - 500).alias("line"), F.when(F.col("id") % 3 == 0, "User: x").when(F.col("id") % 3 == 1, "Assistant: y").otherwise("more").alias("text"))
    model = chat.fit_turns(chat.transcript_lines(conversations(spark)), "conv_id", "line", "role", "begins", "text")
    rows = sorted(chat.recover_turns(lines, model).collect(), key=lambda r: r.line)
    assert [r.turn_no for r in rows] == [2 * (k // 3) + min(k % 3, 1) for k in range(3000)]


def test_odd_rows_and_names(spark):
    """Nulls, repeated lines, ties, empty tables and columns named as the code names its own."""
    model = chat.fit_turns(chat.transcript_lines(conversations(spark)), "conv_id", "line", "role", "begins", "text")
    rows = [(None, None, None, 1), (None, 1, "", 2), (1, 1, "User: x", 3), (1, 1, "User: x", 3), (1, 2, "y", 4), (1, None, "Assistant: z", 5)]
    df = spark.createDataFrame(rows, "conv_id bigint, line bigint, text string, leave int").selectExpr("*", "1 as enter", "2 as __c", "3 as __at", "4 as at", "5 as c", "6 as opens", "'u' as role")
    got = chat.recover_turns(df, model)
    assert got.columns == [c for c in df.columns if c != "opens"] + ["recovered_role", "turn_no", "opens", "closes", "rendered"]
    found = got.collect()
    assert len(found) == 6 and all(r.recovered_role in chat.ROLES for r in found)
    assert {(r.line, r.turn_no, r.recovered_role) for r in found if r.conv_id == 1 and r.line != 2} == {(None, 0, "assistant"), (1, 1, "user")}
    assert chat.recover_turns(df.limit(0), model).count() == 0
    roles = chat.fit(conversations(spark), "conv_id", "turn", "role", "text")
    as_turns = df.withColumnRenamed("line", "turn")
    assert chat.recover_roles(as_turns, roles).count() == 6
    tied = {"step": np.log(np.full((4, 3), 1 / 3)), "emit": {n: np.log(np.full((3, k), 1 / k)) for n, k in (SIZES | {"lines": 8}).items()}}
    assert {r.recovered_role for r in chat.recover_roles(as_turns, tied).collect()} == {"system"}


def test_a_null_turn_comes_before_negative_ones(spark):
    """Lengths decide the roles; only in this order does every row open a turn."""
    emit = {n: np.log(np.full((3, k), 1 / k)) for n, k in (SIZES | {"lines": 8}).items()}
    emit["length"] = np.log(np.where(np.arange(16)[None, :] >= 5, [[1e-6], [1e-6], [1.0]], [[1e-6], [1.0], [1e-6]]))
    df = spark.createDataFrame([(1, None, "a"), (1, -5, "b" * 40), (1, -1, "c")], "conv_id bigint, turn bigint, text string")
    got = {r.turn: (r.recovered_role, r.opens) for r in chat.recover_roles(df, {"step": np.log(np.full((4, 3), 1 / 3)), "emit": emit}).collect()}
    assert got == {None: ("user", True), -5: ("assistant", True), -1: ("user", True)}
