"""Benchmark copies against the alignment of every document with every item."""

import random
from collections import Counter
from pathlib import Path

import pytest

from vantagrain.llm import decontam
from vantagrain.llm.queries import op7_decontamination, table

DATA = "/root/testdata/sf0.001"


def brute(docs, items, min_score=0.5, min_matched=5):
    """(doc, item) -> (score, matched, item words, from, to) of all pairs that count."""
    out = {}
    items = [(i, decontam.tokens(t)) for i, t in items if i is not None]
    for d, text in docs:
        words = decontam.tokens(text)
        have = Counter(words)
        for i, item in items:
            # an alignment cannot match more words than the two have in common
            if not item or sum((Counter(item) & have).values()) < min_score * len(item):
                continue
            score, matched, start, end = decontam.align(item, words)
            part = score / (2 * len(item))
            if part >= min_score and matched >= min(min_matched, len(item)):
                best = (round(part, 6), matched, len(item), start, end)
                if (d, i) not in out or (best[0], -best[4]) > (out[d, i][0], -out[d, i][4]):
                    out[d, i] = best
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.score, r.matched, r.item_words, r.doc_from, r.doc_to) for r in df.collect()}


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_query_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    want = brute(docs, items)
    assert want and found(op7_decontamination(spark, DATA)) == want


def edits(rng, words, kind):
    if kind == "third":
        return [f"z{k}" if k % 3 == 2 else w for k, w in enumerate(words)]
    if kind == "inserted":
        return [x for k, w in enumerate(words) for x in ([w, f"y{k}"] if k % 2 else [w])]
    if kind == "every":
        return [x for k, w in enumerate(words) for x in (w, f"x{k}")]
    if kind == "dropped":
        return [w for k, w in enumerate(words) if k % 3]
    return [w if rng.random() < 0.75 else f"v{rng.random()}" for w in words]


@pytest.mark.parametrize("share", [0.5, 0.75, 1.0])
def test_edited_copies_of_long_and_short_items(spark, share):
    """Little vocabulary, so that seeds are common; edits that leave no three words together."""
    rng = random.Random(8)
    vocab = [f"w{n}" for n in range(60)]
    items = [(n, " ".join(rng.choice(vocab) for _ in range(k))) for n, k in enumerate([1, 2, 3, 4, 5, 7, 12, 20, 40, 60, 60, 1500])]
    docs = [(n, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90)))) for n in range(40)]
    for n, (_, text) in enumerate(items):
        for k, kind in enumerate(["third", "inserted", "every", "dropped", "random", "none"]):
            words = text.split() if kind == "none" else edits(rng, text.split(), kind)
            around = [rng.choice(vocab) for _ in range(30)]
            docs.append((100 + 10 * n + k, " ".join(around + words + around)))
    docs += [(900, items[9][1] + " " + "gap " * 700 + items[9][1]), (901, None), (902, "")]
    items += [(50, items[8][1]), (51, None), (52, ""), (None, items[8][1]), (8, "an other text under the same id")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = found(decontam.find_copies(df, spark.createDataFrame(items, "item_id bigint, text string"), seed_share=share))
    want = brute(docs, items)
    assert got == want
    assert (190, 9) in got and got[900, 9][3:] == (0, 60)


def test_alignment_memory_path_equals_a_full_table():
    """The way back through kept rows gives the table's path."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(150):
        a, b = (list(rng.integers(0, 3, rng.integers(1, 40))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i, j] = max(0, t[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), t[i - 1, j] - 1, t[i, j - 1] - 1)
        if not t.max():
            continue
        j = min(j for i, j in zip(*np.where(t == t.max()), strict=True))
        i = min(i for i in range(len(a) + 1) if t[i, j] == t.max())
        end, matched = j, 0
        while t[i, j] > 0:
            same = a[i - 1] == b[j - 1]
            if t[i, j] == t[i - 1, j - 1] + (2 if same else -1):
                matched, i, j = matched + int(same), i - 1, j - 1
            elif t[i, j] == t[i - 1, j] - 1:
                i -= 1
            else:
                j -= 1
        assert decontam.align(a, b) == (t.max(), matched, j, end)


def test_odd_rows_and_names(spark, odd):
    """Repeated and null ids, and columns named as the operator names its own."""
    items = spark.createDataFrame([(7, "a b c d e f", 1)], "item_id bigint, text string, _t int")
    clash = odd.selectExpr("*", "1 as _k1", "2 as _text", "3 as c0", "4 as _t")
    got = decontam.find_copies(clash, items).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.item_id, r.score) for r in got) == [(False, 1, 7, 1.0), (True, None, 7, 1.0)]
    left = decontam.drop_copies(clash, items)
    assert left.columns == clash.columns and sorted(str(r.text) for r in left.collect()) == ["None", "other words here"]
