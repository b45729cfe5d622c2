"""The pipeline's near-duplicate stage against a brute-force Jaccard test."""

import random

import numpy as np

import corpus_pipeline
from vantagrain.llm import jaccard


def brute(texts, size=5, similarity=0.8):
    """Smallest index of each text's component under all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a | b and len(a & b) >= similarity * len(a | b)):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return [root(i) for i in range(len(texts))]


def edited(rng, words, n):
    """n words replaced, far enough apart to cost five shingles each."""
    out = list(words)
    for at in rng.sample(range(2, len(words) - 2, 6), n):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def test_edited_copies_go(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
        texts += [" ".join(words)] + [edited(rng, words, n) for n in (1, 3, 5, 6, 7, 12)]
    words = [f"w{rng.randint(0, 3000)}" for _ in range(100)]
    texts += [edited(rng, words, 1) for _ in range(150)] + ["", None, " \n", "one two", "One  two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i for i, r in enumerate(brute(texts)) if r == i}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_spanning_links_connect_what_pairs_connect():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    sets = {k: np.unique(np.concatenate((base[k : k + 60], rng.integers(0, 1 << 60, k % 3, dtype=np.uint64)))) for k in range(0, 40, 2)}
    top = {k: k for k in sets}

    def root(k):
        return k if top[k] == k else root(top[k])

    for u, v in jaccard.spanning(sets, 0.8):
        assert jaccard.alike(sets[u], sets[v], 0.8)
        top[root(u)] = root(v)
    for a in sets:
        for b in sets:
            assert root(a) == root(b) or not jaccard.alike(sets[a], sets[b], 0.8)


def test_large_bands_are_linked_in_parts(spark, monkeypatch):
    """A cluster joined by its members only pairwise, two clusters in one band, and a
    cluster of near copies, with bands above the bound."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "PART", 3)
    rng = random.Random(8)
    words = [f"w{n}" for n in range(400)]
    texts = [" ".join(words[k : k + 120]) for k in range(0, 200, 4)]  # a chain: only neighbours are alike
    base = [f"c{rng.randint(0, 3000)}" for _ in range(100)]
    texts += [edited(rng, base, 1) for _ in range(60)]
    other = base[:70] + [f"d{n}" for n in range(30)]
    texts += [edited(rng, other, 1) for _ in range(30)] + [" ".join(base), None, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i for i, r in enumerate(brute(texts)) if r == i}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
