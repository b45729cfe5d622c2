"""Text operators against brute force on small tables."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vantagrain.llm import bpe, decontam, quality_mil, quality_rules, simhash, substring, words
from vantagrain.llm.queries import tokenizer_path

SPACE = " \t\n\r\x0b\x0c"


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_fingerprint(text):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_every_close_pair_shares_a_mask():
    rng = np.random.default_rng(0)
    masks = simhash.table_masks(4)
    assert len(masks) == 31
    for _ in range(5000):
        flip = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(flip & m == 0 for m in masks)


@pytest.mark.parametrize("limit", [64, 2])
def test_near_duplicates(spark, docs, limit):
    """A bucket limit of 2 sends every larger bucket through the shared points."""
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, bucket_limit=limit).collect()}
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    fps = [brute_fingerprint(t) for t in texts]
    comps = brute_components(fps)
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == comps
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(docs, bucket_limit=limit).collect())
    assert kept == sorted(set(comps))


def test_star_links_join_a_dense_cluster(spark):
    rng = np.random.default_rng(4)
    fps = sorted({int(sum(1 << int(b) for b in rng.choice(14, 5, replace=False))) for _ in range(150)} | {1 << 40, (1 << 40) + 31})
    nodes = spark.createDataFrame([(f,) for f in fps], "_fp bigint")
    links = {(r.u, r.v) for r in simhash.links(nodes, 4, 3).collect()}
    assert all((u ^ v).bit_count() <= 4 for u, v in links)
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    assert [fps.index(find(f)) for f in fps] == brute_components(fps)


def test_near_duplicates_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 5 and sum(r.component_id == 1 for r in rows) == 4
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.text) for r in kept.collect()) == ["None", "a b c d e f", "other words here"]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def brute_substring(rows, width=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = split(text)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                gone[s : s + width] = [True] * width
            seen.add(k)
        out[i] = [x for x, g in zip(w, gone, strict=True) if not g], sum(gone), len(w)
    return out


def test_substring(spark, docs):
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    want = brute_substring([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(n for _, n, _ in want.values()) > 500
    for i, (kept, removed, n) in want.items():
        assert (split(got[i].text), got[i]._n_removed, got[i]._n_words) == (kept, removed, n)
        assert removed or got[i].text == docs.filter(F.col("doc_id") == i).first().text


def test_substring_odd_rows(spark, odd):
    long = odd.withColumn("text", F.repeat(F.concat(F.col("text"), F.lit(" ")), 8))
    rows = substring.remove_repeats(long).collect()
    assert len(rows) == 5
    # rows that share an id are not earlier than one another; the null id comes last
    assert sorted((r.doc_id is None, r._n_removed) for r in rows if r.text is not None and (r._n_words in (48,))) == [(False, 42), (False, 42), (True, 48)]
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def test_rolling_windows_and_minima():
    h = np.arange(50, dtype=np.uint64) * words.U(7919) + words.U(3)
    w = words.windows(h, 5)
    assert len(w) == 46 and len(words.windows(h[:4], 5)) == 0
    assert (words.windows(np.concatenate((h[10:], h[:3])), 5)[:36] == w[10:46]).all()
    a = np.random.default_rng(1).integers(0, 99, 40)
    for k in (1, 2, 3, 7, 13):
        assert (words.sliding_min(a, k) == [a[i : i + k].min() for i in range(40 - k + 1)]).all()


def brute_rules(text):
    w = split(text)
    keys = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    inside = set()
    for i, k in enumerate(keys):
        if keys.count(k) > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality_measures_and_verdicts(spark, docs):
    extra = spark.createDataFrame(
        [(900, "é" * 30 + "\nab ab\nab ab\n# $x", "", "", 0), (901, "Word*** " * 25, "", "", 0), (902, "LOUD!! NOISE!! " + "HERE!! " * 1 + " ".join(f"W{n}!!" for n in range(40)), "", "", 0)],
        docs.schema,
    )
    both = docs.unionByName(extra)
    rows = quality_rules.judge(both).collect()
    for r in rows:
        want = brute_rules(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in rows}
    assert not verdict[901] and not verdict[902]
    # the short-circuit run gives the same verdicts, in any order of the rules
    kept = {r.doc_id for r in quality_rules.keep_good(both).collect()}
    assert kept == {i for i, k in verdict.items() if k}
    turned = quality_rules.judge(both, report=False, base=(), own=tuple(reversed(quality_rules.BASE + quality_rules.OWN)))
    assert {r.doc_id for r in turned.filter("kept").collect()} == kept
    assert len(kept) > 30


def test_quality_rules_odd_rows(spark, odd):
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.judge(odd).count() == 5 and quality_rules.judge(odd.limit(0)).count() == 0


def test_alignment_against_plain_dynamic_programming():
    rng = np.random.default_rng(7)
    for _ in range(60):
        a, b = (list(rng.integers(0, 4, rng.integers(1, 9))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i, j] = max(0, t[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), t[i - 1, j] - 1, t[i, j - 1] - 1)
        assert decontam.align(a, b)[0] == t.max()


def test_decontamination(spark, docs):
    import random

    rng = random.Random(3)
    item = [f"w{rng.randint(0, 9999)}" for _ in range(40)]
    edited = [w if k % 7 else "changed" for k, w in enumerate(item)]
    shuffled = item[:]
    rng.shuffle(shuffled)
    half = item[:12]
    more = spark.createDataFrame(
        [(500, "before it " + " ".join(item).upper() + ", after"), (501, "x y " + " ".join(edited) + " z"), (502, " ".join(shuffled)), (503, " ".join(half) + " and more")],
        "doc_id bigint, text string",
    )
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (None, " ".join(item)), (4, "two words")], "item_id bigint, text string")
    all_docs = docs.select("doc_id", "text").unionByName(more)
    got = {(r.doc_id, r.item_id): r for r in decontam.find_copies(all_docs, items).collect()}
    assert set(got) == {(500, 1), (501, 1)}
    assert got[500, 1].score == 1 and (got[500, 1].doc_from, got[500, 1].doc_to) == (2, 42)
    left = decontam.drop_copies(all_docs, items)
    assert left.count() == all_docs.count() - 2 and left.columns == all_docs.columns
    # an item that very many rows hold keeps its seeds
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(item) + " "), F.col("id")).alias("text"))
    assert decontam.find_copies(many, items).count() == 300
    assert decontam.find_copies(all_docs.limit(0), items).count() == 0 and decontam.find_copies(all_docs, items.limit(0)).count() == 0


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def texts_for_bpe():
    import random

    rng = random.Random(5)
    alphabet = "ab cdeé\n\t \x1c\x85\xa0'stve<|endoftext|>ñ中😀0123.,!ing the\x00"
    out = ["", " ", "\n", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "a  b", " lead", "trail ", "don't we'll I'm", "x\r\ny", "中文字", "zzq" * 400, "ab" * 300 + "é" * 90]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 90))) for _ in range(2000)]
    return out


def test_bpe_equals_the_library():
    lib, codec = library(), bpe.Codec(tokenizer_path())
    texts = texts_for_bpe()
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert codec.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_bpe_long_merge_equals_short_merge():
    codec = bpe.Codec(tokenizer_path())
    for word in (b"abcabcthe" * 5, b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"international"):
        assert codec._merge_long([codec.bytes_id[b] for b in word]) == codec.merge(word)


def test_bpe_round_trip(spark, docs, odd):
    coded = bpe.encode(docs, tokenizer_path())
    assert all((r.text or "") == r.decoded for r in coded.collect())
    again = bpe.decode(coded.drop("decoded"), tokenizer_path())
    assert all((r.text or "") == r.decoded for r in again.collect())
    digest = {r.doc_id: r for r in bpe.encode(docs, tokenizer_path(), digests=True).collect()}
    for r in coded.collect():
        raw = np.array(r.input_ids, "<u4").tobytes()
        assert digest[r.doc_id].n_tokens == len(r.input_ids) and digest[r.doc_id].ids_sha256 == hashlib.sha256(raw).hexdigest()
    assert bpe.encode(odd, tokenizer_path()).count() == 5 and bpe.encode(odd.limit(0), tokenizer_path()).count() == 0


def test_passage_features_do_not_depend_on_the_batch():
    texts = [b"Ab cd!! ef\n" * 40, None, b"", b"one two", b"  ", b"x" * 500]
    x, owner = quality_mil.encode(texts)
    assert list(np.bincount(owner)) == [2, 1, 1, 1, 1, 1]
    for n, t in enumerate(texts):
        assert np.allclose(quality_mil.encode([t])[0], x[owner == n])


def test_gradient_training_and_attention(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8)))
    good = lambda n: " ".join(word() for _ in range(n))
    junk = lambda n: " ".join(word() + "***" for _ in range(n))
    rows = [(n, good(rng.randint(30, 200)) if n % 3 else good(70) + " " + junk(90), int(n % 3 > 0)) for n in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality_mil.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    scored = quality_mil.score(df, model, attention=True).withColumn("h", quality_mil.held_out(F.col("doc_id"))).collect()
    unseen = [r for r in scored if r.h]
    assert len(unseen) > 50 and sum((r.score >= 0.3) == (r.quality == 1) for r in unseen) / len(unseen) > 0.95
    extra = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id bigint, text string")
    assert all(0 <= r.score <= 1 for r in quality_mil.score(extra, model).collect())
    assert quality_mil.score(extra.limit(0), model).count() == 0
    assert quality_mil.fit(df.limit(0), df.select("doc_id", "quality"))["c"].sum() == 0


def test_substring_orders_rows_that_share_an_id(spark):
    """Null and equal ids: by a hash of id and text; equal rows are one row."""
    import random

    rng = random.Random(4)
    word = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage = word(30)
    texts = [f"{word(5)} {passage} {word(3)}" for _ in range(60)]
    rows = [(None, t) for t in texts] + [(None, texts[0])] + [(7, passage + " x")] * 2 + [(9, f"{word(4)} {passage}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as _k", "2 as _o", "3 as _n_words", "4 as __whole", "5 as c0")
    got = substring.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "_k", "_o", "__whole", "c0", "_n_words", "_n_removed"]
    found = got.collect()
    assert sorted((str(r.doc_id), r._n_removed) for r in found) == sorted([("7", 0)] * 2 + [("9", 30)] + [("None", 30)] * 61)
    only = substring.remove_repeats(df.filter("doc_id is null")).collect()
    assert sorted(r._n_removed for r in only)[:3] in ([0, 30, 30], [0, 0, 30]) and sum(r._n_removed == 30 for r in only) >= 59


def test_free_column_names(spark, odd):
    """Columns named as the operators name their own."""
    names = "1 as c0, 2 as _t, 3 as __text, 4 as _fp, 5 as _row, 6 as _keys, 7 as `a.b`, 8 as _words, 9 as __q_kept".split(", ")
    clash = odd.selectExpr("*", *names)
    assert simhash.near_duplicates(clash).count() == 5
    for similarity in (None, 0.8):
        kept = simhash.keep_one_of_each(clash, similarity=similarity)
        assert kept.columns == clash.columns and kept.count() == 3
    dotted = clash.withColumnRenamed("text", "the.text")
    assert simhash.near_duplicates(dotted, text_col="the.text").count() == 5
    for out in (
        bpe.encode(clash, tokenizer_path()), quality_rules.judge(clash), quality_rules.keep_good(clash), substring.remove_repeats(clash),
        quality_mil.score(clash, quality_mil.fit(clash, clash.selectExpr("doc_id", "1 as quality"))),
    ):
        assert set(clash.columns) <= set(out.columns) | {"score"} and out.count() in (0, 5)
