"""Classifier, rules, tokenizer and pipeline: the parts that SQL cannot show."""

import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vantagrain.llm import bpe, quality_mil, quality_rules, runtime, sharding, url_filters, warc
from vantagrain.llm.queries import URL_RULES, op8_quality_classifier, table, tokenizer_path

DATA = "/root/testdata/sf0.01"
SPACE = b" \t\n\r\x0b\x0c"


def plain_features(text):
    """Features of each passage of one text, by plain loops."""
    raw = (text or b"") + b"\n"
    words, at = [], 0
    while at < len(raw):
        if raw[at] in SPACE:
            at += 1
            continue
        end = at
        while raw[end] not in SPACE:
            end += 1
        words.append((at, end))
        at = end
    out = []
    for k in range(0, max(1, len(words)), quality_mil.WORDS):
        part = words[k : k + quality_mil.WORDS]
        row = np.zeros(quality_mil.N_FEATURES)
        if part:
            after = words[k + quality_mil.WORDS][0] if k + quality_mil.WORDS < len(words) else len(raw)
            span = raw[part[0][0] : after]
            lengths = [b - a for a, b in part]
            texts = [raw[a:b] for a, b in part]
            for c, members in enumerate(quality_mil._CLASSES.values()):
                row[c] = sum(x in set(members) for x in span) / sum(lengths)
            c = len(quality_mil._CLASSES)
            mean = sum(lengths) / len(part)
            row[c : c + 4] = mean, np.sqrt(max(0, sum(n * n for n in lengths) / len(part) - mean**2)), np.log1p(len(part)), np.log1p(max(lengths))
            before = [raw[words[i - 1][0] : words[i - 1][1]] if i else None for i in range(k, k + len(part))]
            row[c + 4] = sum(a == b for a, b in zip(texts, before, strict=True)) / len(part)
            row[c + 5] = len(set(texts)) / len(part)
            row[c + 6] = sum(t[-1:] == b"!" for t in texts) / len(part)
            row[c + 7] = sum(t[-1] in quality_mil._CLASSES["symbol"] for t in texts) / len(part)
            row[c + 8] = sum(n <= 3 for n in lengths) / len(part)
        out.append(row)
    return np.array(out)


def test_encoder_equals_plain_loops():
    rng = random.Random(6)
    alphabet = b"abcXYZ019#!?.,;( \n\t\xc3\xa9"
    texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 900))) for _ in range(30)] + [b"", None, b"a a a b b", b"word " * 300]
    texts = [t.decode("utf-8", "ignore").encode() if t else t for t in texts]
    x, owner = quality_mil.encode(texts)
    fixed = quality_mil.N_FEATURES - quality_mil._N_HASHED
    for n, t in enumerate(texts):
        want = plain_features(t)
        assert np.allclose(x[owner == n][:, :fixed], want[:, :fixed]), t
        hashed = x[owner == n][:, fixed:]
        assert np.allclose(hashed.sum(axis=1), (want[:, len(quality_mil._CLASSES)] > 0).astype(float))


def network(seed, d=quality_mil.N_FEATURES):
    rng = np.random.default_rng(seed)
    x, owner = rng.normal(size=(40, d)), np.sort(rng.integers(0, 9, 40))
    owner = np.unique(owner, return_inverse=True)[1]
    n = owner.max() + 1
    y = (np.arange(n) % 2).astype(float)
    return x, owner, y, quality_mil.train(x, owner, y, epochs=3, code=5, gate=3)


def test_forward_pass_equals_plain_loops():
    x, owner, y, m = network(1)
    f = quality_mil.forward(m, x, owner, len(y))
    for k in range(len(y)):
        rows = x[owner == k]
        codes = np.tanh(((rows - m["mean"]) / m["sd"]).clip(-8, 8) @ m["W"] + m["b"])
        logits = [(np.tanh(h @ m["V"]) * (1 / (1 + np.exp(-(h @ m["Q"]))))) @ m["w"] for h in codes]
        weight = np.exp(logits) / np.exp(logits).sum()
        assert np.allclose(f["a"][owner == k], weight)
        assert f["p"][k] == pytest.approx(1 / (1 + np.exp(-((weight @ codes) @ m["c"] + m["c0"][0]))))


def test_gradient_against_differences():
    x, owner, y, m = network(2)

    def loss(model):
        p = quality_mil.forward(model, x, owner, len(y))["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = quality_mil.gradients(m, x, owner, y)
    rng = np.random.default_rng(0)
    for name, g in found.items():
        for at in rng.integers(0, m[name].size, 6):
            moved = []
            for step in (1e-5, -1e-5):
                other = m | {name: m[name].copy()}
                other[name].reshape(-1)[at] += step
                moved.append(loss(other))
            assert g.reshape(-1)[at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-6)


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_held_out_accuracy_on_the_labels(spark):
    scored = op8_quality_classifier(spark, DATA).join(table(spark, DATA, "labels"), "doc_id").filter("held_out").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in scored)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in scored if a.quality == 1 for b in scored if b.quality == 0]
    print(f"held out: {len(scored)} rows, accuracy {right / len(scored):.3f}, AUC {np.mean(pairs):.3f}")
    assert len(scored) > 30 and right / len(scored) > 0.85 and np.mean(pairs) > 0.9


def test_training_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    rows = [(n % 300, f"text {n} " * (1 + n % 40), n % 2) for n in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    params = {"max_rows": 100, "max_total": 20_000, "epochs": 1}
    models = [quality_mil.fit(d.drop("quality"), df.select("doc_id", "quality"), **params) for d in (df, df.repartition(7))]
    assert all(np.array_equal(models[0][k], models[1][k]) for k in models[0])


def test_rule_order_is_the_same_every_time_and_counts_what_is_left(spark):
    rng = random.Random(1)
    texts = ["few words"] * 30 + ["SHOUT!! " * 40] * 20 + [" ".join(f"w{rng.randint(0, 999)}" for _ in range(60)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    orders = {tuple(quality_rules.plan(d)) for d in (df, df.repartition(5), df)}
    assert len(orders) == 1
    reasons = [sorted((r.doc_id, r.reason or "") for r in quality_rules.judge(d, report=False).collect()) for d in (df, df.repartition(3))]
    assert reasons[0] == reasons[1]
    # a rule that rejects only what a cheaper one rejects too yields nothing after it
    cheap = quality_rules.Rule("cheap", lambda t: t["n_words"] < 20)
    same = quality_rules.Rule("same", lambda t: t["n_repeat_words"] >= 0 and t["n_words"] < 20)
    other = quality_rules.Rule("other", lambda t: t["n_repeat_words"] > 5)
    sample = [quality_rules.Text(t.encode()) for t in texts]
    assert quality_rules.order_of([(r, r.rejects) for r in (same, cheap, other)], sample) == [1, 2, 0]


def test_added_tokens_that_strip_are_refused(tmp_path):
    spec = json.loads(Path(tokenizer_path()).read_text(encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="lstrip"):
        bpe.Codec(str(tmp_path / "t.json"))


def test_the_pair_table_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "_MAX_PAIRS", 50)
    small, large = bpe.Codec(tokenizer_path()), bpe.Codec(tokenizer_path())
    rng = random.Random(9)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("etaoinsr") for _ in range(rng.randint(2, 12))) for _ in range(20)) for _ in range(3)]
        got = small.encode_batch(texts)
        monkeypatch.setattr(bpe, "_MAX_PAIRS", 1 << 20)
        want = large.encode_batch(texts)
        monkeypatch.setattr(bpe, "_MAX_PAIRS", 50)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_free_names_in_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "h"), (None, None, None)], "page_id bigint, url string, html string")
    clash = pages.selectExpr("*", "1 as __u", "2 as __rule", "3 as u", "4 as c0", "5 as `d.e`", "6 as sha256", "7 as payload", "'x' as verdict")
    judged = url_filters.judge(clash, url_filters.rule_table(spark, URL_RULES))
    assert judged.columns == [c for c in clash.columns if c != "verdict"] + ["host", "path", "rule", "verdict"]
    assert sorted((r.rule or "") for r in judged.collect()) == ["", "net/"]
    path = runtime.new_path(spark, "warc")
    warc.write_archive(clash, path)
    assert warc.read_archive(spark, path).count() == 2
    docs = clash.withColumnsRenamed({"page_id": "doc_id", "html": "text"}).selectExpr("*", "1 as _md5", "2 as _n", "3 as shard")
    assert sharding.assign(docs).count() == 2


def test_records_are_rebuilt_whole(spark):
    many = [(n, "http://x/%y z", f"body {n % 3}\r\n\r\n") for n in range(40)] + [(7, "http://x/%y z", "body 1\r\n\r\n")] * 3
    df = spark.createDataFrame(many, "page_id bigint, url string, html string")
    path = runtime.new_path(spark, "warc")
    warc.write_archive(df, path, filter_bits=64)  # nearly every payload is marked
    rows = warc.read_archive(spark, path)
    data = b"".join(bytes(r.x) for r in rows.select(warc.record_bytes(rows).alias("x")).collect())
    records = list(warc.parse_warc(data))
    assert len(records) == 43 and sorted(b for _, b in records if b) == sorted(f"body {n}\r\n\r\n".encode() for n in range(3))


@pytest.fixture
def small(spark, tmp_path, docs):
    """Tables with nulls, repeated rows, and one column more."""
    more = spark.createDataFrame([(None, None, "en", "s", 0), (None, "x " * 40, None, None, None)], docs.schema)
    whole = docs.unionByName(more).unionByName(docs.limit(5)).withColumn("_fp", F.lit(1))
    for name, df in (("documents", whole), ("empty", whole.limit(0))):
        items = spark.createDataFrame([(1, docs.filter("doc_id = 7").first().text), (2, None)], "item_id bigint, text string")
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        items.limit(0).write.parquet(f"{tmp_path}/{name}-items/benchmark.parquet")
        df.write.parquet(f"{tmp_path}/{name}-items/documents.parquet")
    return str(tmp_path)


def test_pipeline_on_odd_and_empty_tables(spark, small):
    rows = corpus_pipeline.run(spark, f"{small}/documents").collect()
    ids = [r.doc_id for r in rows]
    assert ids and len(ids) == len(set(ids)) and all(r.n_tokens == len(r.input_ids) for r in rows)
    # without items nothing is dropped for them
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{small}/documents-items").collect()} >= set(ids)
    assert corpus_pipeline.run(spark, f"{small}/empty").count() == 0 and corpus_pipeline.run(spark, f"{small}/empty-items").count() == 0


def test_every_stage_keeps_columns_and_scratch_is_deleted(spark, small):
    docs = table(spark, f"{small}/documents", "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        with runtime.scratch(spark) as made:
            docs = runtime.written(stage(spark, docs, f"{small}/documents"), "stage")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "_fp" in docs.columns
        assert docs.count() >= 0 and not any(Path(p.removeprefix("file://")).exists() for p in made[:-1])


def test_no_shared_folder_off_one_machine_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())
