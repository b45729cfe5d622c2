"""The pipeline's stages against what brute force leaves."""

from pathlib import Path

import pytest

import corpus_pipeline
from vantagrain.llm import bpe, decontam, quality_rules
from vantagrain.llm.queries import table, tokenizer_path

from .test_texts import brute_components, brute_fingerprint, brute_substring, split

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_pipeline_against_brute_force(spark):
    docs = [r.asDict() for r in table(spark, DATA, "documents").collect()]
    rules = quality_rules.BASE + quality_rules.OWN
    docs = [d for d in docs if not any(r.rejects(quality_rules.Text((d["text"] or "").encode())) for r in rules)]
    docs.sort(key=lambda d: d["doc_id"])
    comps = brute_components([brute_fingerprint(d["text"]) for d in docs])
    docs = [d for n, d in enumerate(docs) if comps[n] == n]
    cut = brute_substring([(d["doc_id"], d["text"]) for d in docs])
    for d in docs:
        kept, removed, _ = cut[d["doc_id"]]
        if removed:
            d["text"] = " ".join(kept)
    items = [decontam.tokens(r.text) for r in table(spark, DATA, "benchmark").collect()]

    def holds(text):
        words = decontam.tokens(text)
        have = set(words)
        for item in items:
            if len(have & set(item)) >= 5:
                score, matched, *_ = decontam.align(item, words)
                if score >= 0.5 * 2 * len(item) and matched >= min(5, len(item)):
                    return True
        return False

    docs = [d for d in docs if not holds(d["text"])]
    codec = bpe.Codec(tokenizer_path())
    want = {d["doc_id"]: ids.tolist() for d, ids in zip(docs, codec.encode_batch([d["text"] for d in docs]), strict=True)}
    got = {r.doc_id: r.input_ids for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want
    assert split(docs[0]["text"])


def test_stages_keep_the_columns_of_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, "").columns == docs.columns
