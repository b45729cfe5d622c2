"""The whole pipeline against brute force, near duplicates by Jaccard similarity."""

from pathlib import Path

import pytest

import corpus_pipeline
from vantagrain.llm import bpe, decontam, quality_rules
from vantagrain.llm.queries import table, tokenizer_path

from .test_decontam import brute as brute_copies
from .test_jaccard import brute as brute_similar
from .test_texts import brute_substring

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_pipeline_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").orderBy("doc_id").collect()]
    rules = quality_rules.BASE + quality_rules.OWN
    docs = [(i, t) for i, t in docs if not any(r.rejects(quality_rules.Text((t or "").encode())) for r in rules)]
    roots = brute_similar([t for _, t in docs])
    docs = [d for n, d in enumerate(docs) if roots[n] == n]
    cut = brute_substring(docs)
    docs = [(i, " ".join(cut[i][0]) if cut[i][1] else t) for i, t in docs]
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    held = {d for d, _ in brute_copies(docs, items)}
    docs = [(i, t) for i, t in docs if i not in held]
    codec = bpe.Codec(tokenizer_path())
    want = {i: ids.tolist() for (i, _), ids in zip(docs, codec.encode_batch([t for _, t in docs]), strict=True)}
    assert held and {r.doc_id: r.input_ids for r in corpus_pipeline.run(spark, DATA).collect()} == want
