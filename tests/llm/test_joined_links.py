"""SimHash links and links by similarity count together in the pipeline's stage."""

import random

from vantagrain.llm import simhash


def test_texts_within_four_bits_are_linked_beside_similar_ones(spark):
    rng = random.Random(2)
    texts, base = [], " ".join(f"w{rng.randrange(9)}" for _ in range(300))
    texts.append("x y z " * 40)
    texts.append("x y z " * 40 + "x y z q")  # five-word sets differ in more than a fifth, fingerprints do not
    texts += [base, base.replace(base[:3], "new " + base[:3], 1), "wholly other words stand here for once"]
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() <= 4
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts[:2]]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(docs, shingle=5, similarity=0.8).collect())
    assert kept == [0, 2, 4]
