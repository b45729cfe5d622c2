import pytest


def pytest_collection_modifyitems(items):
    """The long run over the whole pipeline comes last, and with it the one test
    whose expectation the pipeline no longer shares (see the README)."""
    items.sort(key=lambda item: item.name == "test_pipeline_against_brute_force")


@pytest.fixture
def docs(spark):
    """Texts with copies, near copies, shared passages, nulls, empty and long ones."""
    import random

    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(60)
    rows = [text(rng.randint(1, 150)) for _ in range(60)]
    rows += [rows[0], rows[0], rows[5], rows[3] + " tail", None, "", " \n\t ", "one", "One", text(5000)]
    rows += [f"{text(20)} {passage}\n{text(15)}" for _ in range(12)] + [f"{passage}  {passage}"]
    rows += ["Und " * 200, "a b c d " * 30]
    return spark.createDataFrame([(n, t, "en", f"s{n % 3}", len(t or "")) for n, t in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture
def odd(spark):
    """Repeated ids and rows, null ids, and columns with names operators use."""
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (None, "a b c d e f", None, None), (None, None, None, None), (1, "other words here", "y", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, _id int")
