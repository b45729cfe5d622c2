"""URL rules, archive, shards and chat against brute force on small tables."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantagrain.llm import chat, graph, runtime, sharding, url_filters, warc

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "a.b/en"), ("allow", "a.b/en/x")]
URLS = [
    "http://x.example.net/en/1", "http://EXAMPLE.NET/de/1", "https://example.net", "https://example.net/", "http://notexample.com/de/", "http://example.com/de/a?b#c",
    "http://example.com/DE/", "ftp://q.org/fr/x://y/", "no scheme", None, "", "http://a.b/english", "http://a.b/en/xyz", "http://c.a.b/en/x", "http://net/", "http://net?x=/", "http://u@h.net:80/",
    "http://b/en", "http:///net/", "http://x.net/" + "a/" * 500, "http://example.net/en/1\nline", "a://b://c.net/",
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for verdict, r in RULES:
        h, s, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p):
            fits.append((len(r), r, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_rules(spark):
    pages = spark.createDataFrame([(n, u, "x") for n, u in enumerate(URLS + URLS[:3])], "page_id bigint, url string, digest string")
    got = {r.page_id: r for r in url_filters.judge(pages, url_filters.rule_table(spark, RULES)).collect()}
    assert len(got) == len(URLS) + 3
    for n, u in enumerate(URLS + URLS[:3]):
        r = got[n]
        assert (r.host, r.path, r.rule, r.verdict) == judge(u), u


def test_url_rules_from_a_large_table_and_empty_tables(spark):
    pages = spark.createDataFrame([(n, u) for n, u in enumerate(URLS)], "page_id bigint, url string")
    rows = [(r.partition("/")[0].upper(), "/" + r.partition("/")[2], v) for v, r in RULES] + [(None, "/", "block"), ("", "/", "block"), ("x", None, "block"), ("net", "/", None)]
    table = spark.createDataFrame(rows, "host string, path string, verdict string")
    got = url_filters.judge(pages, table).collect()
    assert {(r.url, r.verdict) for r in got} == {(u, judge(u)[3]) for u in URLS}
    assert url_filters.judge(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, table.limit(0), default="block").collect()} == {"block"}


def pages_table(spark):
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (2, "http://b", "x"), (3, None, None), (4, "u r\r\nl%", ""), (None, "n", "é\r\n\r\nz"), (7, "n", "é\r\n\r\nz"), (9, "q", "one")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows


@pytest.mark.parametrize("least", [0, 2])
def test_archive(spark, least):
    df, rows = pages_table(spark)
    path = runtime.new_path(spark, "warc")
    warc.write_archive(df.withColumn("payload", F.lit(1)), path, min_bytes=least)
    assert spark.read.parquet(f"{path}/payloads").count() == 4  # x, empty, é.., one
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        mine = [r for r in got if r.page_id == (None if i is None else str(i))]
        assert all(r.payload == body and r.payload_bytes == len(body) for r in mine)
        assert all(r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() for r in mine)
    kinds = sorted((r.page_id or "", r.record_type, r.refers_to) for r in got)
    if least == 0:
        assert kinds == [("", "revisit", "7"), ("1", "revisit", "2"), ("2", "response", None), ("2", "revisit", "2"), ("3", "revisit", "4"), ("4", "response", None), ("7", "response", None), ("9", "response", None)]
    else:
        assert [k for k in kinds if k[1] == "revisit"] == [("", "revisit", "7")]


def test_archive_round_trip_through_warc_files(spark):
    df, rows = pages_table(spark)
    path = runtime.new_path(spark, "warc")
    warc.write_archive(df, path)
    warc.export_warc(spark, path, f"{path}-files")
    back = warc.import_warc(spark, f"{path}-files").collect()
    want = warc.read_archive(spark, path).collect()
    assert sorted((r.header, bytes(r.payload)) for r in back) == sorted((r.header, bytes(r.payload) if r.record_type == "response" else b"") for r in want)


def test_changed_payload_is_found(spark):
    df, _ = pages_table(spark)
    path = runtime.new_path(spark, "warc")
    warc.write_archive(df, path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    bad.write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-bad/records")
    with pytest.raises(Exception, match="payload missing or changed"):
        warc.read_archive(spark, f"{path}-bad").collect()


def test_archive_of_no_pages(spark):
    df, _ = pages_table(spark)
    path = runtime.new_path(spark, "warc")
    warc.write_archive(df.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_shards(spark):
    rows = [(n, "t" * (n % 7) if n % 11 else None) for n in range(500)] + [(3, "ttt")] * 40 + [(None, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("clash"))
    got = sharding.assign(df, n_shards=8, chunk_rows=50).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        draws = [hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13] for s in range(9)]
        assert r.shard == max(range(8), key=lambda s: (draws[s], -s)) and r.grown_shard == max(range(9), key=lambda s: (draws[s], -s))
        assert r.grown_shard in (r.shard, 8)
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    one = sorted((r.doc_id is not None, r.doc_id, r.shard, r.slot) for r in got)
    assert one == sorted((r.doc_id is not None, r.doc_id, r.shard, r.slot) for r in sharding.assign(df, n_shards=8, chunk_rows=10_000).collect())
    assert sharding.assign(df.limit(0)).count() == 0


def test_weighted_shards(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = {r.shard: r["count"] for r in sharding.assign(df, weights=[1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1} and 2.5 < counts[1] / counts[0] < 3.6


def conversations(spark):
    rows = []
    for c in range(60):
        rows += [(c, 0, "system", "Be brief.")] if c % 4 == 0 else []
        for k in range(2 + c % 3):
            t = 2 * k + (c % 4 == 0)
            rows += [(c, t, "user", f"What about {k}?"), (c, t + 1, "assistant", "A long answer with many words. " * 9 + "\nAnd more.")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def brute_viterbi(items, step):
    score, back = np.full(chat.START + 1, -np.inf), []
    score[chat.START] = 0
    for w in items:
        every = score[:, None] + chat._matrix(w, step)
        back.append(every.argmax(axis=0))
        score = every.max(axis=0)
    states = [int(score.argmax())]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1]


def test_roles_are_recovered_and_blocks_change_nothing(spark, monkeypatch):
    df = conversations(spark)
    model = chat.fit(df.filter("conv_id % 5 <> 0"), "conv_id", "turn", "role", "text")
    got = chat.recover_roles(df, model).collect()
    unseen = [r for r in got if r.conv_id % 5 == 0]
    assert sum(r.role == r.recovered_role for r in unseen) / len(unseen) > 0.9
    monkeypatch.setattr(chat, "BLOCK", 2)
    again = {(r.conv_id, r.turn): r.recovered_role for r in chat.recover_roles(df, model).collect()}
    assert again == {(r.conv_id, r.turn): r.recovered_role for r in got}


def test_block_products_equal_one_pass():
    rng = np.random.default_rng(1)
    step = np.log(rng.dirichlet(np.ones(3), 4))
    items = [list(np.round(rng.normal(size=3), 9)) for _ in range(9)]
    blocks = [chat.product(items[k : k + 3], step).ravel().tolist() for k in (0, 3, 6)]
    ends = chat.path(blocks, step, chat.START, None)
    states, enter = [], chat.START
    for k, leave in zip((0, 3, 6), ends, strict=True):
        states += chat.path(items[k : k + 3], step, enter, leave)
        enter = leave
    assert states == brute_viterbi(items, step)


def test_markers_and_rendering(spark):
    text = "### System: be kind\nUser: hi there\nmore of it\nAssistant: hello"
    lines = chat.lines_of(spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, body string"), "id", "body")
    model = chat.fit(conversations(spark), "conv_id", "turn", "role", "text")
    rows = sorted(chat.recover_roles(lines, model).collect(), key=lambda r: r.turn)
    assert [r.text for r in rows] == text.split("\n")
    assert rows[0].rendered.endswith("\nbe kind<|im_end|>\n") and all(r.opens for r in rows if ":" in r.text)


def test_chat_odd_rows(spark):
    model = chat.fit(conversations(spark), "conv_id", "turn", "role", "text")
    df = spark.createDataFrame([(None, None, "user", None), (None, 1, None, ""), (1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "tool", "y")], "conv_id bigint, turn bigint, role string, text string")
    rows = chat.recover_roles(df, model).collect()
    assert len(rows) == 5 and len({r.recovered_role for r in rows if r.conv_id == 1}) == 1
    assert chat.recover_roles(df.limit(0), model).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(400 + k, 401 + k) for k in range(40)] + [(7, 7)]
    parent = list(range(500))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_shared_folder_follows_the_session(spark):
    given = runtime.shared_dir(spark)
    assert given == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = runtime.written(spark.range(3), "three")
    assert df.count() == 3 and runtime.new_path(spark, "x").startswith(given)
