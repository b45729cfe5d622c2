"""The thin queries of this subpackage and their SQL.

Each applies its operator, with production parameters, to a whole table and
derives the returned columns from what the operator gives.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontam, quality_mil, quality_rules, sharding, simhash, substring, url_filters, warc
from .runtime import new_path

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SCORE_THRESHOLD = 0.3


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file: in the folder VANTAGRAIN_TOKENIZERS names, else
    in the installed package of public tokenizers."""
    folder = os.environ.get("VANTAGRAIN_TOKENIZERS")
    if not folder:
        found = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.judge(pages, url_filters.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    records = warc.read_archive(spark, path)
    return records.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
        F.sha2(warc.record_bytes(records), 256).alias("record_sha256"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chat.transcript_lines(table(spark, sf_dir, "conversations"))
    unseen = quality_mil.held_out(F.col("conv_id"))
    model = chat.fit_turns(lines.filter(~unseen), "conv_id", "line", "role", "begins", "text")
    found = chat.recover_turns(lines, model)
    return found.select("conv_id", "line", "role", "begins", unseen.alias("held_out"), "recovered_role", "turn_no", "opens", "closes", "rendered")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.REPORTED, "base_failed", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_copies(docs, table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_mil.score(docs, model)
    return scored.select(
        "doc_id",
        quality_mil.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= SCORE_THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path(), digests=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return kept.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_simhash, op3_warc, op4_sharding, op5_chat, op6_quality_rules,
        op7_decontamination, op8_quality_classifier, op9_bpe, op10_substring,
    )
}

OP1_SQL = """
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), judged as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from parts
)
select page_id, host, path, rule,
  case rule when 'net/' then 'block' when 'example.com/de/' then 'block' else 'allow' end as verdict
from judged
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {at + 1}, 5))::bigint >> {shift}) & 31)::int + 1, 1)"
    for at in range(0, 40, 5)
    for shift in (15, 10, 5, 0)
)
_SAFE_URL = "url"
for _c in "%\t\n\r <>":
    _SAFE_URL = f"replace({_SAFE_URL}, chr({ord(_c)}), '%{ord(_c):02X}')"
OP3_SQL = f"""
with rows as (
  select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages
), ranked as (
  select page_id, url, html, strlen(html)::bigint as payload_bytes, sha,
    max(page_id) over (partition by html) as top,
    row_number() over (partition by html order by page_id desc) as n
  from rows
), found as (
  select *, {_BASE32} as payload_digest, case when n = 1 then 'response' else 'revisit' end as record_type, case when n > 1 then top end as refers_to, chr(13) || chr(10) as nl
  from ranked
)
select page_id, payload_bytes, payload_digest, record_type, refers_to,
  sha256('WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Date: 1970-01-01T00:00:00Z'
    || coalesce(nl || 'WARC-Target-URI: ' || {_SAFE_URL}, '') || nl || 'WARC-Payload-Digest: sha1:' || payload_digest
    || case when n > 1 then nl || 'WARC-Refers-To: <urn:page:' || top || '>' || nl || 'WARC-Profile: identical-payload-digest' else '' end
    || nl || 'Content-Length: ' || case when n = 1 then payload_bytes else 0 end || nl || nl || case when n = 1 then html else '' end || nl || nl) as record_sha256
from found
"""

_DRAWS = ", ".join(f"{{'s': substr(md5(name || ':{n}'), 1, 13), 'n': {-n}}}" for n in range(17))


#: The CRC-32 remainders of the sixteen half bytes, by their rule.
def _nibbles() -> list[int]:
    out = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


OP4_SQL = f"""
with rows as (
  select doc_id, coalesce(doc_id::varchar, '') as name, coalesce(text, '') as text from documents
), halves as (
  select doc_id, name, text, list_concat([4294967295::bigint], list_transform(range(0, 2 * strlen(text)),
    lambda i: instr('0123456789ABCDEF', substr(hex(text), (i + 1 - 2 * (i % 2) + 1)::int, 1))::bigint - 1)) as h
  from rows
), sums as (
  select doc_id, name, strlen(text)::bigint + 1 as size,
    xor(list_reduce(h, lambda r, x: xor(r >> 4, ({_nibbles()}::bigint[])[xor(r & 15, x) + 1])), 4294967295::bigint) as text_crc32,
    list_max([{_DRAWS.rsplit(", {", 1)[0]}]).n as a, list_max([{_DRAWS}]).n as b
  from halves
)
select doc_id, size, text_crc32, 'key' as law, (-a)::int as shard,
  row_number() over (partition by a order by md5(name), doc_id nulls first, size, text_crc32) - 1 as slot,
  (-b)::int as grown_shard
from sums
"""

OP6_SQL = r"""
with words as (
  select doc_id, row_number() over () as r, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), base as (
  select *, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    (length(t) - length(replace(t, '!!', ''))) / 2 as shouts, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as upper,
    length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) as lower,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) as stutters, len(list_distinct(w)) as n_distinct
  from words
), starts as (
  select r, w, unnest(range(1, len(w) - 6)) as s from words where len(w) >= 8
), again as (
  select r, s, count(*) over (partition by r, array_to_string(w[s : s + 7], ' ')) as n from starts
), inside as (
  select r, count(distinct p)::bigint as n_repeat_words from (select r, unnest(range(s, s + 8)) as p from again where n > 1) group by r
), judged as (
  select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, shouts, upper, lower, stutters, n_distinct
  from base left join inside using (r)
), failed as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from judged
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols > 0.2::double * n_words or shouts > 0.3::double * n_words or upper / greatest(1, upper + lower) > 0.6::double
    or word_chars / greatest(1, n_words) not between 2 and 25 or n_dup_lines > 0.5::double * n_lines or stutters > 0.3::double * n_words
    or (n_words >= 50 and n_distinct < 0.1::double * pow(n_words, 0.9::double))) as kept
from failed
"""

OP10_SQL = r"""
with words as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), wins as (
  select doc_id, unnest(range(1, len(w) - 18)) as s, w from words where len(w) >= 20
), keyed as (
  select doc_id, s, sha256(array_to_string(w[s : s + 19], ' ')) as k from wins
), judged as (
  select doc_id, s, row_number() over (partition by k order by doc_id, s) > 1 as again from keyed
), gone as (
  select distinct doc_id, unnest(range(s, s + 20)) as p from judged where again
), lists as (
  select doc_id, list(p) as ps from gone group by doc_id
), kept as (
  select words.doc_id, len(w)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
    case when ps is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(ps, x[2])), lambda x: x[1]) end as k
  from words left join lists using (doc_id)
)
select doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from kept
"""

SQL: dict[str, str] = {"op1_url_filters": OP1_SQL, "op3_warc": OP3_SQL, "op4_sharding": OP4_SQL, "op6_quality_rules": OP6_SQL, "op10_substring": OP10_SQL}
