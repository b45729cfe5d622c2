"""URL rules by hash-prefix lookup, in DataFrame functions only.

A rule is a host and the beginning of a path.  A URL is expanded into all pairs
of a suffix of its host and a prefix of its path that ends in a slash (or is
empty), no deeper than any rule is; a rule is filed under its host and its path
up to the last slash.  The two sides meet on the first four bytes of a digest;
the full digest and the rest of the rule's path confirm.  The longest rule wins.

URLs are judged once each: the expansion and the choice among rules work on
distinct URLs, pre-aggregated before the shuffle, however often one occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .runtime import bare, named, place

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (host, path, verdict) from pairs such as ("block", "net/")."""
    rows = [
        F.struct(F.lit(host).alias("host"), F.lit(slash + path).alias("path"), F.lit(verdict).alias("verdict"))
        for verdict, (host, slash, path) in ((v, r.partition("/")) for v, r in rules)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))  # literals: the planner knows their size


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    *,
    default: str = "allow",
    added: tuple[str, str, str, str] = ("host", "path", "rule", "verdict"),
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the rule
    that decides, null if none fits) and ``verdict`` (the rule's, else
    ``default``).

    ``rules`` has host, path and verdict.  A rule fits its host and all
    subdomains if the path starts with the rule's; the longest wins, on equal
    length the one with the longer host, then the smaller string, then
    ``block`` before ``allow``.  Rule hosts are compared in lower case; rules
    with a null or empty host or a null verdict fit nothing; a null rule path is
    empty.  A null URL, or one without ``://``, has an empty host and path and
    fits no rule.  Rows come back one for one, repeated ones too; input columns
    of the added names are replaced (the URL may be one of them), other names
    are free; empty tables give the default or nothing.

    A URL is expanded no deeper than the deepest rule and its own host and path
    go, so one rule of very many labels or slashes makes all such URLs wide.

    Rules are joined as the optimiser sees fit: broadcast only if their size is
    known to be below the session's threshold, by shuffle otherwise.
    """
    host, path, rule, verdict = added
    filed = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v")
    ).filter("h <> '' and v is not null")
    filed = filed.select("*", F.regexp_extract("p", r"(?s)^(.*/)?", 0).alias("slash")).withColumn("full", _digest(F.col("h"), F.col("slash")))
    filed = filed.withColumn("short", _prefix(F.col("full")))
    depth = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.max(F.length("path") - F.length(F.replace("path", F.lit("/")))).alias("slashes"),
    ).first()  # two numbers, whatever the number of rules
    labels, slashes = int(depth.labels or 0), int(depth.slashes or 0)

    rows, address = bare(pages), place(pages, url_col)
    urls = rows.select(address.alias("url")).filter("url is not null").distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("uh"), path_of(F.col("url")).alias("up"))
    parts, pieces = F.split("uh", r"\."), F.split("up", "/")
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))),
        lambda n: F.array_join(F.slice(parts, -n, n), "."),
    )
    n_slash = F.least(F.size(pieces) - 1, F.lit(slashes))
    paths = F.transform(
        F.sequence(F.lit(0), n_slash),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(pieces, 1, n), "/"), F.lit("/"))),
    )
    pairs = F.flatten(F.transform(hosts, lambda a: F.transform(paths, lambda b: _digest(a, b))))
    expanded = urls.filter("uh <> ''").select("url", "up", F.explode(pairs).alias("digest"))
    met = expanded.join(filed, _prefix(F.col("digest")) == F.col("short"))
    # confirmed after the join, so that its key is the short prefix only
    fits = (F.col("digest") == F.col("full")) & F.startswith("up", "p")
    # least wins: longer rule, longer host, smaller string, block first
    order = F.struct(
        (-F.length(F.concat("h", "p"))).alias("a"), (-F.length("h")).alias("b"), F.concat("h", "p").alias("rule"),
        (F.col("v") != "block").alias("c"), F.col("v").alias("v"),
    )
    best = met.groupBy("url").agg(F.min(F.when(fits, order)).alias("w")).filter("w is not null")
    best = best.select(F.col("url").alias("u"), F.col("w.rule").alias("rule"), F.col("w.v").alias("v"))
    marked = rows.join(best, address == F.col("u"), "left")
    kept = [(k, c) for k, c in enumerate(pages.columns) if c not in added]
    out = marked.select(*[f"c{k}" for k, _ in kept], host_of(address), path_of(address), "rule", F.coalesce("v", F.lit(default)))
    return named(out, [*[c for _, c in kept], *added])
