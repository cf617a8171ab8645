"""URL filter rules by hashed host-suffix and path-prefix expressions.

A rule is a host with a path and the action ``block`` or ``allow``; it fits a
URL whose host is the rule's host or one of its subdomains and whose path
starts with the rule's path. Every distinct URL is expanded into the
expressions that some rule could equal, each expression is looked up by a short
hash prefix in an equi-join, and a candidate counts only if the full digests
agree. Everything is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: hex digits of the digest by which URL expressions and rules are joined
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Path: what follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("/"), path)  # a host holds no slash, so the two parts stay apart


def _digest(expression: Column) -> Column:
    return F.sha2(F.encode(expression, "UTF-8"), 256)


def match_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has the string columns host, path and action. Of the rules that
    fit, the one with the most characters in host and path wins; equal lengths
    go to the longer host, then to ``block``. The columns named here replace
    columns of ``pages`` with the same names. A null URL, or one without
    ``://``, has an empty host and path. Rules with a null part are ignored and
    a repeated rule counts once. With no rules every row gets ``default``.
    """
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
        .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "action")
        .distinct()
        .withColumns({"labels": F.size(F.split("host", r"\.", -1)), "chars": F.length("path")})
    )
    # The shapes (labels in the host, characters of the path) are bounded by the longest
    # host and path, however many rules there are.
    shapes = sorted(tuple(r) for r in rules.select("labels", "chars").distinct().collect())
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    source = F.col(url)
    pages = pages.select(*kept, url_host(source).alias("host"), url_path(source).alias("path"))
    if not shapes:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    sites = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    # one expression over the list of shapes, however many there are
    listed = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in shapes))
    fitting = F.filter(listed, lambda s: (F.size(labels) >= s["n"]) & (F.length("path") >= s["m"]))
    options = F.transform(fitting, lambda s: _expression(F.array_join(F.slice(labels, F.size(labels) - s["n"] + 1, s["n"]), "."), F.substring(F.col("path"), F.lit(1), s["m"])))
    asked = (
        sites.select("host", "path", F.explode(options).alias("expression"))
        .select("host", "path", _digest(F.col("expression")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    known = rules.select(
        _digest(_expression(F.col("host"), F.col("path"))).alias("full"),
        F.struct(
            (F.length("host") + F.col("chars")).alias("n"),
            F.length("host").alias("n_host"),
            (F.col("action") == "block").cast("int").alias("first"),
            F.concat("host", "path").alias("rule"),
            F.col("action").alias("action"),
        ).alias("rank"),
    ).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    best = (
        asked.join(known, "short")
        .where(F.col("digest") == F.col("full"))
        .groupBy("host", "path")
        .agg(F.max("rank").alias("rank"))
        .select("host", "path", F.col("rank.rule").alias("rule"), F.col("rank.action").alias("action"))
    )
    return pages.join(best, ["host", "path"], "left").select(
        *kept, "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )
