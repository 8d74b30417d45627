"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into ``host suffix + path prefix`` expressions, cut at the dots of the
host and the slashes of the path. The first four bytes of an expression's SHA-256 find
candidate rules by an equi-join; the full digest confirms them, and of the rules that fit
the longest decides. Expansion goes only as deep as the deepest rule, so a URL with
thousands of slashes gives no more expressions than the rules can match.

A rule is (host, path, verdict). Its path starts and ends with a slash; ``/`` covers the
whole host. It fits its host and all subdomains where the URL's path starts with the rule's.
Of rules of equal length the one with the longer host wins, then ``block`` over ``allow``.

Defined cases: a null URL, or one without ``://``, has an empty host and path; an empty path
fits no rule. Repeated pages are judged alike. An empty rule table gives every page the
default verdict; an empty page table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.llm.common import ascii_lower, broadcast_within, stored

PREFIX_HEX = 8
BROADCAST_BYTES = 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased.
    Path: from there up to ``?``, ``#`` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """All ``suffix + prefix`` strings with at most so many labels and slashes."""
    parts = F.split(host, "\\.")
    start = F.greatest(F.lit(1), F.size(parts) - labels + 1)
    suffixes = F.transform(F.sequence(start, F.size(parts)), lambda i: F.array_join(
        F.slice(parts, i, F.size(parts) - i + 1), "."))
    steps = F.least(F.lit(slashes), F.size(F.split(path, "/")) - 1)
    prefixes = F.when(steps > 0, F.transform(F.sequence(F.lit(1), steps), lambda k: F.concat(
        F.call_function("substring_index", path, F.lit("/"), k), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules with their expression, its digest and the digest's first four bytes."""
    text = F.concat(ascii_lower(F.col("host")), F.col("path"))
    ok = F.col("path").startswith("/") & F.col("path").endswith("/")
    checked = F.when(ok, text).otherwise(F.raise_error(F.lit("a rule's path starts and ends with /")))
    digest = F.sha2(checked, 256)
    return rules.select(checked.alias("_rule"), digest.alias("_digest"),
                        F.substring(digest, 1, PREFIX_HEX).alias("_prefix"),
                        F.length("host").alias("_host_chars"),
                        F.col("verdict").alias("_verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict."""
    hashed = stored(hashed_rules(rules), "rules")
    deepest = hashed.agg(
        F.max(F.size(F.split("_rule", "\\."))).alias("labels"),
        F.max(F.size(F.split("_rule", "/")) - 1).alias("slashes")).first()
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    places = parsed.select("_host", "_path").distinct()
    expressions = places.select("_host", "_path", F.explode(_expressions(
        F.col("_host"), F.col("_path"), deepest["labels"] or 1, deepest["slashes"] or 1)).alias("_text"))
    digest = F.sha2("_text", 256)
    expressions = expressions.withColumn("_full", digest).withColumn(
        "_prefix", F.substring("_full", 1, PREFIX_HEX)).drop("_text")
    fits = (expressions.join(broadcast_within(hashed, 200, BROADCAST_BYTES), "_prefix")
            .filter("_full = _digest"))
    order = F.struct(F.length("_rule").alias("chars"), "_host_chars",
                     (F.col("_verdict") == "block").cast("int").alias("block"))
    best = fits.groupBy("_host", "_path").agg(
        F.max_by(F.struct("_rule", "_verdict"), order).alias("_best"))
    return parsed.join(best, ["_host", "_path"], "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best._rule").alias("rule"),
        F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))
