"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

A rule is a (host, path, verdict) row. It fits a URL whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path. Of all fitting rules the longest (host plus path) wins; between equally long ones the
one with the longer host, then ``block`` before ``allow``.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule. A path counts only as it is
written, so ``http://a.com`` (empty path) doesn't fit ``a.com/``. Rules that repeat count once. No pages give no rows;
no rules give every page the default verdict. Rows that repeat are judged alike; other columns of ``pages`` are kept
only where asked for, so their names can't clash.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidewright.llm.common import ascii_lower

#: Hex digits of the digest on which URLs and rules are joined; the full digest is compared after that.
PREFIX_DIGITS = 8
#: A rule table is broadcast only up to this many rows (some 100 bytes each); beyond, the join shuffles.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _host_labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules with digest, hash prefix, shape and precedence; one row for each (host, path)."""
    host = ascii_lower(F.coalesce(F.col("host"), F.lit("")))
    path = F.coalesce(F.col("path"), F.lit(""))
    expression = F.concat(host, path)
    digest = F.sha2(F.concat_ws("\n", host, path), 256)
    return (
        rules.select(
            digest.alias("digest"),
            F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"),
            _host_labels(host).alias("labels"),
            F.length(path).alias("path_chars"),
            F.struct(
                F.length(expression).alias("chars"),
                F.length(host).alias("host_chars"),
                F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"),
                expression.alias("rule"),
                F.col("verdict").alias("verdict"),
            ).alias("hit"),
        )
        .groupBy("digest", "prefix", "labels", "path_chars")
        .agg(F.max("hit").alias("hit"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every page: ``key, host, path, rule, verdict``.

    Each distinct URL is expanded once, into one expression for each shape (number of host labels, length of path) that
    the rules have, so a hot URL costs one row after the map-side combine. Expressions meet rules on a short hash
    prefix and the full digest then settles the match.
    """
    prepared = prepare_rules(rules)
    n_rules = prepared.count()
    # One array of path lengths for each number of host labels: both are bounded by what a URL can hold.
    shapes = prepared.groupBy("labels").agg(F.collect_set("path_chars").alias("lengths")).collect()
    judged = pages.select(F.col(key).alias("page_key"), F.col(url).alias("page_url"))
    default_columns = (F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parsed = (url_host(F.col("page_url")).alias("host"), url_path(F.col("page_url")).alias("path"))
    if not shapes:
        return judged.select(F.col("page_key").alias(key), *parsed, *default_columns)
    expanded = []
    for row in shapes:
        suffix = F.substring_index("host", ".", -row["labels"])
        for chars in sorted(row["lengths"]):
            fits = (F.col("labels_here") >= row["labels"]) & (F.length("path") >= chars)
            expression = F.concat_ws("\n", suffix, F.substring(F.col("path"), 1, chars))
            expanded.append(F.when(fits, F.sha2(expression, 256)))
    urls = judged.where(F.col("page_url").contains("://")).select("page_url").distinct().select("page_url", *parsed)
    candidates = urls.withColumn("labels_here", _host_labels(F.col("host"))).select(
        "page_url", F.explode(F.array_compact(F.array(*expanded))).alias("url_digest")
    )
    candidates = candidates.withColumn("prefix", F.substring("url_digest", 1, PREFIX_DIGITS))
    side = F.broadcast(prepared) if n_rules <= BROADCAST_RULES else prepared
    hits = (
        candidates.join(side.select("prefix", "digest", "hit"), "prefix")
        .where(F.col("url_digest") == F.col("digest"))
        .groupBy("page_url")
        .agg(F.max("hit").alias("hit"))
    )
    return judged.join(hits, "page_url", "left").select(
        F.col("page_key").alias(key),
        *parsed,
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )
