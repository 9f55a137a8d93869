"""Line dedup and quality rules, both from how many documents of a host hold a line.

Everything here is DataFrame functions: no Python runs on the executors.

A *line* is a ``\\n``-separated part of a text, normalised (lower case, outer white space off, inner runs of white space
to one space); empty ones are left out. Line dedup counts pages: the rows of a host. Quality rules count distinct documents:
exact copies, which another operator removes, count once there, so that they don't make their own lines boilerplate.

Defined cases: a null text has no lines and no words; a null host is a host of its own; a document that holds a line
twice counts once; repeated rows get equal verdicts (and are pages of their own for line dedup); empty tables give empty
results; other columns, whatever their names, are left alone or not returned, as each docstring says.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidewright.llm.common import SPACE_CLASS, materialize, words_of

#: Boilerplate tables up to this many lines (8 bytes each, and a host name per host) are broadcast.
BROADCAST_LINES = 2_000_000
#: Pages, or distinct documents, that a line must be on to recur at all. Beyond that the share alone decides, on hosts of any size.
LEAST = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE_CLASS + "+", " ")))


def line_hashes(text: Column) -> Column:
    """Hashes of the distinct normalised lines that aren't empty."""
    normal = F.filter(F.transform(lines_of(text), normal_line), lambda x: x != "")
    return F.array_distinct(F.transform(normal, lambda x: F.xxhash64(x)))


def _host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h:"), host), F.lit("null"))


def line_frequencies(docs: DataFrame, host: str, text: str, distinct: bool = False) -> DataFrame:
    """``line_host, line_hash, n_docs, host_docs``: rows of the host with the line, and in all; of ``distinct`` texts if asked for.

    Counts are combined on the map side, so a line that a third of all documents hold is one row for each task. Distinct texts
    take an aggregation before that, by (host, line, text), which folds copies.
    """
    hashed = docs.select(_host_key(F.col(host)).alias("line_host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), line_hashes(F.col(text)).alias("hashes"))
    lines, rows = hashed.select("line_host", "text_hash", F.explode("hashes").alias("line_hash")), hashed.select("line_host", "text_hash")
    if distinct:
        lines, rows = lines.distinct(), rows.distinct()
    counts = lines.groupBy("line_host", "line_hash").agg(F.count("*").alias("n_docs"))
    totals = rows.groupBy("line_host").agg(F.count("*").alias("host_docs"))
    return counts.where(F.col("n_docs") > 1).join(totals, "line_host")


def boilerplate(docs: DataFrame, host: str, text: str, share: float, least: int, distinct: bool = False) -> DataFrame:
    """``line_host, drop``: for each host the hashes of lines in more than ``share`` of its documents, and in ``least`` at least.

    A host has at most (mean lines of a document) / ``share`` such lines, so the arrays stay short at any size.
    """
    return (
        line_frequencies(docs, host, text, distinct)
        .where((F.col("n_docs") >= least) & (F.col("n_docs") > F.lit(share) * F.col("host_docs")))
        .groupBy("line_host")
        .agg(F.sort_array(F.collect_list("line_hash")).alias("drop"))
    )


def with_drop_list(docs: DataFrame, host: str, text: str, share: float, least: int, distinct: bool = False) -> DataFrame:
    """``docs`` with a column ``__drop`` of the hashes of its own lines that go (null or empty where none does).

    The table of boilerplate is written to the shared folder and its size read; it is broadcast only within
    ``BROADCAST_LINES``, else the join shuffles by host and skewed hosts are split by adaptive execution. A document meets its
    host's list once, as two sets, so the cost is the sum of their lengths.
    """
    found = materialize(boilerplate(docs, host, text, share, least, distinct), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()[0]
    found = found.select(F.col("line_host").alias("__line_host"), F.col("drop").alias("__drop"))
    side = F.broadcast(found) if size <= BROADCAST_LINES else found
    joined = docs.join(side, _host_key(docs[host]) == side["__line_host"], "left")
    mine = F.when(F.col("__drop").isNotNull(), F.array_intersect(line_hashes(F.col(text)), "__drop"))
    return joined.withColumn("__drop", mine).drop("__line_host")


def _is_dropped(line: Column) -> Column:
    return F.array_contains(F.col("__drop"), F.xxhash64(normal_line(line)))


def _without_dropped(lines: Column) -> Column:
    return F.when(F.coalesce(F.size("__drop"), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, lambda x: ~_is_dropped(x)))


def dedup_lines(
    docs: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id", share: float = 0.1, least: int = LEAST
) -> DataFrame:
    """Drop lines that more than ``share`` of the host's pages hold (``least`` pages at least, as on one page nothing recurs).

    Returns ``key, n_lines, n_dropped, text``: the text keeps its other lines in order; null stays null.
    """
    chosen = docs.select(F.col(key).alias("__key"), F.col(host).alias("__host"), F.col(text).alias("__text"))
    joined = with_drop_list(chosen, "__host", "__text", share, least)
    lines = F.when(F.col("__text").isNotNull(), F.split("__text", "\n")).otherwise(F.array().cast("array<string>"))
    return (
        joined.withColumn("lines", lines)
        .withColumn("kept_lines", _without_dropped(F.col("lines")))
        .select(
            F.col("__key").alias(key),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"),
            F.when(F.col("__text").isNotNull(), F.array_join("kept_lines", "\n")).alias(text),
        )
    )


def _windows(words: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` words, by position; 64 bits tell the windows of one text apart."""
    n = F.size(words)
    return F.when(
        n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    ).otherwise(F.array().cast("array<bigint>"))


def text_metrics(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long).

    Words under windows that occur twice or more are found by sorting (hash, position) within the row, so a long text
    costs n log n; texts without a repeated window skip that.
    """
    width = 5
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumn("__words", words_of(F.col(text))).withColumn(
        "__lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    base = base.withColumn("__word_hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    base = base.withColumn("__windows", _windows(F.col("__word_hashes"), width))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    base = base.withColumn(
        "__sorted",
        F.when(
            repeats,
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    at = lambda i: F.get(F.col("__sorted"), i)["h"]
    again = F.filter("__sorted", lambda x, k: (x["h"] == at(k + 1)) | ((k > 0) & (x["h"] == at(k - 1))))
    base = base.withColumn("__again", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(
            "__again", lambda p, k: F.least(F.lit(width), F.coalesce(F.get(F.col("__again"), k + 1) - p, F.lit(width)))
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return base.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": covered,
        }
    ).drop("__words", "__lines", "__word_hashes", "__windows", "__sorted", "__again")


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words", "base_failed", "kept")


def _judged(docs: DataFrame, share: float, least: int, left_share: float) -> DataFrame:
    """``docs`` (with ``__host`` and ``__text``) and ``METRICS``, and ``__left``: the text without the lines above the limits."""
    joined = with_drop_list(docs, "__host", "__text", share, least, distinct=True)
    dropped_words = F.when(
        F.coalesce(F.size("__drop"), F.lit(0)) > 0,
        F.aggregate(
            F.filter(lines_of(F.col("__text")), _is_dropped),
            F.lit(0).cast("long"),
            lambda total, line: total + F.size(words_of(line)),
        ),
    ).otherwise(F.lit(0).cast("long"))
    left_text = F.when(F.col("__text").isNotNull(), F.array_join(_without_dropped(lines_of(F.col("__text"))), "\n"))
    measured = text_metrics(joined.withColumns({"n_boilerplate_words": dropped_words, "__left": left_text}), "__text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (left >= F.lit(left_share) * F.col("n_words")))


def apply_quality_rules(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    key: str = "doc_id",
    share: float = 0.02,
    least: int = LEAST,
    left_share: float = 0.2,
) -> DataFrame:
    """``key``, ``METRICS`` and the ``text`` that is left, for every row.

    ``base_failed``: fewer than 10 words, or over 20 % of the words in repeated 5-word windows. Lines above the limits
    (more than ``share`` of the host's distinct texts, and in ``least`` at least) are taken out; a document of which less than
    ``left_share`` of the words then remains is depleted, and isn't kept.
    """
    chosen = docs.select(F.col(key).alias("__key"), F.col(host).alias("__host"), F.col(text).alias("__text"))
    return _judged(chosen, share, least, left_share).select(F.col("__key").alias(key), *METRICS, F.col("__left").alias(text))


def keep_quality(
    docs: DataFrame, host: str = "source", text: str = "text", share: float = 0.02, least: int = LEAST, left_share: float = 0.2
) -> DataFrame:
    """``docs`` without the documents that ``apply_quality_rules`` rejects; all its columns, whatever their names, stay as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = docs.select(F.col(host).alias("__host"), F.col(text).alias("__text"), whole.alias("__row"))
    judged = _judged(chosen, share, least, left_share)
    # A generator, not a filter: a filter on ``kept`` would move below the metrics and compute them several times over.
    return judged.select(F.explode(F.when(F.col("kept"), F.array("__row"))).alias("__row")).select("__row.*")
