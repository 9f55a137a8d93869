"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import byte_bpe, exact_dedup, langid, line_rules, packing, resampling, simhash, token_counts, toxicity, url_filter, vector_codes, warc

#: The URL rules of ``op1_url_filter``: host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), rules)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.dedup_lines(_table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.find_near(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_exact(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_quality_rules(_table(spark, sf_dir, "documents")).drop("text")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_url_filter, op2_line_dedup, op3_best_fit_packing, op4_byte_bpe, op5_language_id, op6_token_counts, op7_warc,
            op8_simhash_near_dedup, op9_exact_dedup, op10_quality_rules, op11_toxicity, op12_vector_codes, op13_importance_resampling,
        )
    }


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

OP1_SQL = rf"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULES_SQL}),
parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""

_LINES_SQL = r"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('h:' || source, 'null') AS host, text FROM documents),
lines AS (
  SELECT rid, host, text, nth, raw, lower(trim(regexp_replace(raw, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS line
  FROM (SELECT rid, host, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM docs)),
totals AS (SELECT host, count(DISTINCT {unit}) AS host_docs FROM docs GROUP BY host),
found AS (
  SELECT host, line FROM (
    SELECT host, line, count(DISTINCT {unit}) AS n_docs FROM lines WHERE line <> '' GROUP BY host, line)
  JOIN totals USING (host) WHERE n_docs >= {least} AND n_docs > {share} * host_docs)
"""

OP2_SQL = f"""
WITH {_LINES_SQL.format(least=2, share="1e-1", unit="rid")},
marked AS (SELECT l.*, f.line IS NOT NULL AS gone FROM lines l LEFT JOIN found f ON l.host = f.host AND l.line = f.line),
joined AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(raw, chr(10) ORDER BY nth) FILTER (NOT gone), '') AS kept_text
  FROM marked GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_dropped,
       CASE WHEN text IS NOT NULL THEN kept_text END AS text
FROM docs JOIN joined USING (rid)
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p
"""

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP10_SQL = rf"""
WITH {_LINES_SQL.format(least=2, share="2e-2", unit="coalesce(text, '')")},
gone AS (
  SELECT rid, sum(len([x for x in regexp_split_to_array(raw, '[ \t\n\x0B\f\r]+') if x <> ''])) AS n_boilerplate_words
  FROM lines l JOIN found f ON l.host = f.host AND l.line = f.line GROUP BY rid),
dup AS (
  SELECT rid, count(*) - count(DISTINCT raw) AS n_dup_lines
  FROM lines WHERE regexp_matches(raw, '[^ \t\n\x0B\f\r]') GROUP BY rid),
words AS (
  SELECT rid, [x for x in regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+') if x <> ''] AS w,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM docs),
windows AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS five FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(5)) AS k) GROUP BY rid),
measured AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_boilerplate_words, 0)::BIGINT AS n_boilerplate_words
  FROM docs JOIN words USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN gone USING (rid))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND n_words - n_boilerplate_words >= 2e-1 * n_words AS kept
FROM measured
"""




def _vector_codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Plain Lloyd rounds in whole numbers, one chain of tables: codebooks ``c``, assignments ``a``."""
    least = "(s - ((s % n + n) % n)) // n"  # rounded down, of whole numbers
    ctes = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, [CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"v AS (SELECT rid, p, q[p * len(q) // {vector_codes.PARTS} + 1 : (p + 1) * len(q) // {vector_codes.PARTS}] AS v FROM kept, range({vector_codes.PARTS}) r(p))",
        f"c0 AS (SELECT p, rid - 1 AS e, v AS c FROM v WHERE rid <= {vector_codes.ENTRIES})",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"""a{k} AS MATERIALIZED (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT rid, v.p, e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)]) AS d
  FROM v JOIN c{k} ON v.p = c{k}.p) GROUP BY rid, p)"""
        )
        if k < rounds:
            ctes.append(
                f"""c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, old.c) AS c FROM c{k} old LEFT JOIN (SELECT p, e, list(CAST({least} AS BIGINT) ORDER BY i) AS c
  FROM (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM a{k} a JOIN v USING (rid, p)) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"""
            )
    ctes.append(f"done AS (SELECT rid, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    ctes.append(f"book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c{rounds}))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN done USING (rid) CROSS JOIN book"


OP12_SQL = _vector_codes_sql()


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": OP1_SQL,
        "op2_line_dedup": OP2_SQL,
        "op7_warc": OP7_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op10_quality_rules": OP10_SQL,
        "op12_vector_codes": OP12_SQL,
    }
