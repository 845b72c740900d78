"""The registered queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _public():
    import public_tokenizers

    return public_tokenizers


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    p = _public()
    return count_tokens(documents(spark, sf_dir), p.path("byte_bpe_50k.json"), p.PATTERN)


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_tree import score_documents

    return score_documents(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import digest

    return digest(documents(spark, sf_dir))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import class_rows

    return class_rows(documents(spark, sf_dir))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import digest_round_trip

    p = _public()
    return digest_round_trip(documents(spark, sf_dir), p.path("byte_bpe_50k.json"), p.PATTERN)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir), report=256)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit_rules, judge

    docs = documents(spark, sf_dir)
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = "_quality_stats"
    return judge(docs, rules).select(
        "doc_id", *[F.col(f"{s}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_quality_base_failed").alias("base_failed"), F.col("_quality_kept").alias("kept"),
    )


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_shards import read_documents, write_shards
    from .workspace import new_path

    path = new_path(spark, "shards")
    write_shards(documents(spark, sf_dir), path, _public().path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, path)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 finds by its base patterns alone."""
    return op4_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_SQL = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
FROM documents"""


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 counts before its learned rules."""
    return op9_quality_rules(spark, sf_dir).drop("kept")


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
w AS (SELECT doc_id, i, words[i:i+2] AS three FROM t, LATERAL (SELECT unnest(generate_series(1, len(words) - 2)) AS i)),
twice AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(j) GROUP BY doc_id),
c AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""


AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
f AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM w
),
l AS (SELECT doc_id, max(quality) AS g, max(toxic) AS x FROM labels GROUP BY doc_id),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (WHERE g = 1) AS good, count(*) FILTER (WHERE x = 1) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT p.name || q.name || r.name || s.name || u.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
  FROM letter p JOIN letter q ON q.bit <> p.bit JOIN letter r ON r.bit NOT IN (p.bit, q.bit)
  JOIN letter s ON s.bit NOT IN (p.bit, q.bit, r.bit) JOIN letter u ON u.bit NOT IN (p.bit, q.bit, r.bit, s.bit)
),
steps AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i-1]), 0)::INT AS before FROM orders, range(1, 6) AS g(i)),
cells AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS toxic_lost
  FROM m, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM cells"""

def op12_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import classify

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import group_variants

    return group_variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_context_tree, op3_line_dedup, op4_secret_scans, op5_near_dedup, op6_bpe_codec, op7_decontamination, op8_repeated_strings, op9_quality_rules, op10_token_shards, op11_filter_audit, op12_quality_model, op13_spelling_variants, secret_base_counts, quality_base_counts)}
ORACLES: dict[str, str] = {"op11_filter_audit": AUDIT_SQL, "secret_base_counts": SECRET_SQL, "quality_base_counts": QUALITY_SQL}
