"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontamination, html, licenses, packing, pii, quality, simhash, suffix_dedup, urls
from .common import spread, table

#: Where the public tokenizers lie; a parameter of the packing operator.
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"


#: Key of the registered query; a parameter of the operator.
PII_KEY = "a key for tests"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(spread(table(spark, sf_dir, "documents")), PII_KEY)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: ids by the byte-level BPE, then id 0, sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.PATTERN)


#: Limits of a sequence of conversations: tokens, conversations and loss-bearing tokens.
CONVERSATION_LIMITS = {"max_tokens": 4096, "max_segments": 4, "max_loss": 3000}


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in sequences under three limits at once; one that exceeds a limit by itself has no place."""
    import public_tokenizers

    examples = packing.conversation_examples(spread(table(spark, sf_dir, "conversations")), public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.PATTERN)
    packed = packing.pack_examples(examples, **CONVERSATION_LIMITS)
    return packed.withColumnRenamed("example_id", "conv_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spread(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source"), keep_text=False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *(F.col(f"__ll_{x}").alias(x) for x in names))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 3-word shingles, links at 2 or fewer differing bits."""
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")), width=3, radius=2)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(spread(table(spark, sf_dir, "documents")))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"), urls.default_rules(spark))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of document and item with a shared seed, and whether it contaminates."""
    found = decontamination.find_matches(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.col("coverage") >= decontamination.THRESHOLD)


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def _op8_sql() -> str:
    rules = [(r, a, "false") for a, r in urls.CONTRACT_RULES] + [(r, "block", "true") for r in urls.LISTED_HOSTS]
    values = ", ".join(f"('{r}', '{a}', {x})" for r, a, x in rules)
    return f"""
WITH rules(rule, action, listed) AS (VALUES {values}),
parts AS (
  SELECT rule, action, listed, split_part(rule, '/', 1) AS rhost, substr(rule, instr(rule, '/')) AS rpath FROM rules),
rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
hosted AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
split AS (SELECT page_id, lower(h) AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM hosted),
urls AS (SELECT DISTINCT host, path FROM split),
fit AS (
  SELECT u.host, u.path, rule, action, listed, length(rule) AS n FROM urls u JOIN parts
  ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)),
best AS (
  SELECT host, path, max_by(rule, n) FILTER (NOT listed) AS rule, max_by(action, n) FILTER (NOT listed) AS action,
  bool_or(listed) AS spam FROM fit GROUP BY host, path)
SELECT page_id, s.host, s.path, rule, coalesce(action, CASE WHEN spam THEN 'block' END, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path"""


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_packing, packing_conversations, op3_suffix_dedup, op4_quality_rules, op5_simhash, op6_html, op7_licenses, op8_urls, op9_decontamination, op10_classifier)
}
ORACLES = {"op8_urls": _op8_sql()}
