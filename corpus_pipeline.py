"""The corpus pipeline: stages in order, each applied to all documents that its predecessor kept.

Quality rules drop documents; of each group of near copies one document stays; documents that hold benchmark passages go; personal data
in the rest is replaced by pseudonyms; what remains is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import common, decontamination, packing, pii, quality, simhash
from logloom.llm.catalog import PII_KEY, TOKENIZER_FILE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.protect_documents(docs, PII_KEY)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("packing", packed_sequences),
]
#: Sketches, components, tilings, pseudonyms and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again before the next."""
    docs = common.spread(common.table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, sf_dir))
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
