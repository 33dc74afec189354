"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next one's ``docs``. All but the last return
the columns of ``documents``; their decisions take effect in the rows or texts
they return.

Edge cases: null, empty and very long texts, repeated rows, empty tables and
further columns are handled as each operator's docstring says; the first
stage rejects texts of fewer than 20 words, so null and empty texts end there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passage.llm import mixing, near_dup, packing, pii, quality
from passage.llm._common import materialise, prepare, read_table
from passage.llm.tokens import word_tokenizer


#: Row groups that the stages write: small ones, as a writer holds one in memory beside the tasks' own needs.
ROW_GROUP = 16 << 20


def _ready(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("parquet.block.size", str(ROW_GROUP))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier keep."""
    _ready(spark)
    return quality.keep_good(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    _ready(spark)
    return near_dup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars follows the text."""
    _ready(spark)
    return pii.mask(docs, pii.fit_pii(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled within the shards."""
    _ready(spark)
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    _ready(spark)
    return packing.pack_documents(docs, word_tokenizer(), release=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

# No stage but the mix has a form in SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
