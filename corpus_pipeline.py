"""From raw documents to packed sequences: quality rules, near duplicates, personal data, mixing, packing.

Each stage is written as Parquet in the shared folder and read again as the next one's documents. All stages but
the last return the columns of documents as they came, extra ones included; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumigrid.llm import common, jaccard, mixing, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts have no words and go. A verdict depends on the row's text and language only, so repeated rows stay or go together.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8, the smallest doc_id stays.

    Rows that repeat doc_id and text go down to one; equal doc_ids with different texts are compared like others; a
    null doc_id comes after all others. Null and empty texts are linked with nothing and stay.
    """
    return jaccard.keep_one(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind. Null and empty texts stay as they are, repeated rows get equal texts."""
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, shrink or go as their source's target asks.

    Null and empty texts have no words to give and go. Null sources are one source. Repeated rows are numbered and
    shared out like other rows; reruns agree.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining row's tokens, placed in sequences of at most 1024.

    Null and empty texts are one end id. Repeated rows are placed each; which of them comes first is arbitrary.
    """
    return packing.pack_documents(docs, units=250_000)  # the workers hold what earlier stages took as well


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizers and the distances have no SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
