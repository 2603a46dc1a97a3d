"""The corpus pipeline: language ID, toxicity, SimHash near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; ``run`` writes each stage's
result as Parquet to the shared folder and reads it again as the next one's documents. Every stage but the last
returns the columns of ``documents``. Null and repeated rows, empty texts, ties and empty tables are handled as
the operators' docstrings say; rows whose ``doc_id`` is null pass the filters on their text alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import decontam, langid, mixing, neardup, toxicity
from varloom.llm.common import materialize
from varloom.session import read

#: Language ID keeps documents whose best language has at least this probability.
MIN_SCORE = 0.3
#: Decontamination removes a document when more than this share of its words was hit.
MAX_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled rows teach; texts without a letter go."""
    return langid.keep_languages(docs, langid.fit(docs), min_score=MIN_SCORE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches one half."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates: SimHash links of five-word shingles and
    min-hash candidates beyond SimHash's radius, all verified at a shingle similarity of 0.8 or more."""
    return neardup.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; documents with over half of their words hit go."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"), max_share=MAX_SHARE)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: slots of equal-token blocks by source, each piece with its doc_id, place and text."""
    return mixing.mixed_text(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("toxicity", toxic),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: The classifiers and SimHash can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
