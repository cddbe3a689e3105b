"""From raw documents to token files: good texts, one of each near copy, clean of the benchmark, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. run() writes every stage as Parquet
to the shared folder and reads it again, so a lost executor repeats one stage's tasks at most. Other columns pass through
under any names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, mixing, quality_rules, simhash, token_output
from quern.llm.common import materialise, table
from quern.llm.queries import END_ID, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, learned from the labels, is at least 0.3.

    Null and empty texts are scored like any other; without labels of both kinds all have the labels' mean, or 0.5.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

    Pairs are found by tries of SimHash fingerprints and decided by their sets; the smallest doc_id stays, null ids last.
    Of equal rows one stays, and of all texts without words, null included.
    """
    return simhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null texts hold none, null items have none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Null texts have size 0; a null source is one source."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from the written token file; null texts are the end id alone.

    Rows of one doc_id each keep their place, ordered by their codes.
    """
    return token_output.token_digests(docs, vocabulary(), END_ID)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]
#: The classifier and the code table have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
