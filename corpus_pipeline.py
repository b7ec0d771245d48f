"""Corpus pipeline: what a training corpus goes through, each stage by one operator of ``tracewell.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs: low quality and toxic documents go, one document of each group of near copies stays, documents that hold a
benchmark passage go, personal data is replaced, and what is left is packed into sequences, which are written whole (a row
each) to the shared folder and returned as their parts in order, with their token ids. All but the last return the columns
of ``documents``. The trained stages cannot be written in SQL, so there is no ORACLE_SQL; tests hold the stages against
brute force.

Defined results: null and empty texts are judged like any other and, where kept, packed as the final 0 alone; they are near
copies of each other, so one of them stays. Very long texts are read whole by every stage. Ties between near copies go to
the smallest doc_id. Repeated rows are near copies too. A null doc_id counts as larger than any. Empty tables (documents,
labels or benchmark) give empty results, keep everything, and hit nothing. Extra columns, whatever their names, are kept
by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, pack, pii, quality_model, simhash
from tracewell.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.select(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.segments(pack.write_sequences(docs, shared_dir(spark, "sequences")))


STAGES = [
    ("quality", quality),
    ("deduplicate", deduplicate),
    ("decontaminate", drop_contaminated),
    ("redact", redact),
    ("pack", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
