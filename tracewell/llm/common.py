"""Small pieces that several training-data operators share."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent (tests on one machine) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tracewell-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tracewell-"))
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` does just that on pure ASCII and is far faster than ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def least_hashed(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of ``df`` whose key has the smallest hash: a bounded sample that depends on the keys alone.

    Rows far beyond the expected bound go before the ordering, so no task is handed ``most`` rows from every partition.
    """
    n, h = df.count(), F.xxhash64(key)
    if n > 4 * most:
        df = df.where(h <= F.lit(int(-(2**63) + 2**64 / n * (2 * most + 200))))
    return df.orderBy(h, key).limit(most)
