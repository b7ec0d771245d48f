"""Sources and sinks of exchanges: JSON request documents, a Parquet table, and a log read up to its first damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_HOP = T.StructType([
    T.StructField("index", T.IntegerType()), T.StructField("hop", T.StringType()), T.StructField("link", T.StringType()), T.StructField("queue", T.StringType()),
    *[T.StructField(f"{k}_{v}", T.LongType() if v == "ns" else T.StringType()) for k in ("entry", "exit") for v in ("ns", "domain")],
    T.StructField("queue_entry_ns", T.LongType()), T.StructField("queue_exit_ns", T.LongType()),
])
_RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("path", "generation", "source", "epoch", "incarnation")], T.StructField("source_revision", T.IntegerType()), T.StructField("sequence", T.LongType()),
    T.StructField("domain", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("request_ns", "response_ns", "rtt_ns", "observed_at_ns")], T.StructField("observed_at_domain", T.StringType()),
    T.StructField("synthetic", T.LongType()), T.StructField("hops", T.ArrayType(_HOP)),
])
REQUEST = T.StructType([T.StructField("op", T.StringType()), T.StructField("received_at_ns", T.LongType()), T.StructField("records", T.ArrayType(_RECORD)), T.StructField("_corrupt_record", T.StringType())])
REQUIRED = ("path", "generation", "source", "epoch", "incarnation", "source_revision", "sequence", "domain", "request_ns", "response_ns", "observed_at_ns", "observed_at_domain")


def decode_requests(lines: DataFrame, column: str = "value", most: int = 4096) -> DataFrame:
    """One row per record of each ingest document: request (line number as given by ``line`` if present), received_at_ns, record, ok, error.

    A document that doesn't parse, asks another operation, holds a record without a required field or more than ``most``
    records fails whole: one row, ok false and its error. An empty batch gives no rows.
    """
    keep = [c for c in lines.columns if c != column]
    parsed = lines.select(*keep, F.from_json(column, REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"), F.col(column).alias("_text"))
    lacking = F.exists("d.records", lambda r: ~_complete(r))
    error = (
        F.when(F.col("d").isNull() | F.col("d._corrupt_record").isNotNull() | F.col("_text").isNull(), "malformed_payload").when(F.coalesce(F.col("d.op"), F.lit("")) != "ingest", "unsupported_operation")
        .when(F.col("d.records").isNull(), "missing_field").when(F.size("d.records") > most, "capacity_exceeded").when(lacking, "missing_field")
    )
    marked = parsed.withColumn("error", error)
    good = marked.where("error is null").select(*keep, F.col("d.received_at_ns").alias("received_at_ns"), F.explode("d.records").alias("record"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    bad = marked.where("error is not null").select(*keep, F.lit(None).cast("bigint").alias("received_at_ns"), F.lit(None).cast(_RECORD).alias("record"), F.lit(False).alias("ok"), "error")
    return good.unionByName(bad)


def _complete(record):
    out = F.lit(True)
    for name in REQUIRED:
        out = out & record[name].isNotNull()
    return out


def write_exchanges(exchanges: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by path and day of receipt, so that questions about a path and a window read only their folders."""
    day = F.expr("received_ns div 86400000000000").cast("int")
    exchanges.withColumn("received_day", day).write.mode(mode).partitionBy("path", "received_day").parquet(path)


def read_exchanges(spark: SparkSession, path: str, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    if from_ns is not None:
        out = out.where((F.col("received_day") >= from_ns // 86_400_000_000_000) & (F.col("received_ns") >= from_ns))
    if to_ns is not None:
        out = out.where((F.col("received_day") <= to_ns // 86_400_000_000_000) & (F.col("received_ns") < to_ns))
    return out.drop("received_day")


def undamaged_prefix(log: DataFrame, damaged, segment: str = "segment", position: str = "position") -> DataFrame:
    """The records of a log before its first damaged one, in order of segment and position; all that follow are left out.

    The first damage is one minimum (combined before the shuffle), so the log itself is neither sorted nor moved.
    """
    first = log.where(damaged).agg(F.min(F.struct(segment, position)).alias("_first"))
    return log.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.struct(segment, position) < F.col("_first"))).drop("_first")  # one row


def recovery_report(log: DataFrame, damaged, segment: str = "segment") -> DataFrame:
    """segment, records, kept, lost of each segment of a log."""
    kept = undamaged_prefix(log, damaged).groupBy(segment).agg(F.count("*").alias("kept"))
    n = log.groupBy(segment).agg(F.count("*").alias("records"))
    keep = F.coalesce("kept", F.lit(0).cast("bigint"))
    return n.join(kept, segment, "left").select(segment, "records", keep.alias("kept"), (F.col("records") - keep).alias("lost"))


__all__ = ["REQUEST", "decode_requests", "read_exchanges", "recovery_report", "undamaged_prefix", "write_exchanges"]
