"""The tables at hand seen as the data model: exchanges with their hops, clock reports, a fenced event stream.

``exchanges``: exchange_id, arrival, path, generation, source, received_ns, observed_ns, rtt_ns, hops (a map from hop index to
dwell_ns and queue_dwell_ns, at most one entry per position of the path), state and domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.evidence import freshness
from ..plans.policy import REFERENCE_DOMAIN

HOPS = 7  # positions of every path of these views


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def hop_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exchange_id, hop_index, dwell_ns, queue_dwell_ns: one row per observed hop (lines of an order, by line number)."""
    lines = read(spark, sf_dir, "lineitem").repartition("l_orderkey")  # one shuffle serves both groupings and the join by order
    queue = F.when(F.min("l_returnflag") == "R", F.sum(F.col("l_quantity").cast("bigint")))
    return lines.groupBy(F.col("l_orderkey").alias("exchange_id"), (F.col("l_linenumber") - 1).alias("hop_index")).agg(F.sum(cents(F.col("l_extendedprice"))).alias("dwell_ns"), queue.alias("queue_dwell_ns"))


def hops_of_orders(spark: SparkSession, sf_dir: str) -> int | None:
    """One more than the largest hop position of any order, read off the lines alone; None where that takes a look at all.

    The largest number of any line is that of an order's if one of some of its lines has an order.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    top = lines.agg(F.max("l_linenumber").alias("top")).first()["top"]
    some = [] if top is None else lines.where(F.col("l_linenumber") == top).where("l_orderkey is not null").limit(100).collect()
    met = some and read(spark, sf_dir, "orders").where(F.col("o_orderkey").isin([r["l_orderkey"] for r in some])).limit(1).count()
    return top if met else None


def order_exchanges(spark: SparkSession, sf_dir: str, hops: bool = True) -> DataFrame:
    """Orders as exchanges. Age runs from -2 to 87 seconds; some records are conflicting, unsupported or off the domain."""
    key = F.col("o_orderkey")
    received = nanos(F.col("o_orderdate"))
    base = read(spark, sf_dir, "orders").select(
        key.alias("exchange_id"), key.alias("arrival"), F.col("o_orderpriority").alias("path"),
        F.concat(F.lit("gen."), F.year("o_orderdate")).alias("generation"), F.concat(F.lit("src."), F.col("o_custkey") % 8).alias("source"),
        received.alias("received_ns"), (received - ((key % 90) - 2) * 1_000_000_000).alias("observed_ns"), cents(F.col("o_totalprice")).alias("rtt_ns"),
        F.when(key % 11 == 0, 4).when(key % 11 == 1, 6).otherwise(0).alias("state"), F.when(key % 13 == 0, "edge").otherwise(REFERENCE_DOMAIN).alias("domain"),
    )
    base = base.withColumn("freshness", freshness(F.col("received_ns") - F.col("observed_ns")))
    if not hops:
        return base
    entry = F.struct("hop_index", F.struct("dwell_ns", "queue_dwell_ns"))
    nested = hop_observations(spark, sf_dir).groupBy("exchange_id").agg(F.map_from_entries(F.collect_list(entry)).alias("hops"))
    return base.join(nested, "exchange_id", "left")


def event_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of exchanges: a source is a user, arrival order is the event id."""
    e = read(spark, sf_dir, "events")
    return event_columns(e)


def event_columns(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("exchange_id"), F.col("event_id").alias("arrival"), F.col("event_type").alias("path"), F.col("user_id").alias("source"),
        nanos(F.col("ts")).alias("received_ns"), (F.round(F.col("value") * 1000).cast("bigint") * 1000).alias("rtt_ns"),
        F.get_json_object("props", "$.k").cast("bigint").alias("sequence"), F.concat(F.lit("epoch."), F.expr("dayofmonth(ts) div 10")).alias("epoch"),
        F.concat(F.lit("inc."), F.expr("event_id div 400 % 3")).alias("incarnation"), (1 + F.col("event_id") % 3).cast("int").alias("source_revision"),
    )


def clock_reports(spark: SparkSession, sf_dir: str, now_ns: int) -> DataFrame:
    """Two revisions of a clock report per supplier; the second is the newer."""
    s = F.col("s_suppkey")
    both = read(spark, sf_dir, "supplier").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("revision"))
    return both.select(
        s.cast("string").alias("domain"), F.when(s % 11 == 0, "other").otherwise(REFERENCE_DOMAIN).alias("reference"),
        F.when(s % 5 == 0, "unsynced").when(s % 5 == 1, "holdover").otherwise("synchronized").alias("sync_state"),
        (cents(F.col("s_acctbal")) * F.col("revision")).alias("offset_ns"), ((s % 7) * 250_000).cast("bigint").alias("uncertainty_ns"),
        (1 + (s % 3) * 1_000_000_000_000).cast("bigint").alias("valid_for_ns"), (F.lit(now_ns) - (s % 13) * 100_000_000_000 + F.when(s % 17 == 3, 10_000_000_000_000).otherwise(0)).cast("bigint").alias("observed_ns"),
        "revision",
    )
