"""Exports: samples as rows with a column per hop, as canonical JSON, with accounting of what a limit leaves out; provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import evidence as ev
from ..functions.identity import fnv1a64


def provenance(included: DataFrame, most: int = 64) -> DataFrame:
    """The first records by arrival that an answer rests on (a report of at most ``most`` rows)."""
    return included.select("exchange_id", "arrival", "source", "received_ns", "rtt_ns").orderBy("arrival").limit(most)


def provenance_of(included: DataFrame, sources: DataFrame, most: int = 64) -> DataFrame:
    """:func:`provenance` with source_kind and authority of each record's source, and whether there are more records than told.

    sources (source, source_kind, authority). One record more than told is looked at, so nothing is counted.
    """
    some = included.orderBy("arrival").limit(most + 1)
    n = some.agg(F.count("*").alias("_n"))
    first = some.orderBy("arrival").limit(most).join(sources, "source", "left").crossJoin(F.broadcast(n))  # one row
    return first.select("exchange_id", "arrival", "source", "source_kind", "authority", "received_ns", "observed_ns", "state", "freshness", (F.col("_n") > most).alias("truncated"))


#: The columns of a sample before those of its hops, in their order.
FIXED = (
    "measurement", "path", "generation", "source", "epoch", "incarnation", "sequence", "observed_at_ns", "observed_at_domain", "received_at_ns", "state", "freshness",
    "confidence", "rtt_ns",
)


def hop_count(exchanges: DataFrame) -> int:
    """One more than the largest hop position of any record."""
    top = exchanges.agg(F.max(F.array_max(F.map_keys("hops"))).alias("top")).first()["top"]
    return 0 if top is None else top + 1


def sample_rows(exchanges: DataFrame, hops: int | None = None) -> DataFrame:
    """FIXED and, for every position up to the largest of any record, hop{i}_dwell_ns and hop{i}_queue_dwell_ns.

    Needs the columns of FIXED but measurement, with ranks for state, freshness and confidence, and hops.
    """
    names = {"state": ev.STATES, "freshness": ev.FRESHNESS, "confidence": ev.CONFIDENCE}
    identity = fnv1a64(F.concat_ws("|", F.lit("measurement"), "source", "epoch", "incarnation", "sequence"))
    fixed = [identity.alias("measurement")] + [ev.name_of(F.col(c), names[c]).alias(c) if c in names else F.col(c) for c in FIXED[1:]]
    columns = []
    for i in range(hop_count(exchanges) if hops is None else hops):
        hop = F.try_element_at("hops", F.lit(i))
        columns += [hop["dwell_ns"].alias(f"hop{i}_dwell_ns"), hop["queue_dwell_ns"].alias(f"hop{i}_queue_dwell_ns")]
    return exchanges.select(*fixed, *columns)


def json_text(rows: DataFrame, key: str, text: str = "json") -> DataFrame:
    """key and the whole row as compact JSON in which unknown is null: summaries, baselines, samples."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(text))


def document(rows: DataFrame, order: str, text: str, limit: int) -> DataFrame:
    """One row: matched, exported, skipped, truncated and the SHA-256 of the exported lines in their order.

    What is put together is at most ``limit`` lines; the rest is only counted.
    """
    if limit < 1:
        raise ValueError("a limit must be 1 or more")
    lines = rows.orderBy(order).limit(limit).agg(F.count("*").alias("exported"), F.expr(f"listagg({text}, '\n') WITHIN GROUP (ORDER BY {order})").alias("_text"))
    both = rows.agg(F.count("*").alias("matched")).crossJoin(lines)  # one row each
    skipped = F.col("matched") - F.col("exported")
    return both.select("matched", "exported", skipped.alias("skipped"), (skipped > 0).alias("truncated"), F.sha2(F.coalesce("_text", F.lit("")), 256).alias("sha256"))


def csv_rows(exchanges: DataFrame, hops: int) -> DataFrame:
    """One row per record with hop{i}_dwell_ns and hop{i}_queue_dwell_ns for every position; unknown is NULL, never 0.

    The hops are in the record, so the pivot is a projection.
    """
    columns = []
    for i in range(hops):
        hop = F.try_element_at("hops", F.lit(i))
        columns += [hop["dwell_ns"].alias(f"hop{i}_dwell_ns"), hop["queue_dwell_ns"].alias(f"hop{i}_queue_dwell_ns")]
    return exchanges.select("exchange_id", "path", "generation", "source", "received_ns", "observed_ns", "rtt_ns", *columns)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def json_rows(exchanges: DataFrame, hops: int) -> DataFrame:
    """exchange_id, sample: each record as compact JSON in which unknown is null."""
    listed = F.transform(
        F.sequence(F.lit(0), F.lit(hops - 1)),
        lambda i: F.struct(i.alias("index"), F.try_element_at("hops", i)["dwell_ns"].alias("dwell_ns"), F.try_element_at("hops", i)["queue_dwell_ns"].alias("queue_dwell_ns"), F.try_element_at("hops", i).isNotNull().alias("seen")),
    )
    seen = F.transform(F.filter(F.when(F.col("hops").isNotNull(), listed).otherwise(F.filter(listed, lambda h: F.lit(False))), lambda h: h["seen"]), lambda h: h.dropFields("seen"))
    record = F.struct("exchange_id", "path", "generation", "source", "received_ns", "observed_ns", "rtt_ns", seen.alias("hops"))
    return exchanges.select("exchange_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("sample"))


def accounting(exchanges: DataFrame, by: list[str], limit: int) -> DataFrame:
    """by, matched, exported, skipped, truncated: what an export of at most ``limit`` records takes and leaves."""
    if limit < 1:
        raise ValueError("a limit must be 1 or more")
    n = exchanges.groupBy(*by).agg(F.count("*").alias("matched"))
    return n.select(*by, "matched", F.least("matched", F.lit(limit)).alias("exported"), F.greatest(F.col("matched") - limit, F.lit(0).cast("bigint")).alias("skipped"), (F.col("matched") > limit).alias("truncated"))


def limited(exchanges: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` records by arrival."""
    if limit < 1:
        raise ValueError("a limit must be 1 or more")
    return exchanges.orderBy("arrival").limit(limit)


def digest(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Each exported text with its SHA-256."""
    return rows.select(key, text, F.sha2(text, 256).alias("sha256"))
