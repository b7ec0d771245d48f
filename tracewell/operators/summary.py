"""Which records answer a question, and the exact summaries of those that do: end to end, per hop, and over time."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.evidence import merged_state, usable
from ..functions.numeric import bucket_of, distribution, floor_div, ppm
from ..plans.policy import DEFAULT, PROBES, REFERENCE_DOMAIN, Policy, check_bounds

#: Classes of a record, in the order in which they are decided.
CLASSES = ("other_path", "other_generation", "other_source", "clock_domain_mismatch", "out_of_window", "conflicting", "unsupported", "stale", "included")


@dataclass(frozen=True)
class Request:
    """A question: one path in one generation, received in [from_ns, to_ns) of one clock domain."""

    path: str
    generation: str
    from_ns: int
    to_ns: int
    mode: str = "historical"
    source: str | None = None
    domain: str = REFERENCE_DOMAIN

    def __post_init__(self):
        if self.from_ns >= self.to_ns:
            raise ValueError("a window must end after it begins")
        if self.mode not in ("current", "historical"):
            raise ValueError(f"no such mode: {self.mode}")


def record_class(r: Request) -> Column:
    """The first class that fits, in the order of CLASSES. The window is on the time of receipt."""
    at = F.when(F.col("path") != r.path, "other_path").when(F.col("generation") != r.generation, "other_generation")
    if r.source is not None:
        at = at.when(F.col("source") != r.source, "other_source")
    at = at.when(F.col("domain") != r.domain, "clock_domain_mismatch").when(~((F.col("received_ns") >= r.from_ns) & (F.col("received_ns") < r.to_ns)), "out_of_window")
    at = at.when(F.col("state") == 4, "conflicting").when(F.col("state").isin(2, 5, 6, 7), "unsupported")
    if r.mode == "current":
        at = at.when(~usable(F.col("state"), F.col("freshness")), "stale")
    return at.otherwise("included")


def included(exchanges: DataFrame, r: Request) -> DataFrame:
    """Records that answer the request. The equalities and the window stand alone, so that they reach the scan."""
    plain = exchanges.where((F.col("path") == r.path) & (F.col("generation") == r.generation) & (F.col("received_ns") >= r.from_ns) & (F.col("received_ns") < r.to_ns))
    return plain.where(record_class(r) == "included")


def class_counts(exchanges: DataFrame, r: Request, modes: tuple[str, ...] | None = None) -> DataFrame:
    """considered (every record) and one counter for each class; records of other sources count as of another path.

    With ``modes`` a row for each, counted in the same scan.
    """
    asked = modes or (r.mode,)
    every = []
    for mode in asked:
        c = record_class(replace(r, mode=mode))
        n = {k: F.count_if(c == k) for k in CLASSES}
        n["other_path"] = n["other_path"] + n.pop("other_source")
        every.append(F.struct(F.lit(mode).alias("mode"), F.count("*").alias("considered"), *[v.alias(k) for k, v in n.items()]))
    rows = exchanges.agg(F.array(*every).alias("_rows")).select(F.explode("_rows").alias("_r")).select("_r.*")
    return rows if modes else rows.drop("mode")


def summarize(exchanges: DataFrame, keys: list[str], probes=PROBES) -> DataFrame:
    """The distribution of round trips for each group of keys."""
    return distribution(exchanges, keys, "rtt_ns", probes)


def contributing_sources(exchanges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_sources, first_source, last_source, and how many records the busiest one gave."""
    each = exchanges.groupBy(*keys, "source").agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.count("source").alias("n_sources"), F.min("source").alias("first_source"), F.max("source").alias("last_source"), F.max("n").alias("busiest_n"))


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[int]) -> DataFrame:
    """keys, bucket, lower_ns, upper_ns, n: one row for each bucket that holds values; bucket -1 is underflow.

    Bucket k holds [bounds[k - 1], bounds[k]); the last has no upper bound.
    """
    check_bounds(bounds)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, bucket_of(F.col(value), bounds).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    edges = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    lower = F.when(F.col("bucket") == 0, F.lit(0).cast("bigint")).when(F.col("bucket") > 0, F.get(edges, F.col("bucket") - 1))
    upper = F.when(F.col("bucket") < 0, F.lit(0).cast("bigint")).otherwise(F.get(edges, F.col("bucket")))
    return counted.select(*keys, "bucket", lower.alias("lower_ns"), upper.alias("upper_ns"), "n")


def spine(exchanges: DataFrame, hops: int, keep: list[str]) -> DataFrame:
    """keep, hop_index, dwell_ns, queue_dwell_ns, observed: a row for every position of the path, whether observed or not.

    The hops travel inside their record, so positions are looked up in place: no join, and a row carries its own hop only.
    """

    def at(i: Column) -> Column:
        hop = F.try_element_at("hops", i)
        return F.struct(hop["dwell_ns"].alias("dwell_ns"), hop["queue_dwell_ns"].alias("queue_dwell_ns"), hop.isNotNull().alias("observed"))

    places = F.transform(F.sequence(F.lit(0), F.lit(hops - 1)), at)
    rows = exchanges.select(*keep, F.posexplode(places).alias("hop_index", "_hop"))
    return rows.select(*keep, "hop_index", "_hop.*").withColumn("observed", F.coalesce("observed", F.lit(False)))


def hop_summary(exchanges: DataFrame, keys: list[str], hops: int, probes=()) -> DataFrame:
    """For each group and hop: counters, coverage in ppm, state and the exact distribution of known dwells."""
    rows = spine(exchanges, hops, keys)
    by = [*keys, "hop_index"]
    more = {
        "exchanges": F.lit(1),
        "missing": F.col("dwell_ns").isNull().cast("int"),
        "queue_observed": F.col("queue_dwell_ns").isNotNull().cast("int"),
        "queue_unknown": (F.col("observed") & F.col("queue_dwell_ns").isNull()).cast("int"),
    }
    d = distribution(rows, by, "dwell_ns", probes, more).withColumnRenamed("n", "observed")
    state = F.when(F.col("observed") == 0, "missing").when(F.col("missing") > 0, "incomplete").otherwise("observed")
    counts = ["exchanges", "observed", "missing", "queue_observed", "queue_unknown"]
    rest = [c for c in d.columns if c not in [*by, *counts]]
    return d.select(*by, *counts, ppm(F.col("observed"), F.col("exchanges")).alias("coverage_ppm"), state.alias("hop_state"), *rest)


def undeclared_hops(hop_obs: DataFrame, exchanges: DataFrame, hops: int) -> DataFrame:
    """Observed hops that their record's path doesn't have."""
    return hop_obs.where((F.col("hop_index") < 0) | (F.col("hop_index") >= hops)).join(exchanges.select("exchange_id", "path"), "exchange_id")


def history(exchanges: DataFrame, r: Request, bucket_ns: int, policy: Policy = DEFAULT, dense: bool = True) -> DataFrame:
    """One row per time bucket of the window: considered, the exclusions, and the distribution of what is included.

    The last bucket keeps its nominal end even where that lies beyond the window.
    """
    buckets = -(-(r.to_ns - r.from_ns) // bucket_ns)
    if bucket_ns <= 0 or buckets > policy.history_buckets:
        raise ValueError(f"a history has 1 to {policy.history_buckets} buckets, not {buckets}")
    c = record_class(r)
    held = exchanges.where((F.col("path") == r.path) & (F.col("generation") == r.generation) & (F.col("received_ns") >= r.from_ns) & (F.col("received_ns") < r.to_ns))
    held = held.select("rtt_ns", "state", "freshness", c.alias("_class"), floor_div(F.col("received_ns") - r.from_ns, F.lit(bucket_ns)).cast("int").alias("bucket"))
    held = held.where(F.col("_class").isin("conflicting", "unsupported", "stale", "included"))
    own = F.col("_class") == "included"
    counts = held.groupBy("bucket").agg(
        F.count("*").alias("considered"), F.count_if(own).alias("included"), *[F.count_if(F.col("_class") == k).alias(k) for k in ("conflicting", "unsupported", "stale")],
        merged_state(F.when(own, F.col("state"))).alias("state"), F.max(F.when(own, F.col("freshness"))).alias("freshness"),
    )
    dist = distribution(held.where(own), ["bucket"], "rtt_ns", ((50, 100), (99, 100))).drop("n", "sum_overflow")
    found = counts.join(dist, "bucket", "left")
    if dense:
        all_ = exchanges.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        found = all_.join(F.broadcast(found), "bucket", "left")  # both at most history_buckets rows
    zero = [F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in ("considered", "included", "conflicting", "unsupported", "stale")]
    start = F.lit(r.from_ns) + F.col("bucket") * F.lit(bucket_ns)
    return found.select("bucket", start.alias("from_ns"), (start + bucket_ns).alias("to_ns"), *zero, F.coalesce("state", F.lit(5)).alias("state"), "freshness", "min_ns", "max_ns", "sum_ns", "mean_ns", "remainder_ns", "p50", "p99")
