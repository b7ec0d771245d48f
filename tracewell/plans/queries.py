"""One registered query per operator, over the stand-in views of ``sources.views``, with SQL for each in ``oracles``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import evidence as ev, identity, numeric
from ..operators import admission, attribution, baseline, catalog, clocks, export, ingest, summary
from ..sources import store, synthetic, views
from ..streaming import fences
from . import oracles, oracles_gates, oracles_ingest, oracles_values, service
from .policy import DEFAULT, PROBES, Policy, bounds_digest, default_bounds

QUERIES: dict = {}
DAY = 86_400_000_000_000
#: Instants of the requests: 1996-01-01, 1999-01-01, 2024-01-05, 2024-01-25 (UTC) and the "now" of the clock view.
Y1996, Y1999, JAN5, JAN25, NOW = 820_454_400 * 10**9, 915_148_800 * 10**9, 1_704_412_800 * 10**9, 1_706_140_800 * 10**9, 1_700_000_000 * 10**9
REQUEST = summary.Request("1-URGENT", "gen.1997", Y1996, Y1999)
SESSION = ["source", "epoch", "incarnation"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _events(spark, sf_dir):
    return views.event_exchanges(spark, sf_dir)


def _orders(spark, sf_dir, hops=True):
    return views.order_exchanges(spark, sf_dir, hops)


def _residuals(spark, sf_dir):
    x = attribution.accounts(_orders(spark, sf_dir), views.HOPS, ["exchange_id", "path", "hops"])
    dwell = F.aggregate(F.map_values("hops"), F.lit(0).cast("bigint"), lambda a, h: a + h["dwell_ns"])
    return x.select("path", (F.col("rtt_ns") - F.coalesce(F.when(F.col("hops").isNotNull(), dwell), F.lit(0))).alias("residual_ns"))


# ---- summaries ---------------------------------------------------------------------------------------------------------


@query
def summary_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summarize(_events(spark, sf_dir), ["path"]).drop("sum_overflow")


@query
def summary_windowed(spark, sf_dir):
    e = _events(spark, sf_dir).where((F.col("received_ns") >= JAN5) & (F.col("received_ns") < JAN25))
    return summary.summarize(e, ["path"], ((50, 100),)).drop("sum_overflow")


@query
def summary_by_source(spark, sf_dir):
    return summary.contributing_sources(_events(spark, sf_dir), ["path"])


@query
def summary_of_request(spark, sf_dir):
    return summary.summarize(summary.included(_orders(spark, sf_dir, False), REQUEST), ["path", "generation"]).drop("sum_overflow")


@query
def record_class_counts(spark, sf_dir):
    return summary.class_counts(_orders(spark, sf_dir, False), REQUEST, ("current", "historical"))


@query
def histogram_long(spark, sf_dir):
    return summary.histogram(_events(spark, sf_dir), ["path"], "rtt_ns", default_bounds())


@query
def histogram_underflow(spark, sf_dir):
    return summary.histogram(_residuals(spark, sf_dir), [], "residual_ns", [10**k for k in range(3, 9)]).select("bucket", "n")


@query
def quantiles_rational(spark, sf_dir):
    return numeric.nearest_rank(_events(spark, sf_dir), ["path"], "rtt_ns", ((1, 3), (2, 3), (1, 1000), (999, 1000), (1, 1), (50, 100)))


@query
def floor_mean_negative(spark, sf_dir):
    return numeric.distribution(_residuals(spark, sf_dir), ["path"], "residual_ns", ((50, 100),)).drop("sum_overflow")


@query
def sum_overflow(spark, sf_dir):
    big = _events(spark, sf_dir).select("path", (F.col("rtt_ns") * 10_000_000_000).alias("v"))
    return numeric.distribution(big, ["path"], "v", ())


@query
def checked_arithmetic(spark, sf_dir):
    e = _events(spark, sf_dir).select("exchange_id", (F.col("rtt_ns") * 10_000_000_000).alias("v"))
    return e.select("exchange_id", F.try_add("v", "v").alias("sum"), F.try_subtract(-F.col("v"), "v").alias("difference"), F.try_multiply("v", F.lit(10)).alias("product"))


# ---- hops --------------------------------------------------------------------------------------------------------------


@query
def hop_summary(spark, sf_dir):
    return summary.hop_summary(_orders(spark, sf_dir), ["path"], views.HOPS, ((90, 100),)).drop("sum_overflow")


@query
def hop_coverage(spark, sf_dir):
    rows = summary.spine(_orders(spark, sf_dir), views.HOPS, ["path"])
    c = rows.groupBy("path").agg(F.count("*").alias("positions"), F.count("dwell_ns").alias("observed"))
    return c.select("*", numeric.ppm(F.col("observed"), F.col("positions")).alias("coverage_ppm"))


@query
def undeclared_hops(spark, sf_dir):
    found = summary.undeclared_hops(views.hop_observations(spark, sf_dir), _orders(spark, sf_dir, False), 5)
    return found.groupBy("path", "hop_index").agg(F.count("*").alias("n"))


# ---- history and freshness ---------------------------------------------------------------------------------------------

HISTORY = summary.Request("1-URGENT", "gen.1997", 852_076_800 * 10**9, 883_612_800 * 10**9)  # the year 1997


@query
def history_buckets(spark, sf_dir):
    return summary.history(_orders(spark, sf_dir, False), HISTORY, 30 * DAY, dense=False)


@query
def history_dense(spark, sf_dir):
    r = summary.Request("1-URGENT", "gen.1997", Y1996, Y1999, "current")
    return summary.history(_orders(spark, sf_dir, False), r, 7 * DAY).select("bucket", "from_ns", "to_ns", "considered", "included", "conflicting", "unsupported", "stale", "state", "sum_ns", "mean_ns")


@query
def freshness_classes(spark, sf_dir):
    return _orders(spark, sf_dir, False).groupBy(ev.name_of(F.col("freshness"), ev.FRESHNESS).alias("freshness"), ev.usable(F.col("state"), F.col("freshness")).alias("usable")).agg(F.count("*").alias("n"))


@query
def evidence_merge(spark, sf_dir):
    o = _orders(spark, sf_dir, False)
    why = ev.reasons(F.when(F.col("state") == 4, "sequence_replay"), F.when(F.col("freshness") == 4, "freshness_unknown"), F.when(F.col("domain") != "reference", "clock_domain_missing"))
    m = o.groupBy("path", "generation").agg(ev.merged_state(F.col("state")).alias("s"), F.max("freshness").alias("f"), ev.merged_reasons(why).alias("r"))
    return m.select("path", "generation", ev.name_of(F.col("s"), ev.STATES).alias("state"), ev.name_of(F.col("f"), ev.FRESHNESS).alias("freshness"), F.array_join("r", ",").alias("reasons"))


# ---- clocks ------------------------------------------------------------------------------------------------------------


@query
def clock_latest(spark, sf_dir):
    return clocks.latest(views.clock_reports(spark, sf_dir, NOW))


def _pairs(spark, sf_dir):
    line = views.read(spark, sf_dir, "lineitem")
    s = F.col("l_suppkey")
    left = F.when(s % 10 == 9, "reference").otherwise(s.cast("string"))
    right = F.when(F.col("l_partkey") % 4 == 0, "reference").when(F.col("l_partkey") % 4 == 1, s.cast("string")).when(F.col("l_partkey") % 50 == 2, F.lit(None)).otherwise((s + 1).cast("string"))
    entry = F.col("l_orderkey") * 1_000_000
    return line.select("l_orderkey", "l_linenumber", left.alias("left_domain"), right.alias("right_domain"), entry.alias("entry_ns"), (entry + views.cents(F.col("l_extendedprice"))).alias("exit_ns"))


@query
def clock_compare(spark, sf_dir):
    c = clocks.compare(_pairs(spark, sf_dir), views.clock_reports(spark, sf_dir, NOW), F.lit(NOW))
    return c.groupBy("verdict", "reason", "confidence").agg(F.count("*").alias("n"), F.sum("uncertainty_ns").alias("uncertainty_ns"))


@query
def cross_domain_dwell(spark, sf_dir):
    c = clocks.compare(_pairs(spark, sf_dir), views.clock_reports(spark, sf_dir, NOW), F.lit(NOW), policy=Policy(max_clock_uncertainty_ns=3_000_000))
    return clocks.dwell(c).groupBy("dwell_state").agg(F.count("*").alias("n"), F.sum("dwell_ns").alias("dwell_ns"), F.sum("dwell_uncertainty_ns").alias("uncertainty_ns"))


@query
def clock_age(spark, sf_dir):
    readings = views.read(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 7 == 5, "reference").otherwise(F.col("s_suppkey").cast("string")).alias("domain"), "s_suppkey", (F.lit(NOW) - F.col("s_suppkey") * 1_000_000_000).alias("observed_at_ns"))
    return clocks.estimate_age(readings, views.clock_reports(spark, sf_dir, NOW), F.lit(NOW))


@query
def queue_dwell(spark, sf_dir):
    line = views.read(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    rows = line.select(
        F.when(k % 7 != 0, "q1").alias("hop_queue"), F.when(k % 5 == 0, F.lit(None)).when(k % 11 == 1, "q2").otherwise("q1").alias("queue"),
        F.when(k % 3 == 0, "hop_dwell").otherwise("hop_dwell|queue_dwell").alias("declared"), F.when(k % 13 != 4, F.col("l_orderkey")).alias("queue_entry_ns"),
        (F.col("l_orderkey") + F.col("l_quantity").cast("bigint") - 10).alias("queue_exit_ns"),
    )
    return clocks.queue_dwell(rows).groupBy("queue_state").agg(F.count("*").alias("n"), F.sum("queue_dwell_ns").alias("queue_dwell_ns"))


# ---- admission ---------------------------------------------------------------------------------------------------------


def _validated(spark, sf_dir):
    o = _orders(spark, sf_dir)
    k = F.col("exchange_id")
    records = o.select(
        "exchange_id", "path", "generation", "source", F.when(k % 17 != 3, "epoch.1").alias("epoch"), F.lit("inc.1").alias("incarnation"), (F.col("exchange_id") % 19).cast("int").alias("source_revision"),
        "domain", F.when(k % 23 == 0, "edge").otherwise("reference").alias("response_domain"), F.col("received_ns").alias("request_ns"), (F.col("received_ns") + F.when(k % 29 == 0, -F.col("rtt_ns")).otherwise(F.col("rtt_ns"))).alias("response_ns"),
        (F.col("rtt_ns") + F.when(k % 31 == 0, 1).otherwise(0)).alias("rtt_ns"), F.when(k % 37 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("hop_indexes"),
        (k % 41 != 0).alias("known_path"), (k % 43 != 0).alias("known_source"), (k % 47 != 0).alias("known_generation"),
    )
    return admission.validate(records)


@query
def validation_reasons(spark, sf_dir):
    return _validated(spark, sf_dir).select("exchange_id", F.array_join("reasons", ",").alias("reasons"), "rejected")


@query
def reason_histogram(spark, sf_dir):
    return admission.reason_counts(_validated(spark, sf_dir))


@query
def sequence_fence(spark, sf_dir):
    return admission.sequence_fence(_events(spark, sf_dir), ["source"]).select("exchange_id", "source", "sequence", "seen", "decision", "gap")


@query
def sequence_gaps(spark, sf_dir):
    f = admission.sequence_fence(_events(spark, sf_dir), ["source"]).where("gap > 0")
    return f.groupBy("source").agg(F.count("*").alias("gaps"), F.sum("gap").alias("skipped"))


@query
def replay_rejects(spark, sf_dir):
    f = admission.sequence_fence(_events(spark, sf_dir), ["source"])
    return f.groupBy("decision").agg(F.count("*").alias("n"))


@query
def session_fence(spark, sf_dir):
    return admission.session_fence(_events(spark, sf_dir)).select("exchange_id", "session", "session_current", "session_reason")


@query
def revision_fence(spark, sf_dir):
    f = admission.revision_fence(_events(spark, sf_dir), SESSION)
    return f.select("exchange_id", "revision_current", admission.registry_fence(F.col("source_revision"), F.lit(2)).alias("registry"))


def _generations(spark, sf_dir):
    years = _orders(spark, sf_dir, False).select("generation").distinct()
    year = F.substring("generation", 5, 4).cast("int")
    return years.select("generation", F.when(year > 1995, F.concat(F.lit("gen."), year - 1)).alias("supersedes"))


@query
def generation_fence(spark, sf_dir):
    o = _orders(spark, sf_dir, False)
    old = admission.superseded(_generations(spark, sf_dir)).select("generation", F.lit(True).alias("_old"))
    return o.join(old, "generation", "left").select("exchange_id", F.coalesce("_old", F.lit(False)).alias("historical"))


def _admitted(spark, sf_dir):
    return admission.admit(_events(spark, sf_dir), 2)


@query
def admission_verdicts(spark, sf_dir):
    return _admitted(spark, sf_dir).select("exchange_id", "decision", "gap", "session_current", "session_reason", "verdict")


@query
def admission_report(spark, sf_dir):
    return admission.report(_admitted(spark, sf_dir))


@query
def admission_bounds(spark, sf_dir):
    return admission.within_bounds(_events(spark, sf_dir), Policy(sessions_per_source=3, replay_window=20))


def _ingest_parts(spark, sf_dir):
    """Records of requests made of events, and the registry and clock reports that they meet."""
    k = F.col("exchange_id")
    e = _events(spark, sf_dir)
    entry, hop = F.col("received_ns"), lambda i, name: F.struct(F.lit(i).alias("index"), F.lit(name).alias("hop"))
    exit_ = entry + (k % 50 - 5) * 1000
    near, far = F.lit("reference"), (k % 100 + 1).cast("string")
    names = F.when(k % 73 == 0, F.array(hop(0, "h1"))).when(k % 79 == 0, F.array(hop(1, "h1"), hop(0, "h0"))).otherwise(F.array(hop(0, "h0"), hop(1, "h1")))
    hops = F.transform(
        names,
        lambda h: F.struct(
            h["index"].alias("index"), F.when((k + h["index"]) % 83 == 0, "hx").otherwise(h["hop"]).alias("hop"),
            F.when(k % 7 == 1, F.lit(None)).otherwise("q").alias("queue"), entry.alias("entry_ns"), F.when(k % 9 == 2, far).otherwise(near).alias("entry_domain"),
            exit_.alias("exit_ns"), near.alias("exit_domain"), (entry + 1).alias("queue_entry_ns"), F.when(k % 8 != 3, exit_ - 1).alias("queue_exit_ns"),
        ),
    )
    records = e.select(
        "exchange_id", "arrival", "path", F.when(k % 97 == 0, "g.9").when(k % 5 == 0, "g.1").otherwise("g.2").alias("generation"), F.col("source"),
        F.when(k % 61 != 0, F.col("epoch")).alias("epoch"), "incarnation", "source_revision", "sequence", near.alias("domain"), F.when(k % 67 == 0, "edge").otherwise(near).alias("response_domain"),
        F.col("received_ns").alias("request_ns"), (F.col("received_ns") + F.col("rtt_ns")).alias("response_ns"), (F.col("rtt_ns") + F.when(k % 71 == 0, 1).otherwise(0)).alias("rtt_ns"),
        "received_ns", F.when(k % 4 == 1, far).otherwise(near).alias("observed_at_domain"), (F.col("received_ns") - (k % 90 - 2) * 1_000_000_000).alias("observed_at_ns"),
        F.transform(hops, lambda h: h["index"]).alias("hop_indexes"), F.transform(hops, lambda h: h["hop"]).alias("hop_names"), hops.alias("hops"),
    )
    paths = e.select("path").distinct().where("path <> 'error'").select("path", F.lit("g.2").alias("generation"), F.array(F.lit("h0"), F.lit("h1")).alias("hops"))
    sources = e.select("source").distinct().where("source % 29 <> 0").select("source", (2 + F.col("source") % 2).cast("int").alias("revision"))
    generations = spark.range(1, 3).select(F.concat(F.lit("g."), "id").alias("generation"), F.when(F.col("id") == 2, "g.1").alias("supersedes"))
    defined = spark.range(2).select(F.concat(F.lit("h"), "id").alias("hop"), F.when(F.col("id") == 1, "q").alias("queue"), F.lit("hop_dwell|queue_dwell").alias("declared"))
    reports = views.clock_reports(spark, sf_dir, NOW).withColumn("valid_for_ns", F.when(F.col("valid_for_ns") > 1, F.lit(10**18)).otherwise(F.col("valid_for_ns")))
    return records, paths, sources, generations, defined, reports


@query
def ingest_verdicts(spark, sf_dir):
    records, paths, sources, generations, _, reports = _ingest_parts(spark, sf_dir)
    found = ingest.evidence_names(ingest.ingest(records, paths, sources, generations, reports))
    return found.select("exchange_id", F.array_join("reasons", ",").alias("reasons"), "state", "freshness", "age_ns", "decision", "gap", "session_current", "verdict")


@query
def ingest_hop_dwells(spark, sf_dir):
    records, *_, defined, reports = _ingest_parts(spark, sf_dir)
    made = ingest.hop_dwells(records, defined, reports, Policy(max_clock_uncertainty_ns=3_000_000))
    flat = made.select("arrival", F.explode("hops").alias("hop_index", "h")).select("arrival", "hop_index", "h.*")
    return flat.select("arrival", "hop_index", "dwell_ns", "queue_dwell_ns", "uncertainty_ns", ev.name_of(F.col("state"), ev.STATES).alias("state"), "reason")


# ---- baselines ---------------------------------------------------------------------------------------------------------


def _baselines(spark, sf_dir):
    return baseline.create(_orders(spark, sf_dir, False), "yearly", F.lit(NOW - 5_000_000_000))


@query
def baseline_create(spark, sf_dir):
    return _baselines(spark, sf_dir)


@query
def baseline_add(spark, sf_dir):
    every = _baselines(spark, sf_dir)
    return baseline.add(every.where("generation < 'gen.1998'"), every).select("path", "generation", "domain", "n")


@query
def baseline_latest(spark, sf_dir):
    b = _baselines(spark, sf_dir).where("path <> '5-LOW' or generation < 'gen.1997'").drop("baseline_id")
    b = b.withColumn("baseline_id", F.concat_ws("/", "path", "generation", "domain"))
    return baseline.latest(b, generation="gen.1997").select("path", "domain", "baseline_id", "n", "mean_ns", "other_generation_only")


def _once(df: DataFrame) -> DataFrame:
    """A small result computed once into the shared folder, for a query that reads it several times."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _compared(spark, sf_dir):
    now = _once(summary.summarize(_orders(spark, sf_dir, False), ["path", "generation", "domain"], ((99, 100),)))
    stored = baseline.of_statistics(now, "yearly", F.lit(NOW - 5_000_000_000))
    named = stored.where("generation = 'gen.1996'").select("baseline_id", F.col("path").alias("_p"), F.col("domain").alias("_d"))
    pairs = now.join(named, (F.col("path") == F.col("_p")) & (F.col("domain") == F.col("_d")), "left").withColumn("baseline_id", F.when(F.col("generation") != "gen.1999", F.col("baseline_id")))
    pairs = pairs.withColumn("generation", F.when(F.col("generation") == "gen.1997", "gen.1996").otherwise(F.col("generation")))
    own = pairs.select("path", "generation", "domain", "n", "min_ns", "max_ns", "mean_ns", "p99", "baseline_id")
    return baseline.compare(own, stored, "baseline_id", F.lit(NOW), Policy(watch_ns=100, elevated_ns=100_000))


@query
def baseline_compare(spark, sf_dir):
    return _compared(spark, sf_dir).withColumn("mismatches", F.array_join("mismatches", ",")).drop("baseline_id")


@query
def baseline_mismatches(spark, sf_dir):
    return baseline.mismatch_rows(_compared(spark, sf_dir), ["path"]).groupBy("path", "mismatch").agg(F.count("*").alias("n"))


@query
def anomaly_classes(spark, sf_dir):
    both = _orders(spark, sf_dir).where(F.col("generation").isin("gen.1998", "gen.1997"))
    hops = _once(summary.hop_summary(both, ["generation", "path"], views.HOPS).select("generation", "path", "hop_index", F.col("observed").alias("n"), "mean_ns"))
    of = lambda g: hops.where(F.col("generation") == g)
    return baseline.anomalies(of("gen.1998"), of("gen.1997"), ["path", "hop_index"], Policy(watch_ns=20_000, elevated_ns=200_000))


# ---- attribution -------------------------------------------------------------------------------------------------------


@query
def attribution_exchanges(spark, sf_dir):
    return attribution.accounts(_orders(spark, sf_dir), 2, ["exchange_id", "path"])


@query
def attribution_hops(spark, sf_dir):
    return attribution.hop_contributions(_orders(spark, sf_dir), 3, ["path"])


def _attributed(spark, sf_dir, policy):
    a = attribution.accounts(_orders(spark, sf_dir), 2, ["path", "generation", "domain", "source"])
    found = attribution.verdict(a, ["path", "generation"], policy, clocks_refused=(F.col("domain") != "reference") & (F.col("generation") == "gen.1998"), supported=F.col("source") == "src.3")
    return found.drop("clocks_refused")


@query
def attribution_verdict(spark, sf_dir):
    return _attributed(spark, sf_dir, DEFAULT)


@query
def attribution_partial(spark, sf_dir):
    return _attributed(spark, sf_dir, Policy(allow_partial=True, residual_tolerance_ns=5_000_000))


Y1992 = 694_224_000 * 10**9
PAIRED = ["path", "generation"]


def _gated(spark, sf_dir):
    """Orders whose hops name entry clocks, evidence and uncertainties, gated by the reports of the clocks."""
    k = F.col("exchange_id")
    far = F.when(F.col("generation") == "gen.1994", (k % 100 + 1).cast("string")).when(F.col("generation") == "gen.1997", "4")

    def hop(i, h):
        known = (k + i) % 41 != 5
        return F.struct(
            F.when(known, h["dwell_ns"]).alias("dwell_ns"),
            h["queue_dwell_ns"].alias("queue_dwell_ns"),
            F.when((k + i) % 5 == 2, F.coalesce(far, F.col("domain"))).otherwise(F.col("domain")).alias("entry_domain"),
            F.when(known, 0).when(F.col("generation") == "gen.1996", 7).otherwise(6).alias("state"),
            F.when(~known & (F.col("generation") == "gen.1995"), "clock_unsynced").alias("reason"),
            (k % 7 * 10 + i).alias("uncertainty_ns"),
        )

    domain = F.when(F.col("generation") != "gen.1993", "reference").otherwise(F.col("domain"))
    o = _orders(spark, sf_dir).where("state = 0").withColumn("domain", domain).withColumn("hops", F.transform_values("hops", hop))
    reports = views.clock_reports(spark, sf_dir, Y1992).withColumn("valid_for_ns", F.when(F.col("valid_for_ns") > 1, F.lit(10**18)).otherwise(F.col("valid_for_ns")))
    return attribution.gates(o, reports, 2)


def _accounted(spark, sf_dir):
    return attribution.gated_accounts(_gated(spark, sf_dir), 2, ["exchange_id", *PAIRED, "source"])


def _judged():
    return {"policy": Policy(allow_partial=True), "clocks_refused": F.col("clocks_refused"), "supported": F.col("source") == "src.3"}


@query
def attribution_gates(spark, sf_dir):
    g = _accounted(spark, sf_dir)
    return g.select("exchange_id", F.array_join("clock_reasons", ",").alias("clock_reasons"), F.array_join("gated_hops", ",").alias("gated_hops"), "clocks_refused", "complete", "residual_ns")


@query
def attribution_distributions(spark, sf_dir):
    return attribution.distributions(_accounted(spark, sf_dir), 2, PAIRED, ((50, 100), (99, 100))).drop("sum_overflow")


@query
def attribution_contributions(spark, sf_dir):
    return attribution.gated_contributions(_accounted(spark, sf_dir), 2, PAIRED, **_judged())


@query
def attribution_reasons(spark, sf_dir):
    return attribution.verdict_reasons(_accounted(spark, sf_dir), PAIRED, **_judged()).withColumn("reasons", F.array_join("reasons", ","))


# ---- export, identity, registry, recovery ------------------------------------------------------------------------------


@query
def provenance(spark, sf_dir):
    return export.provenance(summary.included(_orders(spark, sf_dir, False), REQUEST))


@query
def export_samples(spark, sf_dir):
    return export.digest(export.json_rows(_orders(spark, sf_dir), views.HOPS), "exchange_id", "sample")


@query
def export_csv_pivot(spark, sf_dir):
    return export.csv_rows(_orders(spark, sf_dir), 3)


@query
def export_limit_accounting(spark, sf_dir):
    return export.accounting(_orders(spark, sf_dir, False), ["path", "generation"], 400)


@query
def identity_fnv(spark, sf_dir):
    return views.read(spark, sf_dir, "part").select("p_partkey", identity.fnv1a64(F.concat_ws("|", "p_name", "p_brand", "p_partkey")).alias("identity"))


@query
def identity_crc32c(spark, sf_dir):
    return views.read(spark, sf_dir, "part").select("p_partkey", identity.crc32c(F.concat_ws("|", "p_name", "p_brand", "p_partkey")).alias("crc"))


@query
def integer_roots(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") + F.col("o_custkey") % 5 - 2  # beside and on squares
    return views.read(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), numeric.isqrt(n).alias("root"))


@query
def synthetic_exchanges(spark, sf_dir):
    e = synthetic.exchanges(spark, 5_000, 42)
    return e.select("sequence", "request_ns", "response_ns", *[F.get("dwells", F.lit(i)).alias(f"hop{i}_dwell_ns") for i in range(3)])


@query
def identity_hex(spark, sf_dir):
    h = identity.hex_id(F.col("event_id") * 1_000_003 - 5_000_015)
    e = views.read(spark, sf_dir, "events").select("event_id", h.alias("hex"))
    return e.select("event_id", "hex", identity.parse_hex_id(F.col("hex")).alias("number"))


@query
def format_utc(spark, sf_dir):
    # Up to 246 years are taken off, for instants before 1970; a BIGINT holds that for any event_id and a ts of 1925 to 2261.
    ns = F.try_subtract(views.nanos(F.col("ts")), F.pmod(F.col("event_id"), F.lit(10_007)) * 777_000_000_777_001)
    e = views.read(spark, sf_dir, "events").select("event_id", ns.alias("ns"))
    t = e.select("event_id", "ns", identity.format_utc(F.col("ns")).alias("text"))
    return t.select("*", identity.parse_utc(F.col("text")).alias("parsed"))


@query
def name_validation(spark, sf_dir):
    p = views.read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("-"), "p_brand")).otherwise(F.col("p_brand")).alias("name"))
    s = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("+"), F.col("p_partkey"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.col("p_partkey"), F.lit("99999999999999999"))).otherwise(F.col("name"))
    number = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))
    return p.select("p_partkey", "name", identity.valid_name(F.regexp_replace("name", "#", ":")).alias("valid"), number.alias("number"))


@query
def catalog_lineage(spark, sf_dir):
    return catalog.lineage(_generations(spark, sf_dir))


def _definitions(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select((F.col("o_custkey") % 50).cast("string").alias("name"), (1 + k % 4).cast("int").alias("revision"), F.concat(F.lit("v"), k % 3).alias("content"), k.alias("arrival"))


@query
def catalog_upsert(spark, sf_dir):
    return catalog.upsert(_definitions(spark, sf_dir))


@query
def catalog_held(spark, sf_dir):
    return catalog.held(_definitions(spark, sf_dir))


@query
def catalog_dangling(spark, sf_dir):
    return catalog.dangling(_generations(spark, sf_dir).where("generation <> 'gen.1997'"), "supersedes", _generations(spark, sf_dir).where("generation <> 'gen.1997'"), "generation")


@query
def recovery_prefix(spark, sf_dir):
    log = views.read(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("segment"), (F.col("event_id") % 100).alias("position"), "value")
    return store.recovery_report(log, (F.col("value") > 100) & (F.col("position") > 50) & (F.col("segment") > 4))


@query
def ingest_requests(spark, sf_dir):
    e = views.read(spark, sf_dir, "events")
    k, c = F.col("event_id"), lambda v: F.coalesce(v.cast("string"), F.lit("null"))
    q = lambda v: F.concat(F.lit('"'), v.cast("string"), F.lit('"'))
    record = F.concat(
        F.lit('{"path":'), q(F.col("event_type")), F.lit(',"generation":"g","source":'), q(F.col("user_id")), F.lit(',"epoch":"e","incarnation":"i","source_revision":1,"sequence":'), c(k), F.lit(',"domain":"reference","request_ns":'), c(k),
        F.when(k % 9 == 4, F.lit("")).otherwise(F.concat(F.lit(',"response_ns":'), c(k + 5))), F.lit(',"observed_at_ns":1,"observed_at_domain":"reference","hops":[{"index":0,"entry_ns":1,"exit_ns":3}]}'),
    )
    document = F.concat(F.lit('{"op":"'), F.when(k % 9 == 5, "explode").otherwise("ingest"), F.lit('","records":['), F.when(k % 9 == 6, F.concat(record, F.lit(","), record)).otherwise(record), F.when(k % 9 == 7, F.lit("")).otherwise(F.lit("]}")))
    rows = store.decode_requests(e.select("event_id", document.alias("value")))
    return rows.select("event_id", "ok", "error", F.col("record.path").alias("path"), (F.col("record.response_ns") - F.col("record.request_ns")).alias("rtt_ns"))


@query
def capabilities(spark, sf_dir):
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("capability"), F.lit(s).alias("status")) for c, s in service.CAPABILITIES]))
    return spark.range(1).select(rows)


# ---- evidence as a value, texts, documents --------------------------------------------------------------------------


def _evidence(k):
    """One kind of evidence for each remainder of a number."""
    out = ev.observed(k % 5, k % 3, "evidence_fresh")
    for i, kind in enumerate(ev.KINDS):
        out = F.when(k % 9 == i, ev.evidence(kind, f"why_{i}", "also")).otherwise(out)
    return out


@query
def evidence_values(spark, sf_dir):
    k = F.col("exchange_id")
    o = _orders(spark, sf_dir, False).select("exchange_id", _evidence(k).alias("a"), _evidence(k + 4).alias("b"))
    both = ev.merge(F.col("a"), F.col("b"))
    parsed = ev.rank_of(F.when(k % 10 == 0, "no such state").otherwise(ev.name_of(F.col("a.state"), ev.STATES)), ev.STATES)
    return o.select("exchange_id", ev.summarize(F.col("a")).alias("text"), ev.summarize(both).alias("merged"), ev.has_value(F.col("a.state")).alias("has_value"), parsed.alias("parsed"))


@query
def evidence_rollup(spark, sf_dir):
    o = _orders(spark, sf_dir, False).where("exchange_id % 9 > 6 or exchange_id % 9 < 3 and path < '3'")
    m = o.select("path", "generation", _evidence(F.col("exchange_id")).alias("e")).groupBy("path", "generation").agg(ev.merged(F.col("e")).alias("m"))
    return m.select("path", "generation", ev.summarize(F.col("m")).alias("text"))


@query
def number_parsing(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("+"), k)).when(k % 5 == 1, F.concat(k, F.lit("99999999999999999"))).when(k % 5 == 2, F.concat(F.lit("-"), k)).when(k % 5 == 3, F.concat(k, F.lit(" "))).otherwise(k.cast("string"))
    p = views.read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    signed = numeric.parse_i64(F.col("text"))
    return p.select("p_partkey", "text", signed.alias("signed"), numeric.parse_u64(F.col("text")).cast("string").alias("unsigned"), numeric.successor(signed, 1500).alias("next"))


@query
def coverage_texts(spark, sf_dir):
    h = summary.hop_summary(_orders(spark, sf_dir), ["path"], views.HOPS)
    return h.select("path", "hop_index", numeric.coverage_text(F.col("observed"), F.col("exchanges")).alias("coverage"))


@query
def histogram_spec(spark, sf_dir):
    return spark.range(1).select(F.lit(bounds_digest(default_bounds())).alias("digest"), F.lit(len(default_bounds())).alias("bounds"))


@query
def restart_reclassified(spark, sf_dir):
    k = F.col("exchange_id")
    e = _events(spark, sf_dir).where(F.col("received_ns") < JAN5)
    stored = e.select("exchange_id", F.when(k % 4 == 1, (k % 100 + 1).cast("string")).otherwise("reference").alias("observed_at_domain"), (F.col("received_ns") + (k % 7) * 1_000_000_000).alias("observed_at_ns"), F.when(k % 3 == 0, 4).otherwise(0).alias("state"))
    reports = views.clock_reports(spark, sf_dir, NOW).withColumn("valid_for_ns", F.when(F.col("valid_for_ns") > 1, F.lit(10**18)).otherwise(F.col("valid_for_ns")))
    found = ingest.reclassified(stored, reports, F.lit(JAN5), Policy(stale_ns=86_400 * 10**9))
    return found.select("exchange_id", ev.name_of(F.col("freshness"), ev.FRESHNESS).alias("freshness"), F.array_join("restart_reasons", ",").alias("reasons"))


@query
def provenance_sources(spark, sf_dir):
    kinds = spark.range(6).select(F.concat(F.lit("src."), "id").alias("source"), F.when(F.col("id") % 2 == 0, "probe").otherwise("agent").alias("source_kind"), F.lit("primary").alias("authority"))
    return export.provenance_of(summary.included(_orders(spark, sf_dir, False), REQUEST), kinds)


@query
def export_fixed_columns(spark, sf_dir):
    k = F.col("exchange_id")
    o = _orders(spark, sf_dir).withColumns({"epoch": F.concat(F.lit("e"), k % 3), "incarnation": F.lit("i"), "sequence": k, "observed_at_ns": F.col("observed_ns"), "observed_at_domain": F.col("domain"), "received_at_ns": F.col("received_ns"), "confidence": (k % 5).cast("int")})
    return export.sample_rows(o, views.hops_of_orders(spark, sf_dir))


@query
def export_document(spark, sf_dir):
    samples = export.json_rows(_orders(spark, sf_dir), views.HOPS)
    return export.document(samples, "exchange_id", "sample", 400)


@query
def summary_json(spark, sf_dir):
    return export.json_text(summary.summarize(_events(spark, sf_dir), ["path"], ((50, 100),)).drop("sum_overflow"), "path")


@query
def anomalies_and_total(spark, sf_dir):
    both = _orders(spark, sf_dir).where(F.col("generation").isin("gen.1998", "gen.1997"))
    hops = _once(summary.hop_summary(both, ["generation", "path"], 3).select("generation", "path", "hop_index", F.col("observed").alias("n"), "mean_ns"))
    whole = _once(summary.summarize(_orders(spark, sf_dir, False), ["generation", "path"], ()).select("generation", "path", "n", "mean_ns"))
    of = lambda df, g: df.where(F.col("generation") == g).drop("generation")
    return baseline.anomalies_with_total(of(hops, "gen.1998"), of(hops, "gen.1997"), of(whole, "gen.1998"), of(whole, "gen.1997"), ["path"], Policy(watch_ns=20_000, elevated_ns=200_000))


@query
def baseline_shapes(spark, sf_dir):
    stats = _once(summary.summarize(_orders(spark, sf_dir, False), ["path", "generation", "domain"], ((99, 100),)))
    spec, k = bounds_digest(default_bounds()), F.substring("generation", 8, 1).cast("int")
    stored = baseline.of_statistics(stats, "yearly", F.lit(NOW)).withColumns({"histogram": F.lit(spec), "probes": F.lit("99/100")})
    named = stored.select("baseline_id", "path", "generation", "domain")
    now = stats.join(named, ["path", "generation", "domain"]).withColumns({"histogram": F.when(k % 2 == 0, spec).otherwise("other"), "probes": F.when(k % 3 == 0, "50/100").otherwise("99/100")})
    own = now.select("path", "generation", "domain", "n", "min_ns", "max_ns", "mean_ns", "p99", "baseline_id", "histogram", "probes")
    found = baseline.compare(own, stored, "baseline_id", F.lit(NOW))
    return found.select("path", "generation", "domain", F.array_join("mismatches", ",").alias("mismatches"), "applicable", "p99_delta_ns")


# ---- streams -----------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tracewell-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _streamed(spark, sf_dir):
    schema = views.read(spark, sf_dir, "events").schema
    events, folder = fences.table_stream(spark, sf_dir, "events", schema), _folder(spark)
    return fences.run_to_table(fences.admit_stream(views.event_columns(events), 2), f"{folder}/out", f"{folder}/state")


@query
def stream_fence(spark, sf_dir):
    return _streamed(spark, sf_dir).select("exchange_id", "decision", "gap", "session_current", "session_reason", "verdict")


@query
def stream_admission(spark, sf_dir):
    return fences.decision_counts(_streamed(spark, sf_dir))


ORACLES = oracles.ALL | oracles_gates.ALL | oracles_ingest.ALL | oracles_values.ALL
__all__ = ["ORACLES", "PROBES", "QUERIES"]
