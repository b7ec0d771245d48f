"""Ingest as one operator: records of requests, joined with the registry, checked, timed, fenced, and given a verdict.

The dimensions (paths, sources, generations, clock reports) are broadcast up to a counted size and else shuffled, as most
records may have one path, generation or clock; definitions of hops are joined by Spark's own choice of join. A record that
fails a structural check is rejected before the fences, so it uses up no sequence and opens no session. The fences order blocks
of a source's arrivals, not whole sources. A source that :func:`admission.within_bounds` names is for ``tracewell.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.evidence import FRESHNESS, STATES, freshness, name_of, usable
from ..functions.lookup import looked_up
from ..plans.policy import DEFAULT, Policy
from . import admission, clocks

#: The reason that tells each freshness.
FRESHNESS_REASONS = ("evidence_fresh", "evidence_aging", "evidence_stale", "evidence_expired", "freshness_unknown")
#: The evidence state that a verdict on clocks amounts to.
CLOCK_STATES = {clocks.OK: "observed", clocks.UNKNOWN: "unknown", clocks.CONFLICTING: "conflicting", clocks.REFUSED: "refused", clocks.STALE: "stale"}


def _rank(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), state).cast("int") - 1


def attach_registry(records: DataFrame, paths: DataFrame, sources: DataFrame, generations: DataFrame) -> DataFrame:
    """records with known_path, known_source, known_generation, path_generation, path_hops, registered_revision, superseded.

    paths (path, generation, hops), sources (source, revision), generations (generation, supersedes): one row for each name.
    """
    p = paths.select(F.col("path").alias("_name"), F.col("generation").alias("path_generation"), F.col("hops").alias("path_hops"), F.lit(True).alias("_path"))
    s = sources.select(F.col("source").alias("_name"), F.col("revision").alias("registered_revision"), F.lit(True).alias("_source"))
    old = admission.superseded(generations).select("generation", F.lit(True).alias("_old"))
    g = generations.select("generation").join(old, "generation", "left").select(F.col("generation").alias("_name"), F.lit(True).alias("_known"), F.coalesce("_old", F.lit(False)).alias("_old"))
    out = records
    for key, named in (("path", p), ("source", s), ("generation", g)):
        out = looked_up(out, named, key, "_name")
    known = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        *records.columns, known("_path").alias("known_path"), known("_source").alias("known_source"), known("_known").alias("known_generation"),
        "path_generation", "path_hops", "registered_revision", known("_old").alias("superseded"),
    )


def timed(records: DataFrame, reports: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """records with age_ns, freshness and state (ranks): how old each reading was on receipt, by the reference clock."""
    age = clocks.estimate_age(records, reports, F.col("received_ns"), "observed_at_domain", "observed_at_ns", policy)
    state = F.lit(5)
    for verdict, name in CLOCK_STATES.items():
        state = F.when(F.col("verdict") == verdict, STATES.index(name)).otherwise(state)
    return age.select(*records.columns, "age_ns", freshness(F.col("age_ns"), policy).alias("freshness"), state.alias("state"))


def hop_dwells(records: DataFrame, hops: DataFrame, reports: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """arrival, hops: for each record a map from position to dwell_ns, queue_dwell_ns, uncertainty_ns, entry_domain, state, reason.

    hops (hop, queue, declared): the definitions. A dwell across clocks needs a comparable pair of them, and so does that of the
    hop's queue, whose entry is on the clock of the hop's entry and whose exit on that of its exit.
    """
    bound = [c for c in clocks.BINDINGS if c in records.columns]
    rows = records.select("arrival", "received_ns", *bound, F.explode("hops").alias("_h")).select("arrival", "received_ns", *bound, "_h.*")
    defined = hops.select("hop", F.col("queue").alias("hop_queue"), "declared", F.lit(True).alias("_known"))
    met = clocks.compare(rows.join(defined, "hop", "left"), reports, F.col("received_ns"), "entry_domain", "exit_domain", policy)
    met = clocks.queue_dwell(clocks.dwell(met), across=True)
    known = F.coalesce("_known", F.lit(False))
    state = F.when(~known, "unsupported").otherwise(F.col("dwell_state"))
    reason = (
        F.when(~known, "unknown_hop").when(F.col("dwell_state") == "observed", None)
        .when(F.col("verdict") == clocks.OK, F.when(F.col("dwell_state") == "conflicting", "hop_out_of_order").otherwise("incomparable_clocks")).otherwise(F.col("reason"))
    )
    own = F.struct(
        F.when(known, F.col("dwell_ns")).alias("dwell_ns"), F.when(known, F.col("queue_dwell_ns")).alias("queue_dwell_ns"),
        F.when(known, F.col("dwell_uncertainty_ns")).alias("uncertainty_ns"), "entry_domain", _rank(state).alias("state"), reason.alias("reason"),
    )
    return met.groupBy("arrival").agg(F.map_from_entries(F.collect_list(F.struct(F.col("index"), own))).alias("hops"))


def ingest(records: DataFrame, paths: DataFrame, sources: DataFrame, generations: DataFrame, reports: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """records with reasons (sorted), state, freshness, age_ns, decision, gap, session, session_current and verdict.

    In order: the registry; structure; age; then generation, session, revision and sequence; the registered revision of the
    record's own source; and last, what is current but not usable becomes history.
    """
    known = timed(attach_registry(records, paths, sources, generations), reports, policy)
    checked = admission.validate(known).withColumnRenamed("rejected", "_fatal").withColumnRenamed("reasons", "_structure")
    late = (F.col("generation") != F.col("path_generation")) | F.col("superseded")
    fresh = usable(F.col("state"), F.col("freshness"))
    out = admission.admit(checked, F.col("registered_revision"), fresh, fatal=F.col("_fatal"), late=late)
    told = ~F.col("_fatal")
    replay = told & (F.col("decision") == "replay")
    newer = F.col("session_reason") == "session_superseded"
    told_reasons = [
        F.when(late, "generation_superseded"),
        F.when(F.col("session_reason").isin("epoch_advanced", "incarnation_changed"), F.col("session_reason")),
        F.when(newer, F.when(F.col("newest_epoch") != F.col("epoch"), "epoch_replayed").otherwise("incarnation_replayed")),
        F.when(F.col("session_reason").isNotNull() & ~newer & (F.col("session") > policy.sessions_per_source), "session_evicted"),
        F.when(~F.col("revision_current") | F.col("revision_advanced") | (F.col("source_revision") != F.col("registered_revision")), "revision_changed"),
        F.when(F.col("gap") > 0, "sequence_gap"), F.when(F.col("decision") == "reordered", "sequence_reordered"), F.when(replay, "sequence_replay"),
    ]
    aged = F.get(F.array(*map(F.lit, FRESHNESS_REASONS)), F.col("freshness"))
    first = F.exists("_structure", lambda r: r.isin("unknown_path", "unknown_source", "unknown_generation"))
    found = F.array_compact(F.array(F.when(~first, aged), *[F.when(told, r) for r in told_reasons]))
    conflict = F.col("_fatal") | replay | (F.col("source_revision") > F.col("registered_revision"))
    state = F.when(conflict, F.greatest(F.lit(STATES.index("conflicting")), F.when(first, F.lit(0)).otherwise(F.col("state")))).otherwise(F.col("state"))
    reasons = F.array_sort(F.array_distinct(F.concat(F.col("_structure"), found)))
    return out.select(
        *records.columns, reasons.alias("reasons"), state.alias("state"), F.when(replay | first, FRESHNESS.index("unknown")).otherwise(F.col("freshness")).alias("freshness"), "age_ns",
        *[F.when(told, F.col(c)).alias(c) for c in ("decision", "gap", "session", "session_current")], "verdict",
    )


def from_documents(decoded: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Records as of :func:`ingest` from decoded documents (received_at_ns, record), in the documents' order.

    A missing round trip is response less request; a missing time of receipt is the time of the reading.
    """
    flat = decoded.select("received_at_ns", "record.*")
    return flat.select(
        F.monotonically_increasing_id().alias("arrival"), "path", "generation", "source", "epoch", "incarnation", "source_revision", "sequence", "domain",
        F.col("domain").alias("response_domain"), "request_ns", "response_ns", F.coalesce("rtt_ns", F.try_subtract("response_ns", "request_ns")).alias("rtt_ns"),
        F.coalesce("received_at_ns", "observed_at_ns").alias("received_ns"), "observed_at_domain", "observed_at_ns", F.col("observed_at_ns").alias("observed_ns"),
        F.coalesce(F.transform("hops", lambda h: h["index"]), F.array()).alias("hop_indexes"), F.coalesce(F.transform("hops", lambda h: h["hop"]), F.array()).alias("hop_names"), "hops",
    )


def reclassified(records: DataFrame, reports: DataFrame, as_of_ns: Column, policy: Policy = DEFAULT) -> DataFrame:
    """Stored records (observed_at_domain, observed_at_ns, state) with the freshness and reasons they have after a restart.

    A restart never makes what is past current: ages are taken anew at ``as_of_ns``; times and states stay.
    """
    aged = clocks.estimate_age(records.drop("freshness"), reports, as_of_ns, "observed_at_domain", "observed_at_ns", policy)
    fresh = freshness(F.col("age_ns"), policy)
    stale = F.when((F.col("state") == 0) & ~usable(F.col("state"), fresh), "evidence_stale")
    reasons = F.array_compact(F.array(stale, F.lit("restart_loaded_evidence")))
    return aged.select(*[c for c in records.columns if c != "freshness"], fresh.alias("freshness"), reasons.alias("restart_reasons"))


def evidence_names(rows: DataFrame) -> DataFrame:
    """rows with state and freshness as names."""
    return rows.withColumns({"state": name_of(F.col("state"), STATES), "freshness": name_of(F.col("freshness"), FRESHNESS)})
