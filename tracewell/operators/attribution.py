"""Attribution: end-to-end time decomposed into hops, with what no hop accounts for. Never a statement about causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import distribution, fits, floor_div, ppm, wide_sum
from ..plans.policy import DEFAULT, PROBES, Policy
from . import clocks
from .summary import spine

#: Reasons that say that a comparison across clocks was impossible, refused or contradictory.
CLOCK_REASONS = (
    "incomparable_clocks", "clock_offset_unavailable", "clock_unsynced", "clock_sync_expired", "clock_uncertainty_exceeded",
    "clock_reference_mismatch", "clock_domain_missing",
)


def gates(exchanges: DataFrame, reports: DataFrame, hops: int, policy: Policy = DEFAULT) -> DataFrame:
    """exchanges with clock_reasons (sorted), gated_hops (sorted positions) and clocks_refused: what its clocks don't permit.

    ``hops`` of an exchange hold entry_domain, state (rank) and reason beside the dwells. The exchange's own domain must be
    comparable with the reference, and the entry domain of each hop with a dwell with the exchange's, at the time of receipt.
    A hop without a dwell whose evidence is refused, conflicting or a clock's counts as a refusal too.

    Only pairs of different domains are looked up, and only what fails is joined back to its exchange.
    """
    hop = lambda i: F.try_element_at("hops", i)
    pair = lambda i, left, right: F.struct(i.cast("int").alias("index"), left.alias("left_domain"), right.alias("right_domain"))
    places = F.sequence(F.lit(0), F.lit(hops - 1))
    timed = F.filter(places, lambda i: hop(i)["dwell_ns"].isNotNull())
    pairs = F.concat(
        F.array(pair(F.lit(-1), F.col("domain"), F.lit(policy.reference_domain))),
        F.transform(timed, lambda i: pair(i, hop(i)["entry_domain"], F.col("domain"))),
    )
    apart = F.filter(pairs, lambda p: ~p["left_domain"].eqNullSafe(p["right_domain"]))
    bound = [c for c in clocks.BINDINGS if c in exchanges.columns]
    asked = exchanges.select("exchange_id", "received_ns", *bound, F.explode(apart).alias("_p")).select("exchange_id", "received_ns", *bound, "_p.*")
    failed = clocks.compare(asked, reports, F.col("received_ns"), policy=policy).where(F.col("verdict") != clocks.OK)
    failed = failed.groupBy("exchange_id").agg(
        F.sort_array(F.collect_set("reason")).alias("clock_reasons"),
        F.sort_array(F.collect_set(F.when(F.col("index") >= 0, F.col("index")))).alias("gated_hops"),
    )
    out = exchanges.join(failed, "exchange_id", "left")
    blocked = F.filter(places, lambda i: hop(i).isNotNull() & hop(i)["dwell_ns"].isNull())
    told = F.exists(blocked, lambda i: hop(i)["state"].isin(4, 7) | F.coalesce(hop(i)["reason"].isin(*CLOCK_REASONS), F.lit(False)))
    refused = F.col("clock_reasons").isNotNull() | F.coalesce(F.col("hops").isNotNull() & told, F.lit(False))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return out.select(
        *exchanges.columns,
        F.coalesce("clock_reasons", none("string")).alias("clock_reasons"),
        F.coalesce("gated_hops", none("int")).alias("gated_hops"),
        refused.alias("clocks_refused"),
    )


def gated_accounts(gated: DataFrame, hops: int, keep: list[str]) -> DataFrame:
    """:func:`accounts` of gated exchanges, of which one with any failed comparison is not complete; overflowed tells sums that don't fit.

    Keeps clock_reasons, gated_hops, clocks_refused, hops and exchange_id too.
    """
    own = ["clock_reasons", "gated_hops", "clocks_refused", "hops"]
    rows = accounts(gated, hops, [*keep, *own])
    free = F.size("clock_reasons") == 0
    whole = F.col("complete") & free
    overflowed = free & (F.col("known_hops") == hops) & (F.col("rtt_ns") >= 0) & ~F.col("complete")
    return rows.select(
        *keep, *own, "rtt_ns", "known_hops", F.when(whole, F.col("accounted_ns")).alias("accounted_ns"),
        F.when(whole, F.col("residual_ns")).alias("residual_ns"), whole.alias("complete"), overflowed.alias("overflowed"),
    )


def distributions(accounted: DataFrame, hops: int, keys: list[str], probes=PROBES) -> DataFrame:
    """keys, measure (end_to_end, residual, dwell, queue_dwell), hop_index (-1 for the whole) and the exact distribution over
    complete exchanges (of :func:`gated_accounts`)."""
    value = lambda name, i, v: F.struct(F.lit(name).alias("measure"), i.cast("int").alias("hop_index"), v.cast("bigint").alias("value"))
    whole = F.array(value("end_to_end", F.lit(-1), F.col("rtt_ns")), value("residual", F.lit(-1), F.col("residual_ns")))
    places = F.sequence(F.lit(0), F.lit(hops - 1))
    of = lambda name, field: F.transform(places, lambda i: value(name, i, F.try_element_at("hops", i)[field]))
    own = [of("dwell", "dwell_ns"), of("queue_dwell", "queue_dwell_ns")]
    rows = accounted.where("complete").select(*keys, F.explode(F.concat(whole, *own)).alias("_v")).select(*keys, "_v.*")
    return distribution(rows, [*keys, "measure", "hop_index"], "value", probes)


def _hop_sums(hops: int) -> Column:
    """For each position what :func:`gated_contributions` tells of it, summed: an aggregate of rows of :func:`gated_accounts`."""

    def at(i: int) -> Column:
        hop = F.try_element_at("hops", F.lit(i))
        free = ~F.array_contains("gated_hops", i)
        own, queue = (F.when(F.col("complete"), hop[c]) for c in ("dwell_ns", "queue_dwell_ns"))
        return F.struct(
            F.lit(i).alias("hop_index"), F.count(own).alias("observed"), F.count_if(hop["dwell_ns"].isNull()).alias("missing"), wide_sum(own).alias("_s"), wide_sum(queue).alias("_q"),
            F.count(queue).alias("_nq"), F.max(F.when(free & hop["dwell_ns"].isNotNull(), hop["uncertainty_ns"])).alias("uncertainty_ns"),
        )

    return F.array(*[at(i) for i in range(hops)])


def gated_contributions(accounted: DataFrame, hops: int, keys: list[str], policy: Policy = DEFAULT, clocks_refused: Column | None = None, supported: Column | None = None) -> DataFrame:
    """keys, hop_index, observed, missing, sums, means, uncertainty_ns, coverage_ppm, share_ppm, hop_state of each position.

    observed counts complete exchanges, missing those without a dwell; the uncertainty is the largest of any dwell that its
    clocks permit. A refused or unsupported verdict publishes no share. The rows are read once, for the verdict
    too; a group whose keys aren't all known has no contributions.
    """
    by = verdict(accounted, keys, policy, clocks_refused, supported, {"_hops": _hop_sums(hops)})
    total = F.aggregate("_hops", F.lit(0).cast("decimal(38,0)"), lambda a, h: (a + F.coalesce(h["_s"], F.lit(0))).cast("decimal(38,0)"))
    joined = by.na.drop(subset=keys).select(*keys, "kind", total.alias("_all"), F.explode("_hops").alias("_h")).select(*keys, "kind", "_all", "_h.*")
    told = F.col("kind").isin("partial", "observed_decomposition")
    share = F.when(told & (F.col("_all") > 0), ppm(F.coalesce("_s", F.lit(0)), F.col("_all"))).otherwise(F.lit(0).cast("bigint"))
    state = F.when(F.col("observed") == 0, "unknown").when(F.col("missing") > 0, "incomplete").otherwise("observed")
    return joined.select(
        *keys, "hop_index", "observed", "missing", fits(F.col("_s")).alias("sum_ns"), floor_div(F.col("_s"), F.col("observed")).alias("mean_ns"),
        floor_div(F.col("_q"), F.col("_nq")).alias("queue_mean_ns"), "uncertainty_ns", ppm(F.col("observed"), F.col("observed") + F.col("missing")).alias("coverage_ppm"),
        share.alias("share_ppm"), state.alias("hop_state"),
    )


def verdict_reasons(accounted: DataFrame, keys: list[str], policy: Policy = DEFAULT, clocks_refused: Column | None = None, supported: Column | None = None) -> DataFrame:
    """keys, kind, reasons (sorted names): why each verdict is what it is; no_causal_inference is always among them."""
    seen = {
        "_clock": F.array_distinct(F.flatten(F.collect_set("clock_reasons"))), "_over": F.bool_or("overflowed"),
        "_unfit": fits(wide_sum(F.when(F.col("complete"), F.col("rtt_ns")))).isNull(),
    }
    j = verdict(accounted, keys, policy, clocks_refused, supported, seen)
    kind, lit = F.col("kind"), F.lit
    told = kind.isin("partial", "observed_decomposition")
    partly = (kind == "partial") | (kind == "refused") & (F.size("_clock") == 0) & ~F.col("clocks_refused") & (F.col("complete") > 0) & (F.col("incomplete") > 0)
    short = (kind == "refused") & ~F.col("clocks_refused") & (F.col("complete") == 0)
    found = [
        F.when(F.col("included") == 0, "no_samples"), F.when(kind == "unsupported", "semantics_unsupported"),
        F.when(partly, "partial_coverage"), F.when(partly | short, "non_tiling_coverage"), F.when(partly & (kind == "refused"), "refused_by_policy"),
        F.when(told, F.col("residual_reading")), F.when(kind == "observed_decomposition", "attribution_complete"), F.when(kind == "partial", "attribution_partial"),
        F.when(F.col("negative_residuals") > 0, "hop_overlap"), F.when(F.col("_over") | F.col("_unfit") & (F.col("complete") > 0), "arithmetic_overflow"),
        lit("no_causal_inference"),
    ]
    own = F.array_compact(F.array(*found))
    every = F.when(kind == "refused", F.concat(own, "_clock")).otherwise(own)
    return j.select(*keys, "kind", F.array_sort(F.array_distinct(every)).alias("reasons"))


def accounts(exchanges: DataFrame, hops: int, keep: list[str]) -> DataFrame:
    """keep, rtt_ns, known_hops, accounted_ns, residual_ns, complete: one row per exchange, computed inside its row.

    An exchange is complete if every position of its path has a dwell, its time isn't negative and the sum fits.
    """
    dwells = F.transform(F.sequence(F.lit(0), F.lit(hops - 1)), lambda i: F.try_element_at("hops", i)["dwell_ns"])
    known = F.filter(dwells, lambda d: d.isNotNull())
    rows = exchanges.select(*keep, "rtt_ns", known.alias("_known"))
    total = F.aggregate("_known", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d.cast("decimal(20,0)")).cast("decimal(38,0)"))
    rows = rows.select(*keep, "rtt_ns", F.size("_known").alias("known_hops"), fits(total).alias("_sum"))
    complete = (F.col("known_hops") == hops) & (F.col("rtt_ns") >= 0) & F.col("_sum").isNotNull()
    return rows.select(*keep, "rtt_ns", "known_hops", F.when(complete, F.col("_sum")).alias("accounted_ns"), F.when(complete, F.try_subtract("rtt_ns", "_sum")).alias("residual_ns"), F.coalesce(complete, F.lit(False)).alias("complete"))


def hop_contributions(exchanges: DataFrame, hops: int, keys: list[str]) -> DataFrame:
    """keys, hop_index, observed, missing, sum_ns, mean_ns, coverage_ppm, share_ppm.

    observed counts complete exchanges only, missing every exchange that lacks the hop; a share is of the sums of all hops.
    """
    id_ = ["exchange_id"]
    marked = exchanges.withColumn("_whole", _complete(hops))
    rows = spine(marked, hops, [*id_, *keys, "_whole"])
    own = F.when(F.col("_whole"), F.col("dwell_ns"))
    by = rows.groupBy(*keys, "hop_index").agg(F.count(own).alias("observed"), F.count_if(F.col("dwell_ns").isNull()).alias("missing"), wide_sum(own).alias("_s"))
    totals = by.groupBy(*keys).agg(F.sum("_s").alias("_all"))
    joined = by.join(totals, keys) if keys else by.crossJoin(totals)  # the total is one row
    share = F.when(F.coalesce("_all", F.lit(0)) == 0, F.lit(0).cast("bigint")).otherwise(ppm(F.coalesce("_s", F.lit(0)), F.col("_all")))
    seen = F.col("observed") + F.col("missing")
    return joined.select(*keys, "hop_index", "observed", "missing", fits(F.col("_s")).alias("sum_ns"), floor_div(F.col("_s"), F.col("observed")).alias("mean_ns"), ppm(F.col("observed"), seen).alias("coverage_ppm"), share.alias("share_ppm"))


def _complete(hops: int) -> Column:
    every = F.forall(F.sequence(F.lit(0), F.lit(hops - 1)), lambda i: F.try_element_at("hops", i)["dwell_ns"].isNotNull())
    return F.coalesce(F.col("hops").isNotNull() & every & (F.col("rtt_ns") >= 0), F.lit(False))


def verdict(accounted: DataFrame, keys: list[str], policy: Policy = DEFAULT, clocks_refused: Column | None = None, supported: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """keys, counters, kind, means of time, accounted and unaccounted time, residual extremes and the residual's reading.

    A refused or unsupported attribution still tells means and residuals; what the hops account for it withholds. ``more`` names
    further aggregates of the same rows, which are told beside.
    """
    refused, can = F.bool_or(clocks_refused if clocks_refused is not None else F.lit(False)), F.bool_or(supported if supported is not None else F.lit(True))
    whole = F.col("complete")
    sums = accounted.groupBy(*keys).agg(
        F.count("*").alias("included"), F.count_if(whole).alias("complete"), F.count_if(~whole).alias("incomplete"), refused.alias("_refused"), can.alias("_can"),
        wide_sum(F.when(whole, F.col("rtt_ns"))).alias("_e2e"), wide_sum(F.col("accounted_ns")).alias("_acc"), wide_sum(F.col("residual_ns")).alias("_res"),
        F.min("residual_ns").alias("residual_min_ns"), F.max("residual_ns").alias("residual_max_ns"), F.count_if(F.col("residual_ns") < 0).alias("negative_residuals"),
        *[c.alias(n) for n, c in (more or {}).items()],
    )
    kind = (
        F.when(F.col("included") == 0, "refused").when(~F.col("_can"), "unsupported").when(F.col("_refused") | (F.col("complete") == 0), "refused")
        .when(F.col("incomplete") > 0, "partial" if policy.allow_partial else "refused").otherwise("observed_decomposition")
    )
    out = sums.withColumn("kind", kind)
    told = F.col("kind").isin("partial", "observed_decomposition")
    mean = F.when(fits(F.col("_e2e")).isNotNull(), floor_div(F.col("_e2e"), F.col("complete")))  # a sum that doesn't fit has no mean
    acc = F.when(told & (F.col("_acc") != 0), floor_div(F.col("_acc"), F.col("complete")))
    rest = F.try_subtract(mean, acc)
    reading = F.when(rest.isNull(), None).when(F.abs(rest) <= policy.residual_tolerance_ns, "residual_within_tolerance").otherwise("unaccounted_residual")
    return out.select(
        *keys, "included", "complete", "incomplete", "kind", mean.alias("e2e_mean_ns"), floor_div(F.col("_res"), F.col("complete")).alias("residual_mean_ns"), "residual_min_ns", "residual_max_ns", "negative_residuals",
        acc.alias("accounted_mean_ns"), rest.alias("unaccounted_mean_ns"), reading.alias("residual_reading"), F.col("_refused").alias("clocks_refused"), *(more or {}),
    )
