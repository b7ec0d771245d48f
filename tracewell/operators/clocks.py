"""Clock comparability: durations across clocks exist only where sync reports allow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lookup import looked_up
from ..plans.policy import DEFAULT, Policy

#: What a report may be bound to, in the order in which it is checked.
BINDINGS = ("generation", "epoch", "incarnation")
OK, REFUSED, UNKNOWN, CONFLICTING, STALE = "comparable", "refused", "unknown", "conflicting", "stale"


def latest(reports: DataFrame) -> DataFrame:
    """The report of highest revision of each domain."""
    rest = [c for c in reports.columns if c != "domain"]
    best = reports.groupBy("domain").agg(F.max_by(F.struct(*rest), "revision").alias("r"))
    return best.select("domain", *[F.col(f"r.{c}").alias(c) for c in rest])


def _single(side: str, now: Column, policy: Policy, bound: list[str]) -> Column:
    """Why one side cannot be compared with its reference: (verdict:reason), NULL where it can."""
    c = lambda name: F.col(f"{side}_{name}")
    age = now - c("observed_ns")
    out = F.when(c("sync_state").isNull(), f"{UNKNOWN}:clock_offset_unavailable").when(~c("sync_state").isin("synchronized", "holdover"), f"{REFUSED}:clock_unsynced")
    if not policy.allow_holdover:
        out = out.when(c("sync_state") == "holdover", f"{REFUSED}:clock_holdover")
    for name in bound:
        out = out.when(c(name) != F.col(name), f"{CONFLICTING}:clock_sync_{name}_mismatch")
    return out.when(age < 0, f"{CONFLICTING}:clock_offset_unavailable").when(age > c("valid_for_ns"), f"{STALE}:clock_sync_expired")


def _confidence(side: str, now: Column) -> Column:
    c = lambda name: F.col(f"{side}_{name}")
    return F.when(c("sync_state") == "holdover", 3).when((now - c("observed_ns")) > F.call_function("div", c("valid_for_ns"), F.lit(2)), 1).otherwise(0)


def attach(pairs: DataFrame, reports: DataFrame, sides: dict[str, str], policy: Policy = DEFAULT) -> DataFrame:
    """The latest report of the domains of a pair as columns, for sides a_* and b_*; NULL where a domain has none.

    The reference domain, which may be that of most rows, needs none: a report is looked up for the other domains only.
    """
    now = latest(reports)
    out, own = pairs, ["reference", "sync_state", "offset_ns", "uncertainty_ns", "valid_for_ns", "observed_ns", *[c for c in BINDINGS if c in reports.columns]]
    for side, key in sides.items():
        named = now.select(F.col("domain").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in own])
        out = looked_up(out, named, key, f"_{side}", F.col(key) == policy.reference_domain)
    return out


def compare(pairs: DataFrame, reports: DataFrame, now: Column, left: str = "left_domain", right: str = "right_domain", policy: Policy = DEFAULT) -> DataFrame:
    """pairs with verdict, reason, left_offset_ns, right_offset_ns, uncertainty_ns and confidence (rank).

    Decided in order: a missing domain; the same domain (comparable without any report); the left side's own report, then the
    right's; one common reference; the sum of uncertainties within the policy's ceiling. A report that names a generation,
    epoch or incarnation holds for pairs of that one only, where the pairs have such a column.
    """
    bound = [c for c in BINDINGS if c in reports.columns and c in pairs.columns]
    a, b, ref = F.col(left), F.col(right), F.lit(policy.reference_domain)
    joined = attach(pairs, reports, {"a": left, "b": right}, policy)
    a_ref, b_ref = a == ref, b == ref
    total = F.try_add(F.when(a_ref, 0).otherwise(F.col("a_uncertainty_ns")).cast("bigint"), F.when(b_ref, 0).otherwise(F.col("b_uncertainty_ns")).cast("bigint"))
    one = a_ref | b_ref
    mismatch = F.when(a_ref, F.col("b_reference") != ref).when(b_ref, F.col("a_reference") != ref).otherwise(F.col("a_reference") != F.col("b_reference"))
    bad = F.coalesce(F.when(~a_ref, _single("a", now, policy, bound)), F.when(~b_ref, _single("b", now, policy, bound)), F.when(mismatch, f"{CONFLICTING}:clock_reference_mismatch"), F.when(total.isNull() | (total > policy.max_clock_uncertainty_ns), f"{REFUSED}:clock_uncertainty_exceeded"))
    why = F.when(a.isNull() | b.isNull(), f"{UNKNOWN}:clock_domain_missing").when(a == b, f"{OK}:clock_self_comparable").otherwise(F.coalesce(bad, F.lit(f"{OK}:clock_comparable")))
    joined = joined.withColumn("_why", why)
    good, own = F.split_part("_why", F.lit(":"), F.lit(1)) == OK, a == b
    confidence = F.when(own, 0).when(one, F.when(a_ref, _confidence("b", now)).otherwise(_confidence("a", now))).otherwise(F.greatest(_confidence("a", now), _confidence("b", now)))
    offset = lambda side, is_ref: F.when(good, F.when(own | is_ref, F.lit(0).cast("bigint")).otherwise(F.col(f"{side}_offset_ns")))
    return joined.select(
        *pairs.columns, F.split_part("_why", F.lit(":"), F.lit(1)).alias("verdict"), F.split_part("_why", F.lit(":"), F.lit(2)).alias("reason"),
        offset("a", a_ref).alias("left_offset_ns"), offset("b", b_ref).alias("right_offset_ns"),
        F.when(good, F.when(own, F.lit(0).cast("bigint")).otherwise(total)).alias("uncertainty_ns"), F.when(good, confidence).otherwise(4).alias("confidence"),
    )


def estimate_age(readings: DataFrame, reports: DataFrame, now: Column, domain: str = "domain", observed: str = "observed_at_ns", policy: Policy = DEFAULT) -> DataFrame:
    """readings with age_ns, verdict and confidence (rank): how old a reading is by the reference clock.

    Reports count here whatever their uncertainty, and holdover is always allowed, with degraded confidence.
    """
    ref = F.lit(policy.reference_domain)
    joined = attach(readings, reports, {"a": domain}, policy)
    age = now - F.col("a_observed_ns")
    own = F.col(domain) == ref
    verdict = (
        F.when(own, OK).when(F.col("a_sync_state").isNull(), UNKNOWN).when(F.col("a_reference") != ref, CONFLICTING)
        .when(~F.col("a_sync_state").isin("synchronized", "holdover"), REFUSED).when((age < 0) | (age > F.col("a_valid_for_ns")), STALE).otherwise(OK)
    )
    shifted = F.try_subtract(now, F.try_subtract(F.col(observed), F.when(own, F.lit(0).cast("bigint")).otherwise(F.col("a_offset_ns"))))
    return joined.select(*readings.columns, verdict.alias("verdict"), F.when(verdict == OK, shifted).alias("age_ns"), F.when(own, 0).when(verdict != OK, 4).when(F.col("a_sync_state") == "holdover", 3).otherwise(1).alias("confidence"))


def dwell(pairs: DataFrame, entry: str = "entry_ns", exit_: str = "exit_ns") -> DataFrame:
    """Compared pairs with dwell_ns, dwell_uncertainty_ns and dwell_state: exit less entry, each on its reference.

    A negative dwell is out of order and unknown; so is one that doesn't fit.
    """
    shifted = F.try_subtract(F.try_subtract(F.col(exit_), F.col("right_offset_ns")), F.try_subtract(F.col(entry), F.col("left_offset_ns")))
    good = (F.col("verdict") == OK) & F.col(entry).isNotNull() & F.col(exit_).isNotNull()
    value = F.when(good & (shifted >= 0), shifted)
    state = F.when(~good & (F.col("verdict") == OK), "missing").when(~good, F.col("verdict")).when(shifted.isNull(), "refused").when(shifted < 0, "conflicting").otherwise("observed")
    return pairs.select("*", value.alias("dwell_ns"), F.when(value.isNotNull(), F.col("uncertainty_ns")).alias("dwell_uncertainty_ns"), state.alias("dwell_state"))


def queue_dwell(rows: DataFrame, across: bool = False) -> DataFrame:
    """rows (hop_queue, queue, declared, queue_entry_ns, queue_exit_ns) with queue_dwell_ns and queue_state.

    A queue dwell needs a hop that binds a queue, the same queue in the observation, and queue dwell among its semantics. With
    ``across`` the rows are compared pairs, and entry and exit are each put on their reference first.
    """
    entry, exit_, blocked = F.col("queue_entry_ns"), F.col("queue_exit_ns"), F.lit(None).cast("string")
    if across:
        entry, exit_ = F.try_subtract(entry, F.col("left_offset_ns")), F.try_subtract(exit_, F.col("right_offset_ns"))
        blocked = F.when(F.col("verdict") != OK, F.col("verdict"))
    state = (
        F.when(F.col("hop_queue").isNull() & F.col("queue").isNull(), "absent").when(F.col("hop_queue").isNull(), "unsupported").when(F.col("queue").isNull(), "missing")
        .when(F.col("queue") != F.col("hop_queue"), "conflicting").when(~F.array_contains(F.split("declared", r"\|"), "queue_dwell"), "unsupported")
        .when(F.col("queue_entry_ns").isNull() | F.col("queue_exit_ns").isNull(), "missing").when(blocked.isNotNull(), blocked).when(exit_ < entry, "conflicting").otherwise("observed")
    )
    return rows.select("*", F.when(state == "observed", F.try_subtract(exit_, entry)).alias("queue_dwell_ns"), state.alias("queue_state"))
