"""Baselines, bound to a path, a generation and a clock domain, and what deviates from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import fnv1a64
from ..functions.numeric import distribution, floor_div, quantile_columns
from ..plans.policy import DEFAULT, Policy

#: Kinds of mismatch in their order.
MISMATCHES = ("path", "generation", "clock_domain", "histogram", "probes", "not_usable", "stale", "expired", "too_few_samples")
STATISTICS = ("n", "min_ns", "max_ns", "sum_ns", "mean_ns", "p99")


def create(exchanges: DataFrame, name: str, created_ns: Column, keys: tuple[str, ...] = ("path", "generation", "domain"), probes=((99, 100),)) -> DataFrame:
    """A baseline of revision 1 for each group that holds records: baseline_id, keys, name, revision, created_ns, statistics."""
    return of_statistics(distribution(exchanges, list(keys), "rtt_ns", probes), name, created_ns, keys)


def of_statistics(statistics: DataFrame, name: str, created_ns: Column, keys: tuple[str, ...] = ("path", "generation", "domain")) -> DataFrame:
    """Baselines of groups whose distribution is at hand."""
    identity = fnv1a64(F.concat_ws("|", F.lit("baseline"), *keys, F.lit("1"), F.lit(name)))
    d = statistics.where("n > 0")
    return d.select(identity.alias("baseline_id"), *keys, F.lit(name).alias("name"), F.lit(1).alias("revision"), created_ns.cast("bigint").alias("created_ns"), *STATISTICS)


def add(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The new baselines whose identity isn't stored yet; the rest already exist."""
    return new.join(stored.select("baseline_id"), "baseline_id", "left_anti")


def latest(baselines: DataFrame, keys: tuple[str, ...] = ("path", "domain"), generation: str | None = None) -> DataFrame:
    """For each key the baseline of highest revision (the greatest id of equals), and whether only other generations have one."""
    rest = [c for c in baselines.columns if c not in keys]
    own = F.lit(True) if generation is None else F.col("generation") == generation
    order = F.struct("revision", "baseline_id")
    best = baselines.groupBy(*keys).agg(F.max_by(F.when(own, F.struct(*rest)), F.when(own, order)).alias("r"), (~F.bool_or(own)).alias("other_generation_only"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], "other_generation_only")


def ratio_ppm(current: Column, reference: Column) -> Column:
    """Current over reference in parts per million, floored, not capped; 0 where either is unknown or the reference isn't above 0."""
    return F.when(current.isNull() | reference.isNull() | (reference <= 0), F.lit(0).cast("bigint")).otherwise(floor_div(F.greatest(current, F.lit(0)).cast("decimal(20,0)") * 1_000_000, reference))


def anomaly_class(current_n: Column, reference_n: Column, delta: Column, policy: Policy = DEFAULT) -> Column:
    few = (current_n < policy.min_samples) | (reference_n < policy.min_samples)
    return (
        F.when(few | delta.isNull(), "unknown").when(delta >= policy.elevated_ns, "elevated").when(delta >= policy.watch_ns, "watch")
        .when(delta <= -policy.elevated_ns, "suppressed_elevated").when(delta <= -policy.watch_ns, "suppressed").otherwise("none")
    )


def compare(current: DataFrame, baselines: DataFrame, on: str, as_of_ns: Column, policy: Policy = DEFAULT, usable: Column | None = None) -> DataFrame:
    """current (on, path, generation, domain, statistics) against the baseline it names: mismatches, deltas, ratio, class.

    Where anything mismatches the baseline doesn't apply, and no delta is given. Histogram digests and probes are compared
    where both sides have a column histogram or probes.
    """
    shapes = [F.when(~F.col(c).eqNullSafe(F.col(f"b_{c}")), c) for c in ("histogram", "probes") if c in current.columns and c in baselines.columns]
    b = baselines.select(F.col("baseline_id").alias(on), *[F.col(c).alias(f"b_{c}") for c in baselines.columns if c != "baseline_id"])
    joined = current.join(b, on, "left")
    age = as_of_ns - F.col("b_created_ns")
    found = F.array_compact(F.array(
        F.when(F.col("path") != F.col("b_path"), "path"), F.when(F.col("generation") != F.col("b_generation"), "generation"), F.when(F.col("domain") != F.col("b_domain"), "clock_domain"), *shapes,
        F.when((age < 0) | (~usable if usable is not None else F.lit(False)), "not_usable"),
        F.when((age > policy.aging_ns) & (age <= policy.stale_ns), "stale"), F.when(age > policy.stale_ns, "expired"),
        F.when((F.col("n") < policy.min_samples) | (F.col("b_n") < policy.min_samples), "too_few_samples"),
    ))
    found = F.when(F.col("b_path").isNull(), F.array(F.lit("missing"))).otherwise(found)
    joined = joined.withColumn("mismatches", found).withColumn("applicable", F.size("mismatches") == 0)
    delta = lambda c: F.when(F.col("applicable"), F.try_subtract(c, f"b_{c}"))
    return joined.select(
        *current.columns, "mismatches", "applicable", *[delta(c).alias(f"{c.removesuffix('_ns')}_delta_ns") for c in ("mean_ns", "min_ns", "max_ns", "p99")],
        F.when(F.col("applicable"), ratio_ppm(F.col("mean_ns"), F.col("b_mean_ns"))).alias("ratio_ppm"),
        F.when(F.col("applicable"), anomaly_class(F.col("n"), F.col("b_n"), F.try_subtract("mean_ns", "b_mean_ns"), policy)).alias("anomaly"),
        F.when(F.col("applicable"), F.when(F.col("n") >= 4 * policy.min_samples, "high").otherwise("moderate")).alias("confidence"),
    )


def mismatch_rows(compared: DataFrame, keep: list[str]) -> DataFrame:
    return compared.select(*keep, F.explode("mismatches").alias("mismatch"))


def anomalies(current: DataFrame, reference: DataFrame, keys: list[str], policy: Policy = DEFAULT) -> DataFrame:
    """keys (hop positions among them) matched in both; unmatched ones are skipped: counts, mean delta, ratio and class."""
    c = current.select(*keys, F.col("n").alias("current_n"), F.col("mean_ns").alias("current_mean_ns"))
    r = reference.select(*keys, F.col("n").alias("baseline_n"), F.col("mean_ns").alias("baseline_mean_ns"))
    j = c.join(r, keys)
    delta = F.try_subtract("current_mean_ns", "baseline_mean_ns")
    few = (F.col("current_n") < policy.min_samples) | (F.col("baseline_n") < policy.min_samples)
    confidence = F.when(few, "low").when(F.col("current_n") >= 4 * policy.min_samples, "high").otherwise("moderate")
    return j.select(*keys, "current_n", "baseline_n", delta.alias("mean_delta_ns"), ratio_ppm(F.col("current_mean_ns"), F.col("baseline_mean_ns")).alias("ratio_ppm"), anomaly_class(F.col("current_n"), F.col("baseline_n"), delta, policy).alias("anomaly"), confidence.alias("confidence"))


def tail_column(probes: tuple[tuple[int, int], ...]) -> str | None:
    """The quantile column that stands for the tail: p99, or the last one where that isn't asked."""
    names = quantile_columns(probes)
    return "p99" if "p99" in names else names[-1] if names else None


def anomalies_with_total(current: DataFrame, reference: DataFrame, current_total: DataFrame, reference_total: DataFrame, keys: list[str], policy: Policy = DEFAULT) -> DataFrame:
    """Anomalies of each hop, and one of the whole (hop ``end_to_end`` at position 0), for each group of keys.

    The totals hold keys, n and mean_ns; the hops a hop_index too.
    """
    hops = anomalies(current, reference, [*keys, "hop_index"], policy).withColumn("hop", F.concat(F.lit("hop"), "hop_index"))
    whole = anomalies(current_total, reference_total, keys, policy).withColumns({"hop_index": F.lit(0), "hop": F.lit("end_to_end")})
    return hops.unionByName(whole)
