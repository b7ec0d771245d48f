"""Evidence as columns: a state, a freshness and a confidence, each a rank in which higher is worse, plus reasons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..plans.policy import DEFAULT, Policy

#: Names in rank order.
STATES = ("observed", "incomplete", "missing", "stale", "conflicting", "unknown", "unsupported", "refused")
FRESHNESS = ("fresh", "aging", "stale", "expired", "unknown")
CONFIDENCE = ("high", "moderate", "low", "degraded", "none")


def name_of(rank: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), rank)


def freshness(age_ns: Column, policy: Policy = DEFAULT) -> Column:
    """Rank of an age; a negative or unknown age is unknown."""
    return F.when(age_ns.isNull() | (age_ns < 0), 4).when(age_ns <= policy.fresh_ns, 0).when(age_ns <= policy.aging_ns, 1).when(age_ns <= policy.stale_ns, 2).otherwise(3)


def usable(state: Column, fresh: Column) -> Column:
    """Evidence that may answer a question about now: observed, and fresh or aging."""
    return (state == 0) & (fresh <= 1)


def has_value(state: Column) -> Column:
    """Evidence with a number at all: observed, incomplete or stale."""
    return state.isin(0, 1, 3)


def rank_of(name: Column, names: tuple[str, ...]) -> Column:
    """The rank of a name; NULL for one that isn't among them."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), name), F.lit(0)).cast("int") - 1


#: State, freshness and confidence of each kind of evidence that a reason makes.
KINDS = {
    "missing": (2, 4, 4), "incomplete": (1, 4, 2), "stale": (3, 2, 4), "conflicting": (4, 4, 4), "unknown": (5, 4, 4), "unsupported": (6, 4, 4), "refused": (7, 4, 4),
}


def _value(state: Column, fresh: Column, confidence: Column, why: Column) -> Column:
    return F.struct(state.cast("int").alias("state"), fresh.cast("int").alias("freshness"), confidence.cast("int").alias("confidence"), why.alias("reasons"))


def evidence(kind: str, *why: str) -> Column:
    """Evidence as a value: state, freshness, confidence (ranks) and reasons, for one of KINDS."""
    return _value(*map(F.lit, KINDS[kind]), F.array_sort(F.array(*map(F.lit, why))))


def observed(fresh: Column, confidence: Column, *why: str) -> Column:
    return _value(F.lit(0), fresh, confidence, F.array_sort(F.array(*map(F.lit, why)).cast("array<string>")))


def merge(left: Column, right: Column, most: int = DEFAULT.reasons) -> Column:
    """Two values in one, whatever their order: covering states (observed, incomplete, missing) combine, else the worse wins."""
    worst = F.greatest(left["state"], right["state"])
    state = F.when(worst >= 3, worst).when(worst >= 1, 1).otherwise(0)
    both = F.slice(F.array_sort(F.array_union(left["reasons"], right["reasons"])), 1, most)
    return _value(state, F.greatest(left["freshness"], right["freshness"]), F.greatest(left["confidence"], right["confidence"]), both)


def merged(value: Column) -> Column:
    """Aggregate: all values in one."""
    return _value(merged_state(value["state"]), F.max(value["freshness"]), F.max(value["confidence"]), merged_reasons(value["reasons"]))


def summarize(value: Column) -> Column:
    """One line: state/freshness/confidence and the reasons."""
    head = F.concat_ws("/", name_of(value["state"], STATES), name_of(value["freshness"], FRESHNESS), name_of(value["confidence"], CONFIDENCE))
    return F.concat_ws(" ", head, value["reasons"])


def merged_state(state: Column) -> Column:
    """Aggregate: any of stale and worse wins by rank; else incomplete if anything is incomplete or missing."""
    worst = F.max(state)
    return F.when(worst >= 3, worst).when(worst >= 1, 1).otherwise(F.when(worst.isNull(), 5).otherwise(0))


def reasons(*found: Column) -> Column:
    """The reasons that hold, sorted, each once; each argument is a reason's name where it holds, else NULL."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def merged_reasons(sets: Column, most: int = DEFAULT.reasons) -> Column:
    """Aggregate: the union of reason sets, sorted, the first ``most``. The vocabulary bounds the union, not the rows."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(sets)))), 1, most)
