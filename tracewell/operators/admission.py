"""Admission of records in arrival order: structural validation, then the fences that tell current from history.

The batch forms are running maxima in order of arrival, over sources and over sessions. A source may hold a large share of all
rows, so its arrivals are cut into blocks of ``BLOCK``: windows run inside a block, and what a block takes over from those
before it comes from one aggregated row for each session and block, joined back where there is any. A task thus orders a block
of a source, never a source. Arrivals are whole numbers that differ within a source. The forms equal the sequential rules
while a session has at most ``Policy.replay_window`` sequences and a source at most ``Policy.sessions_per_source`` sessions;
:func:`within_bounds` checks that. Beyond it the keyed state of ``tracewell.streaming`` is the exact form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.evidence import reasons
from ..plans.policy import DEFAULT, Policy

CURRENT, HISTORICAL, REJECTED = "current", "historical", "rejected"
#: Arrivals to a block; how many there are decides nothing but the size of a task.
BLOCK = 1 << 20


def validate(records: DataFrame) -> DataFrame:
    """records with their reasons (sorted names) and rejected: the structural checks that make a record inadmissible.

    Needs path, generation, source, epoch, incarnation, source_revision, domain, response_domain, request_ns, response_ns, rtt_ns,
    hop_indexes, and known_path, known_source, known_generation. An unknown path, source or generation is told alone. With
    hop_names and path_hops (the names along the path) a hop must stand at its path's position.
    """
    first = F.when(~F.col("known_path"), "unknown_path").when(~F.col("known_source"), "unknown_source").when(~F.col("known_generation"), "unknown_generation")
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("hop_indexes") - 1, F.lit(1))), lambda i: F.coalesce(F.get("hop_indexes", i) > F.get("hop_indexes", i - 1), F.lit(True)))
    astray = F.lit(False)
    if {"hop_names", "path_hops"} <= set(records.columns):
        placed = F.zip_with("hop_indexes", "hop_names", lambda i, name: F.coalesce(F.get("path_hops", i) == name, F.lit(False)))
        astray = F.coalesce(F.exists(placed, lambda ok: ~ok), F.lit(False))
    wrong = (F.col("response_ns") < F.col("request_ns")) | (F.col("rtt_ns") != F.try_subtract("response_ns", "request_ns"))
    rest = reasons(
        F.when(F.col("epoch").isNull() | F.col("incarnation").isNull() | wrong, "invalid_field_value"),
        F.when(F.col("source_revision").isNull() | (F.col("source_revision") < 1), "revision_changed"),
        F.when(F.col("domain").isNull(), "clock_domain_missing"), F.when(F.col("domain") != F.col("response_domain"), "clock_reference_mismatch"),
        F.when(~rising, "hop_not_contiguous"), F.when(astray, "hop_conflicting"),
    )
    found = F.when(first.isNotNull(), F.array(first)).otherwise(rest)
    return records.select("*", found.alias("reasons"), (F.size(found) > 0).alias("rejected"))


def reason_counts(rows: DataFrame, column: str = "reasons") -> DataFrame:
    return rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _blocked(records: DataFrame, block: int) -> DataFrame:
    return records.withColumn("_block", F.expr(f"arrival div {block:d}"))


def _taken_over(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns that blocks has for their keys and block (null keys are equal)."""
    named = blocks.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(named, same, "left").drop(*[f"_of_{k}" for k in keys])


def _top_before(blocks: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """blocks (a row for each keys and block, with the highest values) with those of the earlier blocks in their place."""
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumns({f"_top_{n}": F.max(f"_top_{n}").over(earlier) for n in values})


def _tops(values: dict[str, str]) -> list[Column]:
    return [F.max(c).alias(f"_top_{n}") for n, c in values.items()]


def _within(rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """rows (with what the earlier blocks had) with the highest values of all earlier records, by the names of values."""
    inside = W.partitionBy(*keys, "_block").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumns({n: F.greatest(F.col(f"_top_{n}"), F.max(c).over(inside)) for n, c in values.items()}).drop(*[f"_top_{n}" for n in values])


def _before(rows: DataFrame, keys: list[str], **values: str) -> DataFrame:
    """rows (with _block) with, for each name of values, the highest value of its column in earlier records of the same keys."""
    tops = _top_before(rows.groupBy(*keys, "_block").agg(*_tops(values)), keys, values)
    some = tops.where(reduce(lambda a, b: a | b, [F.col(f"_top_{n}").isNotNull() for n in values]))
    return _within(_taken_over(rows, some, [*keys, "_block"]), keys, values)


def _decided(rows: DataFrame, session: list[str]) -> DataFrame:
    """rows (with seen) with decision and gap."""
    again = F.row_number().over(W.partitionBy(*session, "sequence").orderBy("arrival")) > 1
    out = rows.withColumn("_again", again)
    decision = F.when(F.col("seen").isNull(), "first").when(F.col("sequence") > F.col("seen"), "advance").when(F.col("_again"), "replay").otherwise("reordered")
    gap = F.when(F.col("sequence") > F.col("seen"), F.col("sequence") - F.col("seen") - 1).otherwise(F.lit(0).cast("bigint"))
    return out.withColumns({"decision": decision, "gap": gap}).drop("_again")


def sequence_fence(records: DataFrame, session: list[str], block: int = BLOCK) -> DataFrame:
    """records with seen (the highest sequence before), decision and gap.

    first; advance (above all before, with the number skipped); replay (a sequence seen before); reordered (a new one below).
    """
    return _decided(_before(_blocked(records, block), session, seen="sequence"), session).select(*records.columns, "seen", "decision", "gap")


def session_fence(records: DataFrame, apart: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """records with session (its number by first arrival within the source), session_current, session_reason and newest_epoch.

    A session that first arrives later becomes the current one at once; records of older sessions are history. Records that
    differ in the columns of ``apart`` are fenced apart.
    """
    own, source = ["source", "epoch", "incarnation", *apart], ["source", *apart]
    rows = _blocked(records, block)
    sessions = _numbered(rows.groupBy(*own, "_block").agg(F.min("arrival").alias("_born")), own, source)
    return _in_session(_taken_over(rows, sessions, [*own, "_block"]), source).drop("_block")


def _numbered(sessions: DataFrame, own: list[str], source: list[str]) -> DataFrame:
    """sessions (a row for each session and block, _born) numbered, with the epoch before and the newest session of earlier blocks."""
    sessions = sessions.withColumn("_born", F.min("_born").over(W.partitionBy(*own)))
    sessions = sessions.withColumn("session", F.dense_rank().over(W.partitionBy(*source).orderBy("_born")))
    return sessions.withColumns({
        "_previous": F.max("epoch").over(W.partitionBy(*source).orderBy("session").rangeBetween(-1, -1)),
        "_earlier": F.max(F.struct("session", "epoch")).over(W.partitionBy(*source).orderBy("_block").rangeBetween(W.unboundedPreceding, -1)),
    })


def _in_session(rows: DataFrame, source: list[str]) -> DataFrame:
    inside = W.partitionBy(*source, "_block").orderBy("arrival").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn("_newest", F.greatest(F.col("_earlier"), F.max(F.struct("session", "epoch")).over(inside)))
    current = F.col("session") == F.col("_newest.session")
    fresh = (F.col("arrival") == F.col("_born")) & (F.col("session") > 1)
    why = F.when(~fresh, F.when(~current, "session_superseded")).when(F.col("_previous") != F.col("epoch"), "epoch_advanced").otherwise("incarnation_changed")
    told = {"session_current": current, "session_reason": why, "newest_epoch": F.col("_newest.epoch")}
    return out.withColumns(told).drop("_born", "_previous", "_earlier", "_newest")


def _revised(rows: DataFrame) -> DataFrame:
    """rows (with _highest) with revision_current and revision_advanced."""
    now = F.col("source_revision")
    current, advanced = F.coalesce(now >= F.col("_highest"), F.lit(True)), F.coalesce(now > F.col("_highest"), F.lit(False))
    return rows.withColumns({"revision_current": current, "revision_advanced": advanced})


def revision_fence(records: DataFrame, session: list[str], block: int = BLOCK) -> DataFrame:
    """records with revision_current (false where the session has already shown a higher source revision) and revision_advanced."""
    return _revised(_before(_blocked(records, block), session, _highest="source_revision")).select(*records.columns, "revision_current", "revision_advanced")


def registry_fence(revision: Column, registered: Column) -> Column:
    """A record ahead of the registered revision is rejected, one behind it is history."""
    return F.when(revision > registered, REJECTED).when(revision < registered, HISTORICAL).otherwise(CURRENT)


def tips(generations: DataFrame) -> DataFrame:
    """Generations that no other supersedes."""
    newer = generations.select(F.col("supersedes").alias("generation")).where("generation is not null").distinct()
    return generations.join(newer, "generation", "left_anti")


def superseded(generations: DataFrame) -> DataFrame:
    newer = generations.select(F.col("supersedes").alias("generation")).where("generation is not null").distinct()
    return generations.join(newer, "generation", "left_semi")


def admit(records: DataFrame, registered_revision: int | Column, usable: Column | None = None, fatal: Column | None = None, late: Column | None = None, block: int = BLOCK) -> DataFrame:
    """records with decision, gap, session and verdict: all fences in their order.

    ``fatal`` marks records that are rejected before the fences and leave no trace in them. Sessions and sequences are fenced
    next, so a record that the registry rejects has used its sequence up. A replay is rejected; what is reordered, of an older
    session or revision, ``late`` (of another or a superseded generation) or not usable is history.
    """
    registered = registered_revision if isinstance(registered_revision, Column) else F.lit(registered_revision)
    source, values = ["source", "_apart"], {"seen": "sequence", "_highest": "source_revision"}
    own = ["source", "epoch", "incarnation", "_apart"]
    rows = _blocked(records.withColumn("_apart", F.lit(False) if fatal is None else fatal), block)
    blocks = rows.groupBy(*own, "_block").agg(F.min("arrival").alias("_born"), *_tops(values))
    rows = _taken_over(rows, _top_before(_numbered(blocks, own, source), own, values), [*own, "_block"])
    out = _revised(_decided(_within(_in_session(rows, source), own, values), own)).drop("_block", "_highest")
    registry = registry_fence(F.col("source_revision"), registered)
    old = (F.col("decision") == "reordered") | ~F.col("session_current") | ~F.col("revision_current") | (registry == HISTORICAL)
    verdict = F.when(F.col("_apart") | (F.col("decision") == "replay") | (registry == REJECTED), REJECTED)
    for why in [old, *[c for c in (late, None if usable is None else ~usable) if c is not None]]:
        verdict = verdict.when(why, HISTORICAL)
    return out.withColumn("verdict", verdict.otherwise(CURRENT)).drop("_apart")


def report(admitted: DataFrame) -> DataFrame:
    """Counters of a batch of admitted records; with hops (maps with dwells) those of dwells known and unknown too."""
    n = lambda c: F.count_if(c)
    dwells = []
    if "hops" in admitted.columns:
        each = F.coalesce(F.map_values("hops"), F.array())
        for name, field in (("hop_dwells", "dwell_ns"), ("queue_dwells", "queue_dwell_ns")):
            known = F.sum(_known(each, field))
            dwells += [F.coalesce(known, F.lit(0)).cast("bigint").alias(f"{name}_computed"), (F.coalesce(F.sum(F.size(each)), F.lit(0)) - F.coalesce(known, F.lit(0))).cast("bigint").alias(f"{name}_unknown")]
    return admitted.agg(
        F.count("*").alias("received"), *[n(F.col("verdict") == v).alias(v) for v in (CURRENT, HISTORICAL, REJECTED)], n(F.col("gap") > 0).alias("gaps"), F.coalesce(F.sum("gap"), F.lit(0).cast("bigint")).alias("skipped"),
        n(F.col("decision") == "reordered").alias("reordered"), n(F.col("decision") == "replay").alias("replays"), n(F.col("session_reason") == "epoch_advanced").alias("epochs_advanced"), *dwells,
    )


def _known(hops: Column, field: str) -> Column:
    return F.size(F.filter(hops, lambda h: h[field].isNotNull()))


def within_bounds(records: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Sources for which the batch forms may differ from the sequential rules (an empty result means they don't)."""
    per = records.groupBy("source", "epoch", "incarnation").agg(F.count_distinct("sequence").alias("sequences"))
    return per.groupBy("source").agg(F.count("*").alias("sessions"), F.max("sequences").alias("sequences")).where((F.col("sessions") > policy.sessions_per_source) | (F.col("sequences") > policy.replay_window))
