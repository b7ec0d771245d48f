"""The registry of sources, paths and generations: revisions, references, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F


def upsert(definitions: DataFrame, key: str = "name", content: str = "content") -> DataFrame:
    """definitions (key, revision, content, arrival) with outcome, decided in order of arrival.

    created; idempotent (the content already held); replaced (a higher revision); conflict (no higher revision, other content).
    What is held before a definition is the one of highest revision so far, the first of equals.
    """
    before = W.partitionBy(key).orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    held = F.max(F.struct(F.col("revision"), (-F.col("arrival")).alias("first"), F.col(content).alias("content"))).over(before)
    out = definitions.withColumn("_held", held)
    outcome = F.when(F.col("_held").isNull(), "created").when((F.col("revision") == F.col("_held.revision")) & (F.col(content) == F.col("_held.content")), "idempotent").when(F.col("revision") > F.col("_held.revision"), "replaced").otherwise("conflict")
    return out.select(*definitions.columns, outcome.alias("outcome"))


def held(definitions: DataFrame, key: str = "name") -> DataFrame:
    """What the registry holds after all definitions."""
    rest = [c for c in definitions.columns if c != key]
    best = definitions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col("revision"), -F.col("arrival"))).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def dangling(rows: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference names nothing that is defined."""
    known = parents.select(F.col(parent_key).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def lineage(generations: DataFrame) -> DataFrame:
    """generation, supersedes, is_superseded, is_tip, is_current: current is the only tip, none if there are several."""
    newer = generations.select(F.col("supersedes").alias("generation"), F.lit(True).alias("_newer")).where("generation is not null").distinct()
    marked = generations.join(newer, "generation", "left").withColumn("is_superseded", F.coalesce("_newer", F.lit(False))).drop("_newer")
    tips = marked.agg(F.count_if(~F.col("is_superseded")).alias("_tips"))
    out = marked.crossJoin(F.broadcast(tips))  # one row
    return out.select("generation", "supersedes", "is_superseded", (~F.col("is_superseded")).alias("is_tip"), (~F.col("is_superseded") & (F.col("_tips") == 1)).alias("is_current"))


def union_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
