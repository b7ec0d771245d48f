"""Rows met with a dimension whose names may be those of most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a dimension that is broadcast, whatever share of the rows has one name; a larger one is shuffled.
BROADCAST_ROWS = 500_000
#: Places that rows which need no entry are dealt to in a shuffle.
PLACES = 1 << 20


def looked_up(rows: DataFrame, dimension: DataFrame, key: str, name: str, unneeded: Column | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the entry of dimension (at most one for each ``name``, which is dropped) of their key, NULL without one or where ``unneeded``.

    A shuffle by a key that most rows share hands them to one task. So a dimension of at most ``most`` rows (counted first) is
    broadcast; else rows that need no entry are dealt out evenly, and Spark parts what is still uneven.
    """
    wanted = F.lit(True) if unneeded is None else ~F.coalesce(unneeded, F.lit(False))
    if dimension.select(name).limit(most + 1).count() <= most:
        return rows.join(F.broadcast(dimension), (F.col(key) == F.col(name)) & wanted, "left").drop(name)
    wanted = wanted & F.col(key).isNotNull()
    place = F.when(wanted, F.lit(-1).cast("bigint")).otherwise(F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith(("map", "array", "struct"))]), F.lit(PLACES)))
    placed = dimension.withColumn("_at", F.struct(F.lit(-1).cast("bigint").alias("place"), F.col(name).cast(rows.schema[key].dataType).alias("name")))
    dealt = rows.withColumn("_to", F.struct(place.alias("place"), F.when(wanted, F.col(key)).alias("name")))
    return dealt.join(placed, F.col("_to") == F.col("_at"), "left").drop("_to", "_at", name)
