"""Seeded synthetic exchanges: a source for trials, the same rows for a seed on any number of executors.

SplitMix64 adds a constant to its state at each draw, so draw k of a seed can be had without those before it: every row
computes its own draws, and ``spark.range`` decides how the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The constants of SplitMix64, and the generator's start, spacing and dwell range of each hop in nanoseconds.
GAMMA, MIX = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
START_NS, SPACING_NS = 900_000_000_000, 1_000_000
DWELLS = ((1_000, 60_000), (2_000, 90_000), (3_000, 400_000))


def draws(seed: int, k: np.ndarray) -> np.ndarray:
    """Draws number k (from 1) of a seed."""
    z = np.uint64(seed % (1 << 64)) + k.astype(np.uint64) * np.uint64(GAMMA)
    for shift, factor in MIX:
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def exchanges(spark: SparkSession, samples: int, seed: int = 1) -> DataFrame:
    """sequence, request_ns, response_ns, dwells (one per hop): one row for each sample; none for 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            i = frame["id"].to_numpy(np.int64)
            hops = [low + (draws(seed, i * len(DWELLS) + j + 1) % np.uint64(high - low + 1)).astype(np.int64) for j, (low, high) in enumerate(DWELLS)]
            yield pd.DataFrame({"sequence": i, "dwells": list(np.stack(hops, axis=1)) if len(i) else []})

    rows = spark.range(samples).mapInPandas(run, "sequence long, dwells array<long>")
    request = F.lit(START_NS) + F.col("sequence") * SPACING_NS
    return rows.select("sequence", request.alias("request_ns"), (request + F.aggregate("dwells", F.lit(0).cast("long"), lambda a, d: a + d)).alias("response_ns"), "dwells")
