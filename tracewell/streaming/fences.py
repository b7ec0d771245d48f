"""The admission fences as keyed state of a stream: the exact sequential rules, whatever the number of sessions or sequences.

State is kept per source: its sessions in order of first arrival, the current one, and for each session the highest revision, the
last sequence and a bounded window of accepted ones. Nothing is dropped as late: what comes late is history.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.policy import DEFAULT, Policy

_OUT = [("exchange_id", T.LongType()), ("arrival", T.LongType()), ("source", T.LongType()), ("sequence", T.LongType()), ("decision", T.StringType()), ("gap", T.LongType()), ("session_current", T.BooleanType()), ("session_reason", T.StringType()), ("verdict", T.StringType())]
OUTPUT = T.StructType([T.StructField(n, t) for n, t in _OUT])
STATE = T.StructType([T.StructField("fence", T.BinaryType())])


class Fence:
    """The state of one source."""

    def __init__(self):
        self.sessions: dict[tuple, dict] = {}
        self.ordinal, self.current = 0, None

    def admit(self, epoch, incarnation, revision, sequence, registered: int, policy: Policy = DEFAULT) -> tuple:
        """(decision, gap, session_current, session_reason, verdict) of the next record of the source."""
        key, why, verdict = (epoch, incarnation), None, "current"
        own = self.sessions.get(key)
        if own is None:
            self.ordinal += 1
            own = self.sessions[key] = {"ordinal": self.ordinal, "revision": revision, "last": None, "order": deque(), "held": set()}
            if self.current is not None:
                why = "epoch_advanced" if self.current[0] != epoch else "incarnation_changed"
            self.current = key
            while len(self.sessions) > policy.sessions_per_source:
                oldest = min((k for k in self.sessions if k != key), key=lambda k: self.sessions[k]["ordinal"])
                del self.sessions[oldest]
        newest = key == self.current
        if not newest:
            why, verdict = "session_superseded", "historical"
        if revision < own["revision"]:
            verdict = "historical"
        own["revision"] = max(own["revision"], revision)
        last, gap = own["last"], 0
        if last is None:
            decision = "first"
        elif sequence > last:
            decision, gap = "advance", sequence - last - 1
        elif sequence == last or sequence in own["held"]:
            decision, verdict = "replay", "rejected"
        else:
            decision, verdict = "reordered", "historical"
        if decision != "replay":
            own["last"] = sequence if last is None else max(last, sequence)
            own["order"].append(sequence)
            own["held"].add(sequence)
            if len(own["order"]) > policy.replay_window:
                own["held"].discard(own["order"].popleft())
        if verdict != "rejected":
            verdict = "rejected" if revision > registered else "historical" if revision < registered else verdict
        return decision, gap, newest, why, verdict


def admit_stream(records: DataFrame, registered_revision: int, policy: Policy = DEFAULT) -> DataFrame:
    """A stream of records (as of ``admit`` in batch) with the columns of OUTPUT; one source's records are decided in order of arrival."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fence = pickle.loads(state.get[0]) if state.exists else Fence()
        for frame in _by_arrival(frames):
            made = [fence.admit(e, i, int(r), int(s), registered_revision, policy) for e, i, r, s in zip(frame["epoch"], frame["incarnation"], frame["source_revision"], frame["sequence"], strict=True)]
            found = pd.DataFrame(made, columns=["decision", "gap", "session_current", "session_reason", "verdict"], index=frame.index)
            yield pd.concat([frame[["exchange_id", "arrival", "source", "sequence"]], found], axis=1)[[n for n, _ in _OUT]]
        state.update((pickle.dumps(fence),))

    return records.groupBy("source").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


_KEPT = ("exchange_id", "arrival", "source", "sequence", "epoch", "incarnation", "source_revision")


def _by_arrival(frames: Iterator[pd.DataFrame], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """A source's frames of one micro-batch in order of arrival, a bounded number of rows at a time.

    Frames come in no given order, so the micro-batch's rows of the source are kept as narrow columns (texts as categories)
    until all are there; how many files a micro-batch holds bounds them (``files_per_batch``).
    """
    held = [f[list(_KEPT)].astype({"epoch": "category", "incarnation": "category"}) for f in frames]
    if not held:
        return
    order = np.argsort(np.concatenate([f["arrival"].to_numpy() for f in held]), kind="stable")
    starts = np.cumsum([0, *[len(f) for f in held]])
    for i in range(0, len(order), rows):
        part = order[i : i + rows]
        which = np.searchsorted(starts, part, side="right") - 1
        picked = [held[k].iloc[part[which == k] - starts[k]].astype({"epoch": object, "incarnation": object}) for k in np.unique(which)]
        yield pd.concat(picked).sort_values("arrival", kind="stable", ignore_index=True)


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few files to a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A table below a folder as a stream, whether it is one file or a folder of part files."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/{name}.parquet").select("path")
    one = paths.limit(2).where(F.col("path").endswith(f"/{name}.parquet")).count() == 1
    return file_stream(spark, folder, f"{name}.parquet", schema, files_per_batch) if one else file_stream(spark, f"{folder}/{name}.parquet", "*.parquet", schema, files_per_batch)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything available, appended to a Parquet table; state and progress are in the checkpoint, so a rerun goes on from there."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def decision_counts(admitted: DataFrame) -> DataFrame:
    return admitted.groupBy("decision", "verdict").agg(F.count("*").alias("n"), F.sum("gap").alias("skipped"))
