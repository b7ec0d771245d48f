"""Operator 6, best-fit packing with Martello-Toth dominance reduction, over a histogram of piece lengths.

Documents become token ids plus a final 0 and are cut, only where longer than ``capacity``, into pieces. Lengths are whole
numbers up to ``capacity``, so the whole instance is its histogram: at most ``capacity`` counts, whatever the input. The
driver reduces and packs that histogram into *patterns* (how many sequences hold which lengths). Executors then number
the pieces of each length and look their sequence and offset up in the pattern table, which is broadcast. Pieces carry
their token ids; :func:`sequences` shuffles them once, to their sequences, and puts each together.

Reduction (Martello and Toth's criteria, on counts): a set that provably dominates every other set holding the same
largest piece is fixed: an exact pair; a piece that nothing fits beside; the largest partner where two more never fit;
the largest partner where three more never fit and no feasible pair is longer than it. Fixed sets leave the
instance and the rest is packed best-fit decreasing.

Numbering without a hot group: the task that makes the pieces numbers those of each length and writes the numbers beside
them; the tasks' counts are summed up over a small table, so a length that holds a third of all pieces is no group at all.
That table is broadcast up to ``MAX_BROADCAST`` rows (counted first), beyond that joined by shuffle.

Defined results: null and empty texts are one piece of length 1 (the final 0); repeated and null doc_id keep a row each;
very long texts are cut into as many pieces as they need; an empty table gives no rows; columns other than doc_id and text,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import cut, shared_dir
from .tokens import batches, chunks, tokenizer_path

CAPACITY = 2048
MAX_BROADCAST = 500_000

Pattern = tuple[int, list[tuple[int, int]]]  # how many sequences, [(length, how many of it in each)]


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets fixed by dominance, and the counts that remain."""
    left, fixed = {s: c for s, c in counts.items() if c > 0}, []

    def fix(many: int, *sizes: int) -> None:
        held = defaultdict(int)
        for s in sizes:
            held[s] += 1
            left[s] -= many
            if not left[s]:
                del left[s]
        fixed.append((many, sorted(held.items(), reverse=True)))

    changed = True
    while changed:
        changed = False
        for s in sorted(left, reverse=True):
            while (have := left.get(s, 0)) > 0:
                room = capacity - s
                sizes = sorted(left)
                # Other pieces that could go beside one s, smallest first, with their counts (up to three matter).
                others = []
                for x in sizes:
                    others += [x] * min(3, left[x] - (x == s))
                    if len(others) >= 3 or x > room:
                        break
                if not others or others[0] > room:
                    fix(have, s)
                    changed = True
                    continue
                best = next(x for x in reversed(sizes) if x <= room and left[x] - (x == s) > 0)
                alone = len(others) < 2 or others[0] + others[1] > room
                if best < room and not alone:
                    if len(others) >= 3 and sum(others[:3]) <= room:
                        break
                    if _best_pair(left, s, room) > best:
                        break
                many = min(have, left[best]) if best != s else have // 2
                fix(many, s, best)
                changed = True
    return fixed, left


def _best_pair(left: dict[int, int], s: int, room: int) -> int:
    """Largest sum of two other pieces that fits in room, 0 if none."""
    sizes = [x for x in sorted(left) if x < room and left[x] - (x == s) > 0]
    lo, hi, most = 0, len(sizes) - 1, 0
    while lo <= hi:
        both = sizes[lo] + sizes[hi]
        if both > room:
            hi -= 1
        elif lo == hi and left[sizes[lo]] - (sizes[lo] == s) < 2:
            lo += 1
        else:
            most, lo = max(most, both), lo + 1
    return most


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: each length goes into the open sequences with least room that it fits."""
    open_: dict[int, list[tuple[int, list]]] = defaultdict(list)  # room -> [(how many sequences, what they hold)]
    for s in sorted(counts, reverse=True):
        todo = counts[s]
        while todo:
            room = min((r for r, v in open_.items() if r >= s and v), default=None)
            if room is None:
                many, held, room = todo, [], capacity
            else:
                many, held = open_[room].pop()
            each = room // s
            used = min(many, todo // each)
            if used:
                open_[room - each * s].append((used, [*held, (s, each)]))
                todo -= used * each
            elif todo:
                open_[room - todo * s].append((1, [*held, (s, todo)]))
                used, todo = 1, 0
            if held and many > used:
                open_[room].append((many - used, held))
    return [x for v in open_.values() for x in v]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _slots(patterns: list[Pattern]) -> list[tuple]:
    """(length, lo, hi, sequence, each, offset): ranks lo..hi-1 of a length fill the sequences from `sequence` on."""
    rows, seen, sequence = [], defaultdict(int), 0
    for many, held in patterns:
        offset = 0
        for s, each in held:
            rows.append((s, seen[s], seen[s] + many * each, sequence, each, offset))
            seen[s] += many * each
            offset += s * each
        sequence += many
    return rows


_PIECE = "doc_id long, piece int, start long, length long, ids binary, _task int, _k long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids of every piece of every row of ``docs`` (doc_id, text), and its number ``_k`` among
    the pieces of its length in the task ``_task``. ids: little-endian unsigned 32-bit numbers."""
    at = tokenizer or tokenizer_path()

    def run(frames):
        own, task, seen = chunks(at), TaskContext.get().partitionId(), defaultdict(int)
        for frame in batches(frames):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "_task", "_k")}
            for doc, raw in zip(frame["doc_id"], own.encode(list(frame["text"])), strict=True):
                ids = np.append(np.frombuffer(raw, "<u2").astype("<u4"), np.uint32(0)).astype("<u4")
                for k, i in enumerate(range(0, len(ids), capacity)):
                    part = ids[i : i + capacity]
                    for name, value in zip(out, (doc, k, i, len(part), part.tobytes(), task, seen[len(part)]), strict=True):
                        out[name].append(value)
                    seen[len(part)] += 1
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInPandas(run, _PIECE)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces, their ids too, with sequence_id and offset: packed, gapless from 0, at most ``capacity`` tokens a sequence."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "pieces")
    pieces(docs, capacity, tokenizer).write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(_PIECE).parquet(path)
    each = cut(found.groupBy("length", "_task").agg(F.count("*").alias("_n")))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(
        _slots(pack_histogram(counts, capacity)),
        T.StructType([T.StructField(n, T.LongType()) for n in ("length", "_lo", "_hi", "_sequence", "_each", "_offset")]),
    )
    before = each.select("length", "_task", (F.sum("_n").over(W.partitionBy("length").orderBy("_task")) - F.col("_n")).alias("_before"))
    before = F.broadcast(before) if each.count() <= MAX_BROADCAST else before
    ranked = found.join(before, ["length", "_task"]).withColumn("_r", F.col("_before") + F.col("_k"))
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("_r") >= slots["_lo"]) & (F.col("_r") < slots["_hi"])).drop(slots["length"])
    at = F.col("_r") - F.col("_lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"),
        (F.col("_sequence") + F.expr("(_r - _lo) div _each")).alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids, parts: a row for each sequence of ``pack`` with its tokens whole, and whose they are."""
    part = F.struct("offset", "length", "doc_id", "piece", "start")
    made = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.expr("listagg(ids, X'') WITHIN GROUP (ORDER BY offset)").alias("ids"), F.sort_array(F.collect_list(part)).alias("parts"))
    return made.select("sequence_id", "n_tokens", "ids", "parts")


def write_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The sequences of ``docs`` written as Parquet to ``path``; returns that table."""
    made = sequences(pack(docs, capacity, tokenizer))
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def segments(made: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: the sequences' parts in their order, each with its ids as they stand there."""
    own = made.select("sequence_id", F.col("ids").alias("_ids"), F.explode("parts").alias("_p")).select("sequence_id", "_ids", "_p.*")
    return own.select("doc_id", "piece", "start", "length", F.expr("substring(_ids, cast(4 * offset + 1 as int), cast(4 * length as int))").alias("ids"), "sequence_id", "offset")
