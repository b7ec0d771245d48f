"""Operator 2, benchmark decontamination: broadcast hash set of test windows, one scan of the documents.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Every item gives its windows of
``WINDOW`` consecutive words; an item of fewer words, but not none, is one window. A document word inside any occurrence
of a window is hit.

One pass reads the documents: each word position becomes a row with the hash of the window that starts there, which
probes the broadcast windows inside one generated-code stage; a match of hashes is verified word by word. Only matches
and one row per document leave the stage, already combined per document, so no text is ever shuffled.

The benchmark side is broadcast while its windows and item ids take at most ``MAX_BROADCAST`` bytes (summed first); beyond
that the same join runs as a shuffled join on the window hash.

Defined results: null text, empty text or no words: n_words 0 and not contaminated. Null or repeated doc_id: every input
row gives its own output row. Items with a null id still mark words but are not listed. Empty benchmark: nothing is hit.
Very long texts are scanned whole; an empty table of documents gives no rows.
Columns other than the named ones are ignored by :func:`contamination` and kept by :func:`decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, cut

WINDOW = 10
MAX_BROADCAST = 128 << 20  # bytes of windows, each with 200 for its fields
MAX_BROADCAST_TEXTS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """window (array of words), items (distinct item ids as strings): one row per distinct window."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return item.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def _hits(docs: DataFrame, text: str, benchmark: DataFrame, window: int, keep: list[str]) -> DataFrame:
    """One row per input row: _row, the columns of keep, n_words, spans of hit words [(start, end)], item lists."""
    windows = benchmark_windows(benchmark, window)
    held = F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")) + 8 * F.size("items") + 200
    shape = {r["n"]: r["c"] for r in windows.groupBy(F.size("window").alias("n")).agg(F.sum(held.cast("long")).alias("c")).collect()}  # at most `window` rows
    lengths = sorted(shape) or [window]
    windows = windows.select(F.xxhash64(F.size("window"), *[F.get("window", F.lit(k)) for k in range(window)]).alias("_key"), "window", "items")
    small = sum(shape.values()) <= MAX_BROADCAST
    windows = F.broadcast(windows) if small else windows.hint("merge")

    base = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, words(F.col(text)).alias("_w"))
    n = F.size("_w")
    # Position -1 is the row of the document itself. An outer explode keeps the plan from evaluating the words twice.
    at = base.select("*", F.explode_outer(F.sequence(F.lit(-1), F.greatest(n - lengths[0], F.lit(-1)))).alias("_at"))

    def key(size: int) -> Column:
        return F.xxhash64(F.lit(size), *[F.get("_w", F.col("_at") + k) for k in range(size)])

    own = F.xxhash64("_row")
    if len(lengths) == 1:
        at = at.select("*", F.lit(lengths[0]).alias("_len"), F.when(F.col("_at") < 0, own).otherwise(key(lengths[0])).alias("_key"))
    else:
        probes = F.array(*[F.struct(F.lit(s).alias("s"), F.when(F.col("_at") < 0, own).otherwise(key(s)).alias("k")) for s in lengths])
        at = at.select("*", F.explode_outer(probes).alias("_p")).where((F.col("_at") >= 0) | (F.col("_p.s") == lengths[0]))
        at = at.select(*base.columns, "_at", F.col("_p.s").alias("_len"), F.col("_p.k").alias("_key"))
    own_window = F.slice("_w", F.greatest(F.col("_at") + 1, F.lit(1)), F.col("_len"))
    at = at.withColumn("_n", F.when(F.col("_at") < 0, n))
    if not small:  # the rows are shuffled: each takes its own window along, not the whole text
        at = at.select("_row", *keep, "_n", "_at", "_len", "_key", F.when(F.col("_at") >= 0, own_window).alias("_own"))
        own_window = F.col("_own")
    found = at.join(windows, (at["_key"] == windows["_key"]) & (at["_at"] >= 0) & (own_window == windows["window"]), "left")
    found = found.where((F.col("_at") < 0) | F.col("window").isNotNull())
    span = F.when(F.col("_at") >= 0, F.struct(F.col("_at").alias("start"), (F.col("_at") + F.col("_len")).alias("end")))
    rows = found.select("_row", *keep, "_n", span.alias("_span"), "items")
    return rows.groupBy("_row").agg(*[F.first(c).alias(c) for c in keep], F.max("_n").cast("long").alias("n_words"), F.array_sort(F.collect_set("_span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _covered(spans: Column) -> Column:
    """Number of words in the union of sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted ids), spans (hit word ranges), contaminated."""
    found = _hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", benchmark, window, ["doc_id"])
    n_hit = _covered(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (remove="documents") or without the hit words (remove="spans").

    Whether a text is contaminated depends on the text alone, so the decision is joined back by the text's SHA-256. The
    contaminated texts are counted; up to ``MAX_BROADCAST_TEXTS`` of their digests are broadcast and the documents stay where
    they are. Beyond that, and where spans go along, Spark picks the join. Removing spans joins the words that stay with single spaces, only in contaminated documents.
    """
    cols = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)])
    text = own.columns[cols.index("text")]
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    hit = cut(_hits(own.select(digest.alias("_digest"), text), text, benchmark, window, ["_digest"]).where(F.size("spans") > 0).select("_digest", "spans").dropDuplicates(["_digest"]))
    keyed = own.withColumn("_digest", digest)
    if remove == "documents":
        gone = hit.select("_digest")
        left = keyed.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST_TEXTS else gone, "_digest", "left_anti")
    else:
        split_words = words(F.col(text))
        clean = F.array_join(F.filter(split_words, lambda w, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"]))), " ")
        left = keyed.join(hit, "_digest", "left").withColumn(text, F.when(F.col("spans").isNotNull(), clean).otherwise(F.col(text)))
    return left.select(*[F.col(n).alias(c) for n, c in zip(own.columns, cols, strict=True)])
