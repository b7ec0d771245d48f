"""Operator 9, quality rules: counts of a text, and the divergence of its histograms from its language's reference.

Base rules: fewer than 10 words, or more than 20 % of the words in repeated 5-word windows, fail. The method compares two
histograms of a document, character classes and common words, with its language's reference by Jensen-Shannon
distance (square root of the divergence in bits) and fails the document beyond ``CHAR_MOST`` or ``WORD_MOST``. A
histogram of fewer than ``CHAR_LEAST`` characters or ``WORD_LEAST`` words isn't judged.

The references are sums over all documents of a language that pass the base rules, combined before the shuffle: one row for
each value of ``lang``, joined back by it (broadcast where they are at most ``MAX_BROADCAST``, counted first). Each language is
thus judged by its own text, whichever it is; one without a list in ``COMMON`` is judged by its characters only, and one
of fewer than ``LANG_LEAST`` sound documents, or none (null), isn't judged by the method.

Repeated windows: the windows of a text are hashed; only where a hash repeats are they sorted and compared word by word.

Defined results: null or empty text has no words and fails; very long texts are counted whole; a distance equal to its bound
is kept; each input row gives one row, whatever its doc_id, repeated or not; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
CHAR_MOST, WORD_MOST, CHAR_LEAST, WORD_LEAST, LANG_LEAST = 0.22, 0.27, 400, 100, 20
MAX_BROADCAST = 10_000
#: Common words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "on", "as"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "auf", "für"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "dans"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "con"],
}
CLASSES = ("upper", "digit", "punctuation", "symbol", "space", "beyond_ascii", "rest")


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def features(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """keep, language, the counts of the contract, chars and common: the two histograms."""
    own = docs.select(*keep, F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    own = own.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    n = F.size("_w")
    # An element of _hash for each window. _w is read several times in it, so the plan keeps it as a column.
    own = own.withColumn("_hash", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    own = own.withColumn("_sorted", F.when(F.size("_hash") > F.size(F.array_distinct("_hash")), placed))
    same = lambda a, b: (a["h"] == b["h"]) & (F.slice("_w", a["i"] + 1, WINDOW) == F.slice("_w", b["i"] + 1, WINDOW))
    twice = F.filter("_sorted", lambda x, j: F.coalesce(same(x, F.get("_sorted", j - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_sorted", j + 1)), F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, zero, lambda a, s: F.struct((s + WINDOW).alias("to"), (a["n"] + s + WINDOW - F.greatest(a["to"], s)).alias("n")), lambda a: a["n"])
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = own.withColumn("_lines", lines)
    words = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    own = own.withColumn("_common", F.coalesce(F.try_element_at(words, F.coalesce("_lang", F.lit(""))), none))
    every = sorted({w for v in COMMON.values() for w in v})
    counted = own.select(
        *keep, "_lang", "_common",
        n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), _count(F.col("_t"), "#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.when(F.col("_sorted").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.length("_t").cast("long").alias("_chars"), _count(F.col("_t"), "A-Z").alias("_upper"), _count(F.col("_t"), "0-9").alias("_digit"),
        _count(F.col("_t"), r".,;:!?'\"()\-").alias("_punctuation"), _count(F.col("_t"), r"^\x00-\x7F").alias("_beyond"),
        F.filter(F.transform("_w", F.lower), lambda w: w.isin(every)).alias("_hits"),
    )
    space = F.col("_chars") - F.col("word_chars")
    classes = [F.col(c) for c in ("_upper", "_digit", "_punctuation", "n_symbols")] + [space, F.col("_beyond")]
    chars = F.array(*classes, F.greatest(F.col("_chars") - sum(classes[1:], classes[0]), F.lit(0)))
    # naming _hits twice keeps it a column: else it would be made anew for each common word
    per_word = F.transform("_common", lambda w: F.when(F.size("_hits") == 0, 0).otherwise(F.size(F.filter("_hits", lambda h: h == w))).cast("long"))
    return counted.select(*keep, "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), per_word.alias("common"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _words(common: Column) -> Column:
    """The histogram of common words with all other words as one more class."""
    return F.concat(common, F.array(F.col("n_words") - F.aggregate(common, F.lit(0).cast("long"), lambda a, x: a + x)))


def references(found: DataFrame) -> DataFrame:
    """_lang, _q (characters per class) and _r (occurrences per common word and of the rest; null without a list of them) over
    all sound documents of each language that has enough of them."""
    size = len(next(iter(COMMON.values()))) + 1
    total = lambda a, i: F.sum(F.get(a, F.lit(i)).cast("decimal(38,0)")).cast("double")
    chars = F.array(*[total(F.col("chars"), i) for i in range(len(CLASSES))])
    words = F.array(*[total(_words(F.col("common")), i) for i in range(size)])
    sound = found.where(~base_failed() & F.col("_lang").isNotNull())
    sums = sound.groupBy("_lang").agg(F.count("*").alias("_n"), chars.alias("_q"), words.alias("_r")).where(F.col("_n") >= LANG_LEAST)
    return sums.select("_lang", "_q", F.when(F.col("_lang").isin(list(COMMON)), F.col("_r")).alias("_r"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts of one length."""
    total = lambda a: F.greatest(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    n, k = total(p), total(q)
    shares = F.zip_with(p, q, lambda x, y: F.struct((x / n).alias("x"), (y / k).alias("y")))
    terms = F.transform(shares, lambda s: (half(s["x"], (s["x"] + s["y"]) / 2) + half(s["y"], (s["x"] + s["y"]) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed, char_distance, word_distance (null where too short) and kept."""
    found = cut(features(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")), ["doc_id"]))
    reference = cut(references(found))
    reference = F.broadcast(reference) if reference.count() <= MAX_BROADCAST else reference
    real = lambda a: F.transform(a, lambda x: x.cast("double"))
    judged = found.join(reference, "_lang", "left").withColumns({"_p": real(F.col("chars")), "_o": real(_words(F.col("common")))})
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    char = F.when((n_chars >= CHAR_LEAST) & F.col("_q").isNotNull(), js_distance(F.col("_p"), F.col("_q")))
    word = F.when((F.col("n_words") >= WORD_LEAST) & F.col("_r").isNotNull(), js_distance(F.col("_o"), F.col("_r")))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = judged.select(*counts, base_failed().alias("base_failed"), char.alias("char_distance"), word.alias("word_distance"))
    sound = (F.coalesce("char_distance", F.lit(0.0)) <= CHAR_MOST) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_MOST)
    return judged.withColumn("kept", ~F.col("base_failed") & sound)
