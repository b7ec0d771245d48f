"""Operator 4, personal data: candidate spans, boosted trees over their format and context, calibrated redaction.

1. High-recall generators propose overlapping spans: the four base kinds (email, ip, card, phone) and four wide families for
   what writers do to hide or regroup them: addresses with other letters, numbers of 7 or more digits, addresses spelled
   out, addresses with brackets around their dots. Spans come from ``split`` and ``regexp_extract_all`` with the same
   pattern: the gaps and matches alternate, so their lengths give the places.
2. A wide candidate has small whole-number features of format (family, digits, groups, separators, Luhn, year-like) and of
   context (cue word before, neighbouring characters).
3. Training examples never coincide with what the base rules redact anyway. Positive ones are proven base spans rewritten so
   that no base rule finds them (a phone without its plus or country, a card with other separators, an address spelled out or
   with a letter beyond ASCII, dots in brackets), in their own context. Negative ones are the same spans' digits as dates,
   ranges, book numbers, instants and numbers that fail Luhn, and all wide candidates of all documents that overlap no
   proven span, follow no cue word and pass no strict form of their family; others are unlabelled.
4. The features take few values (``CELLS`` tuples at most, whatever the input), so all examples are counted by tuple
   (combined before the shuffle) and boosted trees are fitted exactly on these counts on the driver. A fourth of the
   documents is held out and calibrates a threshold for each family: the least score at which at least ``PRECISION`` of the
   held-out examples scoring as much are positive, a rewritten span counting in all as one.
5. The trees become one SQL expression. Base spans always stay; a wide candidate that overlaps none of them and scores at
   least its family's threshold is added as kind ``like``.

All of it is DataFrame and SQL functions; patterns are possessive and anchored at run starts, so long runs stay linear.
Candidates are computed once and written to the shared folder, as both the fit and the decision read them.

Defined results: null or empty text has no spans; very long texts are searched whole; each input row gives one row, repeated
or not; an empty table gives no rows; without proven spans, or where no threshold of a family reaches the precision,
nothing of that family is added; a score equal to the threshold is added. Offsets are code points, end exclusive. Other
columns, whatever their names, are kept by :func:`redact` and left out by :func:`personal_data`.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import shared_dir

#: The base kinds in their order. ``\G`` lets a match begin right where the last one ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide patterns, which may overlap the base kinds and each other.
WIDE = {
    "address": r"(?:(?<![^\x00-\x20<>\"(),;])|\G)[^\x00-\x20<>\"(),;@]++@[^\x00-\x20<>\"(),;@]++",
    "number": r"(?:(?<![0-9])|\G)[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    "spelled": (
        r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+"
        r"(?:\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]{1,63}+)++"
        r"|\x20at\x20[a-z0-9-]{1,63}+(?:\x20dot\x20[a-z0-9-]{1,63}+)++)"
    ),
    "defanged": r"(?i)(?:(?<![0-9])|\G)[0-9]{1,3}+(?:\x20?[\[(]\x20?(?:\.|dot)\x20?[\])]\x20?[0-9]{1,3}+){3}",
}
#: Strict forms; a natural candidate that has its family's is not taken for a negative example. That of a number
#: is a grouped one of 9 to 13 digits that is no date, or one of 14 to 19 that passes Luhn.
STRICT = {
    "address": r"@[^@]+\.\p{L}{2,}$",
    "spelled": r"(?i)(?:[.)\]]|\bdot)\x20?[a-z]{2,}+$",
    "defanged": r"(?i)^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\x20?[\[(]\x20?(?:\.|dot)\x20?[\])]\x20?|$)){4}$",
}
YEAR = r"^(?:19|20)[0-9]{2}(?![0-9])|(?<![0-9])(?:19|20)[0-9]{2}$"
#: Words that announce personal data.
CUES = r"(?i)\b(?:phone|tel|call|fax|mobile|mail|contact|card|visa|iban|account|ssn|passport|address|ip|host)\b[^A-Za-z0-9]*$"
#: How many values each feature has; their product bounds what the driver reads.
FEATURES = {"family": 4, "digits": 12, "groups": 5, "separators": 16, "cue": 2, "before": 3, "after": 3, "luhn": 2, "year": 2}
CELLS = math.prod(FEATURES.values())
ROUNDS, DEPTH, RATE, PRECISION, LEAST = 30, 4, 0.3, 0.98, 10
_SPAN = "struct<kind:int,start:int,end:int,text:string,before:string,after:string>"


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """Spans of a pattern, each with its text and a little of the gaps around it."""
    found, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["hit"].alias("text"), F.right(pair["gap"], F.lit(24)).alias("before"), F.left(pair["next"], F.lit(2)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.transform(found, lambda hit, i: F.struct(hit.alias("hit"), F.get(gaps, i).alias("gap"), F.get(gaps, i + 1).alias("next")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: (F.ascii(d) - 48) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _proven(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        return text.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(text))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _only_proven(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _proven(kind, s["text"]))


def candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, base and wide: arrays of spans. A cheap test of each text comes before the patterns that need its characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    at, digit, plus = t.contains("@"), t.rlike("[0-9]"), t.contains("+")
    bracket, dot = t.contains("[") | t.contains("("), t.contains(" dot ") | t.contains(" DOT ") | t.contains(" Dot ")
    needs = {
        "email": at,
        "ip": digit & t.contains("."),
        "card": digit & t.rlike("[0-9](?:[\\x20-]?[0-9]){13}"),
        "phone": plus & digit,
        "address": at,
        "number": digit,
        "spelled": dot | bracket & t.rlike(r"(?i)[\[(]\x20?at\x20?[\])]"),
        "defanged": bracket & digit & t.rlike(r"(?i)[0-9]\x20?[\[(]\x20?(?:\.|dot)"),
    }
    spans = {k: F.when(needs[k], _matches(t, i, p)).otherwise(none) for i, (k, p) in enumerate([*BASE.items(), *WIDE.items()])}
    base = [_only_proven(spans[k], k) for k in BASE]
    return docs.select(*keep, F.array_sort(F.concat(*base), _by_place).alias("base"), F.concat(*[spans[k] for k in WIDE]).alias("wide"))


def _by_place(a: Column, b: Column) -> Column:
    """Order by start, then kind."""
    return F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["kind"] - b["kind"])).cast("int")


def _char_class(c: Column) -> Column:
    """0: none or white space, 1: a mark, 2: a letter, digit or anything else."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^[\x00-\x20]?$"), 0).when(c.rlike(r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]$"), 1).otherwise(2)


def features(span: Column) -> list[Column]:
    """Whole numbers from 0, one for each of FEATURES and below its size."""
    text, digits = span["text"], _digits(span["text"])
    inner = F.regexp_replace(text, "[A-Za-z]+", "")
    marks = ((1, r"\x20"), (2, "-"), (4, r"\."), (8, r"[()\[\]]"))
    return [
        span["kind"] - len(BASE),
        F.greatest(F.least(F.length(digits), F.lit(17)) - 6, F.lit(0)),
        F.greatest(F.least(F.regexp_count(text, F.lit("[0-9]+")), F.lit(5)), F.lit(1)) - 1,
        reduce(lambda a, b: a + b, [F.when(inner.rlike(c), b).otherwise(0) for b, c in marks]),
        F.when(span["before"].rlike(CUES), 1).otherwise(0),
        _char_class(F.right(span["before"], F.lit(1))),
        _char_class(F.left(span["after"], F.lit(1))),
        F.when(F.length(digits).between(14, 19) & _luhn(digits), 1).otherwise(0),
        F.when(text.rlike(YEAR), 1).otherwise(0),
    ]


def _cell(parts: list[Column]) -> Column:
    """The features as one number."""
    return reduce(lambda a, b: a * b[1] + b[0], zip(parts[1:], list(FEATURES.values())[1:], strict=True), parts[0])


def uncell(cell: int) -> tuple[int, ...]:
    return tuple(int(v) for v in np.unravel_index(cell, tuple(FEATURES.values())))


# ---- training examples -------------------------------------------------------------------------------------------------


def hidden(kind: str, text: Column) -> list[tuple[str, Column]]:
    """(family, text): a proven span rewritten so that no base rule finds it."""
    if kind == "email":
        local, host = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
        dots = lambda by: F.regexp_replace(host, r"\.", by)
        return [
            ("spelled", F.concat(local, F.lit(" [at] "), dots(" [dot] "))),
            ("spelled", F.concat(local, F.lit(" (at) "), host)),
            ("spelled", F.concat(local, F.lit(" at "), dots(" dot "))),
            ("address", F.concat(local, F.lit("\u00e9@"), host)),
            ("address", F.concat(local, F.lit("@\u00fc"), host)),
        ]
    if kind == "ip":
        return [("defanged", F.regexp_replace(text, r"\.", by)) for by in ("[.]", "(.)", " [dot] ")]
    if kind == "card":
        digits = _digits(text)
        return [("number", F.regexp_replace(digits, "(.{4})(?=.)", by)) for by in ("$1.", "$1  ", "$1--")]
    bare = F.regexp_replace(text, r"^\+", "")
    return [("number", bare), ("number", F.regexp_replace(bare, r"^[0-9]{1,3}[\x20.-]", "")), ("number", F.regexp_replace(bare, r"[()\x20-]+", "."))]


def neutral(kind: str, text: Column) -> list[tuple[str, Column]]:
    """(family, text): the digits of a proven span as a number that is no personal data."""
    digits = _digits(text)
    d = lambda i, n=1: F.substring(digits, i, n)
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    if kind == "phone":
        return [
            ("number", put("20", d(9, 2), "-1", F.least(d(8), F.lit("2")), "-2", d(7))),
            ("number", put("1", d(7), ".0", d(8), ".19", d(9, 2))),
            ("number", put("19", d(7, 2), "-20", d(9, 2))),
            ("number", put("1", d(2, 9))),
            ("number", put("978-", d(3), "-", d(4, 3), "-", d(5, 5), "-", d(10))),
        ]
    if kind == "card":
        last = F.right(digits, F.lit(1)).cast("int")
        wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.pmod(last + 5, F.lit(10)).cast("string"))
        return [("number", wrong), ("number", F.regexp_replace(wrong, "(.{4})(?=.)", "$1."))]
    return []


def _example(family: str, text: Column, span: Column, y: int) -> Column:
    kind = len(BASE) + list(WIDE).index(family)
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), span["before"].alias("before"), span["after"].alias("after"), F.lit(y).alias("y"))


def examples(found: DataFrame) -> DataFrame:
    """held, s (kind, text, before, after, y): training examples from the candidates of all documents."""

    def rewritten(s: Column) -> Column:
        out = F.when(s["kind"] < 0, F.array(_example("number", F.lit(""), s, 0)))
        for i, kind in enumerate(BASE):
            made = [_example(f, t, s, y) for y, of in ((1, hidden), (0, neutral)) for f, t in of(kind, s["text"])]
            out = out.when(s["kind"] == i, F.array(*made))
        return out

    def natural(s: Column) -> Column:
        digits = F.length(_digits(s["text"]))
        grouped = digits.between(9, 13) & s["text"].rlike(r"[\x20().-]") & ~s["text"].rlike(YEAR)
        number = (s["kind"] == len(BASE) + list(WIDE).index("number")) & (grouped | digits.between(14, 19) & _luhn(_digits(s["text"])))
        strict = number | reduce(lambda a, b: a | b, [(s["kind"] == len(BASE) + list(WIDE).index(f)) & s["text"].rlike(p) for f, p in STRICT.items()])
        return ~_overlaps(F.col("base"), s) & ~s["before"].rlike(CUES) & ~strict

    def whole(s: Column) -> Column:
        """Whether the family's generator would propose just this."""
        return reduce(lambda a, b: a | b, [(s["kind"] == len(BASE) + i) & s["text"].rlike(f"^(?:{p})$") for i, p in enumerate(WIDE.values())])

    texts = [F.transform(c, lambda s: s["text"]) for c in ("base", "wide")]
    held = (F.pmod(F.xxhash64(*texts), F.lit(4)) == 0).alias("held")
    fields = ("kind", "text", "before", "after")
    negative = F.transform(F.filter("wide", natural), lambda s: F.struct(*[s[f].alias(f) for f in fields], F.lit(0).alias("y")))
    made = F.filter(F.flatten(F.transform("base", rewritten)), whole)
    some = found.where((F.size("base") > 0) | (F.size("wide") > 0))
    return some.select(held, F.explode(F.concat(made, negative)).alias("s"))


def _overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


# ---- boosted trees on counts -------------------------------------------------------------------------------------------


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A tree on cells (features, gradient, hessian): a value, or (feature, bound, left, right) with left: value <= bound."""
    G, H = g.sum(), h.sum()
    best = None
    for f in range(x.shape[1]) if depth else ():
        lg, lh = np.bincount(x[:, f], g).cumsum()[:-1], np.bincount(x[:, f], h).cumsum()[:-1]
        gain = lg**2 / (lh + 1) + (G - lg) ** 2 / (H - lh + 1) - G**2 / (H + 1)
        if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
            best = (gain.max(), f, int(gain.argmax()))
    if best is None:
        return float(RATE * G / (H + 1.0))
    _, f, bound = best
    left = x[:, f] <= bound
    return f, bound, _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


Counts = dict[tuple[int, ...], tuple[float, float]]


def fit_trees(counts: Counts, rounds: int = ROUNDS) -> tuple[float, list]:
    """Starting log-odds and boosted trees for {features: (examples, positive ones)}, by Newton steps on the logistic loss."""
    x = np.array(sorted(counts), np.int64)
    n, p = np.array([counts[tuple(k)] for k in x.tolist()], float).T
    start = math.log((p.sum() + 1) / ((n - p).sum() + 1))
    score, trees = np.full(len(x), start), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        tree = _grow(x, p - n * q, n * q * (1 - q), DEPTH)
        trees.append(tree)
        score += [_value(tree, row) for row in x.tolist()]
    return start, trees


def calibrate(start: float, trees: list, held: Counts) -> dict[int, float]:
    """family: least score at which PRECISION of its held-out examples scoring as much are positive, LEAST of them at least.

    Examples of equal score (but for the last digits, which depend on the order of sums) stand or fall together.
    """
    out, sums, scored = {}, {}, {}
    for x, counts in held.items():
        key = x[0], round(start + sum(_value(t, x) for t in trees), 6)
        scored[key] = tuple(a + b for a, b in zip(scored.get(key, (0, 0)), counts, strict=True))
    for (family, score), counts in sorted(scored.items(), reverse=True):
        n, p = sums[family] = tuple(a + b for a, b in zip(sums.get(family, (0, 0)), counts, strict=True))
        if n >= LEAST and p >= PRECISION * n:
            out[family] = score - 1e-5
    return out


def _tree_sql(tree, x: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(x[tree[0]] <= tree[1], _tree_sql(tree[2], x)).otherwise(_tree_sql(tree[3], x))


def fit(found: DataFrame) -> tuple[float, list, dict[int, float]] | None:
    """(start, trees, threshold of each family) from the candidates of all documents; None where nothing can be learnt."""
    cell = examples(found).select("held", _cell(features(F.col("s"))).alias("cell"), "s.y")
    rows = cell.groupBy("cell", "held").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()  # at most 2 CELLS rows
    fold: dict[bool, Counts] = {False: {}, True: {}}
    for r in rows:
        x = uncell(r["cell"])
        share = 1 / 3 if list(WIDE)[x[0]] != "address" else 1 / 2  # of a proven span, for each way that it is rewritten
        fold[r["held"]][x] = (r["n"] - r["p"] + r["p"] * share, r["p"] * share)
    if not fold[False] or not fold[True]:
        return None
    start, trees = fit_trees(fold[False])
    return start, trees, calibrate(start, trees, fold[True])


def score_of(span: Column, start: float, trees: list) -> Column:
    """The trees' score of a span. The features become fields once, so that the trees refer to them and don't repeat them."""
    fields = F.struct(*[c.alias(n) for n, c in zip(FEATURES, features(span), strict=True)])
    own = F.transform(F.array(fields), lambda x: sum((_tree_sql(t, [x[n] for n in FEATURES]) for t in trees), F.lit(start)))
    return F.element_at(own, 1)


def detect(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, base and spans (base and added ones, sorted): arrays of (kind, start, end, ...); kind 4 is an added span."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "candidates")
    found = candidates(docs, keep, text)
    found.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    model = fit(found)
    if model is None or not model[2]:
        return found.select(*keep, "base", F.col("base").alias("spans"))
    start, trees, least = model

    def chosen(s: Column) -> Column:
        bound = F.element_at(F.create_map(*[F.lit(v) for f, t in least.items() for v in (len(BASE) + f, t)]), s["kind"])
        return F.coalesce(score_of(s, start, trees) >= bound, F.lit(False))

    free = F.filter("wide", lambda s: ~_overlaps(F.col("base"), s))
    added = F.transform(F.filter(free, chosen), lambda s: s.withField("kind", F.lit(len(BASE))))
    added = F.when(F.size(free) > 0, F.array_distinct(added)).otherwise(free)
    return found.select(*keep, "base", F.array_sort(F.concat("base", added), _by_place).alias("spans"))


def _names() -> Column:
    return F.array(*[F.lit(k) for k in [*BASE, "like"]])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(_names(), s["kind"]), s["start"], s["end"])), ",")


def _of_kind(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans as text, one row per row of ``docs``."""
    found = detect(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"])
    count = [_of_kind(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first names the whole stretch."""
    cols = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)])
    text = own.columns[cols.index("text")]
    found = detect(own, own.columns, text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        put = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(F.get(_names(), s["kind"])), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], put).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    done = found.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text)))
    return done.select(*[F.col(n).alias(c) for n, c in zip(own.columns, cols, strict=True)])
