"""Operator 3, secret scan: a trigram inverted index picks the texts in which a rule's regex can match at all.

For each rule a Boolean query over trigrams is derived from the parsed regex (a sequence needs all of its parts, an
alternation one of them, a repetition its body where it must occur). The texts of a batch form one index segment: only
trigrams some query asks for are posted, found by one vectorised lookup over the batch's bytes. Postings are intersected
and united by each query; the regex then verifies the candidates. A rule without mandatory trigrams scans every text.
Segments live and die inside a task, so nothing is shuffled and memory is bounded by a batch.

Base kinds, leftmost and not overlapping per kind, failing matches dropped: assign (group 2 of 6 or more characters),
access (20 or more), hex (24 or more). Further kinds add spans of well-known key formats; base spans always stay.

Defined results: null or empty text has no spans; each input row gives one row, whatever its doc_id; offsets are code
points, end exclusive; very long texts are searched whole; an empty table gives no rows; columns other than doc_id and
text, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from re import _parser as sre  # the standard library's own regex parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .tokens import batches

#: Kind, pattern, ASCII letters in either case, group and least length of it. Order is the order of kinds.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    ("hex", r"[0-9a-f]+", False, 0, 24),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", False, 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 40),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 0, 39),
    ("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/@]+)@", True, 1, 3),
]
BASE = 3
MOST = 16  # literal alternatives followed exactly before a query falls back to what is sure

# A query is True (any text) or ("and" | "or", parts) with trigrams as lower-case bytes at the leaves.


def _both(a, b):
    return b if a is True else a if b is True else ("and", (a, b))


def _either(parts):
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _sure(texts: set[str]):
    """The query of "one of these literals occurs"."""
    out = []
    for t in texts:
        raw = t.encode().lower()
        grams = {raw[i : i + 3] for i in range(len(raw) - 2)}
        out.append(("and", tuple(sorted(grams))) if grams else True)
    return _either(out) if out else True


def _walk(nodes) -> tuple[set[str] | None, object]:
    """What a parsed sequence matches: its literals if they are few, and a query that holds wherever it matches."""
    exact: set[str] | None = {""}
    query = True
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            one, q = {chr(arg)}, True
        elif name == "SUBPATTERN":
            one, q = _walk(arg[3])
        elif name == "BRANCH":
            ways = [_walk(w) for w in arg[1]]
            one = set().union(*(w for w, _ in ways)) if all(w is not None for w, _ in ways) else None
            q = _either([_both(q, _sure(w) if w is not None and one is None else True) for w, q in ways])
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= MOST:
            one, q = {chr(v) for _, v in arg}, True
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            inner, _ = _walk(arg[2])
            one, q = (inner | {""} if inner is not None else None), True
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            inner, q = _walk(arg[2])
            one, q = None, _both(q, _sure(inner) if inner is not None else True)
        elif name == "AT":
            one, q = {""}, True
        else:
            one, q = None, True
        query = _both(query, q)
        if exact is not None and one is not None and len(exact) * len(one) <= MOST:
            exact = {a + b for a in exact for b in one}
        else:
            query = _both(query, _sure(exact or {""}))
            exact = one if one is not None else {""}
    return (exact, query) if _is_exact(nodes) else (None, _both(query, _sure(exact)))


def _is_exact(nodes) -> bool:
    """Whether every part of a sequence is one of few literals, so that the collected set is all that it matches."""
    many = 1
    for op, arg in nodes:
        name = str(op)
        if name in ("LITERAL", "AT"):
            continue
        if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            many *= len(arg)
        elif name == "SUBPATTERN" and _is_exact(arg[3]):
            many *= len(_walk(arg[3])[0])
        elif name == "BRANCH" and all(_is_exact(w) for w in arg[1]):
            many *= sum(len(_walk(w)[0]) for w in arg[1])
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1) and _is_exact(arg[2]):
            many *= 1 + len(_walk(arg[2])[0])
        else:
            return False
        if many > MOST:
            return False
    return True


def trigram_query(pattern: str):
    exact, query = _walk(list(sre.parse(pattern)))
    return _both(query, _sure(exact)) if exact is not None else query


def _grams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_grams, query[1]))


class Index:
    """Postings of the trigrams that queries ask for, over the texts of one segment."""

    def __init__(self, grams: set[bytes]):
        self.grams = sorted(grams)
        self.slot = np.zeros(1 << 24, np.uint8 if len(self.grams) < 255 else np.uint16)
        for i, g in enumerate(self.grams):
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def post(self, texts: list[str]) -> None:
        raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        ends = np.cumsum([len(r) + 3 for r in raws])
        data = np.frombuffer(b"\0\0\0".join(raws) + b"\0\0\0", np.uint8)
        code = data[:-2].astype(np.uint32) << 16
        code |= data[1:-1].astype(np.uint32) << 8
        code |= data[2:]
        slot = self.slot[code]
        at = np.flatnonzero(slot)
        text, which = np.searchsorted(ends, at, "right"), slot[at]
        self.size = len(texts)
        self.postings = {g: np.unique(text[which == i + 1]) for i, g in enumerate(self.grams)}

    def find(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings[query]
        sets = [self.find(q) for q in query[1]]
        out = sets[0]
        for s in sets[1:]:
            out = np.intersect1d(out, s, True) if query[0] == "and" else np.union1d(out, s)
        return out


class Scanner:
    def __init__(self, rules=None):
        self.rules = []
        for kind, pattern, fold, group, least in rules or RULES:
            # A run of one character class is maximal wherever it starts, so its least length can go into the pattern.
            fast = f"{pattern[:-1]}{{{least},}}" if re.fullmatch(r"\[[^\]]*\]\+", pattern) and not group else pattern
            self.rules.append((kind, re.compile(fast, re.ASCII | (re.IGNORECASE if fold else 0)), trigram_query(pattern), group, least))
        self.index = Index(set().union(*(_grams(r[2]) for r in self.rules)))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end), sorted."""
        self.index.post(texts)
        out: list[list] = [[] for _ in texts]
        for k, (_, regex, query, group, least) in enumerate(self.rules):
            for i in self.index.find(query):
                for m in regex.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


_scanner: list[Scanner] = []


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans as text, one row per row of ``docs``."""

    def run(frames):
        if not _scanner:
            _scanner.append(Scanner())
        own = _scanner[0]
        names = [r[0] for r in own.rules]
        for frame in batches(frames, 256):
            found = own.scan(list(frame["text"]))
            base = [",".join(f"{names[k]}:{s}:{e}" for s, k, e in x if k < BASE) for x in found]
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)}
                | {f"n_{names[k]}": [sum(1 for x in spans if x[1] == k) for spans in found] for k in range(BASE)}
                | {"base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base], "spans": [",".join(f"{names[k]}:{s}:{e}" for s, k, e in x) for x in found]}
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
