"""Operator 8, quality classifier: ordinal regression with cumulative links on hashed text.

Ratings are graded: 0 low quality, 1 sound but toxic, 2 sound. One weight vector over hashed features and ordered
thresholds give P(grade <= k) = sigmoid(theta_k - w.x), from which come the expected grade and the tail probability
P(grade >= 2) used for selection. Features are lower-case words and the shapes of raw words (runs of one character class
collapsed), each as log(1 + count), scaled down by the length to the power 0.25, and the share of different words in tenths.
Each is weighed by its contrast, the log ratio of how often it occurs in texts of grade 2 and in others, so a few telling
words count in a long text.

The model is fitted on the driver on at most ``MAX_TRAIN`` labelled documents (those of smallest hash of their id, a bound that
does not depend on the input; about 250 numbers each); scoring covers all documents, whole texts, in one map over their
partitions. The least tail probability to be kept is calibrated on every fifth training document, held out: what all but
``LOSS`` of the held-out documents of grade 2 reach, and at most ``MOST``.

Defined results: null and empty texts have no features and get the thresholds' own probabilities. Labels that are null are
ignored; of several for a doc_id the lowest grade counts. Without labelled documents of two grades everything is kept.
Each input row gives one row, whatever its doc_id, repeated or not; very long texts are scored whole; a tail probability equal to
the bound is accepted; an empty table gives no rows; other columns, whatever their names, are kept by :func:`select` and left
out by :func:`classify`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import least_hashed
from .tokens import batches

BITS, MAX_TRAIN, EPOCHS, RATE, SEEN, LOSS, GRADES = 18, 12_000, 20, 0.5, 3, 0.002, 3
MOST = 0.9  # the highest tail probability that may be asked for
WEIGHTS = np.array([2.0, 2.0, 1.0])  # of the grades in the likelihood; the rarer ones count double
_PUNCTUATION = b".,;:!?\"'()[]|"
_SHAPES = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"([^\x00-\x20])\1+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's hashed features."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = Counter(raw.lower().translate(None, _PUNCTUATION).split())
    shapes = Counter(_RUN.sub(rb"\1", raw.translate(_SHAPES)).split())
    mask = (1 << BITS) - 1
    variety = 10 * len(words) // max(1, sum(words.values()))  # tenths of words that are different
    at = np.array([zlib.crc32(w) & mask for w in words] + [zlib.crc32(s, 1) & mask for s in shapes] + [zlib.crc32(b"%d" % variety, 2) & mask], np.int32)
    value = np.log1p(np.array([*words.values(), *shapes.values(), 10], np.float32))
    return at, value / max(1.0, float(np.sum(value))) ** 0.25


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, theta: np.ndarray, keep: float):
        self.weights, self.theta, self.keep = weights, theta, keep

    def tails(self, texts) -> np.ndarray:
        """For each text P(grade >= 1), P(grade >= 2), ..."""
        score = np.array([float(self.weights[at] @ value) for at, value in map(features, texts)])
        return _sigmoid(score[:, None] - self.theta[None, :])


def contrast(found: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """|log ratio| of the shares of texts, of the best grade and of the others, that have each feature (one is added to counts)."""
    best = grades == GRADES - 1
    of = lambda own: (np.bincount(np.concatenate([at for at, k in zip(found, own, strict=True) if k] or [np.zeros(0, np.int64)]), minlength=1 << BITS) + 1) / (own.sum() + 2)
    return np.abs(np.log(of(best)) - np.log(of(~best)))


def slopes(score: np.ndarray, theta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of each row's weighted log-likelihood of its grade: by its score, and by the thresholds."""
    tail = np.hstack([np.ones((len(y), 1)), _sigmoid(score[:, None] - theta), np.zeros((len(y), 1))])
    up, down = tail[np.arange(len(y)), y], tail[np.arange(len(y)), y + 1]
    slope = lambda t: t * (1 - t)
    p = np.maximum(up - down, 1e-9) / WEIGHTS[y]
    to = np.zeros((len(y), GRADES - 1))
    for k in range(GRADES - 1):
        to[:, k] = np.where(y == k + 1, -slope(up) / p, np.where(y == k, slope(down) / p, 0))
    return (slope(up) - slope(down)) / p, to


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> Model | None:
    """Stochastic gradient steps (Adagrad) on the ordinal likelihood."""
    if len(set(grades.tolist())) < 2:
        return None
    seen = np.bincount(np.concatenate([np.unique(at) for at, _ in rows]), minlength=1 << BITS)
    rows = [(at[k], v[k]) for at, v in rows for k in [seen[at] >= SEEN]]
    held = np.arange(len(rows)) % 5 == 4
    lift = contrast([at for (at, _), h in zip(rows, held, strict=True) if not h], grades[~held])
    rows = [(at, v * lift[at]) for at, v in rows]
    weights, square = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    share = np.array([np.mean(grades[~held] >= k) for k in range(1, GRADES)]).clip(0.01, 0.99)
    theta, theta_square, rng, train = -np.log(share / (1 - share)), np.full(GRADES - 1, 1e-2), np.random.default_rng(0), np.flatnonzero(~held)
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for part in np.array_split(train, max(1, len(train) // 32)):
            at, value, of = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part]), np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            score = np.bincount(of, weights[at] * value, len(part))
            pull, to = slopes(score, theta, grades[part])
            places, where = np.unique(at, return_inverse=True)
            g = np.bincount(where, pull[of] * value) / len(part)
            square[places] += g * g
            weights[places] += RATE * g / np.sqrt(square[places])
            t = to.mean(axis=0)
            theta_square += t * t
            theta = np.maximum.accumulate(theta + 0.1 * t / np.sqrt(theta_square))
    model = Model(weights * lift, theta, 0.5)
    good = [i for i in np.flatnonzero(held) if grades[i] == GRADES - 1]
    if good:
        scores = np.array([float(weights[rows[i][0]] @ rows[i][1]) for i in good])
        model.keep = float(min(MOST, np.quantile(_sigmoid(scores - theta[-1]), LOSS)))
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model | None:
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    drawn = least_hashed(graded, "doc_id", most)  # at most `most` rows of two numbers

    def run(frames: Iterator[pd.DataFrame]):
        for frame in batches(frames):
            found = [features(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "grade": frame["grade"], "at": [a.tobytes() for a, _ in found], "value": [v.tobytes() for _, v in found]})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    rows = own.mapInPandas(run, "doc_id long, grade int, at binary, value binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in rows], np.array([r["grade"] for r in rows], np.int64)) if rows else None


_KIND = "expected_grade double, tail_probability double, accepted boolean"


def _scored(own: DataFrame, model: Model | None, text: str) -> DataFrame:
    """``own`` with the three columns of _KIND."""
    shared = own.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers
    names = [f.name for f in own.schema.fields]

    def run(frames: Iterator[pd.DataFrame]):
        for frame in batches(frames):
            m = shared.value
            tails = m.tails(frame[text]) if m else np.ones((len(frame), GRADES - 1))
            yield frame.assign(expected_grade=tails.sum(axis=1), tail_probability=tails[:, -1], accepted=tails[:, -1] >= (m.keep if m else 0))[[*names, "expected_grade", "tail_probability", "accepted"]]

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInPandas(run, f"{kind}, {_KIND}")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_probability, accepted for each row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return _scored(own, train(docs, labels), "text").drop("text")


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model accepts, columns as they are (each travels with its text through the map)."""
    cols = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)])
    text = own.columns[cols.index("text")]
    kept = _scored(own, train(docs, labels), text).where("accepted")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(own.columns, cols, strict=True)])
