"""Quality scores learned from preferences between documents (Bradley-Terry).

A good document is preferred to a bad one. The chance that i wins against j is the logistic
function of score(i) - score(j), and a score is a weighted sum of features, so the weights
are those of a logistic loss on feature differences. A score quantile of the labelled rows
is the threshold; it becomes `CUT` on the scale of 0 to 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from .common import labelled_sample

#: Labelled rows of either class that the model is fitted on, at most; opponents of each.
PER_CLASS, OPPONENTS = 6000, 16
CUT = 0.3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:?'\"-"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOPS)
_BLANKS = b" \t\n\r\v\f"

FEATURES = (
    "log_words", "upper", "digits", "stops", "marks", "foreign", "word_length", "distinct",
    "repeats", "top_word", "same_lines", "long_words", "no_words", "short",
    "distinct_short", "marks_any", "upper_most", "repeats_any",
)


def features(text: str) -> list[float]:
    """Shares and sizes of one text, none of them depending on its language's words."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    visible = max(1, n - _count(data, _BLANKS))
    words = text.split()
    count = len(words)
    upper, lower = _count(data, _UPPER), _count(data, _LOWER)
    foreign = 0 if data.isascii() else _count(data, _HIGH)
    distinct = len(set(words)) / count if count else 1.0
    repeats = sum(map(str.__eq__, words, words[1:])) / count if count else 0.0
    top = Counter(words).most_common(1)[0][1] / count if count else 0.0
    lines = [x for x in text.split("\n") if x.strip()]
    same = 1 - len(set(lines)) / len(lines) if lines else 0.0
    marks = _count(data, _MARKS) / visible
    shouting = upper / max(1, upper + lower)
    return [
        np.log1p(count), shouting, _count(data, _DIGITS) / visible, _count(data, _STOPS) / visible,
        marks, foreign / visible, visible / max(1, count), distinct, repeats,
        top, same, float(count and visible / count > 15), float(count == 0), float(count < 20),
        # Of two texts of one kind the longer repeats more words.
        max(0.0, 0.9 - 0.08 * np.log1p(count) - distinct), float(marks > 0.02),
        float(shouting > 0.3), float(repeats > 0.05),
    ]


_HIGH = bytes(range(128, 256))


def _count(data: bytes, what: bytes) -> int:
    return len(data) - len(data.translate(None, what))


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; at least `CUT` exactly where the raw score reaches the threshold."""
        gap = (self.raw(x) - self.threshold) / self.spread
        value = 1 / (1 + np.exp(-np.clip(gap + np.log(CUT / (1 - CUT)), -30, 30)))
        return np.where(gap >= 0, np.maximum(value, CUT), np.minimum(value, np.nextafter(CUT, 0)))


def fit(x: np.ndarray, label: np.ndarray, decay: float = 1e-3) -> Ranking:
    """Weights from pairs of a good and a bad row, each row with `OPPONENTS` others, by Newton steps."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    weights = np.zeros(len(FEATURES))
    if not len(good) or not len(bad):
        # One class alone gives no preference: all rows score alike, as that class.
        return Ranking(mean, scale, weights, 1.0 if len(bad) else 0.0, 1.0)
    z = (x - mean) / scale
    draw = np.random.default_rng(3)
    size = max(len(good), len(bad)) * OPPONENTS
    pick = lambda rows: np.concatenate([draw.permutation(rows) for _ in range(-(-size // len(rows)))])[:size]
    difference = z[pick(good)] - z[pick(bad)]
    for _ in range(25):
        lost = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
        gradient = difference.T @ lost / size - decay * weights
        curve = (difference * (lost * (1 - lost))[:, None]).T @ difference / size
        step = np.linalg.solve(curve + decay * np.eye(len(weights)), gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-7:
            break
    raw = z @ weights
    threshold = _threshold(raw, label)
    spread = max(1e-6, float(np.std(raw)) / 2)
    return Ranking(mean, scale, weights, threshold, spread)


def _threshold(raw: np.ndarray, label: np.ndarray) -> float:
    """The score quantile, among 2000, that separates the classes best (mean of both recalls);
    of those that do so equally well, the middle between the lowest and the highest."""
    cuts = np.unique(np.quantile(raw, np.linspace(0, 1, 2001)))
    cuts = np.concatenate([cuts, (cuts[1:] + cuts[:-1]) / 2])
    good, bad = np.sort(raw[label == 1]), np.sort(raw[label == 0])
    kept = 1 - np.searchsorted(good, cuts) / len(good)
    gone = np.searchsorted(bad, cuts) / len(bad)
    best = cuts[kept + gone >= (kept + gone).max() - 1e-12]
    return float(best.min() + best.max()) / 2


def learn(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS) -> Ranking:
    """Fit on at most `per_class` labelled training rows of either class (a documented bound)."""
    rows = labelled_sample(docs, labels, "quality", train, per_class)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"],
                                "x": [features(t) for t in batch["text"]]})

    found = rows.mapInPandas(run, "doc_id BIGINT, label INT, x ARRAY<DOUBLE>").collect()
    # A fixed order, and one row for each distinct feature vector, whatever copies there are.
    unique = sorted({(tuple(r["x"]), r["label"]) for r in found})
    return fit(np.array([x for x, _ in unique]).reshape(-1, len(FEATURES)), np.array([y for _, y in unique]))


def scored(docs: DataFrame, model: Ranking) -> DataFrame:
    """All columns of `docs`, with quality_score and quality_ok; a null text counts as empty.

    Columns of these names in `docs` are replaced. Rows are scored one by one, so repeated
    rows get equal scores and an empty table gives no rows."""
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([features(t) for t in texts])))

    found = docs.withColumn("quality_score", score(F.coalesce(F.col("text"), F.lit(""))))
    return found.withColumn("quality_ok", F.col("quality_score") >= CUT)
