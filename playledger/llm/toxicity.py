"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding turns letters that look alike into one Latin letter (other alphabets, digits and signs
used as letters; i, l, 1 and | are one letter). Accents stay, as they part words of many
languages; whole words without accents are also looked for with all accents removed. The
lexicon is learned from labelled rows: words, and stems (beginnings of words, written with
`*`), that occur in clearly more toxic texts than clean ones, weighted by the log ratio. Word pairs around a lexicon word that occur in clean rows only become exception
phrases, in which the word does not count. The weights found are normalised
by the length of the text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, stored

#: Labelled rows of either class that lexicon and scale are fitted on, at most.
PER_CLASS = 3000
CUT = 0.3
#: A lexicon word is in this many different toxic texts at least, and its log ratio is above
#: this by two standard errors.
TEXTS, LEAST_RATIO = 4, 0.5
#: Lengths of stems.
STEMS = (4, 5, 6, 7)

# Letters of other alphabets and signs that look like Latin letters.
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "l": "i", "|": "i", "@": "a", "$": "s", "!": "i", "€": "e", "+": "t",
}
_SIGNS = "@$!€+|"
#: A sign stands for a letter only between letters or digits.
_LONE_SIGN = re.compile(rf"(?<![^\W_])[{re.escape(_SIGNS)}]|[{re.escape(_SIGNS)}](?![^\W_]|[{re.escape(_SIGNS)}]+[^\W_])")
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")
_ASCII = {i: _ALIKE.get(chr(i), chr(i)) for i in range(128)}


def _latin(c: str) -> str:
    """One folded character for each character of lower-case text."""
    if c in _ALIKE:
        return _ALIKE[c]
    plain = unicodedata.normalize("NFKC", c)
    return _ALIKE.get(plain, plain) if len(plain) == 1 else c


def _bare(c: str) -> str:
    base = unicodedata.normalize("NFKD", c)[0]
    return _ALIKE.get(base, base)


class _Folding(dict):
    """Fills itself with what `rule` makes of characters."""

    def __init__(self, rule):
        super().__init__(_ASCII)
        self.rule = rule

    def __missing__(self, code: int) -> str:
        self[code] = out = self.rule(chr(code))
        return out


_FOLDING, _BARE = _Folding(_latin), _Folding(_bare)


def folded(text: str) -> str:
    """Lower case in folded letters; loose accents and hidden characters go."""
    text = text.lower()
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFC", text))
    return _LONE_SIGN.sub(" ", text).translate(_FOLDING)


_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(folded(text))


@dataclass
class Lexicon:
    """Folded words and stems with weights, exception phrases (two words), and the scale of the score."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    slope: float = 1.0
    middle: float = 1.0
    _automaton: object = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def _matcher(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for phrase in self.exceptions:
                found.add_word(phrase, (len(phrase), None, False))
            # A word that is a stem too is one entry: the stem, with the larger weight.
            entries: dict[str, tuple[float, bool]] = {}
            for entry, weight in self.weights.items():
                name, stem = entry.removesuffix("*"), entry.endswith("*")
                old = entries.get(name, (0.0, False))
                entries[name] = (max(weight, old[0]), stem or old[1])
            for name, (weight, stem) in entries.items():
                found.add_word(name, (len(name), weight, stem))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the folded text of whole words that no exception covers."""
        if not self.weights:
            return []
        plain = folded(text)
        best: dict[int, tuple[int, int, float]] = {}
        excused = []
        for whole_words, own in ((False, plain), (True, plain if plain.isascii() else plain.translate(_BARE))):
            if whole_words and own is plain:
                continue
            for last, (n, weight, stem) in self._matcher().iter(own):
                start, end = last - n + 1, last + 1
                if (start and own[start - 1].isalnum()) or (
                        end < len(own) and own[end].isalnum() and not stem) or (stem and whole_words):
                    continue
                if weight is None:
                    excused.append((start, end))
                elif start not in best or weight > best[start][2]:
                    best[start] = (start, end, weight)
        found = sorted(best.values())
        if excused:
            covered = np.zeros(len(plain) + 1, dtype=bool)
            for start, end in excused:
                covered[start:end] = True
            found = [h for h in found if not covered[h[0]:h[1]].all()]
        return found

    def density(self, text: str) -> float:
        """Sum of weights over the logarithm of the length in characters: long texts need more
        to be as toxic, but one clear word still shows."""
        total = sum([w for _, _, w in self.hits(text)])
        return total / np.log2(16 + len(text)) if total else 0.0

    def score(self, density: np.ndarray) -> np.ndarray:
        """Between 0 and 1, `CUT` at the fitted middle."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (density - self.middle) + np.log(CUT / (1 - CUT)), -30, 30)))


def _alike(own: list[str]) -> int:
    """The smallest hash of three words in a row: near copies mostly share it."""
    runs = {" ".join(own[i:i + 3]) for i in range(max(1, len(own) - 2))}
    return min(zlib.crc32(r.encode("utf-8", "replace")) for r in runs)


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"label": batch["label"], "text": batch["text"],
                            "text_group": [_alike(words(t)) for t in batch["text"]]})


def _entries(text: str) -> set[str]:
    """The distinct words and stems of a text."""
    kinds = set(words(text))
    return kinds | {f"{w[:n]}*" for w in kinds for n in STEMS if len(w) > n}


def _counted():
    """(word, label, n): groups of alike texts that hold each entry. A group's rows are in one
    partition, so sums over partitions count every group once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], set[str]] = {}
        for batch in batches:
            for label, group, text in zip(batch["label"], batch["text_group"], batch["text"]):
                seen.setdefault((label, group), set()).update(_entries(text))
        counts = Counter((w, label) for (label, _), found in seen.items() for w in found)
        yield pd.DataFrame([(w, label, n) for (w, label), n in counts.items()], columns=["word", "label", "n"])

    return run


def _phrases(found: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = set()
            for label, group, text in zip(batch["label"], batch["text_group"], batch["text"]):
                own = words(text)
                seen.update((label, group, f"{a} {b}") for a, b in zip(own, own[1:]) if a in found or b in found)
            yield pd.DataFrame(list(seen), columns=["label", "text_group", "phrase"])

    return run


def _specific(strong: list[tuple[str, int, float]]) -> dict[str, float]:
    """Weights of words, and of stems that are more than one word's beginning."""
    most: dict[str, int] = {}
    for w, n, _ in strong:
        if not w.endswith("*"):
            for beginning in {w[:length] for length in STEMS}:
                most[beginning] = max(n, most.get(beginning, 0))
    return {
        w: ratio for w, n, ratio in strong
        if not w.endswith("*") or most.get(w[:-1], 0) < 0.7 * n
    }


def learn(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS) -> Lexicon:
    """A lexicon from at most `per_class` labelled training rows of either class.

    Words are counted by different texts; near copies of one text count as one, mostly. Without
    rows of both classes the lexicon is empty and every text scores below `CUT`.
    """
    sample = labelled_sample(docs, labels, "toxic", train, per_class)
    rows = stored(sample.mapInPandas(_grouped, "label INT, text STRING, text_group BIGINT").repartition("text_group"))
    both = [F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")]
    sums = rows.select("label", "text_group").distinct().agg(*both).first()
    if not sums["toxic"] or not sums["clean"]:
        return Lexicon({})
    form = "word STRING, label INT, n BIGINT"
    # Counts of both classes meet in Spark, and only entries that are strong enough leave it:
    # no more than the sample has words and stems.
    counts = rows.repartition("text_group").mapInPandas(_counted(), form).groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))
    shares = [(F.col(c) + 0.5) / F.lit(float(sums[c])) for c in ("toxic", "clean")]
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    passing = (
        counts.where((F.col("toxic") >= TEXTS) & (F.length("word") > 2))
        .withColumn("ratio", F.log(shares[0]) - F.log(shares[1])).where(F.col("ratio") - 2 * error >= LEAST_RATIO)
        .orderBy(F.desc("ratio"), "word")
    )
    strong = [(r["word"], int(r["toxic"]), float(r["ratio"])) for r in passing.collect()]
    found = _specific(strong)
    lexicon = Lexicon(found)
    if found:
        listed = {w for w in found if not w.endswith("*")}
        phrases = rows.mapInPandas(_phrases(listed), "label INT, text_group BIGINT, phrase STRING").distinct()
        kept = phrases.groupBy("phrase").agg(*both).where("toxic = 0 AND clean >= 2")
        # No more than the sample has words beside the listed ones.
        lexicon.exceptions = {r["phrase"] for r in kept.select("phrase").collect()}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [lexicon.density(t) for t in batch["text"]]})

    measured = rows.mapInPandas(measure, "label INT, x DOUBLE").collect()
    x, y = np.array([r["x"] for r in measured]), np.array([r["label"] for r in measured])
    lexicon.middle, lexicon.slope = _scale(x, y)
    return lexicon


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The cut that separates the classes best (mean of both recalls; in the middle of the gap),
    and a slope by which the class means lie well on either side."""
    levels = np.unique(np.concatenate([[0.0], x]))
    cuts = np.append((levels[1:] + levels[:-1]) / 2, levels[-1] + 0.1)
    toxic, clean = np.sort(x[y == 1]), np.sort(x[y == 0])
    right = (1 - np.searchsorted(toxic, cuts) / len(toxic)) + np.searchsorted(clean, cuts) / len(clean)
    best = cuts[np.flatnonzero(right == right.max())]
    middle = float(best[0])
    return middle, 6.0 / max(middle, 1e-6)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns of `docs`, with toxicity and toxic_found; a null text counts as empty.

    Columns of these names in `docs` are replaced. Rows are scored one by one, so repeated
    rows get equal scores and an empty table gives no rows."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(lexicon.score(np.array([lexicon.density(t) for t in texts], dtype=float)))

    found = docs.withColumn("toxicity", score(F.coalesce(F.col("text"), F.lit(""))))
    return found.withColumn("toxic_found", F.col("toxicity") >= CUT)
