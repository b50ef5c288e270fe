"""Personal data by base rules and by context patterns bootstrapped from them.

Base rules find emails, addresses of the internet protocol, cards and phones. Their spans are
seeds: instances whose kind is known. A pattern is what stands around an instance (two words
before it, or a word on either side). Candidates are further tokens with digits or an `@`,
known by text. Patterns and instances form a graph that Spark scores in turns: a pattern of a
kind by the share of its distinct instances that have this kind, an instance by the chance
that not all of its patterns err. Patterns that reach `CONFIDENT` with `SUPPORT` distinct
instances find identifiers that no base rule finds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

KINDS = ("email", "ip", "card", "phone")
#: Turns of scoring; least share and least distinct instances of a pattern; least score of an instance.
TURNS, CONFIDENT, SUPPORT, ACCEPT = 3, 0.8, 5, 0.9

# The base rules. Starts inside a run of digits would fail as its start does.
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Tokens with an ASCII digit or an `@`.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Linear in the text: every `@` is tried once, with the run of characters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _AFTER_AT.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind; a kind's spans are leftmost and apart."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        # int() of a long run is slow, and such a part is above 255.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in spans])


def _around(text: str, start: int, end: int) -> list[str]:
    """The patterns of a place: two words before it; a word before and one after it. Only up to
    200 characters on either side are words of a context; a longer word is no context."""
    before = text[max(0, start - 200):start].lower().split()
    after = text[end:end + 200].lower().split()
    left = [re.sub("[0-9]+", "9", w) for w in before[-2:]]
    right = [re.sub("[0-9]+", "9", w) for w in after[:1]]
    out = []
    if len(left) == 2:
        out.append("<" + " ".join(left))
    if left and right:
        out.append("=" + left[-1] + " _ " + right[0])
    return out


def _candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit or `@`, without the signs around them, that touch no base span."""
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        start = m.start() + len(token) - len(token.lstrip(_EDGE))
        end = m.end() - (len(token) - len(token.rstrip(_EDGE)))
        if end - start >= 4:
            out.append((start, end))
    if not spans or not out:
        return out
    free, at = [], 0
    ends = sorted((a, b) for a, b, _ in spans)
    for start, end in out:
        while at < len(ends) and ends[at][1] <= start:
            at += 1
        if not any(a < end and b > start for a, b in ends[at:at + len(KINDS)]):
            free.append((start, end))
    return free


_PLACES = "ARRAY<STRUCT<start: BIGINT, stop: BIGINT, kind: INT, instance: STRING, patterns: ARRAY<STRING>>>"


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            spans = base_spans(text)
            counts = [sum(1 for s in spans if s[2] == k) for k in range(4)]
            places = [
                {"start": a, "stop": b, "kind": kind, "patterns": patterns,
                 "instance": hashlib.blake2b(text[a:b].lower().encode("utf-8", "replace"), digest_size=16).hexdigest()}
                for a, b, kind in [*spans, *((a, b, None) for a, b in _candidates(text, spans))]
                if (patterns := _around(text, a, b)) or kind is not None
            ]
            joined = _joined(spans)
            rows.append((*counts, joined, hashlib.sha256(joined.encode()).hexdigest(), places))
        out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "places"])
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        out.insert(1, "row_key", batch["row_key"].to_numpy())
        out.insert(2, "text_key", batch["text_key"].to_numpy())
        yield out


def _bootstrapped(edges: DataFrame, seeds: DataFrame, turns: int) -> DataFrame:
    """(pattern, kind, score) of trusted patterns; `edges`: distinct (pattern, instance),
    `seeds`: (instance, kind) of certain instances."""
    # Patterns with few distinct instances can never be trusted.
    crowded = edges.groupBy("pattern").agg(F.count("*").alias("all")).where(F.col("all") >= SUPPORT)
    kept = stored(edges.join(crowded, "pattern"))
    known = seeds.select("instance", "kind").distinct()
    for turn in range(turns):
        of_kind = kept.join(known, "instance").groupBy("pattern", "kind", "all").agg(F.count("*").alias("own"))
        # One more doubtful instance keeps small patterns humble.
        scored = of_kind.withColumn("score", F.col("own") / (F.col("all") + 1)).where(
            (F.col("own") >= SUPPORT) & (F.col("score") >= CONFIDENT))
        best = scored.groupBy("pattern").agg(F.max(F.struct("score", F.col("kind"))).alias("b")).select(
            "pattern", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
        trusted = stored(best)
        if turn == turns - 1 or trusted.isEmpty():
            return trusted
        doubt = kept.join(trusted, "pattern").groupBy("instance", "kind").agg(
            F.sum(F.log1p(-F.least("score", F.lit(0.999)))).alias("doubt"))
        new = doubt.where(1 - F.exp("doubt") >= ACCEPT).select("instance", "kind")
        known = stored(seeds.select("instance", "kind").unionByName(new).distinct())
    return trusted


def key_of_text() -> Column:
    """md5 of the text, a null one as empty: equal texts have equal spans."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def personal_data(docs: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row for each row of `docs`: doc_id, row_key, text_key (md5 of the text), n_email, n_ip,
    n_card, n_phone, base_sha256, spans.

    The counts and the hash are of base spans; `spans` has all spans as kind:start:end by start,
    then kind, joined by commas, in code points of the whole text. Null texts count as empty and
    have no spans. Rows that repeat a doc_id are rows of their own; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"),
                       F.coalesce("text", F.lit("")).alias("text"), key_of_text().alias("text_key"))
    return _with_added(stored(rows.mapInPandas(
        _found, "doc_id BIGINT, row_key BIGINT, text_key BINARY, n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, "
                f"base STRING, base_sha256 STRING, places {_PLACES}")), turns)


def _with_added(first: DataFrame, turns: int) -> DataFrame:
    places = first.select("row_key", F.explode("places").alias("p")).select("row_key", "p.*")
    edges = places.select("instance", F.explode("patterns").alias("pattern")).distinct()
    seeds = places.where(F.col("kind").isNotNull()).select("instance", "kind")
    trusted = _bootstrapped(edges, seeds, turns)
    added = (
        places.where(F.col("kind").isNull()).select("row_key", "start", "stop", F.explode("patterns").alias("pattern"))
        .join(trusted, "pattern").groupBy("row_key", "start", "stop")
        .agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("best"))
        .groupBy("row_key").agg(F.collect_list(F.struct("start", (-F.col("best.k")).alias("kind"), "stop")).alias("added"))
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    own = F.transform(F.filter("places", lambda p: p["kind"].isNotNull()), lambda p: F.struct(
        p["start"].alias("start"), p["kind"].alias("kind"), p["stop"].alias("stop")))
    every = F.array_sort(F.concat(own, F.col("added")))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return first.join(added, "row_key", "left").select(
        "doc_id", "row_key", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("added").isNull(), F.col("base")).otherwise(text).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap,
    what lies beyond the one before goes with it."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, s) for t, s in zip(texts, found)], dtype=object)

    return run(text, spans)


def _masked(text: str | None, spans: str | None) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for span in spans.split(","):
        kind, start, end = span.split(":")
        start, end = int(start), int(end)
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]
