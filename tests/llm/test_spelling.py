"""Spelling variants against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from playledger.llm import spelling
from playledger.llm.queries import op11_spelling

DOCS = "doc_id BIGINT, text STRING, word STRING, n INT, subtree STRING, block STRING"


def counted(docs):
    """word -> occurrences by a plain loop."""
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            found[low] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain(n_of):
    near = {w: [v for v in n_of if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n_of}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n_of[v], v), default=None)
        form[w] = best if best is not None and n_of[best] >= 10 * n_of[w] else None
    out = set()
    for w in n_of:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n_of[w], len(near[w]), n_of[form[w]] if form[w] else None))
    return out


def rows(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def words(seed, count, letters="abnoé", least=7, most=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(least, most))): 10 ** rng.randrange(5)
            for _ in range(count)}


@pytest.mark.parametrize("tile,together,wide", [(8192, 20_000, 100_000), (16, 50, 64), (3, 1, 7)])
def test_equals_brute_force(spark, monkeypatch, tile, together, wide):
    for name, value in (("TILE", tile), ("TOGETHER", together), ("WIDE", wide)):
        monkeypatch.setattr(spelling, name, value)
    n_of = words(1, 350) | {"a" * 7: 1, "a" * 8: 10, "a" * 9: 100, "a" * 10: 1000, "a" * 11: 1}
    frame = spark.createDataFrame([(*x, 1) for x in n_of.items()], "word STRING, n BIGINT, own INT").repartition(5)
    assert rows(spelling.variants(frame)) == plain(n_of)


def test_long_words_and_counts_above_a_byte(spark):
    base = "".join(random.Random(2).choice("abcxyz") for _ in range(400))
    n_of = {base: 100, base[1:]: 1, base[:200] + "q" + base[200:]: 5, base[:-1] + "é": 2, base[::-1]: 9,
            "z" * 1500: 10, "z" * 1501: 100, "z" * 1400 + "b" + "z" * 100: 3,
            "a" * 1500: 10, "a" * 1501: 100, "a" * 1500 + "q": 3, "a" * 1400 + "b" + "a" * 100: 2, "a" * 1022: 4,
            "a" * 1023: 5, "a" * 1024: 6, "b" + "a" * 1023: 7, "b" + "a" * 1022: 8,
            base[:32]: 70, base[:33]: 7, base[:31]: 700, base[:16] + base[17:33]: 3}
    assert rows(spelling.variants(spark.createDataFrame(list(n_of.items()), "word STRING, n BIGINT"))) == plain(n_of)


def test_any_one_edit_is_in_reach(spark):
    rng, n_of = random.Random(3), {}
    for w in words(4, 60, "abcdefghijklmnopqrstuvwxyzàéîõüÿß×", 8, 16):
        at, c = rng.randrange(len(w)), rng.choice("abcdefghijklmnopqrstuvwxyzé")
        n_of |= {w: 50, w[:at] + c + w[at:]: 2, w[:at] + w[at + 1:]: 3, w[:at] + c + w[at + 1:]: 5}
    assert rows(spelling.variants(spark.createDataFrame(list(n_of.items()), "word STRING, n BIGINT"))) == plain(n_of)


def test_words_of_documents(spark):
    rng = random.Random(5)
    stems = ["Meaningful", "ÉTRANGERS", "straße×x", "ordinary", "ordinarz", "kitchens", "seven77seven", "short"]
    docs = [(i, " ".join(rng.choice(stems) + rng.choice(["", "!", "-", "7"]) for _ in range(60))) for i in range(120)]
    docs += [(None, "ordinary meaningful"), (3, None), (4, ""), (5, "x" * 300_000), (5, "x" * 300_000), (6, "12 ā")]
    frame = spark.createDataFrame([(*d, "w", 1, "s", "b") for d in docs], DOCS)
    got = {r.word: r.n for r in spelling.word_counts(frame).collect()}
    expected = counted(docs)
    assert got == expected
    assert rows(spelling.variants(spelling.word_counts(frame))) == plain(expected)


def test_empty_table_and_null_words(spark):
    frame = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert rows(spelling.variants(spelling.word_counts(frame))) == set()
    frame = spark.createDataFrame([(None, 3), ("singles", 2)], "word STRING, n BIGINT")
    assert rows(spelling.variants(frame)) == {("singles", None, "singles", 2, 0, None)}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(op11_spelling(spark, sf)) == plain(counted(docs))


def test_letters_come_from_the_column_and_leaves_together():
    words = pa.array(["über", "aaa", "x", "", "日本"])
    codes, lengths = spelling._codes(words.slice(1, 4))
    assert "".join(map(chr, codes)) == "aaax日本" and lengths.tolist() == [3, 1, 0, 2]
    assert [len(x) for x in spelling._codes(words.slice(0, 0))] == [0, 0]
    # As narrow as the words allow.
    assert spelling._Letters(words, *spelling._codes(words)).left.shape == (5, 5)
    rng = random.Random(3)
    some = sorted({"".join(rng.choice("ab") for _ in range(8)) for _ in range(200)})
    vectors = spelling._vectors(*spelling._codes(pa.array(some)))
    trie = spelling._Trie(np.zeros(len(some), dtype=np.int64), vectors)
    # Leaves of all branches are given at once.
    found = list(trie.search(np.zeros(len(some), dtype=np.int64), vectors))
    assert len(found) == 1
    pairs = {(some[a], some[b]) for a, b in zip(*found[0])}
    assert all((a, b) in pairs for a in some for b in some if one_edit(a, b))
