"""Chat formatting against a plain version, and its edge cases."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from playledger.llm import chat

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, part STRING, block STRING, formatted INT"
ODD = ["", " ", "a\nb", "\\", "<\\", "<|im_end|>", "<\\|im_end|>", "<\\\\\\</s>", "</s>[INST] ok [/INST]", "<<s>s>",
       "<s", "日本語 🙂 <s>", "\x00", "[[INST]]", "é́", "[/INST", "<<SYS>><</SYS>>", "<|im_sep|>x", "x" * 70000]


def plain(rows):
    """Digests by a plain loop over turns."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "b", 3) for r in rows], SCHEMA)


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def rows_of(seed, conversations=40):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, 9)):
            text = rng.choice([*ODD, None]) + rng.choice(ODD) if rng.random() < 0.5 and c else rng.choice([*ODD, None])
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "", "<|im_sep|>"]), text))
    return [(c, t, r, x) for c, t, r, x in rows]


@pytest.fixture
def rows():
    rng = random.Random(5)
    found = [(c, t, rng.choice(["user", "assistant", "system", None, "", "<|im_sep|>"]),
              rng.choice([*ODD, None])) for c in range(40) for t in range(rng.randrange(1, 9))]
    # Ties, repeated rows, null ids and turns, and one long conversation with a third of all rows.
    found += [(1, 0, "user", "tie"), (1, 0, "assistant", "tie"), (1, 0, "user", "tie"), (None, 1, "user", "x"),
              (None, None, "assistant", "y"), (2, None, "assistant", "first"), (-7, 0, "user", ODD[8])]
    return found + [(99, t, "assistant" if t % 2 else "user", f"{t} {rng.choice(ODD)}") for t in range(150)]


@pytest.mark.parametrize("block,at_once", [(256, 8 << 20), (16, 8 << 20), (16, 2000), (1, 100)])
def test_equals_the_plain_version(spark, rows, monkeypatch, block, at_once):
    monkeypatch.setattr(chat, "AT_ONCE", at_once)
    formatted = chat.format_conversations(frame(spark, rows).repartition(5), block)
    assert read(chat.read_back(formatted)) == plain(rows)
    kept = formatted.collect()
    assert sum(r.n_turns for r in kept) == len(rows)
    whole = [r.conv_id for r in kept if r.complete]
    assert len(whole) == len(set(whole))
    if block == 256 and at_once > 2000:
        # Short conversations are one row each.
        assert len(kept) == len({r[0] for r in rows}) + len({r[1] is None for r in rows if r[0] is None}) - 1 + 1
    by_id = defaultdict(list)
    for r in sorted(kept, key=lambda r: r.part):
        by_id[r.conv_id].append(r)
    for parts in by_id.values():
        assert len(parts) == 1 or not any(r.complete for r in parts)
        for r in parts:
            for s, e in zip(r.loss_starts, r.loss_ends):
                assert r.formatted[:s].endswith("assistant" + chat.SEP) and r.formatted[e:].startswith(chat.END)


def test_assembly_equals_joined_strings():
    rng = random.Random(1)
    roles = [rng.choice(["user", "assistant", "ünser", ""]) for _ in range(200)]
    texts = [rng.choice(ODD) for _ in range(200)]
    first = sorted({0, *rng.sample(range(1, 200), 40)})
    import numpy as np

    made = chat.assemble(pa.array(roles), pa.array(texts), np.array(first))
    escaped = [chat.escape(pa.array(x)).to_pylist() for x in (roles, texts)]
    turns = [f"{chat.START}{r}{chat.SEP}{t}{chat.END}" for r, t in zip(*escaped)]
    expected = ["".join(turns[a:b]) for a, b in zip(first, [*first[1:], 200])]
    assert made["formatted"].to_pylist() == expected
    assert made["n_turns"].to_pylist() == [b - a for a, b in zip(first, [*first[1:], 200])]


def test_escapes_are_reversible():
    rng = random.Random(2)
    bits = ["<", "[", "\\", "|im_end|>", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "|", ">", "x", "é", *chat.CONTROL]
    texts = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(5000)] + ODD
    escaped = chat.escape(pa.array(texts)).to_pylist()
    assert [chat.unescape(x) for x in escaped] == texts
    assert not any(c in x for x in escaped for c in chat.CONTROL)
    assert [x for x, t in zip(escaped, texts) if x == t and any(c in t for c in chat.CONTROL)] == []


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(frame(spark, []))).collect() == []
