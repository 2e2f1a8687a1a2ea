"""The trie of conversations against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from foliospark.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, part string, at string"


def symbol(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, symbol(role, text)), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * words
            leaves[path[:d]] += children[path] == 0
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), parent, len(m), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    table = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in conversation_trie.prefix_trie(table).collect()), key=str)


def made(seed, n, longest=9, words=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        for t in range(r.randrange(1, longest)):
            text = r.choice([None, "", " ".join(r.choice("ab") for _ in range(r.randrange(1, words)))])
            rows.append((c, t, r.choice(["user", "assistant", None]) if t > 2 else "user", text))
    return rows


def test_odd_rows(spark):
    rows = made(1, 130)
    rows += [(1000, None, "user", "null turn"), (1000, None, "user", "null turn"), (1000, 1, "user", "tie"), (1000, 1, "user", "other tie"), (1000, 1, "user", "tie")]
    rows += [(None, 1, "user", "no conversation"), (1009, 0, "user", "x" * 200_000), (1009, -5, "system", " \t one  two\u00a0three "), (2**53 + 3, 1, "user", "a")]
    assert run(spark, rows) == brute(rows)


def test_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)] + made(2, 40)
    rows = [(c + 1000 * (i >= 900), t, role, x) for i, (c, t, role, x) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_turnless_conversations_and_empty_tables(spark):
    lone = [(c, 0, "user", "only turn") for c in range(1, 20)]  # the base of the group is absent
    got = run(spark, lone)
    assert got == brute(lone)
    assert any(r[1] == 0 and r[3] == 19 for r in got)
    assert run(spark, []) == []


@pytest.mark.parametrize("longest", [40, 700])
def test_deep_conversations(spark, monkeypatch, longest):
    """Paths of many blocks, where blocks are ranked before whole paths are; two conversations part late."""
    monkeypatch.setattr(conversation_trie, "WIDTH", 4)
    monkeypatch.setattr(conversation_trie, "BLOCK", 32)
    r = random.Random(3)
    trunk = [("user", r.choice("ab")) for _ in range(longest)]
    rows = []
    for c in (1, 2, 3, 4, 5, 6):
        cut = r.randrange(longest // 2, longest)
        turns = trunk[:cut] + [("user", r.choice("ab")) for _ in range(r.randrange(20))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(7, t, *x) for t, x in enumerate(trunk[: longest // 2])]
    assert run(spark, rows) == brute(rows)
