"""Alignment of two tokenizers against whole texts encoded and walked byte by byte."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from foliospark.llm import tokenizer_alignment as ta


def token_bytes(pair):
    pieces = [pair.b.id_to_piece(i) for i in range(pair.b.get_piece_size())]
    byte = re.compile("<0x([0-9A-F]{2})>")
    letters = {chr(c): b for b, c in ta._byte_letters().items()}
    of_b = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("\u2581", " ").encode() for p in pieces]
    return lambda i: bytes(letters[c] for c in pair.a.id_to_token(i)), lambda i: of_b[i]


def brute(rows):
    pair = ta._load(ta.default_tokenizers())
    of_a, of_b = token_bytes(pair)
    found, counts = [], Counter()
    for i, text in rows:
        if not text:
            found.append((i, [], [], []))
            continue
        a = pair.a.encode(" " + text, add_special_tokens=False).ids
        b = pair.b.encode(text)
        if not b"".join(map(of_a, a)) == b"".join(map(of_b, b)) == (" " + text).encode():
            found.append((i, [], [], []))
            continue
        groups, links, x, y = [], [], 0, 0
        ends_a, ends_b, total = [], [], 0
        for t in a:
            total += len(of_a(t))
            ends_a.append(total)
        total = 0
        for t in b:
            total += len(of_b(t))
            ends_b.append(total)
        group = ([], [])
        while x < len(a):
            links.append((a[x], b[y]))
            ea, eb = ends_a[x], ends_b[y]
            if ea <= eb:
                group[0].append(a[x])
                x += 1
            if eb <= ea:
                group[1].append(b[y])
                y += 1
            if ea == eb:
                groups.append(group)
                group = ([], [])
        found.append((i, a, b, groups, links))
        counts.update(links)
    most = Counter()
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, a, b, groups, *rest in found:
        links = rest[0] if rest else []
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if links else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha, text))
    return sorted(out, key=str)


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, t, "x", 3, 4) for i, t in rows], "doc_id long, text string, w string, n int, chunk int").repartition(3)
    return sorted((tuple(r) for r in ta.align(table, with_groups=True, **options).collect()), key=str)


def odd_texts():
    r = random.Random(1)
    words = ["the", "Éléments", "über", "naïve", "it's", "don't", "\u201cquoted\u201d", "x" * 300, "日本語の文", "12345", "3.14", "a\u0301", "\U0001f600", "<|endoftext|>", "<s>", "</s>", "<0x41>", "&&&", "\u00a0", "Ünïcode"]
    gaps = [" ", " ", " ", "  ", "   ", "\n", "\n\n ", " \n", "\t", "\u00a0 ", " \u00a0", "\u3000", "\u2003 ", "\r\n", ""]
    return ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(1, 40))) for _ in range(150)]


def test_odd_texts(spark):
    rows = list(enumerate(odd_texts()))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "  "), (1004, " x"), (1005, "x "), (1006, "a \u2581 b"), (1007, "\u2581"), (1008, "\n"), (None, "no id"), (1009, "\x00 \x1f y")]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (6, "another text of six")]
    assert run(spark, rows) == brute(rows)


def test_long_texts_and_many_chunks(spark, monkeypatch):
    r = random.Random(2)
    vocabulary = ["".join(r.choice(["th", "er", "on", "ß", "ê", "ing", "'s", ","]) for _ in range(r.randrange(1, 6))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(200)))) for i in range(120)]
    rows += [(500, "ab" * 60_000), (501, " ".join(vocabulary) * 200), (502, "日本" * 3000)]
    rows += [(600 + i, rows[3][1]) for i in range(200)]  # copies
    assert run(spark, rows, blocks=2) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "", "")]


def test_chunks_end_and_begin(monkeypatch):
    """Within a task: documents of every chunk use the numbers of their own chunk."""
    import pyarrow as pa

    monkeypatch.setattr(ta, "CHUNK_STRETCHES", 20)
    texts = odd_texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    batches = [batch.slice(i, 10) for i in range(0, len(texts), 10)]
    spelt, docs, seen = {}, {}, Counter()
    for out in ta._split(iter(batches), ta.default_tokenizers(), pa.int64()):
        for x in out.to_pylist():
            if x["w"] is None:
                docs[x["doc_id"]] = (x["chunk"], x["ids"])
            else:
                spelt[x["chunk"], x["idx"]] = x["text"]
                seen[x["text"]] += x["n"]
    assert len({c for c, _ in docs.values()}) > 3 and len(docs) == len(texts)
    want = Counter()
    for i, text in enumerate(texts):
        chunk, ids = docs[i]
        assert ids is not None
        parts = [spelt[chunk, int.from_bytes(ids[k : k + 4], "little")] for k in range(0, len(ids), 4)]
        assert "".join(parts) == " " + text
        want.update(parts)
    assert seen == want


@pytest.mark.parametrize("stretches", [True, False])
def test_whole_texts_give_the_same(spark, monkeypatch, stretches):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:40])]
    monkeypatch.setattr(ta._load(ta.default_tokenizers()), "stretches", stretches)
    pair = ta._load(ta.default_tokenizers())
    for _, t in rows:
        a, b = pair.encode([" " + t])
        import numpy as np

        part = np.frombuffer((" " + t).encode(), dtype=np.uint8)
        start = ta._stretch_starts(part, np.array([0]), stretches)
        parts = [part[x:y].tobytes().decode() for x, y in zip(start, [*start[1:], len(part)])]
        pa_, pb = pair.encode(parts)
        assert a[0] == [i for x in pa_ for i in x] and b[0] == [i for x in pb for i in x]
