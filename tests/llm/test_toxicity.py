"""Toxicity: automaton against edit distances, contexts, and accuracy on documents that taught nothing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from foliospark.llm import toxicity
from foliospark.llm.queries import op13_toxicity

LEXICON = [("idiot", True), ("worthless", True), ("scum", True), ("lowei", False), ("veq", False), ("idiotic", True)]


def distance(a, b):
    """Edits with swaps of neighbours, no character touched twice."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def accepted(word):
    found = []
    for t, (term, whole) in enumerate(LEXICON):
        k = toxicity.limit_of(term)
        for part in [word] if whole else [word[:n] for n in range(len(word) + 1)]:
            if (d := distance(term, part)) <= k:
                found.append((d, -len(term), t))
    return min(found) if found else None


def test_automaton_equals_edit_distances():
    automaton, r = toxicity.build_automaton(LEXICON), random.Random(1)
    words = {"idiot", "idoit", "idi0t", "worthles", "wrothlss", "scum", "scumm", "loweixyz", "lwoeiaa", "veq", "veqab", "ve", "idiotc", "x" * 5000}
    for term, _ in LEXICON:
        for _ in range(400):
            w = list(term + r.choice(["", "", "ab"]))
            for _ in range(r.randrange(4)):
                i = r.randrange(len(w) + 1)
                w[i : i + r.randrange(2)] = r.choice(["", "a", "o", "z", term[i % len(term)]])
            if "".join(w):
                words.add("".join(w))
    words = sorted(words)
    s = toxicity.words_of([" ".join(words)])
    found = automaton.run(s, automaton.lookup())
    assert [s.spell(i) for i in range(len(found))] == words
    for w, code in zip(words, found.tolist()):
        want = accepted(w)
        assert (code >= 0) == (want is not None), w
        if want:
            assert code % 4 == want[0], w


def test_words_and_contexts():
    texts = ["He said 'x'. You IDIOT, ÉTÉ!", None, "", 'They wrote "idiot and scum" there. An idiot', 'idiot "a\n b" idiot', "the word idiot", "id@ot @idiot@ 9idiot"]
    s = toxicity.words_of(texts)
    spelt = [(int(d), s.spell(i)) for i, d in enumerate(s.doc)]
    assert (0, "idiot") in spelt and (0, "été") in spelt and (6, "id@ot") in spelt and (6, "idiot") in spelt and (6, "9idiot") in spelt
    hits = np.array([i for i, (_, w) in enumerate(spelt) if w in ("idiot", "scum")])
    patterns = [(spelt[i][0], int(p)) for i, p in zip(hits, toxicity.contexts(s, hits))]
    assert patterns == [(0, 6), (3, 3), (3, 3), (3, 0), (4, 0), (4, 0), (5, 2), (6, 0)]


def corpus(seed, n):
    r = random.Random(seed)
    syllables = ["an", "re", "on", "ti", "he", "sta", "pu", "mi"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 80))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randrange(1, 5)):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "worthless", "scum", "Lowei" + r.choice(syllables) + r.choice(syllables)]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
        if i % 50 == 0:  # a family of copies whose own words must not become terms
            rows += [(10_000 + 100 * i + j, rows[-1][1] + f" own{i}word") for j in range(30)]
            labels += [(10_000 + 100 * i + j, int(toxic)) for j in range(30)]
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = corpus(5, 1500)
    docs = spark.createDataFrame([(i, t, "en", 0, True) for i, t in rows], "doc_id long, text string, lang string, toxic int, held_out boolean").repartition(3)
    table = spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")
    return docs, table, dict(labels), toxicity.fit(docs, table)


def test_lexicon_and_held_out_accuracy(spark, learned):
    docs, _, labels, model = learned
    assert set(model.lexicon) == {("idiot", True), ("worthless", True), ("scum", True), ("lowei", False)}
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and all(got[i]["predicted"] == labels[i] for i in held)


def test_misspelt_and_quoted_terms(spark, learned):
    _, _, _, model = learned
    cases = {
        1: ("you are an idoit and a complete worthlss person", 1),
        2: ("an I D I O T", 0),
        3: ('she said the word "idiot" is rude', 0),
        4: ("YOU IDIOT", 1),
        5: ("re an wort on less", 0),
        6: ("loweiabc on top", 1),
        7: (None, 0),
        8: ("", 0),
        9: ("\0\ud83d " + "an " * 200_000 + "idiot", 1),
        10: ("\u00a0\t\n ", 0),
    }
    rows = [(i, t.encode("utf-16", "ignore").decode("utf-16") if t else t) for i, (t, _) in cases.items()]
    rows += [(4, "YOU IDIOT"), (None, "idiot scum")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["predicted"] == (1 if r["doc_id"] is None else cases[r["doc_id"]][1]), r


def test_labels_of_held_out_documents_teach_nothing(spark, learned):
    docs, table, labels, model = learned
    turned = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels.items()] + [(None, 1, 1), (77_777_777, 1, 1), (3, 1, None)]
    again = toxicity.fit(docs, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert again.lexicon == model.lexicon and np.allclose(again.beta, model.beta)


@pytest.mark.parametrize("labels, want", [([], 0.0), ([(i, 0) for i in range(20)], 0.0), ([(i, 1) for i in range(20)], 1.0)])
def test_without_labels_of_both_kinds(spark, labels, want):
    docs = spark.createDataFrame([(i, "idiot text") for i in range(20)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {round(r["score"], 9) for r in toxicity.score(docs, model).collect()} == {want}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).lexicon == []


def test_query(spark):
    rows = op13_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
