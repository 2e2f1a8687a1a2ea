"""Interpolated Kneser-Ney against a version over dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from foliospark.llm import language_id


def dictionary_model(counts, characters=None):
    """Probability of (a, b, c, d) from counts of 4-grams: lower orders count the different characters that precede.

    What is left for characters never seen is spread evenly over ``characters``, by default those of the counts.
    """
    levels = [Counter(counts)]
    for _ in range(3):
        below = Counter()
        for gram in levels[-1]:
            below[gram[1:]] += 1
        levels.append(below)
    discounts = []
    for level in levels:
        seen = Counter(level.values())
        discounts.append(min(max(seen[1] / (seen[1] + 2 * seen[2]) if seen[1] else 0.5, 0.05), 0.95))
    totals, kinds = [defaultdict(int) for _ in levels], [defaultdict(int) for _ in levels]
    for k, level in enumerate(levels):
        for gram, n in level.items():
            totals[k][gram[:-1]] += n
            kinds[k][gram[:-1]] += 1
    floor = 1 / (max(2, characters or len(levels[3])) + 1)

    def probability(gram, k=0):
        if k == 4:
            return floor
        context, lower = gram[:-1], probability(gram[1:], k + 1)
        if not totals[k][context]:
            return lower
        n = levels[k][gram]
        return (max(n - discounts[k], 0) if n else 0) / totals[k][context] + discounts[k] * kinds[k][context] / totals[k][context] * lower

    return probability


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_probabilities_equal_a_dictionary_model(seed):
    r = random.Random(seed)
    alphabets = {"a": [97, 98, 99, 100, 32], "b": [97, 99, 0x65E5, 0x672C, 233]}
    counts = {lang: Counter(tuple(r.choice(letters[: r.randrange(1, 6)]) for _ in range(4)) for _ in range(400)) for lang, letters in alphabets.items()}
    pack = lambda g: (g[0] << 21 | g[1], g[2] << 21 | g[3])
    rows = [(lang, *pack(g), n) for lang, c in counts.items() for g, n in c.items()]
    model = language_id.train(pd.DataFrame(rows, columns=["lang", "first", "last", "n"]), 4)
    # all that was seen by either language, and what neither has seen
    grams = sorted({g for c in counts.values() for g in c} | {tuple(r.choice([97, 98, 233, 0x65E5, 122]) for _ in range(4)) for _ in range(300)})
    first, last = (np.array([pack(g)[i] for g in grams], dtype=np.uint64) for i in (0, 1))
    got = model.log_probabilities(first, last)
    characters = len({g[3] for c in counts.values() for g in c})
    for j, lang in enumerate(model.langs):
        probability = dictionary_model(counts[lang], characters)
        assert np.allclose(got[:, j], [math.log(probability(g)) for g in grams], atol=1e-4), lang


@pytest.mark.parametrize("seed", [4, 5])
def test_one_language_is_exact(seed):
    r = random.Random(seed)
    counts = Counter(tuple(r.choice([97, 98, 99, 100, 101, 32][: r.randrange(1, 7)]) for _ in range(4)) for _ in range(900))
    pack = lambda g: (g[0] << 21 | g[1], g[2] << 21 | g[3])
    model = language_id.train(pd.DataFrame([("x", *pack(g), n) for g, n in counts.items()], columns=["lang", "first", "last", "n"]), 4)
    probability = dictionary_model(counts)
    grams = sorted(set(counts) | {tuple(r.choice([97, 98, 99, 100, 101, 32, 120]) for _ in range(4)) for _ in range(400)})
    got = model.log_probabilities(*(np.array([pack(g)[i] for g in grams], dtype=np.uint64) for i in (0, 1)))[:, 0]
    assert np.allclose(got, [math.log(probability(g)) for g in grams], atol=1e-4)
