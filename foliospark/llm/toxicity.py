"""Toxicity by a learned lexicon, matched with misspellings, and the context of each match.

1. Lexicon. All labelled texts count how many word types of each document begin with a prefix, or are a
   word, by label. Those far more frequent in toxic documents are candidates; on a bounded sample of
   labelled texts (``teaching_docs`` distinct ones for each label, by hash) families of near copies become
   one document each, and a candidate stays if toxic families hold it significantly more often. Of nested
   candidates the longest with nearly all the families of a shorter one stays, so ``idiot`` is a whole
   word and a stem that takes many endings is a stem.
2. Matching. The lexicon's trie is intersected with Levenshtein automata (insertion, deletion,
   substitution, swap of neighbours; the distance allowed grows with the term's length, ``LIMITS``) and
   made deterministic on the driver. Its tables are small: at most ``max_terms`` terms. Tasks run all
   words of a slice through it at once.
3. Context. A match is quoted if its line has an odd number of quotation marks before it and one behind
   it within ``WINDOW`` characters, reported if a word of ``CUES`` is among the four words before,
   addressed if a word of ``SECOND`` is within three words. Each of the eight patterns has a factor,
   learned from the labels of documents with such matches and held to ``PRIOR`` where there are few.
4. Score. A match counts its term's weight (log odds of its documents by label, also for misspellings,
   which count ``MISSPELT`` of the term where none were seen) times its context's factor. The sum meets a
   logistic regression fitted on counts of all labelled documents by sum.

Defined results: null and empty texts have no matches. Labels that contradict each other count as their
mean, rounded up at a half; null labels and rows without a document teach nothing. Rows that repeat are
scored alike. Without labels of both kinds there is no lexicon and every score is the rate of toxic
labels, 0 without any. Columns other than id and text are ignored, by learning as by scoring.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix, powers, slices, text_buffers
from .language_id import _letter_codes
from .store import materialize

TEACHING_DOCS = 20_000
MAX_TERMS = 1_000
MAX_CANDIDATES = 200_000
MOST_LABELS = 4_000_000  # of which a table of (id, label) may be broadcast
SHORTEST, LONGEST = 3, 12  # letters of a prefix
LIMITS = ((9, 2), (5, 1))  # (letters, distance)
LEAST_ODDS, LEAST_DOCS = 10.0, 3
MISSPELT = 0.6
WINDOW = 160
PRIOR = {"quoted": 0.1, "reported": 0.5, "addressed": 1.5}
PRIOR_DOCS = 20
_TOP_LOG_ODDS = 4.0
_BANDS, _ROWS = 6, 2
_TEXTS = _BANDS * _ROWS
_BASE = 0x9E3779B97F4A7C15
_POW = powers(_BASE, 1 << 12)
_ALL_WORDS = 1_000_000
QUOTES = "\"“”„‟«»「」『』"
_SIGNS = "@$*"
# Words that announce a quotation, and words that address the reader, in the languages of the corpus.
CUES = set("said says say called calls call word words term quote quoted quotes insult insults slur wrote dit dite mot terme insulte appelé sagte sagt wort begriff genannt nannte dijo dice palabra término insulto llamó".split())
SECOND = set("you your yours youre u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes".split())
_CODES: list[np.ndarray] = []


# --- words of a slice ---------------------------------------------------------------------------


@dataclass
class Slice:
    """Words of some texts: lower-case code points, 0 between words; ``raw`` has the text itself."""

    raw: np.ndarray
    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    size: int

    def spell(self, i: int) -> str:
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "replace")


def _tables() -> np.ndarray:
    if not _CODES:
        codes = _letter_codes()
        codes[codes == 32] = 0
        codes[48:58] = np.arange(48, 58)
        _CODES.append(codes)
    return _CODES[0]


def words_of(texts: list[str | None]) -> Slice:
    """Words are runs of letters and digits; the signs of leet spelling belong to a word inside it."""
    clean = [(t.replace("\0", " ") if "\0" in t else t) if t else "" for t in texts]
    raw = np.frombuffer(("\0" + "\0".join(clean) + "\0").encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = _tables()[raw]
    is_sign = np.isin(raw, [ord(c) for c in _SIGNS])
    if is_sign.any():
        at = np.flatnonzero(is_sign)
        at = at[(codes[at - 1] != 0) & (codes[at + 1] != 0)]
        codes[at] = raw[at]
    word = codes != 0
    edge = np.diff(word.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    doc = np.searchsorted(np.flatnonzero(raw == 0), start) - 1
    return Slice(raw, codes, start, end, doc, len(texts))


def _prefix_hashes(s: Slice, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, hash of their first n characters) for each n, then hashes of whole words."""
    n = s.end - s.start
    running = np.zeros(len(s.start), dtype=U64)
    for k in range(max(lengths)):
        here = np.flatnonzero(n > k)
        running[here] += s.codes[s.start[here] + k].astype(U64) * _POW[k]
        if k + 1 in lengths:
            # a whole word of this length is no prefix of its own
            yield here, mix(running[here] + U64(k + 1))
    yield np.arange(len(n)), _word_hashes(s)


def _word_hashes(s: Slice) -> np.ndarray:
    if not len(s.start):
        return np.zeros(0, U64)
    n = s.end - s.start
    at = np.repeat(s.start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = at - np.repeat(s.start, n)
    weights = _POW[place] if n.max() <= len(_POW) else powers(_BASE, int(n.max()))[place]
    return mix(np.add.reduceat(s.codes[at].astype(U64) * weights, np.cumsum(n) - n) + (n.astype(U64) << U64(32)))


def term_hash(text: str, whole: bool) -> int:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(U64)
    total = (codes * powers(_BASE, len(codes))).sum(dtype=U64)
    return int(mix(np.array([total + (U64(len(codes) << 32) if whole else U64(len(codes)))], dtype=U64))[0])


# --- lexicon ------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): documents with the word, by label, over what the task has read."""
    spelt: dict[int, str] = {}
    counts: dict[int, list[int]] = {}

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([spelt[k] for k in keys], pa.string())] + [pa.array([counts[k][i] for k in keys], pa.int64()) for i in (0, 1)], names=["word", "toxic", "clean"]
        )

    for batch in batches:
        toxic, text = batch.column(0).to_numpy(zero_copy_only=False).astype(bool), batch.column(1)
        for lo, hi in slices(text_buffers(text)[0]):
            s = words_of(text.slice(lo, hi - lo).to_pylist())
            h = _word_hashes(s)
            _, first = np.unique(mix(h + s.doc.astype(U64) * U64(_BASE)), return_index=True)
            kind, at, inverse = np.unique(h[first], return_index=True, return_inverse=True)
            is_toxic = toxic[lo:hi][s.doc[first]]
            n1 = np.bincount(inverse, weights=is_toxic, minlength=len(kind)).astype(np.int64)
            n = np.bincount(inverse, minlength=len(kind))
            for k, i, a, b in zip(kind.tolist(), first[at].tolist(), n1.tolist(), (n - n1).tolist()):
                held = counts.get(k)
                if held is None:
                    counts[k], spelt[k] = [a, b], s.spell(i)
                else:
                    held[0] += a
                    held[1] += b
            if len(counts) > _ALL_WORDS:
                yield flush()
                counts, spelt = {}, {}
    yield flush()


def candidates(labelled: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """(text, whole) of prefixes and words whose share of toxic documents is several times that of clean ones, the strongest first."""
    counts = labelled.select("toxic", "text").mapInArrow(_count_words, "word string, toxic long, clean long")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.filter(F.length("word") <= 64)
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    parts = F.when(F.length("word") >= SHORTEST, F.transform(lengths, lambda n: F.struct(F.substring("word", F.lit(1), n).alias("term"), F.lit(False).alias("whole"))))
    whole = F.array(F.struct(F.col("word").alias("term"), F.lit(True).alias("whole")))
    terms = counts.select(F.explode(F.concat(F.coalesce(parts, F.array().cast("array<struct<term:string,whole:boolean>>")), whole)).alias("t"), "toxic", "clean")
    terms = terms.groupBy("t.term", "t.whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1.0)) / ((F.col("clean") + 0.5) / (n_clean + 1.0))
    found = terms.filter(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") > 2)
    best = found.orderBy((F.col("toxic") * F.log("odds")).desc(), "term", "whole").limit(MAX_CANDIDATES).select("term", "whole").collect()
    return [(r["term"], r["whole"]) for r in best]


def _teach(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Minimum hashes of each document's runs of three words (of its words, if fewer), and the candidates it holds."""
    keys, number = held.value
    lengths = list(range(SHORTEST, LONGEST + 1))
    seeds = mix(np.arange(1, _TEXTS + 1, dtype=U64))
    for batch in batches:
        text = batch.column(2)
        for lo, hi in slices(text_buffers(text)[0]):
            s = words_of(text.slice(lo, hi - lo).to_pylist())
            h = _word_hashes(s)
            sketch = np.zeros((s.size, _TEXTS), dtype=U64)
            sketch -= U64(1)
            runs, of = _runs(h, s.doc, s.size)
            for j, seed in enumerate(seeds):
                np.minimum.at(sketch[:, j], of, mix(runs ^ seed))
            pairs = []
            for rows, hashes in _prefix_hashes(s, lengths):
                at = np.searchsorted(keys, hashes)
                at[at == len(keys)] = 0
                hit = keys[at] == hashes if len(keys) else np.zeros(len(at), bool)
                pairs.append((s.doc[rows[hit]] << 32) | number[at[hit]])
            found = np.unique(np.concatenate(pairs))
            cuts = np.searchsorted(found, np.arange(s.size + 1) << 32)
            terms = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((found & 0xFFFFFFFF).astype(np.int32)))
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(s.size + 1) * _TEXTS, pa.int32()), pa.array(sketch.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), sketches, terms], names=["toxic", "h", "sketch", "terms"])


def _runs(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of runs of three words; documents of one or two words have these."""
    short = np.bincount(doc, minlength=size)[doc] < 3
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    runs = mix(h[whole] + h[whole + 1] * U64(_BASE) + h[whole + 2] * U64(0xD1B54A32D192ED03))
    return np.concatenate([runs, h[short]]), np.concatenate([doc[whole], doc[short]])


def _families(sketches: np.ndarray) -> np.ndarray:
    """A number for each document, equal where two share a band of minimum hashes, directly or through others."""
    parent = np.arange(len(sketches))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for b in range(_BANDS):
        band = sketches[:, b * _ROWS : (b + 1) * _ROWS]
        _, first, inverse = np.unique(band, axis=0, return_index=True, return_inverse=True)
        for i, j in enumerate(first[inverse.ravel()]):
            a, c = find(i), find(int(j))
            if a != c:
                parent[max(a, c)] = min(a, c)
    return np.array([find(i) for i in range(len(parent))])


def choose_terms(found: list[tuple[str, bool]], toxic: np.ndarray, family: np.ndarray, terms: list[list[int]], max_terms: int = MAX_TERMS) -> list[tuple[str, bool]]:
    """The lexicon: candidates that significantly many toxic families hold, without those that a longer one explains."""
    family_of: list[dict[int, set]] = [defaultdict(set), defaultdict(set)]
    for y, f, mine in zip(toxic, family, terms):
        for t in mine:
            family_of[int(y)][t].add(int(f))
    n1, n0 = (max(1, len({int(f) for f, y in zip(family, toxic) if bool(y) == k})) for k in (True, False))
    base, need = n1 / (n1 + n0), np.log(max(len(found), 2)) + 2
    good: dict[tuple[str, bool], set] = {}
    for t, fams in family_of[1].items():
        c1, c0 = len(fams), len(family_of[0].get(t, ()))
        odds = ((c1 + 0.5) / (n1 + 1)) / ((c0 + 0.5) / (n0 + 1))
        p = c1 / (c1 + c0)
        gain = c1 * np.log(max(p, 1e-9) / base) + (c0 * np.log(max(1 - p, 1e-9) / (1 - base)) if c0 else 0.0)
        if c1 >= LEAST_DOCS and odds >= LEAST_ODDS and gain >= need:
            good[found[t]] = fams
    kept: dict[tuple[str, bool], set] = {}
    longer: dict[str, list] = defaultdict(list)
    for term, whole in good:
        for n in range(1, len(term) + whole):
            longer[term[:n]].append((term, whole))
    for key in sorted(good, key=lambda x: (len(x[0]), x[1], x[0])):
        term, whole = key
        explained = not whole and any(len(good[q] & good[key]) >= 0.8 * len(good[key]) for q in longer[term])
        shorter = any((term[:n], False) in kept for n in range(1, len(term) + whole))
        if not explained and not shorter:
            kept[key] = good[key]
    return sorted(kept, key=lambda x: (-len(kept[x]), x))[:max_terms]


# --- automaton ----------------------------------------------------------------------------------


def limit_of(term: str) -> int:
    return next((k for n, k in LIMITS if len(term) >= n), 0)


@dataclass
class Automaton:
    """Deterministic tables: next state by (state, symbol), and term * 4 + distance of the words accepted in a state, or -1."""

    symbol: dict[str, int]
    table: np.ndarray
    accepts: np.ndarray
    absorbing: np.ndarray

    def run(self, s: Slice, lookup: np.ndarray) -> np.ndarray:
        """What each word of the slice is accepted as."""
        n = s.end - s.start
        state = np.ones(len(n), dtype=np.int32)
        alive = np.arange(len(n))
        step = 0
        while len(alive):
            now = self.table[state[alive], lookup[s.codes[s.start[alive] + step]]]
            state[alive] = now
            step += 1
            alive = alive[~self.absorbing[now] & (n[alive] > step)]
        return self.accepts[state]

    def lookup(self) -> np.ndarray:
        out = np.zeros(0x110000, dtype=np.uint16)
        for c, k in self.symbol.items():
            out[ord(c)] = k
        return out


def build_automaton(lexicon: list[tuple[str, bool]]) -> Automaton:
    """The intersection of the lexicon's trie with Levenshtein automata, made deterministic.

    A position is (node, edits so far, awaited letter of a swap). A stem's acceptance sticks, whatever follows.
    """
    children: list[dict[str, int]] = [{}]
    ends: list[list[int]] = [[]]
    most = [0]  # edits that any term below a node allows
    for i, (term, _) in enumerate(lexicon):
        node, k = 0, limit_of(term)
        most[0] = max(most[0], k)
        for c in term:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append([])
                most.append(0)
            node = children[node][c]
            most[node] = max(most[node], k)
        ends[node].append(i)

    def closed(raw: set) -> frozenset:
        best: dict = {}
        todo = list(raw)
        while todo:
            node, e, wait = todo.pop()
            if best.get((node, wait), 9) <= e:
                continue
            best[node, wait] = e
            if not wait:
                todo += [(c, e + 1, "") for c in children[node].values() if e < most[c]]
        return frozenset((n, e, w) for (n, w), e in best.items())

    def step(positions: frozenset, c: str) -> frozenset:
        out = set()
        for node, e, wait in positions:
            if wait:
                if c == wait:
                    out.add((node, e, ""))
                continue
            for x, child in children[node].items():
                if x == c:
                    out.add((child, e, ""))
                    continue
                if e < most[child]:
                    out.add((child, e + 1, ""))
                swapped = children[child].get(c)
                if swapped is not None and e < most[swapped]:
                    out.add((swapped, e + 1, x))
            if e < most[node]:
                out.add((node, e + 1, ""))
        return closed(out)

    def accepted(positions: frozenset, stems: bool):
        found = [(e, -len(lexicon[t][0]), t) for n, e, w in positions if not w for t in ends[n] if e <= limit_of(lexicon[t][0]) and lexicon[t][1] != stems]
        return min(found, default=None)

    letters = sorted({c for t, _ in lexicon for c in t})
    dead = (frozenset(), None)
    first = (closed({(0, 0, "")}) if lexicon else frozenset(), None)
    number, order = {dead: 0}, [dead]
    if first != dead:
        number[first] = 1
    order.append(first)
    rows = [[0] * (len(letters) + 1)]
    at = 1
    while at < len(order):
        positions, sticky = order[at]
        row = []
        for c in ["", *letters]:
            after = step(positions, c)
            held = min((x for x in (sticky, accepted(after, True)) if x), default=None)
            if held and held[0] == 0:
                after = frozenset()
            key = (after, held)
            if key not in number:
                number[key] = len(order)
                order.append(key)
            row.append(number[key])
        rows.append(row)
        at += 1
    accepts, absorbing = [], []
    for positions, sticky in order:
        best = min((x for x in (sticky, accepted(positions, False)) if x), default=None)
        accepts.append(-1 if best is None else best[2] * 4 + best[0])
        absorbing.append(not positions)
    return Automaton({c: i + 1 for i, c in enumerate(letters)}, np.array(rows, dtype=np.int32), np.array(accepts, dtype=np.int32), np.array(absorbing))


# --- context and evidence -----------------------------------------------------------------------


def contexts(s: Slice, hits: np.ndarray) -> np.ndarray:
    """Pattern of each of the words ``hits``: 1 quoted, 2 reported, 4 addressed."""
    out = np.zeros(len(hits), dtype=np.int64)
    if not len(hits):
        return out
    marks = np.flatnonzero(np.isin(s.raw, [ord(c) for c in QUOTES]))
    lines = np.flatnonzero((s.raw == 10) | (s.raw == 0))
    at, to = s.start[hits], s.end[hits]
    line = np.searchsorted(lines, at) - 1
    before = np.searchsorted(marks, at)
    odd = (before - np.searchsorted(marks, lines[line])) % 2 == 1
    padded = np.concatenate([[-(1 << 40)], marks, [1 << 40]])
    behind = padded[np.searchsorted(marks, to) + 1]
    out += odd & (at - padded[before] <= WINDOW) & (behind < lines[line + 1]) & (behind - to <= WINDOW)
    for k, i in enumerate(hits):
        doc = s.doc[i]
        near = {j: s.spell(j) for j in range(max(0, i - 4), min(len(s.doc), i + 4)) if j != i and s.doc[j] == doc and s.end[j] - s.start[j] <= 16}
        out[k] += 2 * any(w in CUES for j, w in near.items() if j < i) + 4 * any(w in SECOND for j, w in near.items() if i - 3 <= j)
    return out


def _scan(text: pa.Array, automaton: Automaton, lookup: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, document of each match, its code: (term * 4 + distance) * 8 + pattern)."""
    for lo, hi in slices(text_buffers(text)[0]):
        s = words_of(text.slice(lo, hi - lo).to_pylist())
        found = automaton.run(s, lookup)
        hits = np.flatnonzero(found >= 0)
        yield lo, hi, s.doc[hits], found[hits].astype(np.int64) * 8 + contexts(s, hits)


def _hits(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    automaton = held.value
    lookup = automaton.lookup()
    for batch in batches:
        toxic, text = batch.column(0), batch.column(1)
        for lo, hi, doc, code in _scan(text, automaton, lookup):
            cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([toxic.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(code))], names=["toxic", "hits"])


def prior_factors() -> np.ndarray:
    out = np.ones(8)
    for k, name in enumerate(("quoted", "reported", "addressed")):
        out[(np.arange(8) >> k & 1) == 1] *= PRIOR[name]
    return np.minimum(out, 1.0)


def _log_odds(n1, n0, all1: int, all0: int) -> np.ndarray:
    odds = np.log((n1 + 0.5) / (all1 + 1.0)) - np.log((n0 + 0.5) / (all0 + 1.0))
    return np.clip(odds / _TOP_LOG_ODDS, 0.0, 1.0)


def _weights(counts: pd.DataFrame, lexicon: list[tuple[str, bool]], n1: int, n0: int) -> np.ndarray:
    """Weight of each (term, distance) from documents by label; unseen misspellings take a share of the term's."""
    seen = np.zeros((len(lexicon) * 4, 2))
    for key, toxic, n in zip(counts["key"], counts["toxic"], counts["n"]):
        seen[key, int(toxic)] = n
    out = _log_odds(seen[:, 1], seen[:, 0], n1, n0).reshape(-1, 4)
    clean = seen[:, 0].reshape(-1, 4) == 0
    for d in (1, 2):
        out[:, d] = np.where(clean[:, d], MISSPELT * out[:, 0], np.minimum(out[:, d], out[:, 0]))
    return out.ravel()


def _factors(counts: pd.DataFrame, n1: int, n0: int) -> np.ndarray:
    """Factor of each context: the share of toxic documents among those with such matches, at equal numbers of both labels."""
    prior, out = prior_factors(), prior_factors()
    seen = np.zeros((8, 2))
    for key, toxic, n in zip(counts["key"], counts["toxic"], counts["n"]):
        seen[key, int(toxic)] = n
    for k in range(8):
        a, b = seen[k, 1], seen[k, 0] * max(n1, 1) / max(n0, 1)
        out[k] = (a + PRIOR_DOCS * prior[k]) / (a + b + PRIOR_DOCS) if a + b else prior[k]
    return out


def evidence(doc: np.ndarray, code: np.ndarray, size: int, weights: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return np.bincount(doc, weights=weights[code >> 3] * factors[code & 7], minlength=size) if len(doc) else np.zeros(size)


def _features(x: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(x), np.minimum(x, 1.0), np.log1p(np.minimum(x, 8.0))], axis=-1)


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps over counts ``n`` of (x, y), lightly held to zero."""
    a, beta = _features(x), np.zeros(3)
    hold = np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + hold, a.T @ (n * (y - p)) - hold @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Model:
    lexicon: list[tuple[str, bool]]
    automaton: Automaton
    weights: np.ndarray
    factors: np.ndarray
    beta: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(x) @ self.beta, -700, 700)))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a document's label teaches nothing; a row without an id is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    known = known.agg((F.avg(F.col(label_col).cast("double")) >= 0.5).alias("toxic"))
    rows = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = materialize(known, "labels")
    if known.count() <= MOST_LABELS:  # texts stay where they are read
        return rows.join(F.broadcast(known), "_id").select("toxic", "text")
    return materialize(rows.join(known, "_id").select("toxic", "text"), "labelled")


def fit(
    docs: DataFrame, labels: DataFrame, teaching_docs: int = TEACHING_DOCS, max_terms: int = MAX_TERMS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Learn lexicon, weights, factors and the regression from the documents whose id is not held out."""
    spark = docs.sparkSession
    labelled = _labelled(docs, labels, id_col, text_col, label_col)
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    sizes = {r["toxic"]: r for r in hashed.groupBy("toxic").agg(F.count("*").alias("n"), F.countDistinct("h").alias("kinds")).collect()}
    n1, n0 = (sizes[k]["n"] if k in sizes else 0 for k in (True, False))
    lexicon: list[tuple[str, bool]] = []
    if n1 and n0:
        found = candidates(labelled, n1, n0)
        keys = np.array([term_hash(*t) for t in found], dtype=U64)
        order = np.argsort(keys)
        held = spark.sparkContext.broadcast((keys[order], order))
        share = F.when(F.col("toxic"), F.lit(min(1.0, teaching_docs / sizes[True]["kinds"]))).otherwise(F.lit(min(1.0, teaching_docs / sizes[False]["kinds"])))
        sample = hashed.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share * (1 << 20)).select("toxic", "h", "text")
        taught = sample.mapInArrow(lambda b: _teach(b, held), "toxic boolean, h long, sketch array<long>, terms array<int>")
        taught = taught.groupBy("toxic", "h").agg(F.first("sketch").alias("sketch"), F.first("terms").alias("terms")).orderBy("h", "toxic").toPandas()
        family = _families(np.stack(taught["sketch"].to_numpy()))
        lexicon = choose_terms(found, taught["toxic"].to_numpy(), family, taught["terms"].tolist(), max_terms)
    automaton = build_automaton(lexicon)
    if not lexicon:
        rate = n1 / (n1 + n0) if n1 + n0 else 0.0
        start = np.log(rate / (1 - rate)) if 0 < rate < 1 else (700.0 if rate else -800.0)
        return Model([], automaton, np.zeros(0), prior_factors(), np.array([start, 0.0, 0.0]))
    sent = spark.sparkContext.broadcast(automaton)
    hits = materialize(labelled.mapInArrow(lambda b: _hits(b, sent), "toxic boolean, hits array<long>"), "hits")

    def by(key: Column) -> pd.DataFrame:
        """Documents with a match of each key, by label; there are as many rows as keys and labels."""
        return hits.select("toxic", F.explode(F.array_distinct(F.transform("hits", lambda c: key(c)))).alias("key")).groupBy("key", "toxic").agg(F.count("*").alias("n")).toPandas()

    weights = _weights(by(lambda c: F.shiftright(c, 3)), lexicon, n1, n0)
    factors = _factors(by(lambda c: c.bitwiseAND(F.lit(7).cast("long"))), n1, n0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            doc = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            x = evidence(doc, column.flatten().to_numpy(), len(column), weights, factors)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.minimum(x, 8.0) * 20).astype(np.int64))], names=["toxic", "x"])

    table = hits.mapInArrow(sums, "toxic boolean, x long").groupBy("toxic", "x").agg(F.count("*").alias("n")).orderBy("x", "toxic").toPandas()
    beta = _fit(table["x"].to_numpy() / 20.0, table["toxic"].to_numpy().astype(float), table["n"].to_numpy().astype(float))
    return Model(lexicon, automaton, weights, factors, beta)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row with score (0 to 1) and predicted (1 from 0.5 on); columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(c for c in keep or ["doc_id"] if c not in ("score", "predicted")), F.col(text_col))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        lookup = m.automaton.lookup()
        for batch in batches:
            x = np.zeros(batch.num_rows)
            for lo, hi, doc, code in _scan(batch.column(batch.num_columns - 1), m.automaton, lookup):
                x[lo:hi] = evidence(doc, code, hi - lo, m.weights, m.factors)
            p = m.probability(x)
            names = batch.schema.names[:-1] + ["score", "predicted"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", score double, predicted int"
    return rows.mapInArrow(judge, schema)
