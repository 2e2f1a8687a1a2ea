"""Language ID with interpolated Kneser-Ney models of characters, one per language.

Letters are lower-cased, everything else between them is one space. The count pass runs over all
labelled texts: tasks count 4-grams, Spark sums them by language, and the lower orders follow as
continuation counts. The models are sorted arrays of 64-bit hashes with a log probability per
language beside each. All that a 4-gram needs hangs on its third character but the counts of single
characters and the discounts, so beyond ``max_grams`` rows of (language, 4-gram), or ``MAX_CELLS`` of
rows times languages, tasks train the models in pieces, each with the grams of some third characters.
Texts meet one piece after the other, so only one is held at a time; a piece is as large as the bound
or as the grams of its one character. The order and the results do not depend on the number of pieces,
but for rounding. A text is given the language of the lowest cross-entropy per
character.

A fold of the labelled texts, by text so that copies stay together, teaches nothing and calibrates:
a sample of it (at most ``calibration_docs`` distinct texts, chosen by hash) gives the temperature, by rows, of the score and,
for each language, the centre and variance of the cross-entropy of correctly labelled texts, both
linear in 1 / length. A text is rejected beyond the limit that ``FALSE_REJECTION`` of them are expected
to exceed. The limit continues the upper tenth as a Pareto tail through its median, at every size of the
sample, so single outliers do not move it. A language whose texts are all in the fold is learned from them. One with too few calibrating
texts takes the variance of all; one without any rejects nothing.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected. Without
any labelled text all are ``und`` with score 0, and only those without a letter are rejected. Rows that repeat are judged alike. Columns other than the id, the
text and the label are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix, slices, text_buffers
from .store import materialize

ORDER = 4
MAX_GRAMS = 4_000_000
MAX_CELLS = 16_000_000
CALIBRATION_DOCS = 20_000
FALSE_REJECTION = 0.002
FOLDS = 5
_TAIL, _FEW, _BINS, _LEAST_POWER = 0.1, 50, 10, 0.4
UNKNOWN = "und"
JUDGED = ("lang_pred", "score", "cross_entropy", "rejected")
_PENDING = 4_000_000
_SLAB_BYTES = 2 << 20  # of text that meets the pieces at once
_BLOB_BYTES = 8 << 20
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def _letter_codes() -> np.ndarray:
    """Code point -> lower-case letter, or space; 0 stays 0, the mark between texts."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for lo, hi in ((1, 0x3400), (0xA000, 0x10000), (0x10000, 0x20000)):
        for i in range(lo, hi):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
    for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x323B0)):
        out[lo:hi] = np.arange(lo, hi)
    out[0] = 0
    return out


_CODES: list[np.ndarray] = []


def _grams(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first two code points, last two code points) of the 4-gram that ends at each character."""
    if not _CODES:
        _CODES.append(_letter_codes())
    clean = [(t.replace("\0", " ") if "\0" in t else t) if t else "" for t in texts]
    raw = np.frombuffer(("\0" + "\0".join(clean)).encode("utf-32-le", "replace"), dtype=np.uint32)
    a = _CODES[0][raw]
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (a[1:] != 32) | ((a[:-1] != 32) & (a[:-1] != 0))
    a = a[keep].astype(U64)
    doc = np.cumsum(a == 0) - 1
    c4 = a
    c3, c2, c1 = (np.concatenate([np.zeros(k, U64), a[:-k]]) if len(a) > k else np.zeros(len(a), U64) for k in (1, 2, 3))
    c2 = np.where(c3 == 0, U64(0), c2)
    c1 = np.where(c2 == 0, U64(0), c1)
    if order < 4:
        c1 = np.zeros_like(c1)
    if order < 3:
        c2 = np.zeros_like(c2)
    real = c4 != 0
    return doc[real], ((c1 << U64(21)) | c2)[real], ((c3 << U64(21)) | c4)[real]


def _key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(first * _A + last * _B + U64(1))


def _tally(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, at, inverse = np.unique(_key(first, last), return_index=True, return_inverse=True)
    return first[at], last[at], np.bincount(inverse, weights=n).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, first, last, n), summed over what the task has read, in rounds of bounded size."""
    held: dict[str, list] = {}

    def flush(rows) -> Iterator[pa.RecordBatch]:
        for lang, parts in rows.items():
            first, last, n = _tally(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array(first.view(np.int64)), pa.array(last.view(np.int64)), pa.array(n)],
                names=["lang", "first", "last", "n"],
            )

    for batch in batches:
        langs, text = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1)
        for lo, hi in slices(text_buffers(text)[0]):
            texts = text.slice(lo, hi - lo).to_pylist()
            doc, first, last = _grams(texts, order)
            mine = langs[lo:hi]
            for lang in sorted(set(mine)):
                use = (mine == lang)[doc]
                if use.any():
                    held.setdefault(lang, []).append(_tally(first[use], last[use], np.ones(int(use.sum()))))
        if sum(len(p[2]) for parts in held.values() for p in parts) > _PENDING:
            held = {lang: [_tally(*(np.concatenate(x) for x in zip(*parts)))] for lang, parts in held.items()}
            if sum(len(p[2]) for parts in held.values() for p in parts) > _PENDING // 2:
                yield from flush(held)
                held = {}
    yield from flush(held)


def _look(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted key in the sorted keys, or the number of keys where it is missing."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys)) if len(keys) else np.zeros(len(wanted), np.int64)


@dataclass
class Model:
    """Sorted hash arrays: log probabilities of 4-grams, and what unseen ones back off to.

    With ``pieces`` (broadcasts of models) the arrays are theirs, and ``part_of`` names the piece of a third character.
    """

    langs: list[str]
    order: int
    keys: np.ndarray
    log_p: np.ndarray  # (grams, langs)
    levels: list  # from trigrams down: (gram keys, discounted shares, context keys, weight of the level below)
    floor: float
    temperature: float = 1.0
    centre: np.ndarray | None = None  # (langs, 2): constant, and factor of 1 / length
    variance: np.ndarray | None = None  # likewise
    limit: float = np.inf

    def backed_off(self, first: np.ndarray, last: np.ndarray, level: int = 0) -> np.ndarray:
        """Probabilities below the top order: (grams, langs)."""
        if level == len(self.levels):
            return np.full((len(first), len(self.langs)), self.floor)
        first, last = _shorten(first, last, level + 1)
        gram_keys, shares, context_keys, weights = self.levels[level]
        out = shares[_look(gram_keys, _key(first, last))]
        weight = weights[_look(context_keys, _key(*_context(first, last)))]
        return out + weight * self.backed_off(first, last, level + 1)

    def log_probabilities(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        at = _look(self.keys, _key(first, last))
        out = self.log_p[np.minimum(at, len(self.keys) - 1)]
        missing = np.flatnonzero(at == len(self.keys))
        if len(missing):
            top_keys, top_weights = self.top
            f, l = first[missing], last[missing]
            weight = top_weights[_look(top_keys, _key(*_context(f, l)))]
            out[missing] = np.log(weight * self.backed_off(f, l))
        return out

    top: tuple = ()
    pieces: list = field(default_factory=list)
    part_of: np.ndarray | None = None


_LOW = U64((1 << 21) - 1)


def _shorten(first: np.ndarray, last: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram without its first ``drop`` characters."""
    if drop == 1:
        return first & _LOW, last
    return np.zeros_like(first), last if drop == 2 else last & _LOW


def _context(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return first, last >> U64(21) << U64(21)


def _orders(first, last, lang, n) -> list[tuple]:
    """(first, last, language, count) of each order from 4-grams down; below those, how many different characters precede."""
    out, g = [(first, last, lang, n)], lang
    for drop in range(1, 4):
        sf, sl = _shorten(first, last, drop)
        if drop > 1:
            pf, pl = _shorten(first, last, drop - 1)
            _, at = np.unique(np.stack([pf, pl, lang.astype(U64)]), axis=1, return_index=True)
            sf, sl, g = sf[at], sl[at], lang[at]
        _, at, inverse = np.unique(np.stack([sf, sl, g.astype(U64)]), axis=1, return_index=True, return_inverse=True)
        out.append((sf[at], sl[at], g[at], np.bincount(inverse.ravel())))
    return out


def _seen(lang, n, n_langs: int) -> np.ndarray:
    """How many grams of each language occur once, and twice."""
    return np.stack([np.bincount(lang[n == m], minlength=n_langs) for m in (1, 2)])


def _discount(seen: np.ndarray) -> np.ndarray:
    once, twice = seen
    return np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.05, 0.95)


def _kneser_ney(first, last, lang, n, n_langs, discount):
    """(gram keys, shares, context keys, weights) of one order; the last row of each table is for what is missing."""
    grams, at = np.unique(_key(first, last), return_inverse=True)
    contexts, cat = np.unique(_key(*_context(first, last)), return_inverse=True)
    counts = np.zeros((len(grams) + 1, n_langs))
    np.add.at(counts, (at, lang), n)
    total = np.zeros((len(contexts) + 1, n_langs))
    kinds = np.zeros_like(total)
    np.add.at(total, (cat, lang), n)
    np.add.at(kinds, (cat, lang), 1)
    context_of = np.zeros(len(grams), dtype=np.int64)
    context_of[at] = cat
    shares = np.zeros_like(counts)
    with np.errstate(divide="ignore", invalid="ignore"):
        shares[:-1] = np.where(counts[:-1] > 0, (counts[:-1] - discount) / total[context_of], 0.0)
        weights = np.where(total > 0, discount * kinds / total, 1.0)
    return grams, shares, contexts, weights


def _build(orders: list[tuple], discounts: list[np.ndarray], singles: tuple, langs: list[str], order: int) -> Model:
    """A model of these grams; ``singles`` is the level of single characters over the whole corpus."""
    size = len(langs)
    top, *levels = (_kneser_ney(*x, size, d) for x, d in zip(orders[:3], discounts))
    levels.append(singles)
    first, last = orders[0][:2]
    vocabulary = max(2, len(singles[0]))
    model = Model(langs, order, top[0], np.zeros((0, size)), levels, 1.0 / (vocabulary + 1))
    model.top = (top[2], top[3])
    _, at = np.unique(_key(first, last), return_index=True)
    f, l = first[at], last[at]
    weight = top[3][_look(top[2], _key(*_context(f, l)))]
    model.log_p = np.log(top[1][:-1] + weight * model.backed_off(f, l)).astype(np.float32)
    return model


def _arrays(grams, langs: list[str]) -> tuple:
    lang = np.searchsorted(np.array(langs, dtype=object), grams["lang"].to_numpy(dtype=object)) if langs else np.zeros(0, int)
    first, last = (grams[c].to_numpy().astype(np.int64).view(U64) for c in ("first", "last"))
    return first, last, lang, grams["n"].to_numpy()


def train(grams, order: int) -> Model:
    """The models from a pandas table (lang, first, last, n) of distinct rows."""
    langs = sorted(grams["lang"].unique())
    orders = _orders(*_arrays(grams, langs))
    discounts = [_discount(_seen(lang, n, len(langs))) for *_, lang, n in orders]
    return _build(orders, discounts, _kneser_ney(*orders[3], len(langs), discounts[3]), langs, order)


def _pack(sizes: list[tuple[int, int]], bound: int) -> list[tuple[int, int]]:
    """(character, piece): pieces of at most ``bound`` rows, or of one character."""
    out, piece, held = [], 0, 0
    for character, n in sorted(sizes):
        if held and held + n > bound:
            piece, held = piece + 1, 0
        out.append((character, piece))
        held += n
    return out


def _train_pieces(grams: DataFrame, packed: list[tuple[int, int]], langs: list[str], order: int) -> Model:
    """The same models in pieces: one pass sums what all pieces share, a second one trains them."""
    spark = grams.sparkSession
    parts = spark.createDataFrame(packed, "third long, part int")
    parted = materialize(grams.withColumn("third", F.shiftrightunsigned("last", 21)).join(F.broadcast(parts), "third").drop("third"), "parted")
    size = len(langs)

    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        orders = _orders(*_arrays(rows, langs))
        out = []
        for level, (_, last, lang, n) in enumerate(orders):
            if level == 3:
                out.append(pd.DataFrame({"level": level, "lang": lang, "x": last.view(np.int64), "n": n}))
            else:
                seen = _seen(lang, n, size)
                out += [pd.DataFrame({"level": level, "lang": np.arange(size), "x": m, "n": seen[m]}) for m in (0, 1)]
        return pd.concat(out)

    sums = parted.groupBy("part").applyInPandas(shared, "level int, lang long, x long, n long").groupBy("level", "lang", "x").agg(F.sum("n").alias("n")).toPandas()
    discounts = []
    for level in range(3):
        seen, mine = np.zeros((2, size), dtype=np.int64), sums[sums["level"] == level]
        seen[mine["x"], mine["lang"]] = mine["n"]
        discounts.append(_discount(seen))
    single = sums[sums["level"] == 3].sort_values(["x", "lang"])
    last, lang, n = single["x"].to_numpy().view(U64), single["lang"].to_numpy(), single["n"].to_numpy()
    singles = _kneser_ney(np.zeros_like(last), last, lang, n, size, _discount(_seen(lang, n, size)))
    held = spark.sparkContext.broadcast((discounts, singles))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        discounts, singles = held.value
        blob = pickle.dumps(_build(_orders(*_arrays(rows, langs)), discounts, singles, langs, order), protocol=5)
        cuts = range(0, len(blob), _BLOB_BYTES)
        return pd.DataFrame({"part": rows["part"].iloc[0], "at": list(cuts), "blob": [blob[at : at + _BLOB_BYTES] for at in cuts]})

    built = materialize(parted.groupBy("part").applyInPandas(build, "part int, at long, blob binary"), "pieces")
    model = Model(langs, order, np.zeros(0, U64), np.zeros((0, size)), [], 1.0 / (max(2, len(singles[0])) + 1))
    model.part_of = np.zeros(1 << 21, dtype=np.int32)
    model.part_of[[c for c, _ in packed]] = [k for _, k in packed]
    for k in range(packed[-1][1] + 1):
        blobs = sorted(built.filter(F.col("part") == k).select("at", "blob").collect())
        model.pieces.append(spark.sparkContext.broadcast(pickle.loads(b"".join(bytes(r.blob) for r in blobs))))
    return model


def _send(spark, model: Model) -> tuple:
    """Broadcasts of a model and its pieces; those of a model within another would not reach the tasks."""
    return spark.sparkContext.broadcast(replace(model, pieces=[])), model.pieces


def _slices(text: pa.Array, pieces: list) -> Iterator[tuple[int, int]]:
    return slices(text_buffers(text)[0], _SLAB_BYTES) if pieces else slices(text_buffers(text)[0])


def _sums(doc, first, last, model: Model, out: np.ndarray) -> None:
    """Adds the log probabilities of each text's grams to its row."""
    if len(doc) and model.langs:
        some, starts = np.unique(doc, return_index=True)
        out[some] += np.add.reduceat(model.log_probabilities(first, last), starts, axis=0, dtype=np.float64)


def _entropies(texts: list[str | None], model: Model, pieces: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, has a letter, log likelihood by language) of each text."""
    doc, first, last = _grams(texts, model.order)
    n = np.bincount(doc, minlength=len(texts))
    letters = np.bincount(doc, weights=(last & _LOW) != 32, minlength=len(texts)) > 0
    out = np.zeros((len(texts), len(model.langs)))
    if not pieces:
        _sums(doc, first, last, model, out)
        return n, letters, out
    part = model.part_of[last >> U64(21)]
    for k, piece in enumerate(pieces):
        at = np.flatnonzero(part == k)
        if len(at):
            _sums(doc[at], first[at], last[at], piece.value, out)
            vars(piece).pop("_value", None)  # the next piece takes its place in memory
    return n, letters, out


def _score(batches: Iterator[pa.RecordBatch], held, pieces: list, keep_text: bool) -> Iterator[pa.RecordBatch]:
    model: Model = held.value
    names = np.array([*model.langs, UNKNOWN], dtype=object)
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        last = batch.num_columns if keep_text else batch.num_columns - 1
        for lo, hi in _slices(text, pieces):
            n, letters, ll = _entropies(text.slice(lo, hi - lo).to_pylist(), model, pieces)
            known = letters & bool(model.langs)
            best = np.where(known, ll.argmax(axis=1), len(model.langs)) if model.langs else np.zeros(len(n), np.int64)
            h = np.divide(-ll.max(axis=1, initial=-np.inf), n, out=np.full(len(n), np.nan), where=known)
            score = _posterior(ll, n, model.temperature) if model.langs else np.zeros(len(n))
            odd = np.zeros(len(n), dtype=bool)
            if model.centre is not None and known.any():
                odd[known] = _deviation(model, best[known], h[known], n[known]) > model.limit
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).slice(lo, hi - lo) for i in range(last)),
                    pa.array(names[best].tolist(), pa.string()), pa.array(np.where(known, score, 0.0)),
                    pa.array(h, from_pandas=True), pa.array(~letters | odd),
                ],
                names=[*(batch.schema[i].name for i in range(last)), "lang_pred", "score", "cross_entropy", "rejected"],
            )


def _posterior(ll: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    """Probability of the best language when neighbouring characters count as dependent."""
    scaled = ll / (temperature * np.sqrt(np.maximum(n, 1)))[:, None]
    return 1.0 / np.exp(scaled - scaled.max(axis=1, keepdims=True)).sum(axis=1)


def _calibrate(model: Model, sample) -> None:
    """Temperature by the likelihood of the labels; cross-entropy limits by the spread of correct texts."""
    n, ll = sample["n"].to_numpy(), np.array(sample["ll"].tolist()).reshape(len(sample), -1)
    truth = np.searchsorted(np.array(model.langs, dtype=object), sample["lang"].to_numpy(dtype=object))
    use = n > 0
    n, ll, truth, weight = n[use], ll[use], truth[use], sample["weight"].to_numpy()[use]
    if not len(n):
        return
    correct = ll.argmax(axis=1) == truth

    def loss(t: float) -> float:
        p = np.clip(_posterior(ll, n, t), 1e-6, 1 - 1e-6)
        return -float(np.average(np.where(correct, np.log(p), np.log(1 - p)), weights=weight))

    model.temperature = min((2.0**k for k in np.arange(-6, 4, 0.5)), key=loss)
    h = -ll.max(axis=1) / n
    size = len(model.langs)
    model.centre, model.variance = np.zeros((size, 2)), np.full((size, 2), np.nan)
    rest = np.full(len(n), np.nan)
    for k in range(size):
        own = correct & (truth == k)
        if own.any():
            model.centre[k] = _line(n[own], h[own], np.median) if own.sum() >= _FEW else (np.median(h[own]), 0.0)
            rest[own] = h[own] - model.centre[k] @ [np.ones(own.sum()), 1 / n[own]]
    if not correct.any():
        return
    pooled = _line(n[correct], np.abs(rest[correct]), _mad)
    for k in range(size):
        own = correct & (truth == k)
        if own.any():
            model.variance[k] = _line(n[own], np.abs(rest[own]), _mad) if own.sum() >= _FEW else pooled
    z = _deviation(model, truth[correct], h[correct], n[correct])
    start = max(float(np.quantile(z, 1 - _TAIL)), 1.0)
    beyond = z[z > start]
    power = max(float(np.median(np.log(beyond / start))) / np.log(2), _LEAST_POWER) if len(beyond) else _LEAST_POWER
    model.limit = start * (_TAIL / FALSE_REJECTION) ** power


def _mad(x: np.ndarray) -> float:
    """Variance of a normal distribution with this median of absolute deviations."""
    return float((1.4826 * np.median(x)) ** 2)


def _line(n: np.ndarray, values: np.ndarray, summary) -> np.ndarray:
    """(constant, factor of 1 / length), neither below 0, through a robust summary of texts of like length."""
    groups = [g for g in np.array_split(np.argsort(n, kind="stable"), min(_BINS, max(1, len(n) // 20))) if len(g)]
    x, y = np.array([np.mean(1 / n[g]) for g in groups]), np.array([summary(values[g]) for g in groups])
    if len(x) > 1 and np.ptp(x) > 0:
        slope, constant = np.polyfit(x, y, 1)
        if slope >= 0 and constant >= 0:
            return np.array([constant, slope])
        if constant < 0:
            return np.array([0.0, float((x * y).sum() / (x * x).sum())])
    return np.array([float(y.mean()), 0.0])


def _deviation(model: Model, k: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Standard deviations above the centre of language k; not a number where the language has none."""
    centre, variance = (x[k, 0] + x[k, 1] / n for x in (model.centre, model.variance))
    return (h - centre) / np.sqrt(np.maximum(variance, 1e-6))


def _sampled(batches: Iterator[pa.RecordBatch], held, pieces: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(1)
        for lo, hi in _slices(text, pieces):
            n, _, ll = _entropies(text.slice(lo, hi - lo).to_pylist(), held.value, pieces)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 2)), pa.array(n), pa.array(ll.tolist(), pa.list_(pa.float64()))], names=["lang", "weight", "n", "ll"])


def _distinct_sample(rows: DataFrame, most: int) -> DataFrame:
    """(lang, _t, weight): at most ``most`` distinct labelled texts in the order of their hash, with the number of their rows."""
    hashes = rows.select(F.xxhash64("_t", "lang").alias("_h")).distinct().orderBy("_h").limit(most + 1).collect()
    if len(hashes) > most:
        rows = rows.filter(F.xxhash64("_t", "lang") < hashes[-1]["_h"])
    return rows.groupBy("lang", "_t").agg(F.count("*").alias("weight"))


def fit(
    labelled: DataFrame, order: int = ORDER, max_grams: int = MAX_GRAMS, calibration_docs: int = CALIBRATION_DOCS, text_col: str = "text", lang_col: str = "lang",
    fold: tuple[int, int] = (0, FOLDS),
) -> Model:
    """Models of every language in ``labelled``; rows without a label or a text teach nothing.

    The texts of ``fold`` (see ``in_fold``) calibrate and do not teach, unless their language has no others.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("_t"))
    rows = rows.withColumn("_apart", in_fold("_t", *fold))
    alone = [r.lang for r in rows.groupBy("lang").agg(F.bool_and("_apart").alias("all")).filter("all").collect()]
    taught = rows.filter(~F.col("_apart") | F.col("lang").isin(alone)).select("lang", "_t")
    rows = rows.filter("_apart").select("lang", "_t")
    counts = taught.mapInArrow(lambda b: _count(b, order), "lang string, first long, last long, n long")
    grams = materialize(counts.groupBy("lang", "first", "last").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r.lang for r in grams.select("lang").distinct().collect())
    bound = max(1, min(max_grams, MAX_CELLS // max(1, len(langs))))
    if grams.count() <= bound:
        model = train(grams.toPandas(), order)
    else:
        sizes = grams.groupBy(F.shiftrightunsigned("last", 21).alias("third")).count().collect()
        model = _train_pieces(grams, _pack([tuple(r) for r in sizes], bound), langs, order)
    if model.langs:
        sample = _distinct_sample(rows, calibration_docs)
        held, pieces = _send(spark, model)
        _calibrate(model, sample.mapInArrow(lambda b: _sampled(b, held, pieces), "lang string, weight long, n long, ll array<double>").toPandas())
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """The columns ``keep`` of every row (and the text, if asked) with lang_pred, score, cross_entropy (nats a character) and rejected.

    Columns of the input with these four names are replaced.
    """
    held, pieces = _send(docs.sparkSession, model)
    rows = docs.select(*(c for c in keep or ["doc_id"] if c not in JUDGED), F.col(text_col))
    carried = rows.dtypes if keep_text else rows.dtypes[:-1]
    schema = ", ".join(f"`{c}` {t}" for c, t in carried) + ", lang_pred string, score double, cross_entropy double, rejected boolean"
    return rows.mapInArrow(lambda b: _score(b, held, pieces, keep_text), schema)


def in_fold(text_col: str, k: int, folds: int) -> Column:
    """Whether a text belongs to fold k; equal texts share a fold."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(folds)), F.lit(folds)) == k


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a document belongs to the fold that teaches nothing."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 5 == 0
