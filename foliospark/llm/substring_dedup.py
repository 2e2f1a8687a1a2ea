"""Substring dedup: winnowed seeds, extended both ways to windows that repeat.

A window is ``min_words`` consecutive words of one document. Each window elects as its anchor the
leftmost of its smallest ``seed``-word hashes, so equal windows elect the same anchor at the same
place. The windows that elect one anchor form a run, and the words they reach on both sides of the
anchor are its context. Documents meet on anchors:

* an anchor whose hash occurs once repeats nowhere;
* runs with equal contexts repeat entirely;
* where an anchor has several contexts, one run of each is extended window by window, and windows
  are compared by 128-bit hashes.

The union of repeated windows gives the maximal repeats. No step lists pairs: all of them count by
hash with partial sums, so a passage in a third of all documents costs a row for each occurrence.

Defined results: a null text has no words. Whether a window repeats is judged on the input, within
documents as well as between them; rows that repeat are copies of each other like any others, also
with equal ids. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Words, kept_text, leftmost_min, mix, rolling, span_hash, words
from .store import materialize, release

MIN_WORDS = 35
SEED_WORDS = 8
_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
_SEED_BASE = 0xC2B2AE3D27D4EB4F


def _runs(w: Words, min_words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, one past the last window, anchor, anchor hash) of each run, as word indexes of the slice."""
    none = np.zeros(0, np.int64)
    if len(w.hash) < min_words:
        return none, none, none, none.astype(U64)
    seeds = rolling(w.hash, seed, _SEED_BASE)
    anchor = leftmost_min(seeds, min_words - seed + 1)
    windows = np.flatnonzero(w.doc[: len(anchor)] == w.doc[min_words - 1 :])
    if not len(windows):
        return none, none, none, none.astype(U64)
    a = anchor[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (np.diff(windows) != 1) | (np.diff(a) != 0) | (np.diff(w.doc[windows]) != 0)
    at = np.flatnonzero(new)
    lo = windows[at]
    hi = windows[np.append(at[1:], len(windows)) - 1] + 1
    return lo, hi, a[at], seeds[a[at]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


def _find_runs(batches: Iterator[pa.RecordBatch], min_words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, text = batch.column(0), batch.column(1), batch.column(2)
        for w in words(text):
            lo, hi, anchor, seed_hash = _runs(w, min_words, seed)
            salt = (hi - lo).astype(U64) * U64(0x9E3779B97F4A7C15) + (anchor - lo).astype(U64) * U64(0xC4CEB9FE1A85EC53)
            rows = pa.array(w.doc[lo] + w.lo) if len(lo) else pa.array([], pa.int64())
            context = [_signed(mix(span_hash(w.hash, lo, hi + min_words - 1, b) + salt)) for b in _BASES]
            first = w.first[w.doc[lo]] if len(lo) else lo
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(rows), keys.take(rows),
                    pa.array((lo - first).astype(np.int32)), pa.array((hi - lo).astype(np.int32)),
                    pa.array(_signed(seed_hash)), pa.array(context[0]), pa.array(context[1]),
                ],
                names=["_id", "_h", "at", "n", "seed", "c1", "c2"],
            )


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _ints(values: pa.Array, name: str) -> np.ndarray:
    return values.field(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _ragged(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, .. n[0] values, then those of lo[1], and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)


def _extend(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, text = batch.column(0), batch.column(1), batch.column(2)
        sizes, runs = _lists(batch.column(3))
        bounds = np.append(0, np.cumsum(sizes))
        at, n, many = _ints(runs, "at"), _ints(runs, "n"), _ints(runs, "many")
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for w in words(text):
            s = slice(bounds[w.lo], bounds[w.hi])
            doc, count = owner[s] - w.lo, n[s]
            p = _ragged(w.first[doc] + at[s], count)
            d, m = np.repeat(doc, count), np.repeat(many[s], count)
            rows = pa.array(d + w.lo)
            hashes = [rolling(w.hash, min_words, b) for b in _BASES]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_signed(hashes[0][p])), pa.array(_signed(hashes[1][p])),
                    ids.take(rows), keys.take(rows),
                    pa.array((p - w.first[d]).astype(np.int32)), pa.array((m + 1).astype(np.int32)),
                ],
                names=["w1", "w2", "_id", "_h", "at", "weight"],
            )


def _remove(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        sizes, dups = _lists(batch.column(2))
        bounds = np.append(0, np.cumsum(sizes))
        at, n = _ints(dups, "at"), _ints(dups, "n")
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for w in words(text):
            s = slice(bounds[w.lo], bounds[w.hi])
            begin = w.first[owner[s] - w.lo] + at[s]
            edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + n[s] + min_words - 1, -1)
            keep = np.cumsum(edge[:-1]) == 0
            total = np.append(0, np.cumsum(keep))[w.first]
            n_words = np.diff(w.first)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(w.lo, w.hi - w.lo), pa.array(n_words), pa.array(n_words - np.diff(total)), kept_text(text, w, keep).cast(pa.string())],
                names=["_id", "n_words", "n_removed", "kept"],
            )


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (the words left, joined by one space)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.col(text_col).alias("_t"))
    kind = dict(keyed.dtypes)["_id"]

    runs = materialize(
        keyed.mapInArrow(lambda b: _find_runs(b, min_words, seed), f"_id {kind}, _h long, at int, n int, seed long, c1 long, c2 long"), "runs"
    )
    # an anchor that occurs twice or more; "several" if its contexts differ
    shared = materialize(
        runs.groupBy("seed")
        .agg(F.count("*").alias("k"), F.min("c1").alias("a"), F.max("c1").alias("z"))
        .filter("k > 1")
        .select("seed", (F.col("a") != F.col("z")).alias("several")),
        "anchors",
    )
    met = materialize(runs.join(shared, "seed").drop("seed"), "met")
    release(runs, shared)

    contexts = materialize(
        met.filter("several").groupBy("c1", "c2").agg(F.count("*").alias("k"), F.min(F.struct("_id", "_h", "at", "n")).alias("one")), "contexts"
    )
    spots = contexts.groupBy(F.col("one._id").alias("r_id"), F.col("one._h").alias("r_h")).agg(
        F.collect_list(F.struct(F.col("one.at").alias("at"), F.col("one.n").alias("n"), (F.col("k") > 1).cast("int").alias("many"))).alias("spots")
    )
    same = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_h") == F.col("r_h"))
    windows = materialize(
        keyed.join(spots.hint("shuffle_hash"), same)
        .select("_id", "_h", "_t", "spots")
        .mapInArrow(lambda b: _extend(b, min_words), f"w1 long, w2 long, _id {kind}, _h long, at int, weight int"),
        "windows",
    )
    repeated = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("k")).filter("k > 1").drop("k")
    lone = windows.filter("weight = 1").join(repeated, ["w1", "w2"]).select("_id", "_h", "at", F.lit(1).alias("n"))
    whole = met.filter("not several").select("_id", "_h", "at", "n")
    alike = met.filter("several").join(contexts.filter("k > 1").select("c1", "c2"), ["c1", "c2"]).select("_id", "_h", "at", "n")
    repeats = (
        lone.unionByName(whole)
        .unionByName(alike)
        .groupBy(F.col("_id").alias("r_id"), F.col("_h").alias("r_h"))
        .agg(F.collect_set(F.struct("at", "n")).alias("repeats"))
    )
    repeats = materialize(repeats, "repeats")
    release(met, contexts, windows)
    return (
        keyed.join(repeats.hint("shuffle_hash"), same, "left")
        .select("_id", "_t", "repeats")
        .mapInArrow(lambda b: _remove(b, min_words), f"_id {kind}, n_words long, n_removed long, kept string")
        .select(F.col("_id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_text"))
    )
