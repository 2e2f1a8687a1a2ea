"""Benchmark decontamination with spaced seeds.

Words are runs of letters and digits in lower case. A mask selects five word positions out of a
short stretch and ignores the rest, so a seed's hash survives substitutions at ignored positions.
The masks together hit every stretch of 15 to 20 words in which at most a fifth of the words differ
(14 words: two). Shorter stretches can lack five such words, so items of fewer than ``SHORT`` words
also have masks of four, which with the others hit every stretch of 5 to 10 words. Hashes of the test items meet those of the documents; each hit fixes an alignment,
along which words are compared one by one: an item is found where ``similarity`` of the words of
some stretch of ``window`` consecutive item words (the whole item, if it is shorter) agree.

Test items are the side that is sent to the executors. Their size is checked: beyond ``block_bytes``
of text they go in blocks, and the documents are read once for each block.

Defined results: null or empty texts and items match nothing, nor do items of fewer than five words.
Repeated rows of documents give repeated results; items with equal text are all reported. Columns
other than the ids and the texts are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Words, mix, powers, words

# Selected positions are 1.
MASKS = ("11111", "111101", "1101011", "110010011")
SHORT_MASKS = ("1111", "10111", "11011", "11101")
SHORT = 11
WINDOW = 20
SIMILARITY = (80, 100)
BLOCK_BYTES = 64 << 20
_SEED_BASE = 0xE7037ED1A0B428DB
_FILTER_BITS = 22


def seeds(w: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the mask at every place that lies within one document."""
    span = len(mask)
    n = len(w.hash) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    out = np.full(n, len(mask), dtype=U64)
    for c, k in zip(powers(_SEED_BASE, len(mask) + 1)[1:], [i for i, x in enumerate(mask) if x == "1"]):
        out += w.hash[k : k + n] * c
    at = np.flatnonzero(w.doc[:n] == w.doc[span - 1 :])
    return at, mix(out[at])


class ItemIndex:
    """Seeds of test items in sorted arrays, for each mask, with a bit table in front."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        parts = list(words(pc.utf8_lower(pa.array(texts, pa.string())), plain=True))
        self.ids = ids
        self.hash = np.concatenate([p.hash for p in parts]) if parts else np.zeros(0, U64)
        doc = np.concatenate([p.doc + p.lo for p in parts]) if parts else np.zeros(0, np.int64)
        self.first = np.searchsorted(doc, np.arange(len(ids) + 1))
        whole = Words(0, len(ids), doc, doc, doc, self.hash, self.first)
        self.tables = []
        short = np.minimum(np.diff(self.first), window) < SHORT
        for mask in MASKS + (SHORT_MASKS if short.any() else ()):
            at, h = seeds(whole, mask)
            if mask in SHORT_MASKS:
                mine = short[doc[at]]
                at, h = at[mine], h[mine]
            order = np.argsort(h)
            seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
            seen[h >> U64(64 - _FILTER_BITS)] = True
            self.tables.append((mask, h[order], at[order], seen))

    def diagonals(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, item, document word minus item word) of all hits."""
        docs, starts = [], []
        for mask, keys, places, seen in self.tables:
            at, h = seeds(w, mask)
            some = seen[h >> U64(64 - _FILTER_BITS)]
            at, h = at[some], h[some]
            lo, hi = np.searchsorted(keys, h, side="left"), np.searchsorted(keys, h, side="right")
            n = hi - lo
            ends = np.cumsum(n)
            pick = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)
            docs.append(np.repeat(at, n))
            starts.append(places[pick])
        p, q = np.concatenate(docs), np.concatenate(starts)
        item = np.searchsorted(self.first, q, side="right") - 1
        rows = np.unique(np.stack([w.doc[p] if len(p) else p, item, p - q]), axis=1)
        return rows[0], rows[1], rows[2]


def _search(batches: Iterator[pa.RecordBatch], held, window: int, similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    index: ItemIndex = held.value
    num, den = similarity
    for batch in batches:
        ids, text = batch.column(0), pc.utf8_lower(batch.column(1))
        for w in words(text, plain=True):
            doc, item, shift = index.diagonals(w)
            if not len(doc):
                continue
            size = index.first[item + 1] - index.first[item]
            ends = np.cumsum(size)
            q = np.arange(ends[-1]) + np.repeat(index.first[item] - (ends - size), size)
            p = q + np.repeat(shift, size)
            inside = (p >= np.repeat(w.first[doc], size)) & (p < np.repeat(w.first[doc + 1], size))
            same = inside & (w.hash[np.clip(p, 0, len(w.hash) - 1)] == index.hash[q])
            total = np.append(0, np.cumsum(same))
            length = np.minimum(size, window)
            # matches in every stretch of ``length`` item words
            places = size - length + 1
            stops = np.cumsum(places)
            begin = np.arange(stops[-1]) + np.repeat((ends - size) - (stops - places), places)
            hits = total[begin + np.repeat(length, places)] - total[begin]
            best = np.maximum.reduceat(hits, stops - places)
            group = np.repeat(np.arange(len(doc)), places)
            at = np.flatnonzero(hits == best[group])
            _, k = np.unique(group[at], return_index=True)
            start = begin[at[k]] - (ends - size)
            found = np.flatnonzero(best * den >= length * num)
            # the best alignment of each (document, item), the earliest on a tie
            order = found[np.lexsort((shift[found], -best[found], item[found], doc[found]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1])
            f = order[new]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(doc[f] + w.lo)), pa.array([index.ids[i] for i in item[f]], pa.int64()),
                    pa.array(shift[f] + index.first[item[f]] + start[f] - w.first[doc[f]]), pa.array(start[f]),
                    pa.array(length[f]), pa.array(best[f]), pa.array(best[f] / length[f]),
                ],
                names=["_id", "item_id", "doc_word", "item_word", "n_words", "n_equal", "similarity"],
            )


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: tuple[int, int] = SIMILARITY, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per (document, item) found: the best stretch, as first words, length, equal words and their share."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    items = items.select(F.col(item_id_col).cast("long").alias("item"), F.col(item_text_col).alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    schema = f"_id {dict(rows.dtypes)['_id']}, item_id long, doc_word long, item_word long, n_words long, n_equal long, similarity double"
    parts = []
    for k in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(n_blocks)) == k).collect()
        held = spark.sparkContext.broadcast(ItemIndex([r["item"] for r in block], [r["t"] for r in block], window))
        parts.append(rows.mapInArrow(lambda b, h=held: _search(b, h, window, similarity), schema))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("_id", id_col)
