"""Token ids of whole texts, one tokenizer per Python worker.

The vocabulary named by the default path drops white space and splits words between a letter and a
closing mark, so a text's ids are those of its parts at these places one after another. Parts repeat:
their ids are kept in sorted hash arrays of bounded size, and a slice of texts is put together from
them by array operations; only parts not held meet the tokenizer. Parts of equal 64-bit hash count as
equal. ``chunked=False`` encodes whole texts, for vocabularies that keep spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernels import U64, slices, text_buffers, words

#: Bounds of what a worker holds: words, and ids of words. Half of it, the longest unused, goes when one is reached.
MOST_WORDS = 500_000
MOST_IDS = 4_000_000
_LOADED: dict = {}
# Byte-level vocabularies write the bytes that do not print as letters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTED)))}


def default_tokenizer() -> str:
    """The path of the default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start + length of each span, one after another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)


class _Vocabulary:
    """A tokenizer and the ids of the words it has met lately."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keys = np.zeros(0, U64)
        self.start, self.length, self.used_at = (np.zeros(0, np.int32) for _ in range(3))
        self.pool, self.filled, self.clock = np.zeros(1 << 16, np.uint32), 0, 0

    def raw(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys in the table, which of them it lacks)."""
        at = np.searchsorted(self.keys, keys)
        inside = np.minimum(at, max(len(self.keys) - 1, 0))
        return at, np.flatnonzero(self.keys[inside] != keys) if len(self.keys) else np.arange(len(keys))

    def _shrink(self) -> None:
        """Keep what the slice at hand uses and the half used last."""
        limit = np.partition(self.used_at, len(self.used_at) // 2)[len(self.used_at) // 2]
        keep = (self.used_at > limit) | (self.used_at == self.clock)
        pool = self.pool[_spans(self.start[keep].astype(np.int64), self.length[keep])]
        self.keys, self.length, self.used_at = self.keys[keep], self.length[keep], self.used_at[keep]
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.pool, self.filled = pool, len(pool)

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """Take up sorted keys that the table lacks."""
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        if len(self.keys) + len(keys) > MOST_WORDS or self.filled + len(flat) > MOST_IDS:
            self._shrink()
        if self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(max(self.filled // 2, len(flat)) + (1 << 16), np.uint32)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, self.filled + np.cumsum(lengths) - lengths)
        self.length = np.insert(self.length, at, lengths)
        self.used_at = np.insert(self.used_at, at, self.clock)
        self.filled += len(flat)

    def _learn(self, new: list[str]) -> list[list[int]]:
        """Ids of words. Lower-case composed letters are one word of the vocabulary: the merges alone give their ids."""
        tokenize, out, whole = self.tokenizer.model.tokenize, [], []
        for i, word in enumerate(new):
            if word.isalpha():
                if word.isascii():
                    out.append([t.id for t in tokenize(word.lower())])
                    continue
                if word == word.lower() and is_normalized("NFC", word):
                    out.append([t.id for t in tokenize(word.encode().decode("latin-1").translate(_BYTE_LETTERS))])
                    continue
            whole.append(i)
            out.append([])
        for i, ids in zip(whole, self.raw([new[i] for i in whole])):
            out[i] = ids
        return out

    def of_words(self, hashes: np.ndarray, spell) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, number of ids of each); ``spell`` gives the words at some indices."""
        self.clock += 1
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at, lacking = self._find(keys)
        if len(lacking):
            known = np.ones(len(keys), dtype=bool)
            known[lacking] = False
            self.used_at[at[known]] = self.clock
            self._add(keys[lacking], self._learn(spell(first[lacking])))
            at, _ = self._find(keys)
        self.used_at[at] = self.clock
        rows = at[inverse]
        return self.pool[_spans(self.start[rows].astype(np.int64), self.length[rows])], self.length[rows]


def encode_rows(text: pa.Array, path: str, chunked: bool = True, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, ids, offsets) for rows lo..hi at a time: row lo + i has ids[offsets[i] : offsets[i + 1]], unsigned 32-bit.

    A null text has no ids; ``end`` is added behind those of each row.
    """
    if path not in _LOADED:
        _LOADED[path] = _Vocabulary(path)
    v = _LOADED[path]
    offsets, data = text_buffers(text)

    def closed(lo, hi, ids, at):
        at = at.astype(np.int64)
        if end is not None:
            ids, at = np.insert(ids, at[1:], end), at + np.arange(len(at))
        return lo, hi, np.ascontiguousarray(ids, dtype="<u4"), at

    if not chunked:
        for lo, hi in slices(offsets):
            found = v.raw([t or "" for t in text.slice(lo, hi - lo).to_pylist()])
            at = np.cumsum([0, *map(len, found)])
            yield closed(lo, hi, np.fromiter(chain.from_iterable(found), np.uint32, int(at[-1])), at)
        return
    special = pc.any(pc.match_substring(text, "<|")).as_py()  # the vocabulary folds case, but for its special tokens
    for w in words(text, fold_case=not special, closed=True):

        def spell(which: np.ndarray) -> list[str]:
            return [data[a:b].tobytes().decode() for a, b in zip(w.start[which], w.end[which])]

        ids, lengths = v.of_words(w.hash, spell)
        yield closed(w.lo, w.hi, ids, np.append(0, np.cumsum(lengths))[w.first])


def encode(texts: list[str | None], path: str, chunked: bool = True) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
    out = []
    for _, _, ids, at in encode_rows(pa.array(texts, pa.large_string()), path, chunked):
        out += [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
    return out
