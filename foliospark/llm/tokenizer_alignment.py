"""Alignment of two tokenizers over the same texts, by byte offsets.

Both tokenizers part a text before a single space that a printing character follows, so the stretches
between such places are aligned on their own, each distinct one once, however often the corpus has it.

* Texts are split into stretches; a chunk of documents numbers its distinct stretches.
* Distinct stretches meet across chunks with the number of their occurrences, and are tokenized.
* Tokens are exploded with their positions, a window sums their byte lengths to ends, and the tokens of
  both sides that end at the same byte of a stretch meet in one row (the equi-join of both sides on
  stretch and end, written as one grouping, so one exchange by stretch serves all steps). Rows with both
  sides are cuts; a running count of cuts numbers the groups.
* Two tokens overlap where no end of either side lies between: each row is one link, of the next token to
  end on either side. So links come in proportion to tokens, also in groups of very many.
* Counts of linked id pairs are sums over stretches, weighted by occurrences; the highest of each B id
  marks the best pairs, and every stretch takes up its sums.
* Chunks take the results of their stretches and put their documents together, in order.

A, ``tokenizer_a``, is a file of byte-level BPE for the library tokenizers and gets the text behind a
space; B, ``tokenizer_b``, a SentencePiece model that adds this space itself. Vocabularies of other make
are aligned over whole texts, without stretches. Stretches of equal 64-bit hash and equal text are one.

Defined results: null and empty texts, and those whose joined token bytes differ from space + text, have
no tokens: zeros, empty groups, nothing counted. Rows that repeat are aligned and counted each. An empty
table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import U64, mix, powers, slices, text_buffers
from .store import materialize, release

SIDE = 1 << 24  # added to the ids of B, so that one array holds the tokens of both
CHUNK_BYTES = 8 << 20
CHUNK_STRETCHES = 1_000_000
MOST_PAIRS = 4_000_000  # of which a table may be broadcast
BLOCKS = 4
SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_BLOCK = 4096
_BASE = 0x9E3779B97F4A7C15
_POW = powers(_BASE, _BLOCK)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
# bytes that begin a character which certainly is no white space
_PRINTS = np.zeros(256, dtype=bool)
_PRINTS[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
_LOADED: dict = {}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Pair:
    """Both tokenizers, and what their vocabularies allow."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.letters = {chr(c): b for b, c in _byte_letters().items()}
        complete = sum(self.b.is_byte(i) for i in range(len(pieces))) == 256
        inner = any("▁" in p.lstrip("▁") for p in pieces)
        self.plain = complete and self.a.normalizer is None and type(self.a.pre_tokenizer).__name__ == "ByteLevel"
        self.stretches = self.plain and not inner

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with the space."""
        a = [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        return a, self.b.encode([t[1:] for t in texts], num_threads=1)

    def bytes_a(self, i: int) -> bytes:
        token = self.a.id_to_token(i)
        return bytes(self.letters[c] for c in token) if all(c in self.letters for c in token) else token.encode()

    def lossless(self, texts: list[str]) -> list[bool]:
        """Whether the tokens of a text that begins with the space are its bytes on both sides."""
        if self.plain:  # A keeps every byte, and so does B unless it normalizes
            return ["▁" not in t and n == t.replace(" ", "▁") for t, n in zip(texts, map(self.b.normalize, (t[1:] for t in texts)))]
        return [
            b"".join(map(self.bytes_a, a)) == t.encode() == b"".join(self.bytes_b[i] for i in b) for t, a, b in zip(texts, *self.encode(texts))
        ]


def _byte_letters() -> dict[int, int]:
    """Byte -> code point that stands for it in byte-level vocabularies: itself if it prints, else from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in printed} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(printed)))}


def _load(paths: tuple[str, str]) -> _Pair:
    if paths not in _LOADED:
        _LOADED[paths] = _Pair(*paths)
    return _LOADED[paths]


def byte_lengths(spark: SparkSession, paths: tuple[str, str]) -> DataFrame:
    """(t, len) of both vocabularies, B's ids with SIDE; as many rows as they have."""
    pair = _load(paths)
    a = [(i, len(pair.bytes_a(i))) for i in range(pair.a.get_vocab_size())]
    b = [(SIDE + i, len(x)) for i, x in enumerate(pair.bytes_b)]
    return spark.createDataFrame(pd.DataFrame(a + b, columns=["t", "len"]), "t int, len int")


def _trim() -> None:
    """Hand free memory back to the system, which a worker would keep for its next tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# --- stretches of texts -------------------------------------------------------------------------


def _stretch_starts(part: np.ndarray, firsts: np.ndarray, cut: bool) -> np.ndarray:
    """Where stretches begin in the bytes of texts that each begin with a space at ``firsts``."""
    if not cut or len(part) < 3:
        return firsts
    here = np.zeros(len(part), dtype=bool)
    here[1:-1] = (part[1:-1] == 32) & (part[:-2] != 32) & _PRINTS[part[2:]]
    here[firsts] = True
    return np.flatnonzero(here)


def _hashes(part: np.ndarray, start: np.ndarray) -> np.ndarray:
    n = np.diff(np.append(start, len(part)))
    place = np.arange(len(part)) - np.repeat(start, n)
    weights = _POW[place] if n.max() <= _BLOCK else powers(_BASE, int(n.max()))[place]
    return mix(np.add.reduceat(_BYTE[part] * weights, start) + (n.astype(U64) << U64(32)))


def _split(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of documents (chunk, doc_id, ids of stretches) and of distinct stretches (chunk, idx, w, n, text)."""
    pair = _load(paths)
    context = TaskContext.get()
    chunk = (context.partitionId() if context else 0) << 24
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", id_type), ("ids", pa.binary()), ("idx", pa.int32()), ("w", pa.int64()), ("n", pa.int64()), ("text", pa.string())])
    known: dict[int, int] = {}
    spelt: list[str] = []
    good, counts = np.zeros(0, bool), np.zeros(0, np.int64)
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = np.fromiter(known, U64, len(known)).view(np.int64)
        for lo in range(0, len(spelt), 100_000):
            hi = min(lo + 100_000, len(spelt))
            m = hi - lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, chunk)), pa.nulls(m, id_type), pa.nulls(m, pa.binary()), pa.array(np.arange(lo, hi, dtype=np.int32)),
                 pa.array(keys[lo:hi]), pa.array(counts[lo:hi]), pa.array(spelt[lo:hi], pa.string())], schema=schema
            )

    for batch in batches:
        text = batch.column(1)
        offsets, data = text_buffers(text)
        for lo, hi in slices(offsets):
            cuts = offsets[lo : hi + 1] - offsets[lo]
            full = np.flatnonzero(np.diff(cuts))  # texts of any bytes
            part = np.insert(data[offsets[lo] : offsets[hi]], cuts[full], 32)
            firsts = cuts[full] + np.arange(len(full))
            ids: list[bytes | None] = [None] * (hi - lo)
            if len(full):
                start = _stretch_starts(part, firsts, pair.stretches)
                keys, at, inverse = np.unique(_hashes(part, start), return_index=True, return_inverse=True)
                ends = np.append(start[1:], len(part))
                before = len(spelt)
                place = np.empty(len(keys), dtype=np.int32)
                for k, (key, i) in enumerate(zip(keys.tolist(), at.tolist())):
                    j = known.get(key)
                    if j is None:
                        j = known[key] = len(spelt)
                        spelt.append(part[start[i] : ends[i]].tobytes().decode())
                    place[k] = j
                good = np.append(good, np.array(pair.lossless(spelt[before:]), dtype=bool))
                counts = np.append(counts, np.zeros(len(spelt) - before, np.int64))
                seq = np.ascontiguousarray(place[inverse], dtype="<i4")
                bounds = np.searchsorted(start, np.append(firsts, len(part)))
                whole = np.logical_and.reduceat(good[seq], bounds[:-1])
                counts += np.bincount(seq[np.repeat(whole, np.diff(bounds))], minlength=len(counts))
                for k in np.flatnonzero(whole):
                    ids[full[k]] = seq[bounds[k] : bounds[k + 1]].tobytes()
            m = hi - lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, chunk)), batch.column(0).slice(lo, m), pa.array(ids, pa.binary()), *(pa.nulls(m, t) for t in schema.types[3:])], schema=schema
            )
            held += int(offsets[hi] - offsets[lo])
            if held > CHUNK_BYTES or len(spelt) > CHUNK_STRETCHES:
                yield from flush()
                chunk, known, spelt, held = chunk + 1, {}, [], 0
                good, counts = np.zeros(0, bool), np.zeros(0, np.int64)
                _trim()
    yield from flush()
    known, spelt = {}, []
    _trim()


def _tokenize(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    pair = _load(paths)
    for batch in batches:
        for lo, hi in slices(text_buffers(batch.column(2))[0]):
            a, b = pair.encode(batch.column(2).slice(lo, hi - lo).to_pylist())
            both = pa.array([x + [SIDE + i for i in y] for x, y in zip(a, b)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), both], names=["w", "n", "t"])
    _trim()


# --- alignment ----------------------------------------------------------------------------------


def links(tokens: DataFrame, lengths: DataFrame) -> DataFrame:
    """Links of texts (w, n, t: ids of A, then of B with SIDE): w, n, end, a and b that end there, over_a and over_b that overlap, group.

    Rows of one text stay in one partition. Groups are numbered from the end of the text.
    """
    rows = tokens.repartition("w").select("w", "n", F.posexplode("t").alias("pos", "t")).join(F.broadcast(lengths), "t")
    rows = rows.withColumn("is_b", F.col("t") >= SIDE)
    rows = rows.withColumn("end", F.sum("len").over(Window.partitionBy("w", "is_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    meet = rows.groupBy("w", "n", "end").agg(F.max(F.when(~F.col("is_b"), F.col("t"))).alias("a"), F.max(F.when(F.col("is_b"), F.col("t") - SIDE)).alias("b"))
    back = Window.partitionBy("w").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    return meet.withColumns({
        "over_a": F.last("a", ignorenulls=True).over(back), "over_b": F.last("b", ignorenulls=True).over(back), "group": F.sum(cut).over(back),
    })


def _joined(strings: pa.Array, cuts: np.ndarray, separator: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), strings), separator)


_ALIGNED = "w long, n long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of rows sorted by (w, end falling): its numbers, its groups as text and its linked pairs."""
    rest: pa.Table | None = None

    def render(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        # rising ends, hence texts in reverse order
        w, n, a, b, over_a, over_b = (table.column(c).combine_chunks() for c in ("w", "n", "a", "b", "over_a", "over_b"))
        turn = pa.array(np.arange(len(w))[::-1])
        w, n, a, b, over_a, over_b = (x.take(turn) for x in (w, n, a, b, over_a, over_b))
        key = w.to_numpy()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        cuts = np.append(first, len(key))
        has_a, has_b = (x.is_valid().to_numpy(zero_copy_only=False) for x in (a, b))
        is_cut = has_a & has_b
        group_end = np.flatnonzero(is_cut) + 1
        count = [np.append(0, np.cumsum(x)) for x in (has_a, has_b, is_cut)]
        sides = [_joined(x.drop_null().cast(pa.string()), np.append(0, c[group_end]), ",") for x, c in zip((a, b), count)]
        groups = _joined(pc.binary_join_element_wise(*sides, "|"), count[2][cuts], ";")
        pairs = (over_a.to_numpy().astype(np.int64) << 32) | over_b.to_numpy()
        numbers = [np.diff(c[cuts]) for c in count]
        return pa.RecordBatch.from_arrays(
            [pa.array(key[first]), n.take(pa.array(first)), *map(pa.array, numbers), pa.array(np.diff(cuts)), groups, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(pairs))],
            names=["w", "n", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        w = table.column("w").to_numpy()
        # the last text may go on
        done = int(np.flatnonzero(np.append(True, w[1:] != w[:-1]))[-1])
        if done:
            yield render(table.slice(0, done))
        rest = table.slice(done)
    if rest is not None and rest.num_rows:
        yield render(rest)
    _trim()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of every linked pair of ids, ``a << 32 | b``: its links corpus-wide, and whether no pair of its b has more."""
    counts = aligned.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def _assemble(with_groups: bool):
    def assemble(docs: pa.Table, parts: pa.Table) -> pa.Table:
        docs, parts = docs.combine_chunks(), parts.combine_chunks()
        place = np.zeros(int(pc.max(parts["idx"]).as_py()) + 1 if len(parts) else 1, dtype=np.int64)
        place[parts["idx"].to_numpy()] = np.arange(len(parts))
        numbers = [parts[c].to_numpy() for c in SUMS]
        strings = parts["groups"].combine_chunks() if len(parts) else pa.array([], pa.string())
        ids = docs["ids"].to_pylist()
        out: list[list] = [[] for _ in SUMS]
        digests, groups = [], []
        lo = 0
        while lo < len(ids):
            hi, held = lo, 0
            while hi < len(ids) and held < 2_000_000:
                held += len(ids[hi] or b"")
                hi += 1
            at = np.cumsum([0, *(len(x or b"") // 4 for x in ids[lo:hi])])
            rows = place[np.frombuffer(b"".join(x or b"" for x in ids[lo:hi]), dtype="<i4")]
            for o, values in zip(out, numbers):
                total = np.append(0, np.cumsum(values[rows]))
                o.append(total[at[1:]] - total[at[:-1]])
            joined = _joined(strings.take(pa.array(rows)), at, ";")
            digests += [hashlib.sha256(x.as_buffer()).hexdigest() if n else "" for x, n in zip(joined, np.diff(at))]
            if with_groups:
                groups += joined.to_pylist()
            lo = hi
        columns = [docs["doc_id"], *(pa.array(np.concatenate(o) if o else []).cast(pa.int64()) for o in out), pa.array(digests, pa.string())]
        if with_groups:
            columns.append(pa.array(groups, pa.string()))
        _trim()
        return pa.Table.from_arrays(columns, names=["doc_id", *SUMS, "groups_sha256"] + ["groups"] * with_groups)

    return assemble


def align(
    docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, with_groups: bool = False, blocks: int = BLOCKS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and the groups themselves if asked for).

    Documents are put together in ``blocks`` of chunks, one after another, which bounds the disk that this takes.
    """
    spark = docs.sparkSession
    both = default_tokenizers()
    paths = (tokenizer_a or both[0], tokenizer_b or both[1])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.dtypes[0][1]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    split = materialize(rows.mapInArrow(lambda x: _split(x, paths, id_type), f"chunk long, doc_id {kind}, ids binary, idx int, w long, n long, text string"), "split")
    parts = split.filter("w is not null")
    distinct = parts.groupBy("w", "text").agg(F.sum("n").alias("n")).filter("n > 0").select("w", "n", "text")
    tokens = materialize(distinct.mapInArrow(lambda x: _tokenize(x, paths), "w long, n long, t array<int>"), "tokens")
    linked = links(tokens, byte_lengths(spark, paths)).sortWithinPartitions("w", F.col("end").desc())
    aligned = materialize(linked.select("w", "n", "a", "b", "over_a", "over_b").mapInArrow(_render, _ALIGNED), "aligned")
    release(tokens)
    pairs = materialize(pair_counts(aligned), "pairs")
    near = F.broadcast(pairs) if pairs.count() <= MOST_PAIRS else pairs
    sums = aligned.select("w", F.explode("pairs").alias("pair")).join(near, "pair").groupBy("w").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    # all that documents need of a stretch, without its pairs
    found = materialize(aligned.drop("n", "pairs").join(sums, "w"), "found")
    release(aligned)
    out = None
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string" + ", groups string" * with_groups
    for k in range(blocks):
        mine = split.filter(F.pmod(F.xxhash64("chunk"), F.lit(blocks)) == k)
        results = mine.filter("w is not null").select("chunk", "idx", "w").join(found, "w").select(F.col("chunk").alias("of_chunk"), "idx", *SUMS, "groups")
        whole = mine.filter("w is null").select("chunk", "doc_id", "ids")
        block = whole.groupBy("chunk").cogroup(results.groupBy("of_chunk")).applyInArrow(_assemble(with_groups), schema)
        block = materialize(block, "documents")
        out = block if out is None else out.unionByName(block)
    release(split, found, pairs)
    return out.withColumnRenamed("doc_id", id_col)

