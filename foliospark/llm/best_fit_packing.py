"""Best-fit packing of token pieces, planned over a histogram of lengths.

Documents become ids, a separator id closes each, and only those longer than a sequence are cut.
The plan is best-fit decreasing carried out on counts: bins with equal room form intervals of
sequence numbers, and a length's whole count goes into the fullest intervals it fits. Its size
depends on the sequence length alone. A piece then takes the planned slot with its rank among the
pieces of its length; ranks come from counts by (length, bucket) plus a rank within the bucket, so
a length that most pieces share is spread over many tasks.

Defined results: a null text counts as empty and gives one piece, the separator alone. Rows that
repeat are packed each. An empty table gives no rows. Columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .kernels import U64, mix
from .store import materialize

SEQUENCE_TOKENS = 2048
SEPARATOR = 0


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Slots for every length: arrays length, rank, sequence, fold, offset, sorted by length and rank.

    Ranks rank.. of a length go into sequences sequence.., ``fold`` to each sequence, from ``offset`` on.
    """
    room: dict[int, deque] = {}  # room left -> intervals (first sequence, how many)
    rooms: list[int] = []  # sorted keys of room
    out: list[tuple[int, int, int, int, int]] = []
    next_sequence = 0

    def put(left: int, first: int, n: int) -> None:
        if n:
            if left not in room:
                room[left] = deque()
                rooms.insert(bisect_left(rooms, left), left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]

        def fill(left: int, first: int, n: int) -> int:
            """Fill the first bins of an interval; returns how many bins took something."""
            nonlocal rank, todo
            fold = left // length
            full = min(n, todo // fold)
            if full:
                out.append((length, rank, first, fold, capacity - left))
                put(left - fold * length, first, full)
                rank, todo = rank + full * fold, todo - full * fold
            used = full
            if todo and used < n:
                out.append((length, rank, first + used, todo, capacity - left))
                put(left - todo * length, first + used, 1)
                rank, todo, used = rank + todo, 0, used + 1
            return used

        while todo:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                break
            left = rooms[k]
            intervals = room[left]
            first, n = intervals.popleft()
            if not intervals:
                del room[left], rooms[k]
            used = fill(left, first, n)
            put(left, first + used, n - used)
        if todo:
            fresh = -(-todo // (capacity // length))
            fill(capacity, next_sequence, fresh)
            next_sequence += fresh
    rows = np.array(sorted(out), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "fold", "offset"), rows.T))


def _pieces(batches: Iterator[pa.RecordBatch], path: str, chunked: bool, size: int, separator: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 40
    for batch in batches:
        owner, text = batch.column(0), batch.column(1)
        for lo, hi, ids, at in tokens.encode_rows(text, path, chunked, separator):
            n = -(-np.diff(at) // size)  # pieces of each row, one at least: its separator
            row = np.repeat(np.arange(hi - lo), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = at[row] + piece * size
            end = np.minimum(begin + size, at[row + 1])
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin, end)]
            salt = mix(np.arange(number, number + len(row), dtype=U64)).view(np.int64)
            number += len(row)
            columns = [
                owner.take(pa.array(lo + row)), pa.array(piece.astype(np.int32)), pa.array(piece * size),
                pa.array(end - begin), pa.array(crc, pa.int64()), pa.array(salt),
            ]
            names = ["_id", "piece", "start", "length", "ids_crc32", "salt"]
            if with_ids:
                columns.append(pa.array([ids[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def token_pieces(
    docs: DataFrame, size: int = SEQUENCE_TOKENS, tokenizer: str | None = None, chunked: bool = True, separator: int = SEPARATOR,
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of at most ``size`` ids: _id, piece, start, length, ids_crc32, salt (no two alike), and the ids themselves if asked for."""
    path = tokenizer or tokens.default_tokenizer()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    schema = f"_id {dict(rows.dtypes)['_id']}, piece int, start long, length long, ids_crc32 long, salt long" + ", ids binary" * with_ids
    return rows.mapInArrow(lambda b: _pieces(b, path, chunked, size, separator, with_ids), schema)


def with_ranks(pieces: DataFrame, group: list[str], order: list[str], per_bucket: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(rows with a dense ``rank`` from 0 within each group, counts by group) of a table that can be read again.

    Buckets by hash hold about ``per_bucket`` rows, so no task ranks a whole group.
    """
    n_buckets = max(16, -(-pieces.count() // per_bucket))
    rows = pieces.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_b")
    offsets = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    within = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)) - 1
    keys = [*group, "_b"]
    ranked = rows.withColumn("_r", within).join(offsets.select(*keys, "_before"), keys)
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("n"))
    return ranked.withColumn("rank", F.col("_r") + F.col("_before")).drop("_b", "_r", "_before"), totals


def _place(batches: Iterator[pa.RecordBatch], slots) -> Iterator[pa.RecordBatch]:
    s = slots.value
    key = (s["length"] << 44) + s["rank"]
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
        nth = rank - s["rank"][at]
        sequence = s["sequence"][at] + nth // s["fold"][at]
        offset = s["offset"][at] + nth % s["fold"][at] * length
        keep = [i for i, f in enumerate(batch.schema) if f.name != "rank"]
        columns = [batch.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema[i].name for i in keep] + ["sequence_id", "offset"])


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Add sequence_id and offset to a materialized table of pieces with a ``length`` of at most ``size`` and a ``salt``."""
    spark = pieces.sparkSession
    ranked, totals = with_ranks(pieces, ["length"], ["salt"])
    # at most ``size`` rows, whatever the input; the plan has a bounded number of slots for each
    counts = {r["length"]: r["n"] for r in totals.collect()}
    slots = spark.sparkContext.broadcast(plan(counts, size))
    kept = [(c, t) for c, t in pieces.dtypes if c != "salt"]
    out = ranked.select(*(c for c, _ in kept), F.col("rank").cast("long"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept) + ", sequence_id long, offset long"
    return out.mapInArrow(lambda b: _place(b, slots), schema)


def pack_documents(
    docs: DataFrame, size: int = SEQUENCE_TOKENS, tokenizer: str | None = None, chunked: bool = True, separator: int = SEPARATOR,
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    pieces = materialize(token_pieces(docs, size, tokenizer, chunked, separator, with_ids, id_col, text_col), "pieces")
    return pack(pieces, size).withColumnRenamed("_id", id_col)
