"""Training-order materialisation: a keyed permutation places sequences in fixed-stride shards.

Each task joins its documents' ids, a separator id after each, and cuts the stream into sequences of
``size`` ids; only a task's last one is padded. Sequences are numbered by task and position. A keyed
Feistel network over the next power of four, walked on until it falls below the number of sequences,
gives every number its own global slot. Slots are dealt to shards by range; a task sorts one range
and writes it as records of equal length, so slot s is record s % shard_records of shard
s // shard_records. Shards go out in ``rounds``, which bounds the ids in shuffle files at a time.
A shard is written under a temporary name and then renamed. A note in the folder names the key, the
sizes and a checksum of the sequences; a later call with the same leaves shards of the right length
alone, one with others raises.

Defined results: a null text counts as empty and gives the separator alone; a null id is kept in the
list of ids. Ids must cast to a long. A vocabulary with ids beyond 65,535 raises. Rows that repeat are written each. An empty table gives no shards. Columns other than
the id and the text are ignored. The order depends on the key and on how the table is split.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .kernels import U64, mix
from .store import delete, exists, materialize, new_path

SEQUENCE_TOKENS = 2048
SHARD_RECORDS = 4096
SEPARATOR = 0
FEISTEL_ROUNDS = 6
WRITE_ROUNDS = 4
KEY = 20240229
NOTE, SOURCE = "order.json", "source.json"
_RECORDS = 256


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each index below ``n``; a bijection of 0..n-1 for every key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = U64((1 << half) - 1)
    round_keys = mix(np.arange(1, FEISTEL_ROUNDS + 1, dtype=U64) + mix(np.array([key % 2**64], dtype=U64)))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> U64(half), x & low
        for k in round_keys:
            left, right = right, left ^ (mix(right + k) & low)
        return left << U64(half) | right

    out = network(index.astype(U64))
    walking = np.flatnonzero(out >= U64(n))
    while len(walking):
        out[walking] = network(out[walking])
        walking = walking[out[walking] >= U64(n)]
    return out.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], path: str, chunked: bool, size: int, separator: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    task, number = context.partitionId() if context else 0, 0
    stream, owners, took = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)  # ids; rows and ids of each
    named: list = []

    def cut(final: bool) -> pa.RecordBatch | None:
        nonlocal stream, owners, took, named, number
        n = -(-len(stream) // size) if final else len(stream) // size
        if not n:
            return None
        bounds = np.minimum(np.arange(n + 1) * size, len(stream))
        parts = [stream[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        ends = np.cumsum(took)
        # the rows that have ids in each sequence, from the first to the last
        first, last = np.searchsorted(ends, bounds[:-1], side="right"), np.searchsorted(ends, bounds[1:], side="left")
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([task] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()),
                pa.array(np.diff(bounds).astype(np.int32)), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                pa.array([[named[i] for i in owners[f : l + 1]] for f, l in zip(first, last)], pa.list_(pa.int64())),
                pa.array([x.tobytes() for x in parts], pa.binary()),
            ],
            names=["task", "number", "n_tokens", "ids_crc32", "doc_ids", "ids"],
        )
        at = int(np.searchsorted(ends, bounds[-1], side="right"))
        left = ends[at:] - bounds[-1]
        took = np.diff(left, prepend=0)
        named, owners = [named[i] for i in owners[at:]], np.arange(len(took))
        stream, number = stream[bounds[-1] :], number + n
        return batch

    for batch in batches:
        for lo, hi, ids, at in tokens.encode_rows(batch.column(1), path, chunked, separator):
            if len(ids) and int(ids.max()) > 0xFFFF:
                raise ValueError("the vocabulary has ids that 16 bits do not hold")
            stream = np.concatenate([stream, ids.astype("<u2")])
            owners, took = np.concatenate([owners, len(named) + np.arange(hi - lo)]), np.concatenate([took, np.diff(at)])
            named += batch.column(0).slice(lo, hi - lo).to_pylist()
            out = cut(False)
            if out:
                yield out
    out = cut(True)
    if out:
        yield out


_SEQUENCES = "task int, number long, n_tokens int, ids_crc32 long, doc_ids array<long>, ids binary"


def token_sequences(
    docs: DataFrame, size: int = SEQUENCE_TOKENS, tokenizer: str | None = None, chunked: bool = True, separator: int = SEPARATOR,
    id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
) -> DataFrame:
    """A written table of sequences: task, number, n_tokens, ids_crc32, doc_ids, ids (unsigned 16-bit, little-endian).

    It is written to ``folder``, unless an earlier call has completed it there.
    """
    spark = docs.sparkSession
    path = tokenizer or tokens.default_tokenizer()
    folder = folder or new_path(spark, "sequences")
    if not exists(spark, f"{folder}/_SUCCESS"):
        rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
        found = rows.mapInArrow(lambda b: _sequences(b, path, chunked, size, separator), _SEQUENCES)
        found.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.schema(_SEQUENCES).parquet(folder)


def _counts(sequences: DataFrame) -> list:
    """A row for each task that wrote sequences: task, n and a checksum of them."""
    mark = F.bit_xor(F.xxhash64("number", "n_tokens", "ids_crc32"))
    return sequences.groupBy("task").agg(F.count("*").alias("n"), mark.alias("mark")).orderBy("task").collect()


def with_slots(sequences: DataFrame, key: int = KEY, counts: list | None = None) -> tuple[DataFrame, int]:
    """(sequences with their global ``slot``, how many there are)."""
    counts = _counts(sequences) if counts is None else counts
    n = sum(r["n"] for r in counts)
    before = np.zeros(max([r["task"] for r in counts], default=0) + 1, dtype=np.int64)
    before[[r["task"] for r in counts]] = np.cumsum([0, *(r["n"] for r in counts)])[:-1]
    held = sequences.sparkSession.sparkContext.broadcast(before)

    @F.pandas_udf("long")
    def slot(task: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(permute(held.value[task.to_numpy()] + number.to_numpy(), n, key))

    return sequences.withColumn("slot", slot("task", "number")), n


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(batches: Iterator[pa.RecordBatch], folder: str, size: int, shard_records: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, slot, ids) sorted by slot become files of equal records."""
    store, root = fs.FileSystem.from_uri(folder)
    stride, state = 2 * size, {"shard": None}

    def close() -> pa.RecordBatch:
        state["file"].close()
        store.move(state["temporary"], f"{root}/{shard_name(state['shard'])}")
        return pa.RecordBatch.from_pydict({"shard": [state["shard"]], "records": [state["n"]], "crc32": [state["crc"]]}, schema=_MANIFEST)

    for whole in batches:
        for at in range(0, whole.num_rows, _RECORDS):
            part = whole.slice(at, _RECORDS)
            for shard, data in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if shard != state["shard"]:
                    if state["shard"] is not None:
                        yield close()
                    temporary = f"{root}/_{uuid.uuid4().hex}"
                    state.update(shard=shard, n=0, crc=0, temporary=temporary, file=store.open_output_stream(temporary))
                record = data.ljust(stride, b"\0")
                state["file"].write(record)
                state["n"] += 1
                state["crc"] = zlib.crc32(record, state["crc"])
    if state["shard"] is not None:
        yield close()


_MANIFEST = pa.schema([("shard", pa.int64()), ("records", pa.int64()), ("crc32", pa.int64())])


def _same_order(store: fs.FileSystem, path: str, order: dict) -> None:
    """Write the note of an order, or hold the one that is there against it."""
    if store.get_file_info(path).type == fs.FileType.NotFound:
        with store.open_output_stream(path) as out:
            out.write(json.dumps(order).encode())
        return
    with store.open_input_stream(path) as held:
        found = json.loads(held.read())
    if found != order:
        raise ValueError(f"the folder holds shards of another order: {found} instead of {order}")


def write_shards(
    sequences: DataFrame, folder: str, size: int = SEQUENCE_TOKENS, shard_records: int = SHARD_RECORDS, key: int = KEY, rounds: int = WRITE_ROUNDS
) -> DataFrame:
    """Write the shards below ``folder`` and return (shard, records, crc32) of those written by this call.

    The first call leaves a note of the order there; a call with another key, size or table of sequences raises.
    """
    spark = sequences.sparkSession
    counts = _counts(sequences)
    placed, n = with_slots(sequences, key, counts)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    _same_order(store, f"{root}/{NOTE}", {"key": key, "sequences": n, "size": size, "shard_records": shard_records, "marks": zlib.crc32(repr([tuple(r) for r in counts]).encode())})
    n_shards = -(-n // shard_records)
    lengths = {f.base_name: f.size for f in store.get_file_info(fs.FileSelector(root)) if f.is_file}
    done = [(k,) for k in range(n_shards) if lengths.get(shard_name(k)) == 2 * size * min(shard_records, n - k * shard_records)]
    rows = placed.select(F.floor(F.col("slot") / shard_records).alias("shard"), "slot", "ids")
    if done:
        rows = rows.join(spark.createDataFrame(done, "shard long"), "shard", "left_anti")
    manifest = spark.createDataFrame([], "shard long, records long, crc32 long")
    for r in range(min(rounds, n_shards)):
        mine = (
            rows.filter(F.col("shard") % rounds == r)
            .repartitionById(-(-(n_shards - r) // rounds), F.floor(F.col("shard") / rounds).cast("int"))
            .sortWithinPartitions("slot")
        )
        written = mine.mapInArrow(lambda b: _write(b, folder, size, shard_records), "shard long, records long, crc32 long")
        manifest = manifest.unionByName(materialize(written, f"manifest_{r}"))
    return manifest


def read_slots(folder: str, first: int, n: int, size: int = SEQUENCE_TOKENS, shard_records: int = SHARD_RECORDS) -> Iterator[np.ndarray]:
    """Sequences of ``n`` slots from ``first`` on, read in order: where a stopped run goes on."""
    store, root = fs.FileSystem.from_uri(folder)
    slot, file, shard = first, None, None
    while slot < first + n:
        if slot // shard_records != shard:
            shard = slot // shard_records
            file = store.open_input_file(f"{root}/{shard_name(shard)}")
            file.seek(slot % shard_records * 2 * size)
        data = file.read(2 * size)
        if not data:
            return
        yield np.frombuffer(data, dtype="<u2")
        slot += 1


def _source_mark(docs: DataFrame, id_col: str, text_col: str) -> dict:
    """The number of rows, and checksums over ids and texts, whatever their order."""
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    r = docs.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("a"), F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("b")).first()
    return {"rows": r["rows"], "marks": [r["a"], r["b"]]}


def materialise_order(
    docs: DataFrame, folder: str | None = None, size: int = SEQUENCE_TOKENS, shard_records: int = SHARD_RECORDS, key: int = KEY, **options
) -> DataFrame:
    """Write the shards and return a row for each sequence: slot, shard, byte_offset, n_tokens, ids_crc32, doc_ids.

    The sequences stay in the folder until the last shard and the index are written, so a call repeated
    with the same arguments and documents goes on where one was stopped, in another session too; one with
    others raises.
    """
    spark = docs.sparkSession
    if folder:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        asked = {"key": key, "size": size, "shard_records": shard_records, **{k: v for k, v in options.items() if not k.endswith("_col")}}
        _same_order(store, f"{root}/{SOURCE}", asked | _source_mark(docs, options.get("id_col", "doc_id"), options.get("text_col", "text")))
    folder = folder or new_path(spark, "shards")
    index = f"{folder}/index"
    if not exists(spark, f"{index}/_SUCCESS"):
        sequences = token_sequences(docs, size, folder=f"{folder}/sequences", **options)
        write_shards(sequences, folder, size, shard_records, key)
        placed, _ = with_slots(sequences.drop("ids"), key)
        placed.drop("task", "number").write.mode("overwrite").option("compression", "zstd").parquet(index)
    delete(spark, f"{folder}/sequences")
    return spark.read.schema("n_tokens int, ids_crc32 long, doc_ids array<long>, slot long").parquet(index).select(
        "slot", F.floor(F.col("slot") / shard_records).alias("shard"), (F.col("slot") % shard_records * (2 * size)).alias("byte_offset"),
        "n_tokens", "ids_crc32", "doc_ids",
    )
