"""Prefix trie of conversations by preorder intervals.

Turns are numbered within their conversation, conversations are rebuilt from a shared opening and their
own turns, and every rebuilt prefix is named by the exclusive or of hashes of (depth, role, text). Equal
names are one node. Nodes sorted by the sequence of their turns stand in preorder: a subtree is the
interval from its top to the last node that any member of the top reaches. Sums over subtrees are then
differences of prefix sums, which are taken within the parts of the sort and shifted by the totals of the
parts before. Sort keys cover blocks of ``WIDTH`` turns; deeper tries rank whole blocks first and go on
with the ranks, so keys stay short whatever the depth.

Every step takes sums, joins that Spark can split, or windows over one part of a sort or one block of
turns: neither a long conversation nor a node with very many members is gathered in one task. Digests
of members stream over pieces of ``PIECE`` ids.

Defined results: null turns come first, null roles and texts are empty; turns of equal number are
ordered by the MD5 hashes of role and text, repeated rows are turns of their own. Rows without conv_id
are left out. A conversation that keeps no turn is a member of the root and ends there. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, release

GROUP = 20
OPENINGS = 4
WIDTH = 16
BLOCK = 1024
PIECE = 1024
_PART = 33  # monotonically_increasing_id keeps the part above this bit
KEY = ["depth", "p1", "p2"]


def _part(c: str) -> Column:
    return F.shiftright(c, _PART)


def _before(rows: DataFrame, group: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """Sums over the earlier parts of the same group: (*group, order, *sums), one row for each part."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, order).agg(*(v.alias(k) for k, v in sums.items()))
    return totals.select(*group, order, *(F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums))


def number_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, symbol, words): the order of each conversation, by one sort over all rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    symbol = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", symbol.alias("symbol"), words.alias("words"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "symbol", "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "symbol", "words", F.monotonically_increasing_id().alias("g")), "turns")
    placed = placed.withColumn("part", _part("g"))
    parts = placed.groupBy("conv_id", "part").agg(F.min("g").alias("g0"), F.count("*").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("g0") + 1).alias("shift"))
    return placed.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("g") + F.col("shift")).alias("pos"), "symbol", "words")


def rebuild(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns: conv_id, depth, symbol, words, n; conversations: conv_id, n): shared openings, then own turns."""
    sizes = numbered.groupBy("conv_id").agg(F.max("pos").alias("own"))
    sizes = sizes.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(OPENINGS)))
    sizes = sizes.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP)))
    bases = sizes.filter("conv_id = base").select("base", F.col("own").alias("of_base"))
    convs = sizes.join(bases, "base", "left").withColumn("opening", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "opening", (F.col("opening") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    own = numbered.join(convs.select("conv_id", "h", "opening", "n"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("opening") + F.col("pos") - F.col("h")).alias("depth"), "symbol", "words", "n")
    first = numbered.filter(F.col("pos") < OPENINGS).filter(F.pmod("conv_id", F.lit(GROUP)) == 0).withColumnRenamed("conv_id", "base")
    opening = first.join(convs.filter("opening > 0"), "base").filter("pos <= opening")
    opening = opening.select("conv_id", F.col("pos").alias("depth"), "symbol", "words", "n")
    return own.unionByName(opening), convs.select("conv_id", "n")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """Names of the prefixes (p1, p2), of their parents (q1, q2) and the sort key of the last block of turns."""
    rows = rebuilt.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    for k in ("1", "2"):
        rows = rows.withColumn("h" + k, F.xxhash64(F.lit(int(k)), "depth", "symbol"))
    w = Window.partitionBy("conv_id", "block").orderBy("depth")
    rows = rows.withColumns({"x" + k: F.bit_xor("h" + k).over(w) for k in "12"})
    # only conversations of several blocks carry something over
    totals = rows.filter(F.col("n") > BLOCK).groupBy("conv_id", "block").agg(*(F.bit_xor("h" + k).alias("c" + k) for k in "12"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", *(F.bit_xor("c" + k).over(earlier).alias("c" + k) for k in "12"))
    rows = rows.join(totals, ["conv_id", "block"], "left")
    for k in ("1", "2"):
        rows = rows.withColumn("p" + k, F.col("x" + k).bitwiseXOR(F.coalesce("c" + k, F.lit(0))))
        rows = rows.withColumn("q" + k, F.col("p" + k).bitwiseXOR(F.col("h" + k)))
    near = Window.partitionBy("conv_id", F.floor((F.col("depth") - 1) / WIDTH)).orderBy("depth")
    key = F.array_join(F.collect_list("symbol").over(near), "")
    return rows.select("conv_id", "depth", "p1", "p2", "q1", "q2", key.alias("key"), "words", (F.col("depth") == F.col("n")).alias("is_end"))


def _ranked(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows sorted by ``key`` with ``at``, a number that follows the sort."""
    return materialize(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()), name)


def _deepen(nodes: DataFrame, members: DataFrame, deepest: int) -> DataFrame:
    """Replace keys of single blocks by keys that order whole paths: ranks of the blocks before, then of the last one."""
    width = 1
    while width * WIDTH < deepest:
        width *= WIDTH
        ranks = _ranked(nodes.select("key").distinct(), "key", "blocks").select("key", F.lpad(F.hex("at"), 16, "0").alias("rank"))
        named = nodes.join(ranks, "key")
        outer = F.floor((F.col("depth") - 1) / (width * WIDTH))
        whole = members.filter(F.col("depth") % width == 0).select("conv_id", *KEY).join(named.select(*KEY, "rank"), KEY)
        whole = whole.groupBy("conv_id", outer.alias("outer")).agg(F.sort_array(F.collect_list(F.struct("depth", "rank"))).alias("ranks"))
        inner = F.floor((F.col("depth") - 1) / width) % WIDTH
        joined = named.withColumn("outer", outer).join(whole, ["conv_id", "outer"], "left")
        above = F.when(inner > 0, F.array_join(F.slice(F.col("ranks.rank"), F.lit(1), inner.cast("int")), "")).otherwise("")
        deeper = materialize(joined.withColumn("key", F.concat(above, "rank")).select(*nodes.columns), "deeper")
        release(nodes)
        nodes = deeper
    return nodes


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join sorted (at, conv_id) rows into pieces of at most PIECE ids of one node."""
    held: list[int] = []
    node = None

    def piece() -> tuple:
        return node, held[0], ",".join(map(str, held))

    for batch in batches:
        out = []
        for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if at != node or len(held) == PIECE:
                if held:
                    out.append(piece())
                node, held = at, []
            held.append(conv)
        yield pa.RecordBatch.from_pydict(dict(zip(("at", "first", "ids"), map(list, zip(*out)))) if out else {"at": [], "first": [], "ids": []}, schema=_PIECES)
    if held:
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("at", "first", "ids"), piece())}, schema=_PIECES)


_PIECES = pa.schema([("at", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([("at", pa.int64()), ("ends_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node of sorted pieces."""
    node, state = None, None
    for batch in batches:
        out = []
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if at == node:
                state.update(b",")
            else:
                if state:
                    out.append((node, state.hexdigest()))
                node, state = at, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], schema=_DIGESTS)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], schema=_DIGESTS)


def end_digests(ends: DataFrame) -> DataFrame:
    """(at, ends_sha256) of rows (at, conv_id): the ids of a node ascending, comma-joined, hashed piece by piece."""
    order = ["at", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "at long, first long, ids string")
    return pieces.repartition("at").sortWithinPartitions("at", "first").mapInArrow(_digests, "at long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations; the columns are those of the contract of op11."""
    rebuilt, convs = rebuild(materialize(number_turns(turns), "numbered"))
    members = materialize(prefixes(rebuilt), "members")
    convs = materialize(convs, "convs")
    # all but the member and the count follow from the name
    nodes = members.groupBy(*KEY, "q1", "q2", "key", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        *(zero.alias(c) for c in KEY), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), F.lit("").alias("key"), F.lit(0).alias("words"), "conv_id", "n_convs"
    )
    nodes = materialize(nodes.unionByName(root), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    top = nodes.filter("depth = 0")
    ranked = _ranked(_deepen(nodes.filter("depth > 0"), members, deepest).unionByName(top), "key", "ranked").drop("key")
    # the last node on a conversation's path, for all nodes of the path
    at = ranked.select(*KEY, "at")
    last = members.filter("is_end").select("conv_id", *KEY).join(at, KEY).select("conv_id", "at")
    root_at = at.filter("depth = 0").first()
    last = last.unionByName(convs.filter("n = 0").select("conv_id", F.lit(root_at["at"] if root_at else None).cast("long").alias("at")))
    last = materialize(last, "last")
    reach = members.select("conv_id", *KEY).join(last, "conv_id").groupBy(*KEY).agg(F.max("at").alias("end"))
    reach = reach.unionByName(last.agg(F.max("at").alias("end")).filter("end is not null").select(*(zero.alias(c) for c in KEY), "end"))
    children = ranked.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    full = ranked.join(reach, KEY).join(children, KEY, "left").withColumn("part", _part("at"))
    full = full.withColumns({"leaf": (F.col("at") == F.col("end")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    full = materialize(full, "intervals")
    sums = {"leaf": F.sum("leaf"), "saved": F.sum("saved")}
    before = _before(full, [], "part", sums).select("part", F.col("leaf").alias("leaf0"), F.col("saved").alias("saved0"))
    w = Window.partitionBy("part").orderBy("at")
    totals = full.withColumns({"_l": F.sum("leaf").over(w), "_s": F.sum("saved").over(w)}).join(F.broadcast(before), "part")
    totals = materialize(totals.withColumns({"leaves": F.col("_l") + F.col("leaf0"), "savings": F.col("_s") + F.col("saved0")}).drop("_l", "_s", "leaf0", "saved0", "part"), "totals")
    ends = totals.select(F.col("at").alias("end"), F.col("leaves").alias("end_leaves"), F.col("savings").alias("end_savings"))
    above = totals.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = totals.join(ends, "end").join(above, ["depth", "q1", "q2"], "left").join(end_digests(last), "at", "left")
    release(full)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        (F.col("end_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_savings") - F.col("savings") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
