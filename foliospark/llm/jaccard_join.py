"""Exact n-gram Jaccard join: bucket signatures route documents to signature trees.

1. A document's set is its distinct word shingles (64-bit hashes). Documents with equal sets form a
   class, and its smallest id stands for it.
2. Sets with J >= t differ in few elements: with the smaller size below U, at most
   k = (1-t)/t * U. Hash space is cut into somewhat more than k buckets, and a signature is the hash
   of a bucket's content. In a fixed order of buckets, fewer than k + 1 filled ones come before the
   first on which two such sets agree, so each document signs its first k + 1. Shingles that very
   many documents share are left out first, which takes differences away only. A document that is
   left with too few filled buckets signs all of them and, in name spaces of their own, finer
   buckets, then those of its whole set. Bounds on k hold for a range of sizes, so a document signs
   for its own range and for those of smaller partners.
3. Documents that share a signature may be linked. Buckets with one shingle or two meet by chance, the
   more of them the larger the corpus, so each set also has a sketch: the parities of its shingles'
   numbers in as many cells as it has shingles. Two sets differ in at least as many shingles as their
   sketches do in cells, so pairs that differ in too many cells, or in size, are no links. Within the
   documents of a signature, what chains of the other pairs tie together is joined, and the components
   of that graph are candidate groups; every true link lies within one. Signatures with the same
   documents are looked at once. Those of more than MOST_MET documents, which only copies have in
   number, join all of these.
4. Each group, in chunks of bounded size, becomes a signature tree: nodes hold the OR of their
   documents' token bitmaps and their range of sizes. A dual traversal of the tree prunes pairs of
   nodes whose maximum possible overlap is too small, or whose documents are connected already;
   what is left is compared exactly. Every chunk also holds the group's smallest document. In groups
   of several chunks, documents not connected to that one are compared with the other chunks too.
5. The components of the verified links are the result.

Defined results: a null text or one without words has an empty set, linked with nothing. A text of
fewer words than a shingle has its whole sequence as one. Rows that repeat an id are the same
document and so in the same component; a null id is linked with nothing and has a null component.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, Words, mix, rolling, span_hash, words
from .store import materialize, release

SHINGLE_WORDS = 5
THRESHOLD = (80, 100)
CHUNK = 256
LEAF = 8
_SHINGLE_BASE = 0xA0761D6478BD642F
HOT_SHARE = 2e-4
HOT_LEAST = 8
MOST_HOT = 4_000_000
DOCS_PER_TASK = 1024
MOST_MET = 4096
_EMPTY = U64(0x5851F42D4C957F2D)


def size_bounds(top: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the size ranges."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, dtype=np.int64)


_BOUNDS = size_bounds()


def most_different(threshold: tuple[int, int]) -> np.ndarray:
    """In how many elements two linked sets can differ, for each range of the smaller size."""
    num, den = threshold
    largest = _BOUNDS[1:] - 1
    return (den * largest // num) * (den - num) // den


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) pairs, distinct, sorted by document, then shingle."""
    h = rolling(w.hash, size, _SHINGLE_BASE)
    doc = w.doc[: len(h)]
    inside = doc == w.doc[size - 1 :] if len(h) else np.zeros(0, bool)
    n_words = np.diff(w.first)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    whole = mix(span_hash(w.hash, w.first[short], w.first[short + 1], _SHINGLE_BASE) + n_words[short].astype(U64) * _EMPTY) if len(short) else np.zeros(0, U64)
    doc, h = np.concatenate([doc[inside], short]), np.concatenate([h[inside], whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _fill(doc: np.ndarray, h: np.ndarray, ranges: np.ndarray, n_buckets: np.ndarray, most: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, signature) of the first ``most + 1`` filled buckets, and how many are filled in all."""
    r = ranges[doc]
    bucket = ((h >> U64(32)) * n_buckets[r].astype(U64)) >> U64(32)
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    owner = doc[at]
    filled = np.bincount(owner, minlength=len(ranges))
    nth = np.arange(len(at)) - np.repeat(np.cumsum(filled) - filled, filled)
    first = nth <= most[ranges[owner]]
    place = mix(r[at].astype(U64) * U64(1 << 40) + bucket[at] + U64(space << 60) + U64(1))
    return owner[first], mix(_sums(mix(h), at) + place)[first], filled


def _sign(doc: np.ndarray, h: np.ndarray, hot: np.ndarray, ranges: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) for documents whose size range for this role is ``ranges[doc]``, -1 for none."""
    owners, signatures = [], []
    signing, coarse, fine = ranges >= 0, most + most // 10 + 4, 2 * most + 3
    for space, (n_buckets, left_out) in enumerate(((coarse, hot), (fine, hot), (coarse, np.zeros_like(hot))), 1):
        use = signing[doc] & ~left_out
        owner, signature, filled = _fill(doc[use], h[use], ranges, n_buckets, most, space)
        owners.append(owner)
        signatures.append(signature)
        signing = signing & (filled <= most[ranges])
    sparse = np.flatnonzero(signing)  # too few filled buckets in every space: these meet each other
    owners.append(sparse)
    signatures.append(mix(ranges[sparse].astype(U64) + _EMPTY))
    return np.concatenate(owners), np.concatenate(signatures)


def parity_sketches(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of each set the parities of its shingles' numbers in 2**b cells, b >= 6 and least with a cell for each shingle."""
    cells = np.where(n > 0, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64), 0)
    first = np.append(0, np.cumsum(cells))
    at = first[doc] + (h & (cells[doc] - 1).astype(U64)).astype(np.int64)
    odd = (np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8)
    data = np.packbits(odd, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((first // 8).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def may_link(n: list[int], sketches: list[bytes], threshold: tuple[int, int]) -> np.ndarray:
    """For each set the first one that chains of pairs tie it to whose sizes and sketches allow a link."""
    num, den = threshold
    size, width = np.array(n), np.array([len(s) for s in sketches])
    widths = np.unique(width).tolist()
    place = np.zeros(len(size), dtype=np.int64)
    maps: dict[tuple[int, int], np.ndarray] = {}
    for k, w in enumerate(widths):
        rows = np.flatnonzero(width == w)
        place[rows] = np.arange(len(rows))
        part = np.frombuffer(b"".join([sketches[i] for i in rows]), dtype=np.uint64).reshape(len(rows), -1)
        maps[w, w] = part
        for narrow in reversed(widths[:k]):
            while part.shape[1] * 8 > narrow:  # parities of two cells add up to that of both as one
                half = part.shape[1] // 2
                part = part[:, :half] ^ part[:, half:]
            maps[w, narrow] = part

    def near(x: int, others: np.ndarray) -> np.ndarray:
        out = num * np.maximum(size[others], size[x]) <= den * np.minimum(size[others], size[x])
        for w in widths:
            at = np.flatnonzero(out & (width[others] == w)) if len(widths) > 1 else np.flatnonzero(out)
            if len(at):
                cells = min(w, int(width[x]))
                rows = others[at]
                differ = np.bitwise_count(maps[w, cells][place[rows]] ^ maps[int(width[x]), cells][place[x]]).sum(axis=1, dtype=np.int64)
                out[at] = differ * (num + den) <= (den - num) * (size[rows] + size[x])
        return out

    first, left = np.zeros(len(size), dtype=np.int64), np.arange(len(size))
    while len(left):
        first[left[0]], front, left, start = left[0], left[:1], left[1:], left[0]
        while len(front) and len(left):
            if len(front) <= len(left):
                met = np.logical_or.reduce([near(x, left) for x in front])
            else:
                met = np.array([near(y, front).any() for y in left])
            first[left[met]] = start
            front, left = left[met], left[~met]
    return first


def _repeated(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Shingles that several documents of a slice have, with their number."""
    for batch in batches:
        for w in words(batch.column(0), fold_case=True):
            shingles, n = np.unique(shingle_sets(w, size)[1], return_counts=True)
            yield pa.RecordBatch.from_pydict({"shingle": shingles[n > 1].view(np.int64), "n": n[n > 1]})


def common_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles that a share of about HOT_SHARE of all documents have, sorted.

    No result depends on which these are. A set has as many shingles as words, so their number is at
    most the words of a document on average over HOT_SHARE; beyond MOST_HOT the rarer ones are not
    left out.
    """
    n_docs = texts.count()
    found = texts.select("_t").mapInArrow(lambda b: _repeated(b, size), "shingle long, n long")
    hot = found.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(HOT_LEAST, int(HOT_SHARE * n_docs)))
    hot = materialize(hot, "common_shingles")
    n_hot = hot.count()
    kept = hot
    if n_hot > MOST_HOT:
        kept = hot.filter(F.col("n") > hot.approxQuantile("n", [1 - MOST_HOT / n_hot], 1e-4)[0])
    out = np.sort(kept.select("shingle").toPandas()["shingle"].to_numpy().astype(np.int64).view(U64))
    release(hot)
    return out


def _describe(batches: Iterator[pa.RecordBatch], size: int, threshold: tuple[int, int], held) -> Iterator[pa.RecordBatch]:
    most = most_different(threshold)
    common = np.append(held.value, U64(2**64 - 1))
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        for w in words(text, fold_case=True):
            doc, h = shingle_sets(w, size)
            hot = common[np.searchsorted(common[:-1], h)] == h
            n = np.bincount(doc, minlength=w.hi - w.lo)
            at = np.searchsorted(doc, np.flatnonzero(n))
            f1, f2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
            f1[n > 0], f2[n > 0] = _sums(mix(h ^ _EMPTY), at), _sums(mix(h + U64(0x2545F4914F6CDD1D)), at)
            own = np.where(n > 0, np.searchsorted(_BOUNDS, n, side="right") - 1, -1)
            low = np.searchsorted(_BOUNDS, -(-n * threshold[0] // threshold[1]), side="right") - 1
            parts = []
            for back in range(int((own - low)[n > 0].max(initial=0)) + 1):
                parts.append(_sign(doc, h, hot, np.where((n > 0) & (own - back >= low), own - back, -1), most))
            owner = np.concatenate([p[0] for p in parts])
            signature = np.concatenate([p[1] for p in parts])
            order = np.argsort(owner, kind="stable")
            lists = pa.ListArray.from_arrays(
                np.append(0, np.cumsum(np.bincount(owner, minlength=len(n)))).astype(np.int32), pa.array(signature[order].view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [ids.slice(w.lo, w.hi - w.lo), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), parity_sketches(doc, h, n), lists],
                names=["_id", "n", "f1", "f2", "sketch", "signatures"],
            )


def _meet(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature come in; (a, b) go out for documents that others of their signature may be linked to."""

    def pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    a, b = [], []
    for _, group in groupby(rows, key=itemgetter(0)):
        _, ids, n, sketches = zip(*group)
        for i, k in enumerate(may_link(n, sketches, threshold).tolist()):
            if ids[i] != ids[k]:
                a.append(ids[i])
                b.append(ids[k])
        if len(a) >= 10_000:
            yield pairs(a, b)
            a, b = [], []
    yield pairs(a, b)


def _possible_links(signed: DataFrame, sketched: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): pairs of documents that share a signature; their components hold all links."""
    spark = signed.sparkSession
    shared = signed.groupBy("signature").agg(F.min("_id").alias("m"), F.max("_id").alias("x")).filter("m < x").select("signature", "m")
    shared = materialize(shared, "shared")
    met = materialize(signed.join(shared.hint("merge"), "signature").select("signature", "m", "_id"), "met")
    # ids that repeat within a signature cancel out in the first check sum, not in the second
    sums = [F.bit_xor(F.xxhash64("_id")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "_id"), 30)).alias("s")]
    groups = met.groupBy("signature").agg(F.min("m").alias("m"), F.count("*").alias("k"), *sums)
    groups = materialize(groups.groupBy("m", "k", "x", "s").agg(F.min("signature").alias("signature")).select("signature", "k"), "met_groups")
    few = met.join(groups.filter(F.col("k") <= MOST_MET).hint("merge"), "signature").select("signature", "_id")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = few.join(sketched.hint("shuffle_hash"), "_id").select("signature", "_id", "n", "sketch").repartition(tasks, "signature").sortWithinPartitions("signature")
    pairs = rows.mapInArrow(lambda b: _meet(b, threshold), "a long, b long")
    many = met.join(groups.filter(F.col("k") > MOST_MET).hint("merge"), "signature").filter("_id <> m").select(F.col("_id").alias("a"), F.col("m").alias("b"))
    out = materialize(pairs.unionByName(many), "possible_links")
    release(shared, met, groups)
    return out


class SignatureTree:
    """Documents in an order that keeps likely partners together, in nodes of OR-ed bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        self.bits = 1 << max(8, min(16, int(2 * self.size.max()).bit_length()))
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.root = self._node(order)

    def _node(self, members: list[int]) -> dict:
        node = {"members": members, "parts": []}
        if len(members) > LEAF:
            step = max(LEAF, -(-len(members) // LEAF))
            node["parts"] = [self._node(members[i : i + step]) for i in range(0, len(members), step)]
            node["map"] = np.bitwise_or.reduce([p["map"] for p in node["parts"]])
            node["excess"] = max(p["excess"] for p in node["parts"])
        else:
            maps = [self._bitmap(i) for i in members]
            node["map"] = np.bitwise_or.reduce(maps)
            node["excess"] = max(int(self.size[i]) - int(np.bitwise_count(m).sum()) for i, m in zip(members, maps))
        node["least"], node["most"] = int(self.size[members].min()), int(self.size[members].max())
        return node

    def _bitmap(self, i: int) -> np.ndarray:
        out = np.zeros(self.bits, dtype=np.uint8)
        out[(self.sets[i] & U64(self.bits - 1)).astype(np.int64)] = 1
        return np.packbits(out).view(np.uint64)


def _enough(overlap, a, b, threshold) -> bool:
    num, den = threshold
    return overlap * (num + den) >= num * (a + b)


def connect(sets: list[np.ndarray], labels: list[int], threshold: tuple[int, int], first: int | None = None, joined: list[bool] | None = None) -> list[int]:
    """For each set the smallest label it is linked to, over chains of links among the given sets.

    ``first`` is an index compared with all before the traversal. Sets flagged in ``joined`` are
    connected by links outside.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(i: int, j: int) -> None:
        root[find(i)] = find(j)

    seen: dict[int, int] = {}
    for i, label in enumerate(labels):
        union(i, seen.setdefault(label, i))
    if joined:
        flagged = [i for i, f in enumerate(joined) if f]
        for i in flagged[1:]:
            union(i, flagged[0])
    size = np.array([len(s) for s in sets])

    def compare(i: int, j: int) -> None:
        if find(i) == find(j) or not _enough(min(size[i], size[j]), size[i], size[j], threshold):
            return
        a, b = (sets[i], sets[j]) if size[i] >= size[j] else (sets[j], sets[i])
        at = np.searchsorted(a, b)
        at[at == len(a)] = 0
        if _enough(int((a[at] == b).sum()), size[i], size[j], threshold):
            union(i, j)

    if first is not None:
        for i in range(len(sets)):
            compare(first, i)
    if len(sets) <= LEAF:
        for i in range(len(sets)):
            for j in range(i):
                compare(i, j)
    else:
        tree = SignatureTree(sets)
        todo = [(tree.root, tree.root)]
        while todo:
            x, y = todo.pop()
            if len({find(i) for i in x["members"]} | {find(i) for i in y["members"]}) == 1:
                continue
            if x is not y:
                overlap = int(np.bitwise_count(x["map"] & y["map"]).sum()) + min(x["excess"], y["excess"])
                overlap = min(overlap, x["most"], y["most"])
                if not _enough(overlap, x["least"], y["least"], threshold):
                    continue
            if not x["parts"] and not y["parts"]:
                for i in x["members"]:
                    for j in y["members"]:
                        if x is not y or j < i:
                            compare(i, j)
            elif x is y:
                parts = x["parts"]
                todo += [(parts[i], parts[j]) for i in range(len(parts)) for j in range(i + 1)]
            elif x["parts"] and (not y["parts"] or len(x["members"]) >= len(y["members"])):
                todo += [(p, y) for p in x["parts"]]
            else:
                todo += [(x, p) for p in y["parts"]]
    least: dict[int, int] = {}
    for i, label in enumerate(labels):
        r = find(i)
        least[r] = min(label, least.get(r, label))
    return [least[find(i)] for i in range(len(sets))]


def _link_groups(batches: Iterator[pa.RecordBatch], size: int, threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group come in; (_id, group, root) go out for the documents of each."""

    def finish(key, ids, joined, sets) -> pa.RecordBatch:
        roots = connect(sets, ids, threshold, ids.index(key[0]) if key[0] in ids else None, joined)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([key[0]] * len(ids), pa.int64()), pa.array(roots, pa.int64())], names=["_id", "candidate", "root"]
        )

    key, ids, joined, sets = None, [], [], []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for w in words(batch.column(5), fold_case=True):
            doc, h = shingle_sets(w, size)
            cuts = np.searchsorted(doc, np.arange(w.hi - w.lo + 1))
            for i in range(w.hi - w.lo):
                group = tuple(columns[c][w.lo + i] for c in (1, 2, 3))
                if group != key:
                    if len(ids) > 1:
                        yield finish(key, ids, joined, sets)
                    key, ids, joined, sets = group, [], [], []
                if cuts[i + 1] > cuts[i]:
                    ids.append(columns[0][w.lo + i])
                    joined.append(columns[4][w.lo + i])
                    sets.append(h[cuts[i] : cuts[i + 1]].copy())
    if len(ids) > 1:
        yield finish(key, ids, joined, sets)


def _run_groups(texts: DataFrame, placed: DataFrame, size: int, threshold: tuple[int, int], name: str) -> DataFrame:
    """Link the documents of each (candidate, chunk, block) of ``placed``, a table that can be read again."""
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // DOCS_PER_TASK))
    rows = (
        texts.join(placed.hint("shuffle_hash"), "_id")
        .select("_id", "candidate", "chunk", "block", "joined", "_t")
        .repartition(tasks, "candidate", "chunk", "block")
        .sortWithinPartitions("candidate", "chunk", "block")
    )
    out = rows.mapInArrow(lambda b: _link_groups(b, size, threshold), "_id long, candidate long, root long")
    return materialize(out, name)


def jaccard_components(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (null if the id is null).

    ``threshold`` is (numerator, denominator); documents link when denominator * |x & y| >= numerator * |x | y|.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    held = spark.sparkContext.broadcast(common_shingles(texts, shingle))
    described = materialize(
        texts.mapInArrow(lambda b: _describe(b, shingle, threshold, held), "_id long, n long, f1 long, f2 long, sketch binary, signatures array<long>"), "described"
    )
    sized = materialize(described.select("_id", "n", "f1", "f2"), "sized")
    full = sized.filter("n > 0 and _id is not null")
    # only sets that several rows have need a representative; the join is one that Spark can split where a set is frequent
    copied = materialize(full.groupBy("f1", "f2").agg(F.min("_id").alias("rep"), F.count("*").alias("k")).filter("k > 1").drop("k"), "copied")
    copies = materialize(full.join(copied.hint("merge"), ["f1", "f2"]).filter("_id <> rep").select("_id", "f1", "f2", "rep").distinct(), "copies")
    signing = described.filter("n > 0 and _id is not null").join(copies.hint("shuffle_hash"), ["_id", "f1", "f2"], "left_anti")
    signed = materialize(signing.select("_id", F.explode("signatures").alias("signature")), "signatures")
    sketched = materialize(described.filter("n > 0 and _id is not null").select("_id", "n", "sketch"), "sketches")
    release(described)
    possible = _possible_links(signed, sketched, threshold)
    release(signed, sketched, copied)
    candidates = components(possible)
    release(possible)

    labels = candidates.select(F.col("node").alias("_id"), F.col("component").alias("candidate"))
    groups = labels.groupBy("candidate").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    placed = labels.join(groups, "candidate").withColumn("chunk", F.pmod(F.xxhash64("_id"), F.col("chunks")).cast("int"))
    placed = materialize(placed, "placed")
    # texts of candidates only: the table of all texts is shuffled once
    texts = materialize(texts.join(placed.select("_id").hint("shuffle_hash"), "_id", "left_semi"), "candidate_texts")
    pivots = groups.filter("chunks > 1").select(F.col("candidate").alias("_id"), "candidate", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    first = placed.select("_id", "candidate", "chunk").unionByName(pivots).distinct().withColumn("block", F.lit(0)).withColumn("joined", F.lit(False))
    linked = _run_groups(texts, materialize(first, "first"), shingle, threshold, "linked")
    links = linked.select(F.col("_id").alias("a"), F.col("root").alias("b")).filter("a <> b")

    # documents that their chunk does not connect to the smallest of a group of several chunks
    apart = materialize(
        placed.filter("chunks > 1").join(linked.filter("root <> candidate").select("_id").distinct(), "_id"), "apart"
    )
    if not apart.isEmpty():
        blocks = apart.groupBy("candidate").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("blocks"))
        mine = apart.join(blocks, "candidate").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "_id"), F.col("blocks")).cast("int"))
        guests = mine.select("_id", "candidate", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", F.lit(False).alias("joined"))
        homes = (
            placed.join(blocks, "candidate")
            .join(apart.select("_id", F.lit(1).alias("out")), "_id", "left")
            .select("_id", "candidate", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("out").isNull().alias("joined"))
        )
        again = guests.unionByName(homes).groupBy("_id", "candidate", "chunk", "block").agg(F.max("joined").alias("joined"))
        relinked = _run_groups(texts, materialize(again, "again"), shingle, threshold, "relinked")
        links = links.unionByName(relinked.select(F.col("_id").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    release(texts)
    final = components(links.unionByName(copies.select(F.col("_id").alias("a"), F.col("rep").alias("b"))))
    release(placed, copies, linked, apart)
    return sized.join(final, sized["_id"] == final["node"], "left").select(
        sized["_id"].alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id")
    )
