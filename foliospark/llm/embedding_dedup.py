"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter is a direction made of one codeword for each half of a randomly rotated vector, so B*B
directions cost 2B inner products. Each vector is list-decoded to all filters whose inner product
reaches a limit. For each dimension the limit is set by the distribution of the sphere, so that a
filter's cap holds about ``cap_size`` of uniform vectors, and the number of codewords so that two
vectors at the threshold have ``common`` filters in common on average; ``codes`` independent codes
share them. A simulation of pairs at the threshold then adds codewords until at least ``RECALL`` of
them meet, for the number of vectors at hand. Vectors meet on filters and are compared exactly.
A pair counts in the first filter it has in common, so no pairs are written: a group gives each
member its number of links and the smallest member that it reaches by the group's links, which
connects whatever the group links. Groups beyond ``block`` members are compared block by
block. Recall is measured against brute force in the tests; nothing below the threshold links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do rows with a null id; vectors of unequal length do not link. Equal vectors are one
class and link with each other. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import materialize

THRESHOLD = 0.9
CAP_SIZE = 24
COMMON = 16.0
CODES = 16
BLOCK = 2048
WIDTH = 2048
SEED = 77
#: Highest inner product asked for: in few dimensions no direction is that close to both vectors of a pair beyond it.
MOST_LIMIT = 0.75
#: Expected share of pairs at the threshold with a common filter, and how many pairs a simulation of it draws.
RECALL = 0.98
TRIALS = 1000
#: Sums of codeword products that decode holds at once.
SUMS = 5_000_000


def cap_limit(share: float, dim: int) -> float:
    """The inner product with a direction that this share of uniform unit vectors exceeds."""
    if dim < 2:
        return MOST_LIMIT
    angle = np.linspace(0, np.pi, 200_001)[1:]
    with np.errstate(divide="ignore"):
        log_density = (dim - 2) * np.log(np.sin(angle[:-1])) if dim > 2 else np.zeros(len(angle) - 1)
    below = np.cumsum(np.exp(log_density))
    return float(np.cos(angle[np.searchsorted(below, share * below[-1])]))


def _projected(r, norms, cosine, size: int, dim: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the halves of a pair with random codewords: only the plane of the pair matters."""
    if size == 0:
        return np.zeros(n_words), np.zeros(n_words)
    if size == 1:
        sign = r.choice([-1.0, 1.0], n_words)
        return sign * norms[0] / sqrt(dim), sign * norms[1] * np.sign(cosine) / sqrt(dim)
    reach = np.sqrt(1 - r.random(n_words) ** (2 / (size - 2))) if size > 2 else np.ones(n_words)
    reach *= sqrt(size / dim)
    turn = r.uniform(0, 2 * np.pi, n_words)
    return norms[0] * reach * np.cos(turn), norms[1] * reach * np.cos(turn - np.arccos(np.clip(cosine, -1, 1)))


def expected_recall(dim: int, limit: float, n_words: int, threshold: float, codes: int, trials: int = TRIALS) -> float:
    """Share of pairs at the threshold that have a filter in common, by simulation; codes are independent."""
    r = np.random.default_rng([SEED, dim, n_words])
    x, z = r.standard_normal((2, trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim > 1:
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = threshold * x + sqrt(1 - threshold**2) * z
    else:
        y = x
    half, met = (dim + 1) // 2, 0
    for t in range(trials):
        sides = []
        for lo, hi in ((0, half), (half, dim)):
            u, v = x[t, lo:hi], y[t, lo:hi]
            norms = np.linalg.norm(u), np.linalg.norm(v)
            cosine = float(u @ v / max(norms[0] * norms[1], 1e-300))
            sides.append(_projected(r, norms, cosine, hi - lo, dim, n_words))
        (ax, ay), (bx, by) = sides
        a = np.flatnonzero((ax >= limit - bx.max()) & (ay >= limit - by.max()))
        b = np.flatnonzero((bx >= limit - ax.max()) & (by >= limit - ay.max()))
        met += any(((ax[i] + bx[b] >= limit) & (ay[i] + by[b] >= limit)).any() for i in a)
    return 1 - (1 - met / trials) ** codes


def plan_filters(n: int, threshold: float, dim: int, cap_size: int = CAP_SIZE, common: float = COMMON, codes: int = CODES) -> tuple[float, int]:
    """(lowest inner product, codewords for each half of each code) for n vectors of one dimension."""
    limit = min(cap_limit(min(0.02, cap_size / max(n, 1)), dim), MOST_LIMIT)
    words = 2
    if dim > 1:
        # a filter's part in the plane of a pair is longer than s with probability (1 - s * s) ** ((dim - 2) / 2)
        half_angle = np.arccos(threshold) / 2
        s = np.linspace(min(limit / np.cos(half_angle), 1.0), 1.0, 20_001)
        arc = np.clip(np.arccos(np.minimum(limit / s, 1.0)) - half_angle, 0, None) / np.pi
        both = float(-(np.diff((1 - s * s) ** ((dim - 2) / 2)) * (arc[1:] + arc[:-1]) / 2).sum()) if dim > 2 else float(arc[-1])
        words = max(words, ceil(sqrt(common / max(both, 1e-30) / codes)))
    while expected_recall(dim, limit, words, threshold, codes) < RECALL:
        words = ceil(words * 1.2)
    return limit, words


class ProductCode:
    def __init__(self, dim: int, n_words: int, codes: int = CODES, seed: int = SEED):
        r = np.random.default_rng([seed, dim, n_words])
        self.rotations, self.words, self.dim = [], [], dim
        half = (dim + 1) // 2
        for _ in range(codes):
            self.rotations.append(np.linalg.qr(r.standard_normal((dim, dim)))[0])
            words = []
            for size in (half, dim - half):
                w = r.standard_normal((n_words, max(size, 1)))
                words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * sqrt(max(size, 1) / dim))
            self.words.append(words)
        self.half, self.n_words = half, n_words

    def decode(self, unit: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for all filters whose inner product with a row reaches the limit."""
        rows, filters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, SUMS // self.n_words)
        for k, (rotation, (a, b)) in enumerate(zip(self.rotations, self.words)):
            x = unit @ rotation
            left = x[:, : self.half] @ a.T
            right = x[:, self.half :] @ b.T if self.dim > 1 else np.zeros((len(x), self.n_words))
            # left halves that some right half can complete
            i, p = np.nonzero(left >= limit - right.max(axis=1)[:, None])
            for at in range(0, len(i), step):
                ii, pp = i[at : at + step], p[at : at + step]
                hit, q = np.nonzero(left[ii, pp][:, None] + right[ii] >= limit)
                rows.append(ii[hit])
                filters.append((k * self.n_words + pp[hit]) * self.n_words + q)
        return np.concatenate(rows), np.concatenate(filters)


_CODES: dict = {}


def _unit(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _decode(batches: Iterator[pa.RecordBatch], plans: dict[int, tuple[float, int]], codes: int, dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, dims = batch.column(0), batch.column(1), batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            mine = np.flatnonzero(dims == dim)
            limit, n_words = plans[int(dim)]
            for lo in range(0, len(mine), 512):
                part = pa.array(mine[lo : lo + 512])
                vectors = batch.column(2).take(part).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                key = (int(dim), n_words, codes)
                code = _CODES[key] = _CODES.get(key) or ProductCode(int(dim), n_words, codes)
                row, filters = code.decode(_unit(vectors), limit)
                order = np.lexsort((filters, row))
                row, filters = row[order], filters[order]
                n = np.bincount(row, minlength=len(part))
                # with each filter the vector's filters before it
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                bounds = np.append(0, np.cumsum(nth))
                place = np.arange(bounds[-1]) + np.repeat(np.arange(len(row)) - nth - bounds[:-1], nth)
                earlier = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(filters[place]))
                at = pa.array(row)
                raw = pa.array([v.tobytes() for v in vectors.astype(dtype)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), dim, np.int32)), pa.array(filters), ids.take(part).take(at), counts.take(part).take(at), raw.take(at), earlier],
                    names=["dim", "filter", "_id", "n", "raw", "earlier"],
                )


def _met_before(earlier: list[list[int]], a: np.ndarray, b: np.ndarray, link: np.ndarray) -> np.ndarray:
    """``link`` without the pairs of (a, b) that have an earlier filter in common, compared ``WIDTH`` filters at a time."""
    owner = np.repeat(np.arange(len(earlier)), [len(e) for e in earlier])
    _, name, n = np.unique(np.concatenate([np.array(e, dtype=np.int64) for e in earlier]), return_inverse=True, return_counts=True)
    owner, name = owner[n[name] > 1], name[n[name] > 1]
    _, name = np.unique(name, return_inverse=True)
    for lo in range(0, int(name.max(initial=-1)) + 1, WIDTH):
        at = (name >= lo) & (name < lo + WIDTH)
        has = np.zeros((len(earlier), WIDTH), dtype=np.float32)
        has[owner[at], name[at] - lo] = 1
        link = link & (has[a] @ has[b].T == 0)
        if not link.any():
            break
    return link


def _first_reached(near: np.ndarray) -> np.ndarray:
    """For each member of a symmetric matrix the first one that it reaches; every row is read once."""
    first = np.full(len(near), -1)
    for seed in range(len(near)):
        front = np.array([seed] if first[seed] < 0 else [], dtype=np.int64)
        while len(front):
            first[front] = seed
            front = np.flatnonzero(near[front].any(axis=0) & (first < 0))
    return first


def _count(key: tuple, members: list[tuple], threshold: float, dtype: str) -> pa.RecordBatch:
    """Links first met in this filter: (id, links, smallest id reached by them, over several if need be)."""
    *_, one, two = key
    ids = np.array([m[0] for m in members])
    copies = np.array([m[1] for m in members])
    unit = _unit(np.frombuffer(b"".join(m[2] for m in members), dtype).astype(np.float64).reshape(len(members), -1))
    block = np.array([m[4] for m in members])
    a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
    link = unit[a] @ unit[b].T >= threshold
    if link.any():
        link = _met_before([m[3] for m in members], a, b, link)
    if one == two:
        np.fill_diagonal(link, False)
    links = np.zeros(len(members), dtype=np.int64)
    links[a] += link @ copies[b]
    if one != two:
        links[b] += copies[a] @ link
    found = np.flatnonzero(links)
    found = found[np.argsort(ids[found])]
    near = np.zeros((len(members), len(members)), dtype=bool)
    near[np.ix_(a, b)] = link
    near = near[np.ix_(found, found)]
    root = ids[found][_first_reached(near | near.T)]
    return pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(links[found]), pa.array(root)], names=["_id", "links", "root"])


def _link_groups(batches: Iterator[pa.RecordBatch], threshold: float, dtype: str) -> Iterator[pa.RecordBatch]:
    key, members = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:4] != key:
                if len(members) > 1:
                    yield _count(key, members, threshold, dtype)
                key, members = row[:4], []
            members.append(row[4:])
    if len(members) > 1:
        yield _count(key, members, threshold, dtype)


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, cap_size: int = CAP_SIZE, common: float = COMMON, codes: int = CODES, block: int = BLOCK,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("v"))
    dtype = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"  # what vectors are carried in; all sums are in double precision
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("_id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.filter(usable).withColumn("h", F.xxhash64("v"))
    classes = materialize(good.groupBy("h", "v").agg(F.min("_id").alias("rep"), F.count("*").alias("n")), "classes")
    sizes = classes.groupBy(F.size("v").alias("dim")).count().collect()
    plans = {r["dim"]: plan_filters(r["count"], threshold, r["dim"], cap_size, common, codes) for r in sizes}
    decoded = classes.select("rep", "n", "v").mapInArrow(
        lambda b: _decode(b, plans, codes, dtype), "dim int, filter long, _id long, n long, raw binary, earlier array<long>"
    )
    decoded = materialize(decoded, "decoded")
    sizes = decoded.groupBy("dim", "filter").agg(F.count("*").alias("k")).filter("k > 1")
    sizes = sizes.select("dim", "filter", F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    placed = decoded.join(sizes, ["dim", "filter"]).withColumn("mine", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "dim", "filter", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "_id", "n", "raw", "earlier", "mine"
    )
    groups = paired.repartition("dim", "filter", "one", "two").sortWithinPartitions("dim", "filter", "one", "two")
    found = materialize(groups.mapInArrow(lambda b: _link_groups(b, threshold, dtype), "_id long, links long, root long"), "found")
    members = materialize(good.join(classes.select("h", "v", "rep", "n"), ["h", "v"]).select("_id", "rep", "n"), "members")
    joined = components(
        found.select(F.col("_id").alias("a"), F.col("root").alias("b")).unionByName(members.select(F.col("_id").alias("a"), F.col("rep").alias("b")))
    )
    links = found.groupBy(F.col("_id").alias("rep")).agg(F.sum("links").alias("links"))
    linked = members.join(links, "rep", "left").select(F.col("_id").alias("m_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    # rows may repeat an id: each keeps the number of its own vector through the usable flag and the largest count
    linked = linked.groupBy("m_id").agg(F.max("n_links").alias("n_links"))
    out = rows.select("_id", usable.alias("usable")).join(linked, F.col("_id") == F.col("m_id"), "left").join(joined, F.col("_id") == F.col("node"), "left")
    component = F.when(F.col("usable"), F.coalesce("component", "_id")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("usable"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"),
    )
