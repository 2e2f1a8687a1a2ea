"""Documents whose generator fingerprints have something in common: counts for each document, or pairs of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..store import materialize

BLOCK = 2000
_FIELDS = ["rep", "g_full", "g_header", "g_structure", "g_hint"]


def _side(p: str) -> dict[str, Column]:
    return {k: F.col(f"{p}.g_{k}") for k in ("full", "header", "structure", "hint")}


def _pairs(classes: DataFrame, key: str, block: int) -> DataFrame:
    """(x, y): every two classes of a key, once; large keys are joined block by block."""
    sizes = classes.groupBy(key).agg(F.count("*").alias("k")).filter(f"k > 1 and {key} is not null")
    sizes = sizes.select(F.col(key).alias("key"), F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    placed = classes.join(sizes, F.col(key) == F.col("key")).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    row = F.struct(*_FIELDS)
    left = placed.select("key", F.col("mine").alias("one"), F.explode(F.sequence("mine", F.col("blocks") - 1)).alias("two"), row.alias("x"))
    right = placed.select("key", F.explode(F.sequence(F.lit(0), "mine")).alias("one"), F.col("mine").alias("two"), row.alias("y"))
    met = left.join(right.hint("shuffle_hash"), ["key", "one", "two"]).filter("one < two or x.rep < y.rep")
    return met.select("x", "y")


def contained_hints(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(outer, inner): distinct hints of which one holds the other.

    They meet on the rarest trigram of the shorter one; hints of a frequent trigram are dealt out in blocks.
    """
    hints = classes.filter("g_hint <> ''").select("g_hint").distinct()
    grams = F.transform(F.sequence(F.lit(1), F.length("g_hint") - 2), lambda i: F.substring(F.col("g_hint"), i, F.lit(3)))
    index = hints.filter("length(g_hint) >= 3").select("g_hint", F.explode(F.array_distinct(grams)).alias("gram"))
    often = index.groupBy("gram").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("k"))
    rarest = index.join(often, "gram").groupBy(F.col("g_hint").alias("inner")).agg(F.min(F.struct("k", "gram", "blocks")).alias("r"))
    rarest = rarest.select("inner", F.col("r.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.col("r.blocks") - 1)).alias("block"))
    dealt = index.join(often, "gram").select(F.col("g_hint").alias("outer"), "gram", F.pmod(F.xxhash64("g_hint"), "blocks").cast("int").alias("block"))
    held = rarest.join(dealt, ["gram", "block"])
    return held.filter(F.contains("outer", F.col("inner")) & (F.col("outer") != F.col("inner"))).select("outer", "inner")


def _contained(classes: DataFrame) -> DataFrame:
    """(x, y): classes where the hint of x holds the other hint of y."""
    held = contained_hints(classes)
    row = F.struct(*_FIELDS)
    x, y = classes.select(F.col("g_hint").alias("outer"), row.alias("x")), classes.select(F.col("g_hint").alias("inner"), row.alias("y"))
    return held.join(x, "outer").join(y, "inner").select("x", "y")


def likeness_counts(docs: DataFrame) -> DataFrame:
    """One row for each document: its class and how many others are like it, and why.

    class_id is the smallest id of the documents with its fingerprint. n_same others have that fingerprint
    (similarity 1), n_header its header (0.6), n_structure its structure (0.3), n_hint its hint (0.1), and the
    hint of n_contained others holds or lies in its own (0.05); these parts add up to the similarity of two
    documents. Work and rows grow with the documents and with the distinct hints that hold one another, not
    with the pairs.
    """
    g = materialize(text.generator_fingerprint(docs).select("doc_id", "g_full", "g_header", "g_structure", "g_hint"), "fingerprints")
    keys = ["g_header", "g_structure", "g_hint"]
    classes = materialize(g.groupBy("g_full", *keys).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes")
    out = classes.withColumn("n_same", F.col("n") - 1)
    for key in keys:
        sizes = classes.filter(F.col(key).isNotNull()).groupBy(key).agg((F.sum("n") - 1).alias("n_" + key[2:]))
        out = out.join(sizes, key, "left")
    by_hint = classes.filter("g_hint is not null").groupBy("g_hint").agg(F.sum("n").alias("k"))
    held = materialize(contained_hints(classes), "held")
    both = held.select(F.col("outer").alias("x"), F.col("inner").alias("g_hint")).unionByName(held.select(F.col("inner").alias("x"), F.col("outer").alias("g_hint")))
    contained = both.join(by_hint, "g_hint").groupBy(F.col("x").alias("g_hint")).agg(F.sum("k").alias("n_contained"))
    out = out.join(contained, "g_hint", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_same", "n_header", "n_structure", "n_hint", "n_contained")]
    return g.select("doc_id", "g_full").join(out.select("g_full", "class_id", *numbers), "g_full").drop("g_full")


def similar_pairs(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of all pairs that score above 0, with equal fingerprints taken together.

    Documents with one fingerprint are a class, named by its smallest id: each of them has a row with
    that id as ``a`` and similarity 1. The other rows are pairs of classes, and hold for every document
    of the one with every document of the other. A pair is taken at the first key that it has in common:
    header, structure, equal hint, contained hint.
    """
    g = materialize(text.generator_fingerprint(docs).select("doc_id", "g_full", "g_header", "g_structure", "g_hint"), "fingerprints")
    keys = ["g_full", "g_header", "g_structure"]
    classes = materialize(g.groupBy(*keys, "g_hint").agg(F.min("doc_id").alias("rep")), "classes")
    same = {k: F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in ("g_header", "g_structure")}
    pairs = _pairs(classes, "g_header", block)
    pairs = pairs.unionByName(_pairs(classes, "g_structure", block).filter(~same["g_header"]))
    apart = ~same["g_header"] & ~same["g_structure"]
    pairs = pairs.unionByName(_pairs(classes, "g_hint", block).filter(apart)).unionByName(_contained(classes).filter(apart))
    scored = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), text.similarity(_side("x"), _side("y")).alias("similarity"))
    members = g.join(classes.select("g_full", "rep"), "g_full").filter("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    return scored.unionByName(members)
