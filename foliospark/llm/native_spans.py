"""Positions of regex matches with built-in SQL functions only.

Spark has no function that returns every match together with its offset. The pieces between the
matches (``split``) and the matches (``regexp_extract_all``) alternate, so the offsets are running
sums of their lengths; ``length`` counts code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def _exclusive_sums(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array, in blocks, so that no array grows element by element beyond a block."""

    def scan(values: Column, seed: Column) -> Column:
        start = F.struct(seed.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            values,
            start,
            lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    n_blocks = F.ceil(F.size(lengths) / F.lit(_BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v))
    return F.flatten(F.zip_with(blocks, scan(totals, F.lit(0)), scan))


def match_spans(text: Column, pattern: str, kind: str, order: int, accept=None, gate: Column | None = None, context: int = 0) -> Column:
    """array<struct<start, ord, end, kind>> of the leftmost non-overlapping matches that ``accept`` keeps.

    ``pattern`` must not match the empty string. ``gate`` is a cheap test without which no match can
    exist. Dropped matches still consume their text. With ``context`` the structs also hold the match
    and that many characters before and after it (m, before, after).
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def spans(m: Column) -> Column:
        # piece i + match i, for i below the number of matches; the start is what precedes plus the piece
        n = F.size(m)
        pieces = F.transform(F.slice(between, F.lit(1), n), lambda p: F.length(p))
        steps = F.zip_with(pieces, m, lambda p, x: p + F.length(x))
        rows = F.arrays_zip(_exclusive_sums(steps).alias("at"), pieces.alias("gap"), m.alias("m"))
        out = F.transform(
            rows,
            lambda r: F.struct(
                (r["at"] + r["gap"]).cast("long").alias("start"),
                F.lit(order).alias("ord"),
                (r["at"] + r["gap"] + F.length(r["m"])).cast("long").alias("end"),
                F.lit(kind).alias("kind"),
                r["m"].alias("m"),
            ),
        )
        kept = F.filter(out, lambda s: accept(s["m"])) if accept else out
        if context:
            return F.transform(
                kept,
                lambda s: F.struct(
                    s["start"], s["ord"], s["end"], s["kind"], s["m"],
                    F.substring(text, F.greatest(s["start"] - context, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(context)).cast("int")).alias("before"),
                    F.substring(text, s["end"].cast("int") + 1, F.lit(context)).alias("after"),
                ),
            )
        return F.transform(kept, lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"]))

    extra = ",m:string,before:string,after:string" if context else ""
    empty = F.array().cast(f"array<struct<start:bigint,ord:int,end:bigint,kind:string{extra}>>")
    some = F.when(F.size(found) > 0, spans(found)).otherwise(empty)
    return F.when(gate, some).otherwise(empty) if gate is not None else some


def render(spans: Column, by_kind: bool = False) -> Column:
    """``kind:start:end`` joined by commas, by start then kind order, or by kind order then start."""
    if by_kind:
        spans = F.transform(spans, lambda s: F.struct(s["ord"], s["start"], s["end"], s["kind"]))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
