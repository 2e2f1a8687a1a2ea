"""Values named once: inside a column expression, or as a column of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it.

    Without it each mention repeats the value's whole expression, and expressions that build on one
    another grow with the product of their mentions. The body must name the value itself, also in lambdas
    over arrays: an expression in a lambda is computed for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns whose values are computed once, whatever is built on them.

    Exploding an array of one keeps Spark from writing an expression out at each of its mentions, and
    lambdas over the column find a value instead of computing it for every element. Values that nobody
    reads are computed too.
    """
    fields = F.struct(*(v.alias(k) for k, v in values.items()))
    kept = [c for c in df.columns if c not in values]
    return df.select(*kept, F.explode(F.array(fields)).alias("_bound")).select(*kept, *(F.col(f"_bound.{k}").alias(k) for k in values))
