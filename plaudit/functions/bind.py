"""Evaluate once, use many times.

Catalyst merges neighbouring projections, and a column used inside a lambda is then re-evaluated
for every element.  These two helpers keep an intermediate value computed once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value bound to a lambda variable."""
    return F.transform(F.array(value), body)[0]


def is_in(members: Iterable[str]) -> Callable[[Column], Column]:
    """A lambda that tests an element for membership in a literal set."""
    values = list(members)
    return lambda element: element.isin(values)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, fixed by a one-element generator that projections stop at."""
    return df.select(
        *df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    )
