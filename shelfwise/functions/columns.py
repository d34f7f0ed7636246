"""Named intermediate columns that are computed exactly once.

The optimizer merges stacked projections and moves filters below them by
copying the expressions they use.  For deep expressions that multiplies work.
``let`` puts a one-element ``inline`` between: a row-wise step that stays in
the same code-generated stage and is never copied through.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns, each evaluated once per row whatever follows."""
    kept = [c for c in df.columns if c not in columns]
    packed = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*kept, packed)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, for places inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)
