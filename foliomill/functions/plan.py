"""Helpers that keep costly expressions from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with computed columns that later filters and projections refer to by name.

    A filter on an ordinary computed column is rewritten in terms of its expression and evaluated
    below it as well; chained columns then multiply.  A one-row generator stops that rewriting, so
    each expression is computed once per row.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.stack(F.lit(1), *columns.values()).alias(*columns))
