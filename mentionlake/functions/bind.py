"""Binding a computed value once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is used. Elsewhere, and in lambdas, each use of an expression computes it again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
