"""Give an expression a name inside another expression, so that it is computed once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``. Without this, a lambda that mentions a long expression repeats it for
    every element it visits."""
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))
