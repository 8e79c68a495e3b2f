"""Name an intermediate value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    A Python variable only copies the expression; inside conditional branches those
    copies are not shared by common subexpression elimination.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
