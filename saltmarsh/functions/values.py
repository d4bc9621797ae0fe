"""Naming of intermediate values inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A column that is used several times in a later expression, or that a filter
    pushes below its projection, is otherwise computed again at every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(value: Column) -> Column:
    """Null for the empty string, the value computed once."""
    return let(value, lambda v: F.when(v != "", v))


def rest(array: Column) -> Column:
    """The array without its first element."""
    return F.slice(array, F.lit(2), F.size(array))
