"""Naming a value within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often, or in whatever lambda, the body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def once(value: Column) -> Column:
    """A generator of one row for use in a select: ``value``, made once.

    Filters on its result are not pushed below it, where they would make it a second time.
    """
    return F.explode_outer(F.array(value))
