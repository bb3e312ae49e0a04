"""Helpers for building expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Millivolts beyond which no reading of a heart's signal can be.
BOUND = 50.0


def sound(value: str | Column, bound: float | None = BOUND) -> Column:
    """The value if it is a number within ``bound`` (none: any finite one), else null.

    Operators along a channel read it so: a reading that cannot be keeps its place and counts as missing.
    """
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v) & (F.abs(v) <= bound if bound is not None else F.abs(v) < float("inf")), v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once per row.

    A column added before is put in place of its name wherever it is used, also inside a lambda that runs once per
    element; a lambda's own variable is not.
    """
    return F.transform(F.array(value), body)[0]
