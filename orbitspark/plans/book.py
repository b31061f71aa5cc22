"""A list of queries under construction, and the rounding that both engines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Book:
    def __init__(self):
        self.found: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.found[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to 6 decimals, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as DuckDB does it, half away from zero, in plain arithmetic: F.round goes through a decimal for every value. No negative zero."""
    scale = F.lit(10.0 ** digits)
    y = F.abs(c) * scale
    up = F.rint(y) + F.when(y - F.rint(y) == 0.5, 1.0).otherwise(0.0)
    return F.when(y < float("inf"), F.signum(c) * up / scale).otherwise(c) + F.lit(0.0)


def s6(expr: str, name: str) -> str:
    """The same in SQL."""
    return f"round({expr}, 6) + 0.0::DOUBLE AS {name}"
