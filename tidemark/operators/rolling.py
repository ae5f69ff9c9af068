"""Guarded rolling windows: a value only where the frame is full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window as W, functions as F


class Frame:
    """Row frames inside a segment."""

    def __init__(self, *key: str, order: str = "open_us"):
        self.by = W.partitionBy(*key).orderBy(order)

    def roll(self, f: Callable[[Column], Column], c: str | Column, n: int, back: int = 0) -> Column:
        """f over the n rows that end `back` rows ago."""
        c = F.col(c) if isinstance(c, str) else c
        w = self.by.rowsBetween(-(n - 1) - back, -back)
        return F.when(F.count(c).over(w) == n, f(c).over(w))

    def ahead(self, f: Callable[[Column], Column], c: str | Column, first: int, last: int) -> Column:
        """f over rows first..last after this one."""
        c = F.col(c) if isinstance(c, str) else c
        w = self.by.rowsBetween(first, last)
        return F.when(F.count(c).over(w) == last - first + 1, f(c).over(w))

    def lag(self, c: str | Column, n: int) -> Column:
        return F.lag(c, n).over(self.by)

    def lead(self, c: str | Column, n: int) -> Column:
        return F.lead(c, n).over(self.by)


def ratio(a: Column, b: Column, otherwise: float) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(otherwise))
