"""Range bounds on keys: included, excluded or unbounded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """A key and whether it belongs to the range; key None: unbounded."""

    key: str | None = None
    inclusive: bool = True


UNBOUNDED = Bound()


def included(key: str) -> Bound:
    return Bound(key)


def excluded(key: str) -> Bound:
    return Bound(key, False)


def in_range(column: Column, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> Column:
    """The predicate of a range; it reaches the Parquet scan."""
    out = F.lit(True)
    if start.key is not None:
        out = out & (column >= start.key if start.inclusive else column > start.key)
    if end.key is not None:
        out = out & (column <= end.key if end.inclusive else column < end.key)
    return out


def may_hold(smallest: str, largest: str, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> bool:
    """Whether a file of keys from smallest to largest can have a key in the range."""
    low = start.key is None or largest.encode() > start.key.encode() or (start.inclusive and largest == start.key)
    high = end.key is None or smallest.encode() < end.key.encode() or (end.inclusive and smallest == end.key)
    return low and high


def overlaps(smallest: Column, largest: Column, low: Column, high: Column, low_inclusive: Column | bool = True, high_inclusive: Column | bool = True) -> Column:
    """Interval overlap with open or closed query bounds; a null bound is unbounded."""
    closed_low, closed_high = F.lit(low_inclusive) if isinstance(low_inclusive, bool) else low_inclusive, F.lit(high_inclusive) if isinstance(high_inclusive, bool) else high_inclusive
    after = low.isNull() | (largest > low) | (closed_low & (largest == low))
    before = high.isNull() | (smallest < high) | (closed_high & (smallest == high))
    return after & before
