"""Bucket and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerband.params import CAPACITY_BUCKETS, HORIZON_BUCKETS


def capacity_bucket(accommodates: Column, buckets=CAPACITY_BUCKETS) -> Column:
    """Right-closed guest-count bucket; NULL outside all of them."""
    label = None
    for name, above, up_to in buckets:
        inside = (accommodates > above) & (accommodates <= up_to)
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return label


def horizon_bucket(days: Column, buckets=HORIZON_BUCKETS) -> Column:
    label = None
    for name, start, stop in buckets:
        inside = (days >= start) & (days < stop)
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return label


def in_annual_window(date: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """Whether a date falls in a (month, day) window of any year, wrapping past December."""
    day_of_year = F.month(date) * 100 + F.dayofmonth(date)
    after = day_of_year >= first[0] * 100 + first[1]
    before = day_of_year <= last[0] * 100 + last[1]
    return (after | before) if first[0] > last[0] else (after & before)


def quoted(name: str) -> Column:
    """Reference a column whose name may hold spaces, dots or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")
