"""Calendar aggregates and the detrended market series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerband.functions import parse
from peerband.params import DEFAULTS
from peerband.sources.raw import check_snapshot_date


def day_of_week(date: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return (F.dayofweek(date) - 1).cast("bigint")


def _column(df: DataFrame, name: str) -> str | None:
    return next((c for c in df.columns if c.lower() == name), None)


def calendar_cube(calendar: DataFrame) -> DataFrame:
    """Median price and unavailable share per (listing_id, month, dow).

    All days count towards ``booked_rate``, priced or not; an unknown availability counts as
    available. Without a price column the median is NULL. A cell holds the days of one listing,
    month and weekday, so its exact median needs no splitting and all is one aggregate.
    """
    keys = ["listing_id", "month", "dow"]
    price = _column(calendar, "price")
    date = parse.typed(calendar, "date", parse.date_strict, T.DateType)
    listing = parse.typed(calendar, "listing_id", parse.bigint_strict, T.LongType)
    days = calendar.select(
        listing.alias("listing_id"),
        F.month(date).cast("bigint").alias("month"),
        day_of_week(date).alias("dow"),
        F.when(F.col("available") == "f", 1).otherwise(0).alias("_busy"),
        *(
            [parse.typed(calendar, price, parse.money_strict, T.DoubleType).alias("value")]
            if price
            else []
        ),
    )
    median = F.median("value") if price else F.lit(None).cast("double")
    return days.groupBy(*keys).agg(
        median.alias("median_cal_price"), F.avg("_busy").alias("booked_rate")
    )


def daily_unavailability(calendar: DataFrame, snapshot_date: str,
                         market: Sequence[str] = ()) -> DataFrame:
    """Unavailable share per date, with days since the snapshot (negative before it)."""
    check_snapshot_date(snapshot_date)
    return (
        calendar.select(
            *market,
            parse.typed(calendar, "date", parse.date_strict, T.DateType).alias("date"),
            F.when(F.col("available") == "f", 1).otherwise(0).alias("_busy"),
        )
        .groupBy(*market, "date")
        .agg(F.avg("_busy").alias("unavail_rate"))
        .withColumn(
            "horizon_days",
            F.datediff("date", F.to_date(F.lit(snapshot_date))).cast("bigint"),
        )
    )


def detrend(calendar: DataFrame, snapshot_date: str, window: int = DEFAULTS.rolling_window,
            market: Sequence[str] = ()) -> DataFrame:
    """Unavailability less its centred rolling mean, one row per date (and market).

    The rolling frame counts rows, not days. The calendar is first collapsed to one row per
    date, so the window's input is bounded by the number of calendar dates however many
    listings there are.
    """
    half = int(window) // 2
    daily = daily_unavailability(calendar, snapshot_date, market)
    series = Window.partitionBy(*market) if market else Window.partitionBy(F.lit(0))
    by_date = series.orderBy("date")
    baseline = F.avg("unavail_rate").over(by_date.rowsBetween(-half, half))
    row = F.row_number().over(by_date)
    rows = F.count(F.lit(1)).over(series)
    return daily.select(
        *market,
        "date",
        day_of_week(F.col("date")).alias("dow"),
        "horizon_days",
        "unavail_rate",
        baseline.alias("baseline"),
        (F.col("unavail_rate") - baseline).alias("event_uplift"),
        ((row <= half) | (row > rows - half)).alias("is_edge"),
    )


def booked_rate_by_listing(cube: DataFrame) -> DataFrame:
    """Unweighted mean of a listing's cells (each month and weekday counts the same)."""
    return cube.groupBy("listing_id").agg(F.avg("booked_rate").alias("booked_rate"))
