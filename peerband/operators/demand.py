"""Dated demand context from the detrended calendar. Uplifts are lower bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerband.functions.buckets import in_annual_window
from peerband.params import DEFAULTS, EVENTS_NOTE_PREFIX, NO_EVENTS_NOTE, Params


def drop_edges(detrended: DataFrame) -> DataFrame:
    """Rows with a full rolling window; an unknown flag is not an edge."""
    return detrended.where(~F.coalesce(F.col("is_edge"), F.lit(False)))


def top_dates(detrended: DataFrame, n: int = 10) -> DataFrame:
    """The n dates with the highest uplift; earlier dates win ties."""
    return (
        drop_edges(detrended)
        .where(F.col("event_uplift").isNotNull())
        .orderBy(F.desc("event_uplift"), "date")
        .limit(n)
        .select("date", "dow", "horizon_days", "event_uplift")
    )


def event_days(detrended: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Dates inside an event window, once per window, with the window's place in the list."""
    windows = F.array(
        *[
            F.when(
                in_annual_window(F.col("date"), first, last),
                F.struct(F.lit(i).alias("place"), F.lit(name).alias("event")),
            )
            for i, (name, first, last) in enumerate(params.events)
        ]
    )
    return (
        drop_edges(detrended)
        .select("date", "event_uplift", F.explode(F.array_compact(windows)).alias("w"))
        .select("w.place", "w.event", "date", "event_uplift")
    )


def event_peaks(detrended: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Peak uplift of each event and its (earliest) date; absent events have no row."""
    # The latest date has the largest day number, so its negation breaks ties to the earliest.
    rank = F.struct("event_uplift", -F.datediff("date", F.to_date(F.lit("1970-01-01"))))
    return (
        event_days(detrended, params)
        .groupBy("place", "event")
        .agg(
            F.max("event_uplift").alias("event_uplift"),
            F.max_by("date", F.when(F.col("event_uplift").isNotNull(), rank)).alias("peak_date"),
        )
    )


def _note(events: Column) -> Column:
    shown = F.transform(
        events,
        lambda e: F.concat(
            e["event"],
            F.lit(" +"),
            F.bround(e["event_uplift"] * 100, 0).cast("bigint").cast("string"),
            F.lit("%"),
        ),
    )
    return F.when(F.size(events) == 0, F.lit(NO_EVENTS_NOTE)).otherwise(
        F.concat(F.lit(EVENTS_NOTE_PREFIX), F.array_join(shown, ", "), F.lit("."))
    )


def seasonal_context(detrended: DataFrame, top_n: int = 10,
                     params: Params = DEFAULTS) -> DataFrame:
    """One row: top dates, event peaks, dropped edge rows, note, lower-bound flag.

    The input has one row per date and the lists are as long as ``top_n`` and the configured
    events, so a single row holds them.
    """
    top = top_dates(detrended, top_n).agg(
        F.array_sort(
            F.collect_list(F.struct("date", "dow", "horizon_days", "event_uplift")),
            lambda a, b: F.when(a["event_uplift"] > b["event_uplift"], -1)
            .when(a["event_uplift"] < b["event_uplift"], 1)
            .when(a["date"] < b["date"], -1)
            .when(a["date"] > b["date"], 1)
            .otherwise(0),
        ).alias("v")
    )
    peaks = event_peaks(detrended, params).agg(
        F.sort_array(F.collect_list(F.struct("place", "event", "event_uplift"))).alias("v")
    )
    edges = detrended.agg(F.count_if(F.coalesce("is_edge", F.lit(False))).alias("dropped_edge"))
    return (
        edges.withColumn("top_dates", top.select("v").scalar())
        .withColumn("_events", peaks.select("v").scalar())
        .select(
            "top_dates",
            F.map_from_arrays("_events.event", "_events.event_uplift").alias("events"),
            F.lit(True).alias("magnitudes_are_lower_bounds"),
            "dropped_edge",
            _note(F.col("_events")).alias("demand_note"),
        )
    )
