import datetime

import pytest
from pyspark.sql import functions as F

from peerband.operators import demand

SCHEMA = "date date, dow int, horizon_days int, event_uplift double, is_edge boolean"


def series(spark, *rows):
    return spark.createDataFrame(
        [(datetime.date.fromisoformat(d), 0, 0, u, e) for d, u, e in rows], SCHEMA)


@pytest.fixture
def detrended(spark):
    """The largest uplift lies on an edge; two dates of one window; one outside all windows."""
    return series(spark, ("2028-05-09", 0.61, True), ("2027-12-30", 0.174, False),
                  ("2027-12-29", 0.121, False), ("2028-02-08", 0.052, False),
                  ("2027-09-01", -0.03, False))


def test_context(detrended):
    row = demand.seasonal_context(detrended).first()
    assert [str(d["date"]) for d in row["top_dates"]] == [
        "2027-12-30", "2027-12-29", "2028-02-08", "2027-09-01"]
    assert [d["event_uplift"] for d in row["top_dates"]] == [0.174, 0.121, 0.052, -0.03]
    assert row["dropped_edge"] == 1 and row["magnitudes_are_lower_bounds"] is True
    assert row["events"] == {"Réveillon": 0.174, "Carnaval": 0.052}
    assert row["demand_note"] == "Seasonal demand (lower bound): Réveillon +17%, Carnaval +5%."


def test_year_wrap_only_through_january(spark):
    row = demand.seasonal_context(series(
        spark, ("2031-01-01", 0.31, False), ("2030-12-10", 0.7, False))).first()
    assert row["events"] == {"Réveillon": 0.31}


def test_unknown_edge_flag_is_kept(spark):
    row = demand.seasonal_context(series(
        spark, ("2025-06-06", 0.4, True), ("2025-08-08", 0.2, None))).first()
    assert row["dropped_edge"] == 1 and len(row["top_dates"]) == 1


def test_all_edges_leave_nothing(detrended):
    row = demand.seasonal_context(detrended.withColumn("is_edge", F.lit(True))).first()
    assert row["top_dates"] == [] and row["events"] == {} and row["dropped_edge"] == 5
    assert row["demand_note"].startswith("No strong dated demand peaks")


def test_ties_go_to_the_earlier_date(spark):
    rows = series(spark, ("2027-02-07", 0.1, False), ("2027-02-06", 0.1, False),
                  ("2027-02-09", 0.05, False))
    assert [r["date"].day for r in demand.top_dates(rows, 2).collect()] == [6, 7]
    peak = demand.event_peaks(rows).first()
    assert (peak["event"], peak["peak_date"].day) == ("Carnaval", 6)


def test_note_rounds_half_to_even(spark):
    row = demand.seasonal_context(series(spark, ("2027-02-07", 0.125, False))).first()
    assert row["demand_note"] == "Seasonal demand (lower bound): Carnaval +12%."
