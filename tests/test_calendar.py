import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from peerband.operators import calendar as cal


SCHEMA = "listing_id string, date string, available string"


def days_of(spark, shares, rooms=20, first="2024-12-30"):
    """A calendar where day ``d`` has the share ``shares[d]`` of ``rooms`` listings taken."""
    begin = datetime.date.fromisoformat(first)
    return spark.createDataFrame(
        [(f"{room}", str(begin + datetime.timedelta(days=d)),
          "f" if room < round(share * rooms) else "t")
         for d, share in enumerate(shares) for room in range(rooms)], SCHEMA)


def test_booked_rate_and_price(raw_calendar):
    cube = cal.calendar_cube(raw_calendar)
    assert cube.columns == ["listing_id", "month", "dow", "median_cal_price", "booked_rate"]
    got = {(r["listing_id"], r["dow"]): (r["month"], r["median_cal_price"], r["booked_rate"])
           for r in cube.collect()}
    # 3 March 2025 was a Monday.
    assert got[11, 1] == (3, 310.0, 1.0) and got[11, 4] == (3, 310.0, 0.0)
    assert got[12, 0] == (3, 90.0, 1.0) and len(got) == 14
    booked = {r["listing_id"]: r["booked_rate"] for r in
              cal.booked_rate_by_listing(cube).collect()}
    assert booked == {11: pytest.approx(4 / 7), 12: pytest.approx(1 / 7)}


def test_price_column_is_optional_and_found_in_any_case(raw_calendar):
    plain = cal.calendar_cube(raw_calendar.drop("price"))
    assert {r["median_cal_price"] for r in plain.collect()} == {None}
    assert plain.agg(F.sum("booked_rate")).first()[0] == pytest.approx(5.0)
    renamed = cal.calendar_cube(raw_calendar.withColumnRenamed("price", "Price"))
    assert {r["median_cal_price"] for r in renamed.collect()} == {310.0, 90.0}


def test_cube_is_one_exchange(raw_calendar):
    plan = cal.calendar_cube(raw_calendar)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


@pytest.mark.parametrize("prices,median", [((10, 40), 25.0), ((7, 1, 3), 3.0), ((5, 5, 5, 9), 5.0)])
def test_median_of_a_cell(spark, prices, median):
    rows = [("3", f"2025-01-{6 + 7 * i:02d}", "t", f"${p}") for i, p in enumerate(prices)]
    got = cal.calendar_cube(spark.createDataFrame(rows, f"{SCHEMA}, price string")).first()
    assert (got["month"], got["dow"], got["median_cal_price"]) == (1, 1, median)


def test_unpriced_days_still_count(spark):
    rows = [("1", "2026-01-05", "f", None), ("1", "2026-01-12", "t", "$10"),
            ("1", "2026-01-19", None, "$30")]
    row = cal.calendar_cube(
        spark.createDataFrame(rows, "listing_id string, date string, available string, price string")
    ).first()
    assert row["median_cal_price"] == 20.0
    assert row["booked_rate"] == pytest.approx(1 / 3)


def test_bad_calendar_text_fails(spark):
    rows = spark.createDataFrame([("1", "2026-01-05", "f", "free")],
                                 "listing_id string, date string, available string, price string")
    with pytest.raises(PySparkException, match="not a price"):
        cal.calendar_cube(rows).collect()


def test_one_row_a_date_with_its_distance_from_the_snapshot(spark):
    out = cal.detrend(days_of(spark, [0.0, 0.5, 1.0, 0.25]), "2025-01-01", window=3)
    rows = [tuple(r) for r in out.orderBy("date").select(
        "date", "dow", "horizon_days", "unavail_rate", "is_edge").collect()]
    day = datetime.date(2024, 12, 30)
    assert rows == [(day + datetime.timedelta(d), (1 + d) % 7, d - 2, rate, d in (0, 3))
                    for d, rate in enumerate([0.0, 0.5, 1.0, 0.25])]


def test_uplift_is_the_distance_to_the_rolling_mean(spark):
    shares = [0.05 * ((7 * d) % 13) for d in range(40)]
    out = cal.detrend(days_of(spark, shares), "2025-01-01", window=9).orderBy("date").collect()
    for d, row in enumerate(out):
        near = shares[max(0, d - 4):d + 5]
        assert row["baseline"] == pytest.approx(sum(near) / len(near))
        assert row["event_uplift"] == pytest.approx(shares[d] - sum(near) / len(near))


@pytest.mark.parametrize("window,half", [(6, 3), (7, 3), (1, 0)])
def test_edges_count_rows(spark, window, half):
    out = cal.detrend(days_of(spark, [0.5] * 12, rooms=2), "2025-01-01", window=window)
    flags = [r["is_edge"] for r in out.orderBy("date").collect()]
    assert flags == [d < half or d >= 12 - half for d in range(12)]


def test_markets_are_detrended_apart(spark):
    north = days_of(spark, [0.2] * 6).withColumn("city", F.lit("north"))
    south = days_of(spark, [0.8] * 9).withColumn("city", F.lit("south"))
    out = cal.detrend(north.unionByName(south), "2025-01-01", window=5, market=["city"])
    got = {(r["city"], round(r["baseline"], 9)) for r in out.collect()}
    assert got == {("north", 0.2), ("south", 0.8)} and out.count() == 15


@pytest.mark.parametrize("bad", ["2026-01-01'; DROP", "2026-1-1", "2026-02-31", None])
def test_bad_snapshot_date(spark, bad):
    with pytest.raises(ValueError):
        cal.detrend(days_of(spark, [0.5]), bad)
