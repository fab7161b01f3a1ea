import datetime

from pyspark.sql import functions as F

from peerband.functions import geo
from peerband.functions.buckets import capacity_bucket, in_annual_window
from peerband.params import POINTS_OF_INTEREST


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_haversine(spark):
    assert one(spark, geo.haversine_km(-22.97, -43.18, -22.97, -43.18)) == 0.0
    assert 1.5 < one(spark, geo.haversine_km(-22.9869, -43.2045, -22.9711, -43.1822)) < 4.0
    quarter = one(spark, geo.haversine_km(0.0, 0.0, 0.0, 90.0))
    assert abs(quarter - 6371.0 * 3.141592653589793 / 2) < 1e-9


def test_nearest(spark):
    def near(lat, lon):
        return one(spark, geo.nearest_point(F.lit(lat), F.lit(lon), POINTS_OF_INTEREST))

    assert near(-22.9711, -43.1822)["name"] == "Copacabana"
    assert near(-22.9711, -43.1822)["km"] < 0.5
    assert near(-22.95, -43.28)["km"] > near(-22.9711, -43.1822)["km"]
    missing = F.lit(None).cast("double")
    assert one(spark, geo.nearest_km(missing, missing, POINTS_OF_INTEREST)) is None
    assert one(spark, geo.nearest_point(missing, missing, POINTS_OF_INTEREST)) is None
    assert one(spark, geo.nearest_km(0.0, 0.0, [("here", 0.0, 0.0)])) == 0.0


def test_capacity_buckets_are_right_closed(spark):
    guests = [0.0, 1.0, 2.0, 2.5, 4.0, 5.0, 6.0, 7.0, 999.0, 1000.0, None]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(guests)], "i int, g double")
    got = [r["b"] for r in rows.select("i", capacity_bucket(F.col("g")).alias("b"))
           .orderBy("i").collect()]
    assert got == [None, "1-2", "1-2", "3-4", "3-4", "5-6", "5-6", "7+", "7+", None, None]


def test_window_wraps_the_year(spark):
    def inside(day):
        return one(spark, in_annual_window(F.lit(day), (12, 28), (1, 2)))

    assert inside(datetime.date(2027, 1, 1)) and inside(datetime.date(2026, 12, 28))
    assert not inside(datetime.date(2026, 12, 27)) and not inside(datetime.date(2027, 1, 3))
