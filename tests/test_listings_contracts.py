import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from peerband.operators import contracts
from peerband.operators.listings import curate_listings, typed_listings
from tests.conftest import RAW_COLUMNS, RAW_ROWS, raw_frame


def row(**changes):
    base = dict(zip(RAW_COLUMNS, RAW_ROWS[0]))
    base.update(changes)
    return tuple(base[c] for c in RAW_COLUMNS)


def test_types_filter_and_winsor(raw_listings):
    out = {r["listing_id"]: r for r in curate_listings(raw_listings).collect()}
    assert set(out) == {11, 12, 13}
    # Three prices: the window ends 2 % of the way from either end to the middle one.
    assert out[11]["price"] == pytest.approx(310.5)
    assert out[12]["price"] == pytest.approx(96 + 0.02 * (310.5 - 96))
    assert out[13]["price"] == pytest.approx(2750 - 0.02 * (2750 - 310.5))
    assert [out[i]["bathrooms_num"] for i in (11, 12, 13)] == [2.0, 1.5, 0.5]
    assert out[12]["host_response_rate"] == 0.85 and out[12]["host_acceptance_rate"] == 0.4
    assert out[13]["host_response_rate"] is None and out[13]["last_review"] is None
    assert (out[11]["instant_bookable"], out[12]["instant_bookable"]) == (True, False)
    assert out[11]["first_review"].isoformat() == "2020-02-29" and out[11]["bedrooms"] == 2


def test_column_set(raw_listings):
    assert len(curate_listings(raw_listings).columns) == 23
    extra = raw_listings.withColumn("estimated_occupancy_l365d", F.lit("61.5"))
    out = curate_listings(extra)
    assert out.columns[-1] == "estimated_occupancy_l365d"
    assert {r[0] for r in out.select("estimated_occupancy_l365d").collect()} == {61.5}


def test_rows_without_keys_or_price_are_dropped(spark):
    rows = [row(id="1"), row(id="2", neighbourhood_cleansed=""), row(id="3", room_type=None),
            row(id="4", price="$0.00"), row(id="5", price="$-5.00"), row(id="6", price="n/a")]
    assert [r["listing_id"] for r in curate_listings(raw_frame(spark, rows)).collect()] == [1]
    assert typed_listings(raw_frame(spark, rows)).count() == 6


def test_distance(spark):
    rows = [row(id="1", latitude="-22.9711", longitude="-43.1822"),
            row(id="2", latitude="-22.9500", longitude="-43.2800"), row(id="3", latitude=None)]
    out = {r["listing_id"]: r["distance_to_beach_km"] for r in
           curate_listings(raw_frame(spark, rows)).collect()}
    assert out[1] < 0.5 < out[2] and out[3] is None


def test_missing_key_fails(spark):
    with pytest.raises(PySparkException, match="id is not a number"):
        curate_listings(raw_frame(spark, [row(id=None)])).collect()


def test_valid_listings_pass_with_and_without_distance(raw_listings):
    out = curate_listings(raw_listings)
    assert contracts.validate_listings(out).count() == 3
    contracts.validate_listings(out.drop("distance_to_beach_km"))
    contracts.validate_listings(out.withColumn("another", F.lit(1)))


@pytest.mark.parametrize("column, value, rule", [
    ("price", -0.01, "price > 0"),
    ("price", float("nan"), "price not null"),
    ("price", None, "price not null"),
    ("distance_to_beach_km", -1.0, "distance_to_beach_km >= 0"),
    ("review_scores_rating", 5.5, "review_scores_rating <= 5"),
    ("neighbourhood", None, "neighbourhood not null"),
])
def test_broken_listings_fail(raw_listings, column, value, rule):
    out = curate_listings(raw_listings)
    kind = out.schema[column].dataType
    broken = out.withColumn(
        column, F.when(F.col("listing_id") == 11, F.lit(value).cast(kind)).otherwise(F.col(column))
    )
    with pytest.raises(contracts.ContractError, match=rule):
        contracts.validate_listings(broken)


def test_duplicates_and_missing_columns_fail(spark, raw_listings):
    out = curate_listings(raw_listings)
    with pytest.raises(contracts.ContractError, match="unique listing_id"):
        contracts.validate_listings(out.unionByName(out.limit(1)))
    with pytest.raises(contracts.ContractError, match="missing column"):
        contracts.validate_listings(out.drop("price"))
    seasonal = spark.createDataFrame(
        [(77, 12, 0, None, 0.125), (77, 12, 0, 64.5, 0.875)],
        "listing_id int, month int, dow int, median_cal_price double, booked_rate double")
    with pytest.raises(contracts.ContractError, match="unique listing_id, month, dow"):
        contracts.validate_seasonality(seasonal)
    assert contracts.validate_seasonality(seasonal.limit(1)).schema["month"].dataType.typeName() \
        == "long"


def test_occupancy_contract(spark):
    schema = "listing_id long, occupancy_est double"
    edges = spark.createDataFrame([(8, 0.0), (9, 1.0), (10, 0.0625)], schema)
    assert contracts.validate_occupancy(edges).count() == 3
    for share, rule in ((1.0000001, "<= 1"), (-0.0000001, ">= 0"), (None, "not null")):
        with pytest.raises(contracts.ContractError, match=f"occupancy_est {rule}"):
            contracts.validate_occupancy(edges.union(spark.createDataFrame([(11, share)], schema)))


@pytest.mark.parametrize("column, value", [("unavail_rate", 1.5), ("event_uplift", -1.5)])
def test_detrended_contract(spark, column, value):
    good = spark.createDataFrame(
        [("2026-01-01", 4, -89, 0.0, 0.25, -0.25, True),
         ("2026-01-02", 5, -88, 0.5, 0.30, 0.20, False)],
        "date string, dow int, horizon_days int, unavail_rate double, baseline double,"
        " event_uplift double, is_edge boolean")
    assert contracts.validate_detrended(good).count() == 2
    with pytest.raises(contracts.ContractError, match=column):
        contracts.validate_detrended(good.withColumn(column, F.lit(value)))
    with pytest.raises(contracts.ContractError, match="unique date"):
        contracts.validate_detrended(good.unionByName(good))
