"""Curated listings from raw text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerband.functions import geo, parse
from peerband.operators.distribution import exact_quantiles
from peerband.params import DEFAULTS, Params

OPTIONAL_COLUMNS = ("estimated_occupancy_l365d", "estimated_revenue_l365d")


def winsorize(df: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    """Clip a column to its own exact linear-interpolated quantiles."""
    value = F.col(column)
    limits = exact_quantiles(df, [], value, {"lo": lower, "hi": upper})
    # One row by construction, so it is read back as a scalar rather than joined.
    bound = limits.select(F.struct("lo", "hi")).scalar()
    clipped = F.least(F.greatest(value, bound.getField("lo")), bound.getField("hi"))
    return df.withColumn(column, F.when(value.isNotNull(), clipped))


def typed_listings(raw: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Rename, parse and derive; no rows dropped."""

    # Both are used by every point of interest, and are parsed once before.
    raw = raw.withColumns(
        {"_lat": parse.to_double("latitude"), "_lon": parse.to_double("longitude")}
    )

    def whole(name: str) -> Column:
        return parse.to_whole(F.col(name), name)

    return raw.select(
        parse.to_key(F.col("id"), "id").alias("listing_id"),
        parse.blank_to_null("neighbourhood_cleansed").alias("neighbourhood"),
        parse.blank_to_null("room_type").alias("room_type"),
        F.col("property_type").cast("string").alias("property_type"),
        whole("accommodates").alias("accommodates"),
        whole("bedrooms").alias("bedrooms"),
        whole("beds").alias("beds"),
        parse.bathrooms("bathrooms_text").alias("bathrooms_num"),
        parse.money("price").alias("price"),
        geo.nearest_km(F.col("_lat"), F.col("_lon"), params.points).alias("distance_to_beach_km"),
        whole("minimum_nights").alias("min_nights"),
        parse.flag("host_is_superhost").alias("host_is_superhost"),
        parse.flag("instant_bookable").alias("instant_bookable"),
        F.col("host_response_time").cast("string").alias("host_response_time"),
        parse.percent("host_response_rate").alias("host_response_rate"),
        parse.percent("host_acceptance_rate").alias("host_acceptance_rate"),
        whole("number_of_reviews").alias("number_of_reviews"),
        whole("number_of_reviews_ltm").alias("number_of_reviews_ltm"),
        parse.to_double("reviews_per_month").alias("reviews_per_month"),
        parse.to_double("review_scores_rating").alias("review_scores_rating"),
        whole("availability_365").alias("availability_365"),
        parse.to_date("last_review").alias("last_review"),
        parse.to_date("first_review").alias("first_review"),
        *[parse.to_double(c).alias(c) for c in OPTIONAL_COLUMNS if c in raw.columns],
    )


def analyzable(listings: DataFrame) -> DataFrame:
    """Rows with a positive price and both comparison keys."""
    return listings.where(
        (F.col("price") > 0)
        & F.col("neighbourhood").isNotNull()
        & F.col("room_type").isNotNull()
    )


def curate_listings(raw: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Typed, filtered, then clipped to the quantiles of the rows that were kept."""
    kept = analyzable(typed_listings(raw, params))
    return winsorize(
        kept, "price", params.winsor_lower, params.winsor_upper
    )
