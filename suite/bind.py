"""The star-schema tables seen as listings, calendars and requests.

Every binding is a projection of whole tables; nothing is sampled or synthesised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar(spark: SparkSession, sf_dir: str, priced: bool = False) -> DataFrame:
    """One listing-day per line item; returned items stand for unavailable days."""
    price = [F.col("l_extendedprice").alias("price")] if priced else []
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("listing_id"),
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_returnflag") == "R", "f").otherwise("t").alias("available"),
        *price,
    )


def _whole(expression: str):
    return F.expr(f"cast({expression} as bigint)")


def listings(spark: SparkSession, sf_dir: str, located: bool = True) -> DataFrame:
    """One listing per order, located by its customer's nation.

    Customers are keyed uniquely, and nations are joined to customers first so that the orders
    are joined once.
    """
    homes = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "c_mktsegment", "n_name")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"
    )
    joined = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    km = [F.expr("cast((o_orderkey * 7919) % 1000 as double) / 50.0").alias(
        "distance_to_beach_km")] if located else []
    return joined.select(
        F.col("o_orderkey").alias("listing_id"),
        F.col("o_totalprice").alias("price"),
        F.col("n_name").alias("neighbourhood"),
        F.col("c_mktsegment").alias("room_type"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("property_type"),
        _whole("1 + o_orderkey % 8").alias("accommodates"),
        F.expr("case when o_orderkey % 17 = 0 then null else 1 + (o_orderkey * 31) % 4 end")
        .cast("bigint").alias("bedrooms"),
        F.expr("case when o_orderkey % 13 = 0 then null "
               "else (1 + (o_orderkey * 17) % 5) / 2.0 end").cast("double").alias("bathrooms_num"),
        _whole("1 + (o_orderkey * 13) % 30").alias("min_nights"),
        F.expr("case when o_orderkey % 11 = 0 then null else (o_orderkey * 3) % 7 < 3 end")
        .alias("host_is_superhost"),
        F.expr("case when o_orderkey % 19 = 0 then null else (o_orderkey * 5) % 9 * 4 end")
        .cast("bigint").alias("number_of_reviews"),
        F.expr("case when o_orderkey % 23 = 0 then null else (o_orderkey * 5) % 41 end")
        .cast("bigint").alias("number_of_reviews_ltm"),
        *km,
    )


# The same binding for the reference SQL.
LISTINGS_SQL = """
listings AS (
  SELECT o_orderkey AS listing_id, o_totalprice AS price, n_name AS neighbourhood,
    c_mktsegment AS room_type, o_orderstatus || ' ' || o_orderpriority AS property_type,
    CAST(1 + o_orderkey % 8 AS BIGINT) AS accommodates,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL
      ELSE CAST(1 + (o_orderkey * 31) % 4 AS BIGINT) END AS bedrooms,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL
      ELSE CAST((1 + (o_orderkey * 17) % 5) / 2.0 AS DOUBLE) END AS bathrooms_num,
    CAST(1 + (o_orderkey * 13) % 30 AS BIGINT) AS min_nights,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 3) % 7 < 3 END
      AS host_is_superhost,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL
      ELSE CAST((o_orderkey * 5) % 9 * 4 AS BIGINT) END AS number_of_reviews,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL
      ELSE CAST((o_orderkey * 5) % 41 AS BIGINT) END AS number_of_reviews_ltm,
    CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 50.0 AS distance_to_beach_km
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

CALENDAR_SQL = """
calendar AS (
  SELECT l_suppkey AS listing_id, CAST(l_shipdate AS DATE) AS date,
    CASE WHEN l_returnflag = 'R' THEN 'f' ELSE 't' END AS available,
    l_extendedprice AS price
  FROM lineitem
)"""


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written out in the text encodings of a dump (negative balances stay in)."""
    base = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = "c_custkey"
    return base.select(
        F.col(key).cast("string").alias("id"),
        F.expr(f"case when {key} % 29 = 0 then '' else n_name end").alias("neighbourhood_cleansed"),
        F.expr(f"case when {key} % 31 = 0 then '' else c_mktsegment end").alias("room_type"),
        F.concat(F.lit("Home "), F.expr(f"cast({key} % 12 as string)")).alias("property_type"),
        F.expr(f"cast(1 + {key} % 9 as string)").alias("accommodates"),
        F.expr(f"concat(cast(1 + {key} % 4 as string), '.0')").alias("bedrooms"),
        F.expr(f"case when {key} % 7 = 0 then '' else cast(1 + {key} % 5 as string) end")
        .alias("beds"),
        F.expr(
            f"case {key} % 5 when 0 then '1 bath' when 1 then '1.5 shared baths' "
            "when 2 then 'Half-bath' when 3 then 'Shared half-bath' else '' end"
        ).alias("bathrooms_text"),
        F.concat(F.lit("$"), F.format_number("c_acctbal", 2)).alias("price"),
        F.expr(f"cast(-22.9 - cast({key} % 100 as double) / 500.0 as string)").alias("latitude"),
        F.expr(f"cast(-43.1 - cast(({key} * 7) % 100 as double) / 200.0 as string)")
        .alias("longitude"),
        F.expr(f"cast(1 + {key} % 28 as string)").alias("minimum_nights"),
        F.expr(f"case {key} % 3 when 0 then 't' when 1 then 'f' else '' end")
        .alias("host_is_superhost"),
        F.expr(f"case {key} % 4 when 0 then 't' when 1 then 'f' else 'T' end")
        .alias("instant_bookable"),
        F.expr(f"element_at(array('within an hour', 'within a day', '', 'N/A'), cast(1 + {key} % 4 as int))")
        .alias("host_response_time"),
        F.expr(f"case when {key} % 6 = 0 then 'N/A' else concat(cast({key} % 101 as string), '%')"
               " end").alias("host_response_rate"),
        F.expr(f"concat(cast({key} % 100 as string), '%')").alias("host_acceptance_rate"),
        F.expr(f"cast({key} % 50 as string)").alias("number_of_reviews"),
        F.expr(f"cast({key} % 20 as string)").alias("number_of_reviews_ltm"),
        F.expr(f"cast(cast({key} % 37 as double) / 8.0 as string)").alias("reviews_per_month"),
        F.expr(f"cast(3.0 + cast({key} % 9 as double) / 8.0 as string)")
        .alias("review_scores_rating"),
        F.expr(f"cast({key} % 366 as string)").alias("availability_365"),
        F.expr(f"case when {key} % 10 = 0 then 'never' else "
               f"date_format(date_add(date'2024-01-01', cast({key} % 400 as int)), 'yyyy-MM-dd')"
               " end").alias("last_review"),
        # Days with a time, impossible days, and text after a day, which is no date.
        F.expr(f"case when {key} % 11 = 0 then '2019-02-30' when {key} % 11 = 1 then "
               f"concat(date_format(date_add(date'2015-03-01', cast({key} % 900 as int)), "
               f"'yyyy-MM-dd'), ' or so') when {key} % 11 = 2 then '' else "
               f"concat(date_format(date_add(date'2015-03-01', cast({key} % 900 as int)), "
               f"'yyyy-MM-dd'), if({key} % 2 = 0, 'T10:30:00', '')) end").alias("first_review"),
        F.expr(f"cast({key} % 200 as string)").alias("estimated_occupancy_l365d"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advice request per line item, keyed by order and part; some keys are unknown."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("request_id"),
        F.expr("case when l_partkey % 37 = 0 then 'Nowhere' when l_partkey % 41 = 0 then null "
               "else concat('NATION_', cast(l_suppkey % 25 as string)) end").alias("neighbourhood"),
        F.expr("case when l_partkey % 43 = 0 then 'Treehouse' "
               "else element_at(array('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD',"
               "'MACHINERY'), cast(1 + l_suppkey % 5 as int)) end").alias("room_type"),
        F.expr("case when l_partkey % 3 = 0 then concat(l_linestatus, ' 5-LOW') else p_type end")
        .alias("property_type"),
        F.expr("case when l_partkey % 47 = 0 then null else cast(1 + p_size % 9 as double) end")
        .alias("accommodates"),
        F.expr("cast(1 + l_suppkey % 3 as double)").alias("bedrooms"),
        F.expr("case when l_partkey % 29 = 0 then null else cast(1 + l_suppkey % 2 as double) end")
        .alias("bathrooms_num"),
        F.expr("cast(l_linenumber as double)").alias("min_nights"),
        F.expr("l_returnflag = 'A'").alias("host_is_superhost"),
        F.col("l_quantity").alias("number_of_reviews"),
        F.expr("case when l_linenumber % 3 = 0 then null when l_linenumber % 3 = 1 "
               "then round(l_extendedprice, 0) * 4 else 0.0 end").alias("current_price"),
    )
