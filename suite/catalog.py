"""Every registered query with its reference SQL."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerband.functions import geo, parse
from peerband.functions.buckets import capacity_bucket, quoted
from peerband.operators import (
    advise,
    audits,
    contracts,
    demand,
    explore,
    features,
    hedonic,
    peers,
)
from peerband.operators import calendar as cal
from peerband.operators import listings as curate
from peerband.operators import occupancy as occ
from peerband.operators.distribution import level_counts
from peerband.params import POINTS_OF_INTEREST
from peerband.plans.build import publish_market
from peerband.plans.report import persona_report
from peerband.session import shared_folder, stage
from peerband.sources import raw
from suite.bind import (
    CALENDAR_SQL,
    LISTINGS_SQL,
    SNAPSHOT,
    calendar,
    listings,
    raw_listings,
    requests,
    table,
)
from suite.model_sql import (
    ADVICE_SQL,
    ERRORS_SQL,
    FIT_SQL,
    HEDONIC_SQL,
    PROFILES_SQL,
    REQUESTS_SQL,
    SCORE_SQL,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Round every double so that both engines print the same value.

    ``nudge`` moves exact halves off the tie, where engines may round either way.
    """
    return df.select(
        *[
            F.round(quoted(f.name) + F.lit(nudge), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/suite/{uuid.uuid4().hex}/{name}"


# ---------------------------------------------------------------- sources and sinks


@query(
    """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
      'say "' || c_mktsegment || '", twice' AS note, 'x' AS extra
    FROM customer
    """
)
def raw_text_load(spark, sf_dir):
    """Land a gzip CSV dump with quotes, commas and an extra column as all-text rows."""
    dump = scratch(spark, "dump")
    table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        "c_name",
        F.concat(F.lit('say "'), "c_mktsegment", F.lit('", twice')).alias("note"),
        F.lit("x").alias("extra"),
    ).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(dump)
    raw.load_csv(spark, dump, "raw_customers", store=scratch(spark, "raw"))
    return raw.raw_table(spark, "raw_customers")


@query(
    """
    SELECT l_suppkey AS listing_id, CAST(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)
      * count(*) AS BIGINT) AS busy, count(*) AS days FROM lineitem GROUP BY 1
    """
)
def curated_write_read(spark, sf_dir):
    """Write the calendar binding as a curated Parquet table, read it back and count."""
    path = scratch(spark, "calendar.parquet")
    calendar(spark, sf_dir).write.mode("overwrite").parquet(path)
    return (
        spark.read.parquet(path)
        .groupBy("listing_id")
        .agg(F.count_if(F.col("available") == "f").alias("busy"),
             F.count(F.lit(1)).alias("days"))
    )


@query(
    """
    WITH folder AS (SELECT regexp_replace(file_name, '[^/]*$', '') AS f
      FROM parquet_file_metadata('/root/testdata/sf*/lineitem.parquet')
      WHERE num_rows = (SELECT count(*) FROM lineitem))
    SELECT regexp_extract(filename, '[^/]*$') AS file, sha256(content) AS sha256, size AS bytes
    FROM read_blob('/root/testdata/sf*/*.parquet')
    WHERE regexp_replace(filename, '[^/]*$', '') = (SELECT f FROM folder)
    """
)
def file_fingerprints(spark, sf_dir):
    """sha256 and size of each input file."""
    return raw.fingerprints(spark, f"{sf_dir}/*.parquet")


@query(
    """
    SELECT sha256(n_name || chr(10)) AS sha256, CAST(strlen(n_name) + 1 AS BIGINT) AS bytes
    FROM nation
    """
)
def text_fingerprints(spark, sf_dir):
    """sha256 and size of one small text file written for each nation."""
    folder = scratch(spark, "texts")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.partitionBy(
        "n_nationkey").text(folder)
    return raw.fingerprints(spark, f"{folder}/*/*.txt").select("sha256", "bytes")


_CURATED_SQL = """
raw AS (
  SELECT c_custkey AS listing_id,
    CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE n_name END AS neighbourhood,
    CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS room_type,
    c_acctbal AS price, c_custkey % 12 AS home, 1 + c_custkey % 9 AS accommodates,
    1 + c_custkey % 4 AS bedrooms,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1 + c_custkey % 5 END AS beds,
    CASE c_custkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 WHEN 2 THEN 0.5 WHEN 3 THEN 0.5 END
      AS bathrooms_num,
    -22.9 - CAST(c_custkey % 100 AS DOUBLE) / 500.0 AS latitude,
    -43.1 - CAST((c_custkey * 7) % 100 AS DOUBLE) / 200.0 AS longitude,
    1 + c_custkey % 28 AS min_nights,
    CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS host_is_superhost,
    CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS instant_bookable,
    CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_custkey % 101) / 100.0 END
      AS host_response_rate,
    (c_custkey % 100) / 100.0 AS host_acceptance_rate,
    c_custkey % 50 AS number_of_reviews, c_custkey % 20 AS number_of_reviews_ltm,
    (c_custkey % 37) / 8.0 AS reviews_per_month,
    3.0 + (c_custkey % 9) / 8.0 AS review_scores_rating,
    c_custkey % 366 AS availability_365,
    CASE WHEN c_custkey % 10 = 0 THEN NULL
      ELSE CAST(DATE '2024-01-01' + CAST(c_custkey % 400 AS INTEGER) AS DATE) END AS last_review,
    ['within an hour', 'within a day', '', 'N/A'][1 + c_custkey % 4] AS host_response_time,
    CASE WHEN c_custkey % 11 < 3 THEN NULL
      ELSE CAST(DATE '2015-03-01' + CAST(c_custkey % 900 AS INTEGER) AS DATE) END AS first_review
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
points(lat, lon) AS (VALUES """ + ", ".join(
    f"({lat}, {lon})" for _, lat, lon in POINTS_OF_INTEREST
) + """),
near AS (
  SELECT listing_id, min(2 * 6371.0 * asin(sqrt(
      pow(sin(radians(lat - latitude) / 2), 2)
      + cos(radians(latitude)) * cos(radians(lat)) * pow(sin(radians(lon - longitude) / 2), 2)
    ))) AS km
  FROM raw, points GROUP BY 1
)
"""
_TYPED_COLUMNS = """
  raw.listing_id, neighbourhood, room_type, 'Home ' || home AS property_type,
  accommodates, bedrooms, beds, CAST(bathrooms_num AS DOUBLE) AS bathrooms_num,
  {price} AS price, round(km, 6) AS distance_to_beach_km, min_nights, host_is_superhost,
  instant_bookable, CAST(host_response_rate AS DOUBLE) AS host_response_rate,
  CAST(host_acceptance_rate AS DOUBLE) AS host_acceptance_rate, number_of_reviews,
  number_of_reviews_ltm, CAST(reviews_per_month AS DOUBLE) AS reviews_per_month,
  CAST(review_scores_rating AS DOUBLE) AS review_scores_rating, availability_365, last_review,
  host_response_time, first_review,
  CAST(listing_id % 200 AS DOUBLE) AS estimated_occupancy_l365d
"""


@query(
    f"WITH {_CURATED_SQL} SELECT {_TYPED_COLUMNS.format(price='round(price, 6)')} "
    "FROM raw JOIN near USING (listing_id)"
)
def listing_text_parsed(spark, sf_dir):
    """Every scalar parser over a whole text dump; no row dropped."""
    typed = curate.typed_listings(raw_listings(spark, sf_dir))
    return rounded(typed)


@query(
    f"""WITH {_CURATED_SQL},
    kept AS (SELECT * FROM raw WHERE price > 0 AND neighbourhood IS NOT NULL
      AND room_type IS NOT NULL),
    lim AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM kept)
    SELECT {_TYPED_COLUMNS.replace('raw.', 'raw.').format(
        price='round(least(greatest(raw.price, lo), hi), 6)')}
    FROM kept AS raw JOIN near USING (listing_id), lim
    """
)
def curated_listings(spark, sf_dir):
    """The curated listings table: typed, filtered, winsorized."""
    out = curate.curate_listings(raw_listings(spark, sf_dir))
    return rounded(out)


@query(
    """
    SELECT CAST(l_suppkey AS BIGINT) AS listing_id, CAST(l_shipdate AS DATE) AS date,
      round(l_extendedprice, 2) AS price, l_orderkey, l_linenumber, l_partkey
    FROM lineitem
    """
)
def calendar_text_strict(spark, sf_dir):
    """Strict key, date and price casts over calendar text."""
    text = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("listing_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("price"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )
    return text.select(
        parse.bigint_strict("listing_id").alias("listing_id"),
        parse.date_strict("date").alias("date"),
        F.round(parse.money_strict("price"), 2).alias("price"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


@query(
    """
    WITH kept AS (SELECT * FROM customer WHERE c_acctbal > 0),
    lim AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi
      FROM kept)
    SELECT c_custkey, round(least(greatest(c_acctbal, lo), hi), 6) AS price FROM kept, lim
    """
)
def winsorized_price(spark, sf_dir):
    """Positive balances clipped to their 1 % and 99 % quantiles."""
    kept = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(
        "c_custkey", F.col("c_acctbal").alias("price")
    )
    return rounded(curate.winsorize(kept, "price", 0.01, 0.99))


@query(
    """
    WITH spot AS (SELECT o_orderkey, -22.9 - CAST(o_orderkey % 100 AS DOUBLE) / 500.0 AS la,
      -43.1 - CAST((o_orderkey * 7) % 100 AS DOUBLE) / 200.0 AS lo FROM orders),
    points(name, lat, lon) AS (VALUES """
    + ", ".join(f"('{n}', {lat}, {lon})" for n, lat, lon in POINTS_OF_INTEREST)
    + """),
    d AS (SELECT o_orderkey, name, 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - la) / 2), 2)
      + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2))) AS km
      FROM spot, points)
    SELECT o_orderkey, round(min(km), 6) AS km, arg_min(name, km) AS name FROM d GROUP BY 1
    """
)
def nearest_point_distance(spark, sf_dir):
    """Distance to, and name of, the nearest of twelve points."""
    at = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr("-22.9 - cast(o_orderkey % 100 as double) / 500.0").alias("la"),
        F.expr("-43.1 - cast((o_orderkey * 7) % 100 as double) / 200.0").alias("lo"),
    )
    near = geo.nearest_point(F.col("la"), F.col("lo"), POINTS_OF_INTEREST)
    return rounded(at.select("o_orderkey", near.alias("p")).select("o_orderkey", "p.km", "p.name"))


@query(
    """
    SELECT CASE WHEN p_size % 12 = 0 THEN NULL WHEN p_size % 12 <= 2 THEN '1-2'
      WHEN p_size % 12 <= 4 THEN '3-4' WHEN p_size % 12 <= 6 THEN '5-6' ELSE '7+' END
      AS cap_bucket, count(*) AS n FROM part GROUP BY 1
    """
)
def capacity_bucket_counts(spark, sf_dir):
    """Right-closed guest buckets; zero guests is in none."""
    size = (F.col("p_size") % 12).cast("double")
    return (
        table(spark, sf_dir, "part")
        .groupBy(capacity_bucket(size).alias("cap_bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---------------------------------------------------------------- calendar


@query(
    f"""WITH {CALENDAR_SQL}
    SELECT listing_id, CAST(month(date) AS BIGINT) AS month, CAST(dayofweek(date) AS BIGINT) AS dow,
      round(median(price), 4) AS median_cal_price,
      round(avg(CASE WHEN available = 'f' THEN 1.0 ELSE 0.0 END), 6) AS booked_rate
    FROM calendar GROUP BY 1, 2, 3
    """
)
def calendar_cube_priced(spark, sf_dir):
    """Listing x month x weekday median price and booked rate."""
    cube = cal.calendar_cube(calendar(spark, sf_dir, priced=True))
    return cube.withColumns(
        {"median_cal_price": F.round("median_cal_price", 4),
         "booked_rate": F.round("booked_rate", 6)}
    )


@query(
    f"""WITH {CALENDAR_SQL}
    SELECT listing_id, CAST(month(date) AS BIGINT) AS month, CAST(dayofweek(date) AS BIGINT) AS dow,
      CAST(NULL AS DOUBLE) AS median_cal_price,
      round(avg(CASE WHEN available = 'f' THEN 1.0 ELSE 0.0 END), 6) AS booked_rate
    FROM calendar GROUP BY 1, 2, 3
    """
)
def calendar_cube_unpriced(spark, sf_dir):
    """The same cube for a dump without prices."""
    return rounded(cal.calendar_cube(calendar(spark, sf_dir)))


@query(
    f"""WITH {CALENDAR_SQL}
    SELECT date, round(avg(CASE WHEN available = 'f' THEN 1.0 ELSE 0.0 END), 6) AS unavail_rate,
      CAST(date - DATE '{SNAPSHOT}' AS BIGINT) AS horizon_days
    FROM calendar GROUP BY 1
    """
)
def daily_unavailability(spark, sf_dir):
    """Market-wide unavailable share per date."""
    return rounded(cal.daily_unavailability(calendar(spark, sf_dir), SNAPSHOT))


_DETREND_SQL = f"""{CALENDAR_SQL},
daily AS (SELECT date, date - DATE '{SNAPSHOT}' AS horizon_days,
  avg(CASE WHEN available = 'f' THEN 1.0 ELSE 0.0 END) AS unavail_rate
  FROM calendar GROUP BY 1, 2),
detrended AS (SELECT date, CAST(dayofweek(date) AS BIGINT) AS dow,
  CAST(horizon_days AS BIGINT) AS horizon_days, unavail_rate,
  avg(unavail_rate) OVER w AS baseline, unavail_rate - avg(unavail_rate) OVER w AS event_uplift,
  row_number() OVER (ORDER BY date) <= 14
    OR row_number() OVER (ORDER BY date) > count(*) OVER () - 14 AS is_edge
  FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING)),
clean AS (SELECT * FROM detrended WHERE NOT is_edge)
"""


@query(
    f"""WITH {_DETREND_SQL} SELECT date, dow, horizon_days, round(unavail_rate, 6) AS unavail_rate,
    round(baseline, 6) AS baseline, round(event_uplift, 6) + 0.0 AS event_uplift, is_edge
    FROM detrended"""
)
def detrended_seasonality(spark, sf_dir):
    """Unavailability less its centred rolling baseline."""
    return rounded(cal.detrend(calendar(spark, sf_dir), SNAPSHOT))


def _detrended(spark, sf_dir):
    return cal.detrend(calendar(spark, sf_dir), SNAPSHOT)


def _market(spark, sf_dir):
    """The listings binding as a stored table, for jobs that read it several times."""
    return stage(listings(spark, sf_dir), "listings")


@query(
    f"""WITH {CALENDAR_SQL},
    cells AS (SELECT listing_id, month(date) AS m, dayofweek(date) AS d,
      avg(CASE WHEN available = 'f' THEN 1.0 ELSE 0.0 END) AS r FROM calendar GROUP BY 1, 2, 3)
    SELECT listing_id, round(avg(r), 6) AS booked_rate FROM cells GROUP BY 1
    """
)
def listing_booked_rate(spark, sf_dir):
    """Unweighted mean of each listing's calendar cells."""
    return rounded(cal.booked_rate_by_listing(cal.calendar_cube(calendar(spark, sf_dir))))


# ---------------------------------------------------------------- occupancy


def _reviewed(spark, sf_dir):
    """Customers as listings, reviewed once per order; some have no orders at all."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("number_of_reviews_ltm")
    )
    return table(spark, sf_dir, "customer").join(
        orders, F.col("c_custkey") == F.col("o_custkey"), "left"
    ).select(F.col("c_custkey").alias("listing_id"), "number_of_reviews_ltm")


def _booked(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("listing_id"))
        .agg(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("booked_rate"))
    )


_OCCUPANCY_SQL = """
reviewed AS (SELECT c_custkey AS listing_id, n FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey),
booked AS (SELECT l_partkey AS listing_id,
  avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem GROUP BY 1),
proxy AS (SELECT listing_id, least(coalesce(n, 0) / 0.5 * 4.0 / 365.0, 0.70) AS sf FROM reviewed),
occupancy AS (SELECT listing_id, greatest(0.0, least(0.70,
  CASE WHEN rate IS NULL THEN sf ELSE (sf + rate) / 2 END)) AS occupancy_est
  FROM proxy LEFT JOIN booked USING (listing_id))
"""


@query(
    f"""WITH {_OCCUPANCY_SQL} SELECT listing_id, round(sf, 6) AS occupancy FROM proxy"""
)
def review_occupancy(spark, sf_dir):
    """Occupancy implied by review counts."""
    return rounded(
        _reviewed(spark, sf_dir).select(
            "listing_id",
            occ.review_occupancy(F.col("number_of_reviews_ltm")).alias("occupancy"),
        )
    )


@query(
    f"""WITH {_OCCUPANCY_SQL} SELECT listing_id, round(occupancy_est, 6) AS occupancy_est
    FROM occupancy"""
)
def blended_occupancy(spark, sf_dir):
    """Mean of the review proxy and the calendar rate."""
    return rounded(occ.estimate_occupancy(_reviewed(spark, sf_dir), _booked(spark, sf_dir)))


@query(
    f"""WITH {_OCCUPANCY_SQL},
    pair AS (SELECT o.listing_id, o.occupancy_est AS p, sf AS b
      FROM occupancy o JOIN proxy USING (listing_id)),
    rp AS (SELECT p, avg(k) AS r FROM (SELECT p, row_number() OVER (ORDER BY p) AS k FROM pair)
      GROUP BY 1),
    rb AS (SELECT b, avg(k) AS r FROM (SELECT b, row_number() OVER (ORDER BY b) AS k FROM pair)
      GROUP BY 1)
    SELECT round(corr(pair.p, pair.b), 6) AS pearson, round(corr(rp.r, rb.r), 6) AS spearman,
      round(avg(abs(pair.p - pair.b)), 6) AS mae, round(avg(pair.p - pair.b), 6) AS bias,
      round(avg(CASE WHEN pair.b = 0 THEN 1.0 ELSE 0.0 END), 6) AS structural_zero_frac,
      round(avg(CASE WHEN pair.p >= 0.699 - 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS proxy_cap_hit_frac,
      round(avg(CASE WHEN pair.b >= 0.699 - 1e-6 THEN 1.0 ELSE 0.0 END), 6)
        AS benchmark_cap_hit_frac,
      true AS shared_input_warning, count(*) AS n
    FROM pair JOIN rp ON pair.p = rp.p JOIN rb ON pair.b = rb.b
    """
)
def occupancy_agreement(spark, sf_dir):
    """Error, correlation and ceiling shares of the blend against the review proxy."""
    reviewed = _reviewed(spark, sf_dir)
    blend = occ.estimate_occupancy(reviewed, _booked(spark, sf_dir))
    proxy = reviewed.select(
        "listing_id", occ.review_occupancy(F.col("number_of_reviews_ltm")).alias("benchmark")
    )
    return rounded(occ.occupancy_agreement(blend, proxy))


# ---------------------------------------------------------------- features


@query(
    f"""WITH {LISTINGS_SQL},
    top AS (SELECT property_type, count(*) AS n FROM listings GROUP BY 1
      ORDER BY n DESC, property_type LIMIT 8)
    SELECT coalesce(top.property_type, 'Other') AS property_type, count(*) AS n
    FROM listings LEFT JOIN top USING (property_type) GROUP BY 1
    """
)
def property_levels_collapsed(spark, sf_dir):
    """Top property types, the rest pooled."""
    kept = features.collapse_top_levels(
        listings(spark, sf_dir).select("property_type"), "property_type", 8
    )
    return level_counts(kept, "property_type")


@query(
    """
    WITH c AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    k AS (SELECT n_name, count(*) AS n FROM c GROUP BY 1),
    typical AS (SELECT CAST(count(*) // 25 AS BIGINT) AS least FROM c)
    SELECT CASE WHEN k.n < least THEN 'Other' ELSE n_name END AS location, count(*) AS n
    FROM c JOIN k USING (n_name), typical GROUP BY 1
    """
)
def rare_levels_pooled(spark, sf_dir):
    """Locations with fewer customers than the average are pooled."""
    base = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("n_name").alias("location"))
    counts = level_counts(base, "location")
    typical = table(spark, sf_dir, "customer").count() // 25
    return level_counts(
        features.pool_rare_levels(base, "location", counts, typical), "location"
    )


@query(
    f"""WITH {LISTINGS_SQL}
    SELECT 'bedrooms' AS name, count(bedrooms) AS n, round(median(bedrooms), 6) AS median
      FROM listings
    UNION ALL SELECT 'bathrooms_num', count(bathrooms_num), round(median(bathrooms_num), 6)
      FROM listings
    UNION ALL SELECT 'min_nights', count(min_nights), round(median(min_nights), 6) FROM listings
    UNION ALL SELECT 'accommodates', count(accommodates), round(median(accommodates), 6)
      FROM listings
    UNION ALL SELECT 'distance_to_beach_km', count(*), round(median(distance_to_beach_km), 6)
      FROM listings
    """
)
def numeric_medians(spark, sf_dir):
    """Imputation medians of all numeric features in one pass."""
    names = (*features.NUMERIC, features.DISTANCE)
    return rounded(features.column_medians(listings(spark, sf_dir), names))


_PRICED_SQL = f"""{LISTINGS_SQL},
med AS (SELECT median(bedrooms) AS bedrooms, median(bathrooms_num) AS bathrooms_num FROM listings),
top AS (SELECT property_type, count(*) AS n FROM listings GROUP BY 1
  ORDER BY n DESC, property_type LIMIT 8),
hoods AS (SELECT neighbourhood, count(*) AS rows FROM listings WHERE price > 0 GROUP BY 1),
feat AS (SELECT listing_id, ln(price) AS log_price,
  CASE WHEN hoods.rows < 30 THEN 'Other' ELSE neighbourhood END AS neighbourhood,
  CAST(accommodates AS DOUBLE) AS accommodates,
  CAST(coalesce(l.bedrooms, med.bedrooms) AS DOUBLE) AS bedrooms,
  CAST(coalesce(l.bathrooms_num, med.bathrooms_num) AS DOUBLE) AS bathrooms_num,
  CAST(min_nights AS DOUBLE) AS min_nights, distance_to_beach_km, room_type,
  coalesce(top.property_type, 'Other') AS property_type,
  CASE WHEN host_is_superhost THEN 1.0 ELSE 0.0 END AS host_is_superhost,
  CASE WHEN host_is_superhost IS NULL THEN 1.0 ELSE 0.0 END AS superhost_missing,
  CASE WHEN coalesce(number_of_reviews, 0) = 0 THEN 1.0 ELSE 0.0 END AS no_review_history,
  CASE WHEN accommodates <= 2 THEN '1-2' WHEN accommodates <= 4 THEN '3-4'
    WHEN accommodates <= 6 THEN '5-6' ELSE '7+' END AS cap_bucket
  FROM listings l LEFT JOIN top USING (property_type) JOIN hoods USING (neighbourhood), med
  WHERE price > 0)
"""


@query(
    f"""WITH {_PRICED_SQL}
    SELECT listing_id, round(log_price, 6) AS log_price, neighbourhood, accommodates, bedrooms,
      bathrooms_num, min_nights, round(distance_to_beach_km, 6) AS distance_to_beach_km,
      CAST(host_is_superhost AS DOUBLE) AS host_is_superhost,
      CAST(superhost_missing AS DOUBLE) AS superhost_missing,
      CAST(no_review_history AS DOUBLE) AS no_review_history, cap_bucket,
      CASE WHEN room_type <> (SELECT min(room_type) FROM feat)
        THEN 'room_type_' || room_type ELSE '' END AS room_columns,
      CASE WHEN property_type <> (SELECT min(property_type) FROM feat)
        THEN 'property_type_' || property_type ELSE '' END AS property_columns
    FROM feat
    """
)
def model_features(spark, sf_dir):
    """The full design matrix row by row; of the dummy columns, the names of those that are 1."""
    frame, _ = features.model_matrix(_market(spark, sf_dir))

    def set_columns(prefix):
        return F.concat_ws(",", *[
            F.when(quoted(c) == 1, c) for c in frame.columns if c.startswith(prefix)
        ])

    return rounded(
        frame.select(
            "listing_id", "log_price", "neighbourhood", *features.NUMERIC, features.DISTANCE,
            "host_is_superhost", "superhost_missing", "no_review_history", "cap_bucket",
            set_columns("room_type_").alias("room_columns"),
            set_columns("property_type_").alias("property_columns"),
        )
    )


@query(
    f"""WITH {_PRICED_SQL},
    names AS (SELECT unnest(['accommodates', 'bedrooms', 'bathrooms_num', 'min_nights',
        'distance_to_beach_km', 'host_is_superhost', 'superhost_missing', 'no_review_history'])
        AS name
      UNION ALL (SELECT 'room_type_' || room_type FROM (SELECT DISTINCT room_type FROM feat)
        ORDER BY room_type OFFSET 1)
      UNION ALL (SELECT 'property_type_' || property_type
        FROM (SELECT DISTINCT property_type FROM feat) ORDER BY property_type OFFSET 1))
    SELECT name, 'column' AS role, (SELECT count(*) FROM feat) AS n_rows FROM names
    UNION ALL SELECT unnest(['instant_bookable', 'host_response_time', 'host_response_rate',
      'host_acceptance_rate', 'availability_365', 'estimated_occupancy_l365d',
      'estimated_revenue_l365d', 'beds']), 'dropped', (SELECT count(*) FROM feat)
    """
)
def feature_governance(spark, sf_dir):
    """Design columns used and columns kept out on purpose."""
    _, spec = features.model_matrix(_market(spark, sf_dir))
    meta = features.feature_metadata(spec, spark)
    used = meta.select(F.explode("columns").alias("name"), F.lit("column").alias("role"), "n_rows")
    out = meta.select(F.explode("dropped").alias("name"), F.lit("dropped").alias("role"), "n_rows")
    return used.unionByName(out)


# ---------------------------------------------------------------- regression


_TWO = ["accommodates", "distance_to_beach_km"]
_TWO_SQL = f"""{LISTINGS_SQL},
f AS (SELECT listing_id, ln(price) AS y, neighbourhood AS g, CAST(accommodates AS DOUBLE) AS a,
  distance_to_beach_km AS d FROM listings WHERE price > 0),
m AS (SELECT g, avg(y) AS y, avg(a) AS a, avg(d) AS d, count(*) AS n FROM f GROUP BY 1),
c AS (SELECT f.listing_id, f.g, f.y - m.y AS y, f.a - m.a AS a, f.d - m.d AS d
  FROM f JOIN m USING (g)),
s AS (SELECT sum(a * a) AS aa, sum(a * d) AS ad, sum(d * d) AS dd, sum(a * y) AS ay,
  sum(d * y) AS dy FROM c),
b AS (SELECT (ay * dd - dy * ad) / (aa * dd - ad * ad) AS ba,
  (dy * aa - ay * ad) / (aa * dd - ad * ad) AS bd,
  dd / (aa * dd - ad * ad) AS va, aa / (aa * dd - ad * ad) AS vd FROM s),
fe AS (SELECT g, n, m.y - ba * m.a - bd * m.d AS lvl FROM m, b),
base AS (SELECT lvl AS intercept FROM fe ORDER BY g LIMIT 1),
r AS (SELECT f.listing_id, f.y, f.y - (lvl + ba * f.a + bd * f.d) AS e
  FROM f JOIN fe USING (g), b),
q AS (SELECT sum(e * e) AS sse, avg(abs(e)) AS mae, avg(exp(e)) AS smear, count(*) AS n,
  var_pop(y) * count(*) AS sst FROM r),
dof AS (SELECT n - 2 - (SELECT count(*) FROM fe) AS df FROM q)
"""


def _two_feature_fit(spark, sf_dir):
    frame = stage(
        listings(spark, sf_dir).where("price > 0").select(
            "listing_id", F.ln("price").alias("log_price"), "neighbourhood",
            *[F.col(c).cast("double").alias(c) for c in _TWO],
        ),
        "two_features",
    )
    return frame, hedonic.fit_hedonic(frame, _TWO)


@query(
    f"""WITH {_TWO_SQL}
    SELECT 'accommodates' AS feature, round(ba, 8) AS effect,
      round(sqrt(va * sse / df), 8) AS std_err FROM b, q, dof
    UNION ALL SELECT 'distance_to_beach_km', round(bd, 8), round(sqrt(vd * sse / df), 8)
      FROM b, q, dof
    """
)
def regression_coefficients(spark, sf_dir):
    """Effects and standard errors with location fixed effects absorbed."""
    _, fit = _two_feature_fit(spark, sf_dir)
    return rounded(fit.coefficients.select("feature", "effect", "std_err"), 8)


@query(
    f"""WITH {_TWO_SQL}
    SELECT CAST(n AS BIGINT) AS n_rows, round(intercept, 6) AS intercept,
      round(1 - sse / sst, 8) AS r2, round(1 - (sse / df) / (sst / (n - 1)), 8) AS adj_r2,
      round(mae, 6) AS model_mae, round(smear, 6) AS smearing,
      round((SELECT avg(abs(y - (SELECT median(y) FROM f))) FROM f), 6) AS baseline_median_mae,
      round((SELECT avg(abs(f.y - k.y)) FROM f JOIN
        (SELECT g, median(y) AS y FROM f GROUP BY 1) k USING (g)), 6) AS baseline_group_mae
    FROM q, dof, base
    """
)
def regression_summary(spark, sf_dir):
    """Fit quality, smearing factor and the median baselines it must beat."""
    _, fit = _two_feature_fit(spark, sf_dir)
    s = fit.summary()
    return s.select(
        "n_rows",
        *[F.round(c, 8).alias(c) for c in ("r2", "adj_r2")],
        *[F.round(c, 6).alias(c) for c in (
            "intercept", "model_mae", "smearing", "baseline_median_mae", "baseline_group_mae")],
    )


@query(
    f"""WITH {_TWO_SQL} SELECT g AS neighbourhood, n,
    round(lvl - intercept, 8) + 0.0 AS fixed_effect FROM fe, base"""
)
def regression_fixed_effects(spark, sf_dir):
    """Location effects relative to the alphabetically first location."""
    _, fit = _two_feature_fit(spark, sf_dir)
    return rounded(fit.fixed_effects, 8)


@query(
    f"""WITH {_TWO_SQL} SELECT listing_id, round(r.y - e, 6) AS predicted_log_price,
    round(exp(r.y - e) * smear, 2) AS predicted_price FROM r, q"""
)
def regression_predictions(spark, sf_dir):
    """Smearing-corrected price per listing."""
    frame, fit = _two_feature_fit(spark, sf_dir)
    return hedonic.predict(frame, fit).select(
        "listing_id",
        F.round("predicted_log_price", 6).alias("predicted_log_price"),
        F.round("predicted_price", 2).alias("predicted_price"),
    )


@query(
    f"""WITH {_TWO_SQL}, k AS (SELECT 1 / (1 - pow(corr(a, d), 2)) AS v FROM f)
    SELECT 'accommodates' AS feature, round(v, 8) AS vif FROM k
    UNION ALL SELECT 'distance_to_beach_km', round(v, 8) FROM k
    """
)
def variance_inflation(spark, sf_dir):
    """VIF without fixed effects."""
    frame, _ = _two_feature_fit(spark, sf_dir)
    return rounded(hedonic.vif_table(frame, _TWO), 8)


@query(
    f"""WITH {LISTINGS_SQL},
    named AS (SELECT *, CASE room_type WHEN 'AUTOMOBILE' THEN 'Hotel room' WHEN 'BUILDING'
      THEN 'Entire home/apt' ELSE room_type END AS room FROM listings)
    SELECT CASE room WHEN 'Hotel room' THEN 'Entire home/apt' ELSE room END AS room_level,
      count(*) AS n, count(*) FILTER (room = 'Hotel room') AS hotels,
      round(avg(ln(price)), 6) AS log_price
    FROM named WHERE price > 0 GROUP BY 1
    """
)
def hotel_rooms_folded(spark, sf_dir):
    """Features count hotel rooms among homes; listings keep the level they came with."""
    room = F.expr("case room_type when 'AUTOMOBILE' then 'Hotel room' when 'BUILDING' then"
                  " 'Entire home/apt' else room_type end")
    market = stage(listings(spark, sf_dir).withColumn("room_type", room), "named")
    frame = features.design_frame(market, features.learn_features(market))
    kept = market.select("listing_id", "room_type")
    return rounded(
        frame.join(kept, "listing_id").groupBy("room_level").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("room_type") == "Hotel room").alias("hotels"),
            F.avg("log_price").alias("log_price"),
        )
    )


def _whole_fit(spark, sf_dir):
    market = _market(spark, sf_dir)
    spec = features.learn_features(market)
    frame = stage(features.design_frame(market, spec), "features")
    return hedonic.fit_hedonic(frame, spec.names, factors=spec.factors)


@query(
    f"""WITH RECURSIVE {_PRICED_SQL}, {FIT_SQL}, {ERRORS_SQL}
    SELECT name AS feature, round(b, 8) AS effect, round(se, 8) AS std_err,
      round(p, 6) AS p_value, round(b - c * se, 8) AS ci_low, round(b + c * se, 8) AS ci_high
    FROM tested JOIN tail USING (name), crit
    """
)
def full_regression(spark, sf_dir):
    """The whole interpretable model: effects, errors, p-values, intervals."""
    fit = rounded(_whole_fit(spark, sf_dir).coefficients, 8)
    return fit.withColumn("p_value", F.round("p_value", 6))


@query(
    f"""WITH RECURSIVE {_PRICED_SQL}, {FIT_SQL}
    SELECT name AS feature, round(b, 8) AS effect, round(exp(b) - 1, 8) AS percent_effect
    FROM coef ORDER BY abs(b) DESC, name LIMIT 12
    """
)
def top_price_drivers(spark, sf_dir):
    """The strongest effects and the percentage change each implies."""
    return rounded(hedonic.top_drivers(_whole_fit(spark, sf_dir).coefficients, 12), 8)


# ---------------------------------------------------------------- peers


_BUCKETED_SQL = f"""{LISTINGS_SQL},
mk AS (SELECT *, CASE WHEN accommodates <= 2 THEN '1-2' WHEN accommodates <= 4 THEN '3-4'
  WHEN accommodates <= 6 THEN '5-6' ELSE '7+' END AS cap_bucket FROM listings),
t0 AS (SELECT neighbourhood, room_type, cap_bucket, count(*) AS n, median(price) AS med,
  quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75, avg(price) AS mean,
  stddev_samp(price) AS std FROM mk GROUP BY 1, 2, 3),
t1 AS (SELECT neighbourhood, room_type, '' AS cap_bucket, count(*) AS n, median(price) AS med,
  quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75, avg(price) AS mean,
  stddev_samp(price) AS std FROM mk GROUP BY 1, 2),
t2 AS (SELECT '' AS neighbourhood, room_type, cap_bucket, count(*) AS n, median(price) AS med,
  quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75, avg(price) AS mean,
  stddev_samp(price) AS std FROM mk GROUP BY 2, 3),
t3 AS (SELECT '' AS neighbourhood, room_type, '' AS cap_bucket, count(*) AS n,
  median(price) AS med, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75,
  avg(price) AS mean, stddev_samp(price) AS std FROM mk GROUP BY 2)
"""


@query(
    f"""WITH {_BUCKETED_SQL},
    every AS (SELECT 0 AS tier, * FROM t0 UNION ALL SELECT 1, * FROM t1
      UNION ALL SELECT 2, * FROM t2 UNION ALL SELECT 3, * FROM t3)
    SELECT tier, neighbourhood, room_type, cap_bucket, n, round(q25 + 1e-7, 3) AS q25,
      round(med + 1e-7, 3) AS median, round(q75 + 1e-7, 3) AS q75,
      round(q75 - q25 + 1e-7, 3) AS iqr, round(mean + 1e-7, 3) AS mean,
      round(std + 1e-7, 3) AS std, round(1000 * std / mean + 1e-7, 3) AS cv FROM every
    """
)
def peer_group_statistics(spark, sf_dir):
    """Exact distribution statistics of every comparison group of every tier."""
    market = listings(spark, sf_dir)
    median = peers.global_median(market).select("median").scalar()
    stats = peers.group_statistics(peers.market_histogram(market), median)
    return rounded(stats.withColumn("cv", F.col("cv") * 1000), 3, 1e-7)


@query(
    f"""WITH {LISTINGS_SQL} SELECT count(*) AS n, round(median(price), 6) AS median FROM listings"""
)
def global_median_price(spark, sf_dir):
    """Exact market median."""
    return rounded(peers.global_median(listings(spark, sf_dir)))


_PEER_SQL = """
stat AS (SELECT q.*, gm.med AS g, t0.n AS n0, t1.n AS n1, t2.n AS n2, t3.n AS n3,
    t0.med AS m0, t1.med AS m1, t2.med AS m2, t3.med AS m3,
    t0.q75 - t0.q25 AS i0, t1.q75 - t1.q25 AS i1, t2.q75 - t2.q25 AS i2, t3.q75 - t3.q25 AS i3,
    t0.std / t0.mean AS c0, t1.std / t1.mean AS c1, t2.std / t2.mean AS c2, t3.std / t3.mean AS c3
  FROM req q CROSS JOIN (SELECT median(price) AS med FROM mk) gm
  LEFT JOIN t0 ON q.nb = t0.neighbourhood AND q.rt = t0.room_type AND q.cb = t0.cap_bucket
  LEFT JOIN t1 ON q.nb = t1.neighbourhood AND q.rt = t1.room_type
  LEFT JOIN t2 ON q.rt = t2.room_type AND q.cb = t2.cap_bucket
  LEFT JOIN t3 ON q.rt = t3.room_type),
p0 AS (SELECT *, CASE WHEN n0 > 0 THEN n0 / (n0 + 30.0) * m0 + 30.0 / (n0 + 30.0) * g
  ELSE g END AS s0 FROM stat),
p1 AS (SELECT *, CASE WHEN n1 > 0 THEN n1 / (n1 + 30.0) * m1 + 30.0 / (n1 + 30.0) * s0
  ELSE s0 END AS s1 FROM p0),
p2 AS (SELECT *, CASE WHEN n2 > 0 THEN n2 / (n2 + 30.0) * m2 + 30.0 / (n2 + 30.0) * s1
  ELSE s1 END AS s2 FROM p1),
p3 AS (SELECT *, CASE WHEN n3 > 0 THEN n3 / (n3 + 30.0) * m3 + 30.0 / (n3 + 30.0) * s2
  ELSE s2 END AS s3 FROM p2),
res AS (SELECT *, CASE WHEN n0 >= 30 THEN 0 WHEN n1 >= 30 THEN 1 WHEN n2 >= 30 THEN 2
  WHEN n3 > 0 THEN 3 ELSE 4 END AS t FROM p3),
tgt AS (SELECT DISTINCT t, CASE WHEN t IN (0, 1) THEN nb ELSE '' END AS nb, rt,
  CASE WHEN t IN (0, 2) THEN cb ELSE '' END AS cb, price FROM res WHERE t < 4),
pct AS (SELECT tgt.t, tgt.nb, tgt.rt, tgt.cb, tgt.price,
    avg(CASE WHEN mk.price < tgt.price THEN 1.0 ELSE 0.0 END) AS pct
  FROM tgt JOIN mk ON mk.room_type = tgt.rt AND (tgt.nb = '' OR mk.neighbourhood = tgt.nb)
    AND (tgt.cb = '' OR mk.cap_bucket = tgt.cb) GROUP BY 1, 2, 3, 4, 5),
peer AS (SELECT res.*, CASE WHEN res.t = 4 THEN 0.5 ELSE pct.pct END AS pct
  FROM res LEFT JOIN pct ON res.t = pct.t AND res.rt = pct.rt AND res.price = pct.price
    AND CASE WHEN res.t IN (0, 1) THEN res.nb ELSE '' END = pct.nb
    AND CASE WHEN res.t IN (0, 2) THEN res.cb ELSE '' END = pct.cb)
"""


def _asked(spark, sf_dir):
    """Whole-table requests against the market, including unknown and NULL keys."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.expr("case when o_orderkey % 37 = 0 then 'Nowhere' when o_orderkey % 41 = 0 then null "
               "else concat('NATION_', cast(o_custkey % 25 as string)) end").alias("neighbourhood"),
        F.expr("case when o_orderkey % 43 = 0 then 'Treehouse' else element_at(array('AUTOMOBILE',"
               "'BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'), cast(1 + o_custkey % 5 as int))"
               " end").alias("room_type"),
        F.expr("case o_orderkey % 5 when 0 then '1-2' when 1 then '3-4' when 2 then '5-6' "
               "when 3 then '7+' end").alias("cap_bucket"),
        F.expr("round(o_totalprice / 1000.0, 0) * 1000.0").alias("target_price"),
    )


_ASKED_SQL = """
req AS (SELECT o_orderkey AS request_id,
  CASE WHEN o_orderkey % 37 = 0 THEN 'Nowhere' WHEN o_orderkey % 41 = 0 THEN NULL
    ELSE 'NATION_' || (o_custkey % 25) END AS nb,
  CASE WHEN o_orderkey % 43 = 0 THEN 'Treehouse' ELSE
    ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][1 + o_custkey % 5] END AS rt,
  CASE o_orderkey % 5 WHEN 0 THEN '1-2' WHEN 1 THEN '3-4' WHEN 2 THEN '5-6' WHEN 3 THEN '7+' END
    AS cb,
  round(o_totalprice / 1000.0, 0) * 1000.0 AS price FROM orders)
"""


@query(
    f"""WITH {_BUCKETED_SQL}, {_ASKED_SQL}, {_PEER_SQL}
    SELECT request_id,
      CASE t WHEN 0 THEN 'neighbourhood,room_type,cap_bucket' WHEN 1 THEN 'neighbourhood,room_type'
        WHEN 2 THEN 'room_type,cap_bucket' ELSE 'room_type' END AS tier_used,
      CAST(CASE t WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE 0 END AS BIGINT)
        AS n_effective,
      round(CASE t WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s3 END
        + 1e-7, 3) AS shrunk_median,
      round(CASE t WHEN 0 THEN i0 WHEN 1 THEN i1 WHEN 2 THEN i2 WHEN 3 THEN i3 ELSE 0 END
        + 1e-7, 3) AS iqr,
      round(CASE t WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 END, 6) AS cv,
      round(pct, 6) AS price_percentile, t < 4 AS has_peer_signal
    FROM peer
    """
)
def peer_positions(spark, sf_dir):
    """Tiered fallback, shrinkage and strict percentile for every request."""
    placed = peers.peer_positions(_asked(spark, sf_dir), _market(spark, sf_dir))
    return placed.select(
        "request_id",
        F.array_join("tier_used", ",").alias("tier_used"),
        "n_effective",
        F.round(F.col("shrunk_median") + 1e-7, 3).alias("shrunk_median"),
        F.round(F.col("iqr") + 1e-7, 3).alias("iqr"),
        F.round("cv", 6).alias("cv"),
        F.round("price_percentile", 6).alias("price_percentile"),
        "has_peer_signal",
    )


# ---------------------------------------------------------------- demand


@query(
    f"""WITH {_DETREND_SQL} SELECT date, dow, horizon_days,
    round(event_uplift, 6) AS event_uplift FROM clean ORDER BY clean.event_uplift DESC, date
    LIMIT 10"""
)
def top_demand_dates(spark, sf_dir):
    """The ten dates with the highest uplift."""
    return rounded(demand.top_dates(_detrended(spark, sf_dir)))


_EVENTS_SQL = """
days AS (SELECT date, event_uplift, unnest([
    CASE WHEN month(date) * 100 + day(date) >= 1228 OR month(date) * 100 + day(date) <= 102
      THEN 'Réveillon' END,
    CASE WHEN month(date) * 100 + day(date) BETWEEN 206 AND 212 THEN 'Carnaval' END]) AS event
  FROM clean)
"""


@query(
    f"""WITH {_DETREND_SQL}, {_EVENTS_SQL} SELECT event, date,
    round(event_uplift, 6) + 0.0 AS event_uplift FROM days WHERE event IS NOT NULL"""
)
def event_window_days(spark, sf_dir):
    """Dates inside a recurring event window, year end included."""
    return rounded(demand.event_days(_detrended(spark, sf_dir)).drop("place"))


@query(
    f"""WITH {_DETREND_SQL}, {_EVENTS_SQL} SELECT event, round(max(event_uplift), 6)
    AS event_uplift, arg_max(date, event_uplift) AS peak_date FROM days WHERE event IS NOT NULL
    GROUP BY 1"""
)
def event_peaks(spark, sf_dir):
    """Peak uplift and its date per event."""
    return rounded(demand.event_peaks(_detrended(spark, sf_dir)).drop("place"))


@query(
    f"""WITH {_DETREND_SQL}, {_EVENTS_SQL},
    peak AS (SELECT event, max(event_uplift) AS u FROM days WHERE event IS NOT NULL GROUP BY 1),
    best AS (SELECT date, event_uplift FROM clean ORDER BY event_uplift DESC, date LIMIT 10)
    SELECT (SELECT string_agg(CAST(date AS VARCHAR), ',' ORDER BY event_uplift DESC, date)
        FROM best) AS top_dates,
      (SELECT round(sum(event_uplift), 6) FROM best) AS top_uplift,
      (SELECT round(u, 6) FROM peak WHERE event = 'Réveillon') AS new_year,
      (SELECT round(u, 6) FROM peak WHERE event = 'Carnaval') AS carnival,
      (SELECT count(*) FROM peak) AS n_events,
      (SELECT count(*) FROM detrended WHERE is_edge) AS dropped_edge,
      true AS magnitudes_are_lower_bounds,
      'Seasonal demand (lower bound): ' || (SELECT string_agg(event || ' +' ||
        CAST(CAST(round_even(u * 100, 0) AS BIGINT) AS VARCHAR) || '%', ', ' ORDER BY event DESC)
        FROM peak) || '.' AS demand_note
    """
)
def seasonal_context(spark, sf_dir):
    """The one-row demand context and its note."""
    context = demand.seasonal_context(_detrended(spark, sf_dir))
    return rounded(context.select(
        F.array_join(F.transform("top_dates", lambda d: d["date"].cast("string")), ",")
        .alias("top_dates"),
        F.aggregate("top_dates", F.lit(0.0), lambda a, d: a + d["event_uplift"])
        .alias("top_uplift"),
        F.col("events")["Réveillon"].alias("new_year"),
        F.col("events")["Carnaval"].alias("carnival"),
        F.size("events").cast("bigint").alias("n_events"),
        "dropped_edge", "magnitudes_are_lower_bounds", "demand_note",
    ))


# ---------------------------------------------------------------- advice


@query(
    f"""WITH {_BUCKETED_SQL}, {_ASKED_SQL}, {_PEER_SQL},
    pos AS (SELECT request_id, price AS h, pct,
      CASE t WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END AS m,
      CASE t WHEN 0 THEN i0 WHEN 1 THEN i1 WHEN 2 THEN i2 WHEN 3 THEN i3 ELSE 0 END AS i
      FROM peer)
    SELECT request_id, round(greatest(0.5 * h + 0.5 * m - 0.5 * i, 0.5 * (0.5 * h + 0.5 * m)) + 1e-7, 3)
        AS low,
      round(0.5 * h + 0.5 * m + 1e-7, 3) AS anchor, round(0.5 * h + 0.5 * m + 0.5 * i + 1e-7, 3) AS high,
      CASE WHEN pct < 0.33 THEN 'below market' WHEN pct > 0.66 THEN 'above market'
        ELSE 'in line' END AS position_label
    FROM pos
    """
)
def price_ranges(spark, sf_dir):
    """Range, anchor and label from a point estimate and a peer position."""
    placed = peers.peer_positions(_asked(spark, sf_dir), _market(spark, sf_dir))
    ranged = advise.price_range(placed, hedonic="target_price")
    return rounded(ranged.select("request_id", "low", "anchor", "high", "position_label"), 3, 1e-7)


@query(
    """
    SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'peer median must be positive'
      WHEN c_custkey % 7 = 0 THEN 'peer IQR must not be negative'
      WHEN c_custkey % 11 = 0 THEN 'price percentile must lie in [0, 1]' END AS reject_reason,
      CASE WHEN NOT (c_acctbal <= 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0)
        THEN round(0.5 * 500.0 + 0.5 * c_acctbal, 3) END AS anchor
    FROM customer
    """
)
def price_range_rejections(spark, sf_dir):
    """Rows that cannot be priced keep a reason instead of a range."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lit(500.0).alias("hedonic_price"),
        F.col("c_acctbal").alias("shrunk_median"),
        F.when(F.col("c_custkey") % 7 == 0, -1.0).otherwise(100.0).alias("iqr"),
        F.when(F.col("c_custkey") % 11 == 0, 1.5).otherwise(0.5).alias("price_percentile"),
    )
    out = advise.price_range(rows, on_invalid="flag")
    return rounded(out.select("c_custkey", "reject_reason", "anchor"), 3)


_MARKET_SQL = _BUCKETED_SQL.replace(LISTINGS_SQL, _PRICED_SQL)


@query(
    f"""WITH RECURSIVE {_MARKET_SQL}, {FIT_SQL}, {SCORE_SQL}, {REQUESTS_SQL}, {HEDONIC_SQL},
    {_PEER_SQL}, {ADVICE_SQL}, {_DETREND_SQL}, {_EVENTS_SQL},
    peak AS (SELECT event, max(event_uplift) AS u FROM days WHERE event IS NOT NULL GROUP BY 1),
    note AS (SELECT 'Seasonal demand (lower bound): ' || string_agg(event || ' +' ||
      CAST(CAST(round_even(u * 100, 0) AS BIGINT) AS VARCHAR) || '%', ', ' ORDER BY event DESC)
      || '.' AS demand_note FROM peak)
    SELECT request_id, round(h + 1e-7, 3) AS hedonic_price, known AS neighbourhood_in_model,
      n_effective, round(m + 1e-7, 3) AS shrunk_median, round(pct + 1e-7, 3) AS price_percentile,
      round(low + 1e-7, 3) AS low, round(anchor + 1e-7, 3) AS anchor,
      round(high + 1e-7, 3) AS high, position_label, t < 4 AS has_peer_signal, demand_note
    FROM advised, note
    """
)
def request_advice(spark, sf_dir):
    """Fit a market and advise one request per line item, end to end."""
    advisor = advise.fit_advisor(_market(spark, sf_dir))
    series = stage(_detrended(spark, sf_dir), "series")
    advice = advise.advise(advisor, requests(spark, sf_dir), series)
    return rounded(
        advice.select(
            "request_id", "hedonic_price", "neighbourhood_in_model", "n_effective",
            "shrunk_median", "price_percentile", "low", "anchor", "high", "position_label",
            "has_peer_signal", "demand_note",
        ),
        3, 1e-7,
    )


@query(
    f"""WITH RECURSIVE {_MARKET_SQL}, {FIT_SQL}, {SCORE_SQL}, {PROFILES_SQL}, {HEDONIC_SQL},
    {_PEER_SQL}, {ADVICE_SQL}
    SELECT request_id, neighbourhood, room_type, accommodates, round(anchor + 1e-7, 3) AS anchor,
      round(low + 1e-7, 3) AS low, round(high + 1e-7, 3) AS high, position_label, n_effective,
      known AS neighbourhood_in_model, t < 4 AS has_peer_signal
    FROM advised
    """
)
def persona_positions(spark, sf_dir):
    """The short report: one profile per nation and its most common home, ties by name."""
    market = _market(spark, sf_dir)
    advisor = advise.fit_advisor(market)
    profiles = market.groupBy("neighbourhood").agg(
        F.min("listing_id").alias("request_id"),
        F.mode("room_type", True).alias("room_type"),
        F.mode("property_type", True).alias("property_type"),
    ).select(
        "request_id", "neighbourhood", "room_type", "property_type",
        F.lit(2.0).alias("accommodates"), F.lit(1.0).alias("bedrooms"),
        F.lit(1.0).alias("bathrooms_num"), F.lit(2.0).alias("min_nights"),
        F.lit(False).alias("host_is_superhost"), F.lit(20.0).alias("number_of_reviews"),
        F.lit(None).cast("double").alias("current_price"),
    )
    report = persona_report(advisor, stage(_detrended(spark, sf_dir), "series"), profiles)
    return rounded(report, 3, 1e-7)


# ---------------------------------------------------------------- contracts


@query(
    """
    SELECT 'listing_id not null' AS rule, count(*) FILTER (c_custkey IS NULL) AS violations
      FROM customer
    UNION ALL SELECT 'occupancy_est not null', count(*) FILTER (c_custkey % 9 = 0) FROM customer
    UNION ALL SELECT 'occupancy_est >= 0', count(*) FILTER (c_custkey % 9 <> 0 AND c_acctbal < 0)
      FROM customer
    UNION ALL SELECT 'occupancy_est <= 1',
      count(*) FILTER (c_custkey % 9 <> 0 AND c_acctbal / 5000.0 > 1) FROM customer
    UNION ALL SELECT 'unique listing_id', CAST(count(*) - count(DISTINCT c_custkey // 2) AS BIGINT)
      FROM customer
    """
)
def contract_violations(spark, sf_dir):
    """Violations per rule of a deliberately dirty occupancy table."""
    dirty = table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 2).alias("listing_id"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal") / 5000.0).alias("occupancy_est"),
    )
    return contracts.violations(dirty, contracts.OCCUPANCY)


@query(
    """
    SELECT 'unique listing_id, month, dow' AS rule,
      CAST(count(*) - count(DISTINCT (l_suppkey, month(l_shipdate), dayofweek(l_shipdate)))
        AS BIGINT) AS violations FROM lineitem
    UNION ALL SELECT unnest(['listing_id not null', 'month not null', 'month >= 1', 'month <= 12',
      'dow not null', 'dow >= 0', 'dow <= 6', 'booked_rate not null', 'booked_rate >= 0']), 0
    UNION ALL SELECT 'median_cal_price >= 0', count(*) FILTER (l_extendedprice - 30000 < 0)
      FROM lineitem
    UNION ALL SELECT 'booked_rate <= 1', count(*) FILTER (l_quantity / 40.0 > 1) FROM lineitem
    """
)
def composite_key_violations(spark, sf_dir):
    """Every rule of the seasonality table broken or kept by an unaggregated calendar."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("listing_id"), F.month("l_shipdate").alias("month"),
        cal.day_of_week(F.col("l_shipdate")).alias("dow"),
        (F.col("l_extendedprice") - 30000).alias("median_cal_price"),
        (F.col("l_quantity") / 40.0).alias("booked_rate"),
    )
    return contracts.violations(rows, contracts.SEASONALITY)


@query(
    """
    WITH dirty AS (SELECT c_custkey // 3 AS listing_id,
      CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS neighbourhood, c_acctbal AS price,
      c_custkey % 7 - 2 AS accommodates, c_nationkey - 20 AS min_nights,
      CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 4000 END AS rate,
      c_acctbal / 1000 AS rating, c_custkey % 11 - 1.0 AS km FROM customer)
    SELECT unnest(['listing_id not null', 'room_type not null', 'number_of_reviews_ltm >= 0',
      'price not null']) AS rule, CAST(0 AS BIGINT) AS violations
    UNION ALL SELECT 'neighbourhood not null', count(*) FILTER (neighbourhood IS NULL) FROM dirty
    UNION ALL SELECT 'price > 0', count(*) FILTER (price <= 0) FROM dirty
    UNION ALL SELECT 'accommodates >= 0', count(*) FILTER (accommodates < 0) FROM dirty
    UNION ALL SELECT 'min_nights >= 0', count(*) FILTER (min_nights < 0) FROM dirty
    UNION ALL SELECT unnest(['host_response_rate >= 0', 'host_acceptance_rate >= 0']),
      (SELECT count(*) FILTER (rate < 0) FROM dirty)
    UNION ALL SELECT unnest(['host_response_rate <= 1', 'host_acceptance_rate <= 1']),
      (SELECT count(*) FILTER (rate > 1) FROM dirty)
    UNION ALL SELECT 'review_scores_rating >= 0', count(*) FILTER (rating < 0) FROM dirty
    UNION ALL SELECT 'review_scores_rating <= 5', count(*) FILTER (rating > 5) FROM dirty
    UNION ALL SELECT 'distance_to_beach_km >= 0', count(*) FILTER (km < 0) FROM dirty
    UNION ALL SELECT 'unique listing_id', count(*) - count(DISTINCT listing_id) FROM dirty
    """
)
def listing_contract_violations(spark, sf_dir):
    """Violations per rule of a deliberately dirty listings table."""
    rate = F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") / 4000)
    dirty = table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 3).alias("listing_id"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("neighbourhood"),
        F.col("c_mktsegment").alias("room_type"), F.col("c_acctbal").alias("price"),
        (F.col("c_custkey") % 7 - 2).alias("accommodates"),
        (F.col("c_nationkey") - 20).alias("min_nights"),
        F.lit(3).alias("number_of_reviews_ltm"), F.lit(True).alias("host_is_superhost"),
        F.lit(None).cast("boolean").alias("instant_bookable"),
        rate.alias("host_response_rate"), rate.alias("host_acceptance_rate"),
        (F.col("c_acctbal") / 1000).alias("review_scores_rating"),
        (F.col("c_custkey") % 11 - 1.0).alias("distance_to_beach_km"),
    )
    return contracts.violations(dirty, contracts.LISTINGS)


@query(
    """
    SELECT unnest(['date not null', 'dow not null', 'dow >= 0', 'dow <= 6', 'unavail_rate not null',
      'unavail_rate >= 0', 'baseline not null', 'event_uplift not null',
      'event_uplift >= -1', 'is_edge not null']) AS rule, CAST(0 AS BIGINT) AS violations
    UNION ALL SELECT 'horizon_days not null', count(*) FILTER (o_orderkey % 6 = 0) FROM orders
    UNION ALL SELECT 'unavail_rate <= 1', count(*) FILTER (o_totalprice / 100000 > 1) FROM orders
    UNION ALL SELECT 'baseline >= 0', count(*) FILTER (o_orderkey % 9 / 8.0 - 0.25 < 0) FROM orders
    UNION ALL SELECT 'baseline <= 1', count(*) FILTER (o_orderkey % 9 / 8.0 - 0.25 > 1) FROM orders
    UNION ALL SELECT 'event_uplift <= 1', count(*) FILTER (o_totalprice / 150000 > 1) FROM orders
    UNION ALL SELECT 'unique date',
      count(*) - count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders
    """
)
def detrended_contract_violations(spark, sf_dir):
    """Violations per rule of a deliberately dirty market series."""
    date = F.to_date("o_orderdate")
    dirty = table(spark, sf_dir, "orders").select(
        date.alias("date"), cal.day_of_week(date).alias("dow"),
        F.when(F.col("o_orderkey") % 6 != 0, F.lit(1)).alias("horizon_days"),
        (F.col("o_totalprice") / 100000).alias("unavail_rate"),
        (F.col("o_orderkey") % 9 / 8.0 - 0.25).alias("baseline"),
        (F.col("o_totalprice") / 150000).alias("event_uplift"), F.lit(False).alias("is_edge"),
    )
    return contracts.violations(dirty, contracts.DETRENDED)


# ---------------------------------------------------------------- builds


@query(
    """
    WITH raw AS (SELECT CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE n_name END AS nb,
      CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS rt, c_acctbal
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT '1998-01-01' AS snapshot_date, 'bound tables' AS source,
      'customer.parquet,lineitem.parquet' AS files,
      (SELECT count(*) FROM raw WHERE c_acctbal > 0 AND nb IS NOT NULL AND rt IS NOT NULL)
        AS n_listings,
      (SELECT count(DISTINCT (l_suppkey, month(l_shipdate), dayofweek(l_shipdate)))
        FROM lineitem) AS n_seasonality_rows,
      (SELECT count(DISTINCT CAST(l_shipdate AS DATE)) FROM lineitem)
        AS n_seasonality_detrended_rows,
      true AS has_estimated_occupancy
    """
)
def market_build_manifest(spark, sf_dir):
    """Curate, validate and publish all four tables, then describe the build."""
    files = raw.fingerprints(spark, [f"{sf_dir}/customer.parquet", f"{sf_dir}/lineitem.parquet"])
    market = publish_market(
        spark, raw_listings(spark, sf_dir), calendar(spark, sf_dir, priced=True), files,
        scratch(spark, "curated"), SNAPSHOT, "bound tables",
    )
    return market.manifest.select(
        "snapshot_date", "source", "n_listings", "n_seasonality_rows",
        "n_seasonality_detrended_rows", "has_estimated_occupancy",
        F.concat_ws(",", F.array_sort(F.array(*[
            F.lit(f.name) for f in market.manifest.schema["raw_files"].dataType.fields
        ]))).alias("files"),
    )


# ---------------------------------------------------------------- exploration


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def category_counts(spark, sf_dir):
    """Rows per category."""
    return explore.category_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@query(
    f"""WITH {LISTINGS_SQL},
    top AS (SELECT neighbourhood, count(*) AS n FROM listings GROUP BY 1
      ORDER BY n DESC, neighbourhood LIMIT 12)
    SELECT neighbourhood, count(*) AS n, round(median(price), 4) AS median_price
    FROM listings SEMI JOIN top USING (neighbourhood) GROUP BY 1
    """
)
def busiest_neighbourhood_prices(spark, sf_dir):
    """Median price of the twelve busiest neighbourhoods."""
    return rounded(explore.median_price_of_top_levels(listings(spark, sf_dir)), 4)


@query(
    f"""WITH {LISTINGS_SQL} SELECT count(*) AS n, round(quantile_cont(price, 0.01), 4)
      AS winsor_low, round(quantile_cont(price, 0.25), 4) AS q1, round(median(price), 4) AS median,
      round(quantile_cont(price, 0.75), 4) AS q3, round(quantile_cont(price, 0.99), 4)
      AS winsor_high FROM listings"""
)
def price_quantile_summary(spark, sf_dir):
    """Median, quartiles and winsor window."""
    return rounded(explore.price_summary(listings(spark, sf_dir)), 4)


@query(
    f"""WITH {LISTINGS_SQL},
    lim AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi
      FROM listings),
    w AS (SELECT least(greatest(price, lo), hi) AS p, lo, (hi - lo) / 60.0 AS width
      FROM listings, lim)
    SELECT CAST(least(floor((p - lo) / width), 59) AS BIGINT) AS bin, count(*) AS n FROM w
    GROUP BY 1
    """
)
def winsorized_price_histogram(spark, sf_dir):
    """Sixty equal-width bins of winsorized price."""
    return explore.price_histogram(listings(spark, sf_dir)).select("bin", "n")


@query(
    f"""WITH {_OCCUPANCY_SQL},
    lim AS (SELECT min(occupancy_est) AS lo, max(occupancy_est) AS hi FROM occupancy)
    SELECT CAST(least(floor((occupancy_est - lo) / ((hi - lo) / 50.0)), 49) AS BIGINT) AS bin,
      count(*) AS n FROM occupancy, lim GROUP BY 1
    """
)
def occupancy_histogram(spark, sf_dir):
    """Fifty equal-width bins of the occupancy estimate."""
    estimate = occ.estimate_occupancy(_reviewed(spark, sf_dir), _booked(spark, sf_dir))
    return explore.fixed_width_histogram(estimate, "occupancy_est", 50).select("bin", "n")


@query(
    f"""WITH {_OCCUPANCY_SQL} SELECT count(*) AS n, round(avg(occupancy_est), 6) AS mean,
    round(median(occupancy_est), 6) AS median, round(max(occupancy_est), 6) AS max
    FROM occupancy"""
)
def occupancy_description(spark, sf_dir):
    """Mean, median and maximum occupancy."""
    estimate = occ.estimate_occupancy(_reviewed(spark, sf_dir), _booked(spark, sf_dir))
    return rounded(explore.describe_column(estimate, "occupancy_est"))


@query(
    f"""WITH {LISTINGS_SQL}, m AS (SELECT neighbourhood, median(price) AS g FROM listings
      GROUP BY 1)
    SELECT listing_id, round(g, 4) AS group_median, round(abs(price - g), 4) AS deviation
    FROM listings JOIN m USING (neighbourhood)
    """
)
def neighbourhood_deviation(spark, sf_dir):
    """Each listing beside its neighbourhood's median price."""
    rows = listings(spark, sf_dir).select("listing_id", "neighbourhood", "price")
    out = explore.group_deviation(rows, "neighbourhood", "price")
    return rounded(out.select("listing_id", "group_median", "deviation"), 4)


# ---------------------------------------------------------------- audits


@query(
    f"""WITH {LISTINGS_SQL}, k AS (SELECT count(*) AS rows FROM listings)
    SELECT 'bedrooms' AS "column", count(*) FILTER (bedrooms IS NULL) AS nulls, count(*) AS rows,
      round(count(*) FILTER (bedrooms IS NULL) / count(*), 6) AS null_share FROM listings
    UNION ALL SELECT 'bathrooms_num', count(*) FILTER (bathrooms_num IS NULL), count(*),
      round(count(*) FILTER (bathrooms_num IS NULL) / count(*), 6) FROM listings
    UNION ALL SELECT 'host_is_superhost', count(*) FILTER (host_is_superhost IS NULL), count(*),
      round(count(*) FILTER (host_is_superhost IS NULL) / count(*), 6) FROM listings
    UNION ALL SELECT 'price', count(*) FILTER (price IS NULL), count(*),
      round(count(*) FILTER (price IS NULL) / count(*), 6) FROM listings
    """
)
def null_profile(spark, sf_dir):
    """NULL share per column."""
    return rounded(
        audits.null_profile(
            listings(spark, sf_dir), ["bedrooms", "bathrooms_num", "host_is_superhost", "price"]
        )
    )


@query(
    """
    SELECT count(*) FILTER (n > 1) AS duplicated_keys, CAST(sum(n - 1) AS BIGINT) AS excess_rows
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    """
)
def duplicate_keys(spark, sf_dir):
    """Keys held by several rows."""
    return audits.duplicate_keys(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


@query(
    """
    WITH parents AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    SELECT count(DISTINCT o_custkey) FILTER (c_custkey IS NULL) AS orphan_keys,
      count(*) FILTER (c_custkey IS NULL) AS orphan_rows, count(*) AS rows,
      round(count(*) FILTER (c_custkey IS NULL) / count(*), 6) AS orphan_share
    FROM orders LEFT JOIN parents ON o_custkey = c_custkey
    """
)
def referential_gap(spark, sf_dir):
    """Orders whose customer was dropped by curation."""
    parents = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("listing_id")
    )
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("listing_id"))
    return rounded(audits.referential_gap(facts, parents, "listing_id"))


@query(
    f"""WITH {CALENDAR_SQL},
    h AS (SELECT date - DATE '{SNAPSHOT}' AS d, available FROM calendar)
    SELECT CASE WHEN d < 30 THEN '0-30' WHEN d < 90 THEN '30-90' WHEN d < 180 THEN '90-180'
      WHEN d < 270 THEN '180-270' ELSE '270-365' END AS horizon, count(*) AS listing_days,
      round(avg(CASE WHEN available = 'f' THEN 1.0 ELSE 0.0 END), 6) AS unavail_rate
    FROM h WHERE d >= 0 AND d < 366 GROUP BY 1
    """
)
def unavailability_by_horizon(spark, sf_dir):
    """Unavailable share by distance from the snapshot."""
    return rounded(audits.unavailability_by_horizon(calendar(spark, sf_dir), SNAPSHOT))


@query(
    """
    WITH t AS (SELECT l_extendedprice AS outcome, p_retailprice AS price, l_quantity AS q
      FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT count(*) AS n,
      round(avg(CASE WHEN abs(outcome - price * q) <= 20000 THEN 1.0 ELSE 0.0 END), 6)
        AS equal_share,
      round(median(outcome / (price * q)), 6) AS median_ratio FROM t
    """
)
def circularity(spark, sf_dir):
    """How far an outcome is just price times quantity."""
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select("l_extendedprice", "p_retailprice", "l_quantity")
    return rounded(
        audits.circularity(
            joined, "l_extendedprice", "p_retailprice", "l_quantity", tolerance=20000.0
        )
    )


_SLOPE_SQL = """
f AS (SELECT ln(o_totalprice) AS x, CAST(o_orderkey % 7 AS DOUBLE) AS z, c_acctbal AS y,
  c_mktsegment AS g FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT x - avg(x) OVER w AS x, z - avg(z) OVER w AS z, y - avg(y) OVER w AS y
  FROM f WINDOW w AS (PARTITION BY g)),
s AS (SELECT sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy,
  sum(z * y) AS zy FROM c)
"""


@query(
    f"""WITH {_SLOPE_SQL}
    SELECT 'alone' AS design, round(xy / xx, 4) AS effect FROM s
    UNION ALL SELECT 'controlled', round((xy * zz - zy * xz) / (xx * zz - xz * xz), 4) FROM s
    """
)
def slope_with_control(spark, sf_dir):
    """One slope with and without a control."""
    frame = stage(
        table(spark, sf_dir, "orders").join(
            table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
        ).select(
            F.ln("o_totalprice").alias("x"),
            F.expr("cast(o_orderkey % 7 as double)").alias("z"),
            F.col("c_acctbal").alias("y"), F.col("c_mktsegment").alias("g"),
        ),
        "slope",
    )
    out = audits.slope_with_control(frame, "y", "x", "z", "g")
    return rounded(out.select("design", "effect"), 4)


@query(
    f"""WITH {_BUCKETED_SQL} SELECT neighbourhood, room_type, cap_bucket, n,
    round(std / mean, 6) AS cv FROM t0 WHERE n >= 30"""
)
def slice_variation(spark, sf_dir):
    """Price CV inside the comparison groups with enough rows."""
    return rounded(audits.slice_variation(listings(spark, sf_dir)))


@query(
    """
    SELECT count(*) AS levels, count(*) FILTER (n = 1) AS singletons,
      count(*) FILTER (n < 5) AS thin_levels
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    """
)
def level_census(spark, sf_dir):
    """Singleton and thin levels."""
    return audits.level_census(table(spark, sf_dir, "orders"), "o_custkey")


@query(
    f"""WITH {_TWO_SQL},
    one AS (SELECT ay / aa AS b1 FROM s),
    e1 AS (SELECT sum(pow(c.y - b1 * c.a, 2)) AS sse1 FROM c, one),
    k AS (SELECT 1 / (1 - pow(corr(a, d), 2)) AS v FROM f)
    SELECT 'distance_to_beach_km' AS feature,
      round(1 - (sse1 / (df + 1)) / (sst / (n - 1)), 8) AS adj_r2_without,
      round(1 - (sse / df) / (sst / (n - 1)), 8) AS adj_r2_with,
      round((sse1 / (df + 1) - sse / df) / (sst / (n - 1)), 8) AS delta,
      round(bd, 8) AS effect, round(v, 8) AS vif
    FROM q, dof, b, e1, k
    """
)
def feature_lift(spark, sf_dir):
    """Adjusted R2 gained by one feature, and its VIF."""
    frame = stage(
        listings(spark, sf_dir).where("price > 0").select(
            F.ln("price").alias("log_price"), "neighbourhood",
            *[F.col(c).cast("double").alias(c) for c in _TWO],
        ),
        "lift",
    )
    return rounded(audits.feature_lift(frame, _TWO, "distance_to_beach_km"), 8)


@query(
    f"""WITH {LISTINGS_SQL} SELECT count(*) AS rows,
    count(*) FILTER (bedrooms IS NULL AND number_of_reviews IS NULL) AS jointly_null,
    round(count(*) FILTER (bedrooms IS NULL AND number_of_reviews IS NULL) / count(*), 6) AS share
    FROM listings"""
)
def jointly_null_cohort(spark, sf_dir):
    """Rows missing several columns at once."""
    return rounded(
        audits.jointly_null(listings(spark, sf_dir), ["bedrooms", "number_of_reviews"])
    )
