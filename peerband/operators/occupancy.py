"""Occupancy proxies and their agreement with a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerband.functions import parse
from peerband.operators.distribution import ranked_values
from peerband.params import DEFAULTS, Params


def review_occupancy(reviews_ltm: Column, params: Params = DEFAULTS) -> Column:
    """Yearly occupancy implied by last year's number of reviews; no reviews is zero."""
    stays = F.coalesce(reviews_ltm, F.lit(0.0)) / params.review_rate
    return F.least(stays * params.nights_per_stay / 365.0, F.lit(params.occupancy_ceiling))


def estimate_occupancy(listings: DataFrame, booked: DataFrame,
                       params: Params = DEFAULTS) -> DataFrame:
    """Mean of the review proxy and the calendar rate; the proxy alone without a calendar.

    A listing with no reviews still contributes a real zero to the mean.
    """
    reviews = parse.typed(
        listings, "number_of_reviews_ltm", parse.to_double, T.NumericType
    ).cast("double")
    proxy = review_occupancy(F.nanvl(reviews, F.lit(None).cast("double")), params)
    joined = listings.select("listing_id", proxy.alias("_proxy")).join(
        booked.select("listing_id", "booked_rate"), "listing_id", "left"
    )
    mixed = F.when(F.col("booked_rate").isNull(), F.col("_proxy")).otherwise(
        (F.col("_proxy") + F.col("booked_rate")) / 2
    )
    bounded = F.greatest(F.lit(0.0), F.least(mixed, F.lit(params.occupancy_ceiling)))
    return joined.select("listing_id", bounded.alias("occupancy_est"))


def _mean_ranks(pairs: DataFrame, side: str) -> DataFrame:
    """Average rank of each distinct value of one side, centred on zero."""
    values = (
        pairs.where(F.col("p").isNotNull() & F.col("b").isNotNull())
        .groupBy(F.col(side).alias("value"))
        .agg(F.sum("weight").alias("weight"))
    )
    return ranked_values(values, []).select(
        F.col("value").alias(f"_{side}_value"),
        (F.col("below") + (F.col("weight") + 1) / 2 - (F.col("total") + 1) / 2).alias(
            f"{side}_rank"
        ),
    )


def occupancy_agreement(proxy: DataFrame, benchmark: DataFrame, key: str = "listing_id",
                        ceiling: float = DEFAULTS.benchmark_ceiling) -> DataFrame:
    """One row of error, correlation and ceiling shares for two keyed occupancy columns.

    ``proxy`` and ``benchmark`` are (key, value) frames. A key on one side only, or no rows at
    all, fails the query. Correlations are NULL when either side is constant.
    """
    p_name = next(c for c in proxy.columns if c != key)
    b_name = next(c for c in benchmark.columns if c != key)
    left = proxy.select(F.col(key), F.col(p_name).cast("double").alias("p"), F.lit(1).alias("_l"))
    right = benchmark.select(
        F.col(key), F.col(b_name).cast("double").alias("b"), F.lit(1).alias("_r")
    )
    # One row per distinct pair: repeated values (zeros, ceilings) collapse map-side.
    pairs = (
        left.join(right, key, "full")
        .groupBy("p", "b")
        .agg(
            F.count(F.lit(1)).alias("weight"),
            F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unmatched"),
        )
    )
    p, b, w = F.col("p"), F.col("b"), F.col("weight")
    top = F.lit(ceiling - 1e-6)

    def mean(x):
        return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))

    def share(cond):
        return F.try_divide(F.sum(F.when(cond, w).otherwise(0)), F.sum(w))

    both = p.isNotNull() & b.isNotNull()
    wb = F.when(both, w)
    basics = pairs.agg(
        F.coalesce(F.sum("unmatched"), F.lit(0)).alias("unmatched"),
        F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("n"),
        mean(F.abs(p - b)).alias("mae"),
        mean(p - b).alias("bias"),
        share(b == 0).alias("structural_zero_frac"),
        share(p >= top).alias("proxy_cap_hit_frac"),
        share(b >= top).alias("benchmark_cap_hit_frac"),
        ((F.min(p) < F.max(p)) & (F.min(b) < F.max(b))).alias("varies"),
        F.try_divide(F.sum(p * wb), F.sum(wb)).alias("mean_p"),
        F.try_divide(F.sum(b * wb), F.sum(wb)).alias("mean_b"),
    )
    centre = basics.select(F.struct("mean_p", "mean_b")).scalar()

    def correlation(x, y):
        return F.try_divide(
            F.sum(x * y * w), F.sqrt(F.sum(x * x * w)) * F.sqrt(F.sum(y * y * w))
        )

    complete = pairs.where(both)
    ranked = (
        complete.join(_mean_ranks(pairs, "p"), p == F.col("_p_value"))
        .join(_mean_ranks(pairs, "b"), b == F.col("_b_value"))
    )
    linear = complete.agg(
        correlation(p - centre.getField("mean_p"), b - centre.getField("mean_b")).alias("r")
    ).scalar()
    monotone = ranked.agg(correlation(F.col("p_rank"), F.col("b_rank")).alias("r")).scalar()
    checked = (
        F.when(F.col("n") == 0, F.raise_error(F.lit("agreement needs non-empty inputs")))
        .when(F.col("unmatched") > 0, F.raise_error(F.lit("keys do not match one to one")))
        .otherwise(F.lit(True))
        .cast("boolean")
    )
    return basics.where(checked).select(
        F.when(F.col("varies"), linear).alias("pearson"),
        F.when(F.col("varies"), monotone).alias("spearman"),
        "mae",
        "bias",
        "structural_zero_frac",
        "proxy_cap_hit_frac",
        "benchmark_cap_hit_frac",
        F.lit(True).alias("shared_input_warning"),
        "n",
    )
