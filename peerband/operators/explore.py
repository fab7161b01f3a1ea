"""Descriptive market summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerband.operators.distribution import (
    exact_quantiles,
    histogram_quantiles,
    join_same,
    level_counts,
)
from peerband.params import DEFAULTS, Params
from peerband.session import stage


def category_counts(df: DataFrame, level: str) -> DataFrame:
    """Rows per non-NULL level, most frequent first."""
    return level_counts(df.where(F.col(level).isNotNull()), level).orderBy(F.desc("n"), level)


def value_histogram(df: DataFrame, column: str, *levels: str) -> DataFrame:
    """The stored (levels, value, weight) that the summaries below are read off; NULLs are counted.

    The source is scanned once, and what is stored has a row for each distinct value.
    """
    return stage(
        df.select(*levels, F.col(column).cast("double").alias("value"))
        .groupBy(*levels, "value").agg(F.count(F.lit(1)).alias("weight")),
        "value_histogram",
    )


def median_price_of_top_levels(listings: DataFrame, level: str = "neighbourhood", k: int = 12) -> DataFrame:
    """Median price of the k busiest levels, cheapest first. One scan."""
    hist = value_histogram(listings, "price", level)
    rows = hist.groupBy(level).agg(F.sum("weight").alias("rows")).where(F.col(level).isNotNull())
    top = rows.orderBy(F.desc("rows"), F.asc(level)).limit(k).select(level)
    kept = hist.where("value is not null").join(F.broadcast(top), level, "left_semi")  # k rows
    medians = histogram_quantiles(kept, [level], {"median_price": 0.5})
    return medians.select(level, "n", "median_price").orderBy("median_price", level)


def price_summary(listings: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Median, quartiles and the winsor window of price."""
    probs = {
        "winsor_low": params.winsor_lower, "q1": 0.25, "median": 0.5, "q3": 0.75,
        "winsor_high": params.winsor_upper,
    }
    return exact_quantiles(listings, [], F.col("price"), probs)


def fixed_width_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal-width bin over [min, max]; the last bin is closed. Empty bins are absent."""
    return binned(value_histogram(df, column), bins)


def binned(hist: DataFrame, bins: int) -> DataFrame:
    """``fixed_width_histogram`` of (value, weight)."""
    limits = hist.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("b"))
    limits = limits.scalar()
    lo, hi = limits.getField("lo"), limits.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    place = F.least(F.floor((F.col("value") - lo) / width), F.lit(bins - 1))
    counts = (
        hist.where("value is not null")
        .select(F.when(width > 0, place).otherwise(0).cast("bigint").alias("bin"), "weight")
        .groupBy("bin")
        .agg(F.sum("weight").alias("n"))
    )
    return counts.select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "n",
    )


def price_histogram(listings: DataFrame, bins: int = 60, params: Params = DEFAULTS) -> DataFrame:
    """Histogram of price clipped to its winsor window (a view; the data is not changed)."""
    hist = value_histogram(listings, "price").where("value is not null")
    window = histogram_quantiles(
        hist, [], {"lo": params.winsor_lower, "hi": params.winsor_upper}
    ).select(F.struct("lo", "hi")).scalar()
    clipped = F.least(F.greatest("value", window.getField("lo")), window.getField("hi"))
    return binned(hist.select(clipped.alias("value"), "weight"), bins)


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, exact median and maximum, from one scan."""
    hist = value_histogram(df, column).where("value is not null")
    middle = histogram_quantiles(hist, [], {"median": 0.5}).select("median").scalar()
    stats = hist.agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("n"),
        F.expr("sum(value * weight) / sum(weight)").alias("mean"), F.max("value").alias("max"),
    )
    return stats.select("n", "mean", middle.alias("median"), "max")


def group_deviation(df: DataFrame, group: str, column: str) -> DataFrame:
    """Each row's group median beside it, and the absolute distance to it.

    The rows are needed twice, for the medians and to stand beside them, so they are stored.
    """
    rows = stage(df, "rows")
    medians = exact_quantiles(rows, [group], F.col(column), {"group_median": 0.5})
    return join_same(rows, medians, [group], ["group_median"]).withColumn(
        "deviation", F.abs(F.col(column) - F.col("group_median"))
    )
