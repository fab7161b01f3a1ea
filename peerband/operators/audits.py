"""Data-quality and identification checks published with the analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerband.functions import parse
from peerband.functions.buckets import horizon_bucket
from peerband.operators.distribution import exact_quantiles, level_counts
from peerband.operators.gram import Factors, design_moments, solve, vif_values
from peerband.operators.peers import GROUP, with_capacity
from peerband.params import DEFAULTS, Params
from peerband.sources.raw import check_snapshot_date


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL rows and share per column, from one aggregate."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls"))
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("p"),
        "rows",
    ).select(
        "p.column", "p.nulls", "rows",
        F.try_divide(F.col("p.nulls"), F.col("rows")).alias("null_share"),
    )


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, and the rows in excess."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count_if(F.col("n") > 1).alias("duplicated_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"),
        )
    )


def referential_gap(facts: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Keys and rows of ``facts`` without a parent, with the share of all rows.

    Facts are counted per key before the join, so the join sees one row per key.
    """
    per_key = level_counts(facts.where(F.col(key).isNotNull()), key)
    orphans = per_key.join(parents.select(key), key, "left_anti").agg(
        F.count(F.lit(1)).alias("orphan_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
    )
    rows = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return orphans.withColumn("rows", rows.scalar()).withColumn(
        "orphan_share", F.try_divide("orphan_rows", "rows")
    )


def unavailability_by_horizon(calendar: DataFrame, snapshot_date: str) -> DataFrame:
    """Day-weighted unavailable share per distance from the snapshot."""
    check_snapshot_date(snapshot_date)
    date = parse.typed(calendar, "date", parse.date_strict, T.DateType)
    days = F.datediff(date, F.to_date(F.lit(snapshot_date)))
    return (
        calendar.select(
            horizon_bucket(days).alias("horizon"),
            F.when(F.col("available") == "f", 1).otherwise(0).alias("busy"),
        )
        .where("horizon is not null")
        .groupBy("horizon")
        .agg(F.count(F.lit(1)).alias("listing_days"), F.avg("busy").alias("unavail_rate"))
    )


def circularity(df: DataFrame, outcome: str, price: str, quantity: str,
                tolerance: float = 1e-6) -> DataFrame:
    """Share of rows whose outcome is just price times quantity, and the median ratio."""
    product = F.col(price) * F.col(quantity)
    ratio = F.try_divide(F.col(outcome), product)
    rows = df.select(
        ratio.alias("ratio"), (F.abs(F.col(outcome) - product) <= tolerance).alias("equal")
    )
    middle = exact_quantiles(rows, [], F.col("ratio"), {"median_ratio": 0.5})
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.col("equal"), F.lit(False)).cast("double")).alias("equal_share"),
    ).withColumn("median_ratio", middle.select("median_ratio").scalar())


def slope_with_control(features: DataFrame, target: str, slope: str, control: str,
                       group: str) -> DataFrame:
    """One feature's effect without and with a control column, from one scan of sums."""
    moments = design_moments(features, [slope, control], F.col(target), F.col(group))
    rows = []
    for label, names in (("alone", [slope]), ("controlled", [slope, control])):
        fit = solve(moments.only(names))
        rows.append((label, float(fit.effects[0]), fit.r2, fit.adj_r2))
    return features.sparkSession.createDataFrame(
        rows, "design string, effect double, r2 double, adj_r2 double"
    )


def slice_variation(listings: DataFrame, least: int = 30, params: Params = DEFAULTS) -> DataFrame:
    """CV of price inside the finest comparison groups with enough rows."""
    return (
        with_capacity(listings, params)
        .where("price is not null and neighbourhood is not null and room_type is not null"
               " and cap_bucket is not null")
        .groupBy(*GROUP)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.try_divide(F.stddev_samp("price"), F.avg("price")).alias("cv"),
        )
        .where(F.col("n") >= least)
    )


def level_census(df: DataFrame, level: str, thin: int = 5) -> DataFrame:
    """How many levels there are, are singletons, or hold fewer than ``thin`` rows."""
    return level_counts(df.where(F.col(level).isNotNull()), level).agg(
        F.count(F.lit(1)).alias("levels"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(F.col("n") < thin).alias("thin_levels"),
    )


def feature_lift(features: DataFrame, names: Sequence[str], feature: str,
                 group: str = "neighbourhood", target: str = "log_price",
                 factors: Factors | None = None) -> DataFrame:
    """Adjusted R2 with and without one feature, its effect and its VIF, from one scan of sums."""
    names = list(names)
    moments = design_moments(features, names, F.col(target), F.col(group), factors)
    without, full = solve(moments.only([c for c in names if c != feature])), solve(moments)
    at = names.index(feature)
    return features.sparkSession.createDataFrame(
        [(
            feature, without.adj_r2, full.adj_r2,
            None if None in (without.adj_r2, full.adj_r2) else full.adj_r2 - without.adj_r2,
            float(full.effects[at]), vif_values(moments.total[:-1, :-1])[at],
        )],
        "feature string, adj_r2_without double, adj_r2_with double, delta double,"
        " effect double, vif double",
    )


def jointly_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every named column is NULL, and their share."""
    none = F.lit(True)
    for c in columns:
        none = none & F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(none).alias("jointly_null")).select(
        "rows", "jointly_null", F.try_divide("jointly_null", "rows").alias("share")
    )
