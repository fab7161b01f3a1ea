"""Fit once, then advise whole tables of requests.

Each request is scored as if it alone had been appended to the market: its own row counts
towards its location's and property type's frequency, and nobody else's.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerband.functions.buckets import capacity_bucket
from peerband.operators import demand as demand_ops
from peerband.operators import features as feature_ops
from peerband.operators import hedonic as hedonic_ops
from peerband.operators import peers as peer_ops
from peerband.operators.distribution import join_same
from peerband.params import CAVEAT, DEFAULTS, Params
from peerband.session import stage

REQUEST_SCHEMA = (
    "request_id long, neighbourhood string, room_type string, property_type string,"
    " accommodates double, bedrooms double, bathrooms_num double, min_nights double,"
    " host_is_superhost boolean, number_of_reviews double, current_price double"
)


@dataclass(frozen=True)
class Advisor:
    """A fitted market: small driver-side scalars, everything level-sized as stored tables."""

    spec: feature_ops.FeatureSpec
    fit: hedonic_ops.HedonicFit
    peers: peer_ops.PeerTables
    params: Params = DEFAULTS

    @property
    def adj_r2(self) -> float:
        return self.fit.adj_r2

    def save(self, path: str) -> None:
        """Write the fitted tables and scalars as Parquet under ``path``."""
        spark = self.peers.leaves.sparkSession
        tables = {
            "coefficients": self.fit.coefficients,
            "fixed_effects": self.fit.fixed_effects,
            "vif": self.fit.vif,
            "neighbourhood_counts": self.spec.neighbourhood_counts,
            "property_counts": self.spec.property_counts,
            "peer_groups": self.peers.groups,
            "peer_leaves": self.peers.leaves,
            **{f"peer_answers_{k}": a for k, a in enumerate(self.peers.answers)},
            "encoding": spark.createDataFrame(
                [(
                    list(self.spec.numeric), self.spec.medians, list(self.spec.room_levels),
                    [level for level, _ in self.spec.property_top],
                    [n for _, n in self.spec.property_top],
                    list(self.spec.property_levels), self.spec.n_rows, list(self.spec.dropped),
                    list(self.fit.names), list(self.fit.effects), self.peers.median,
                    list(self.peers.capacities),
                )],
                "numeric array<string>, medians map<string,double>, room_levels array<string>,"
                " top_levels array<string>, top_counts array<long>,"
                " property_levels array<string>, n_rows long, dropped array<string>,"
                " names array<string>, effects array<double>, median_price double,"
                " capacities array<string>",
            ),
            "scalars": spark.createDataFrame(
                [tuple(float(getattr(self.fit, f)) for f in _SCALARS)],
                ", ".join(f"{f} double" for f in _SCALARS),
            ),
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


_SCALARS = (
    "intercept", "n_rows", "n_levels", "rank", "r2", "adj_r2", "sse", "model_mae",
    "baseline_median_mae", "baseline_group_mae", "smearing",
)
_COUNTS = {"n_rows", "n_levels", "rank"}


def load_advisor(spark: SparkSession, path: str, params: Params = DEFAULTS) -> Advisor:
    def table(name):
        return spark.read.parquet(f"{path}/{name}.parquet")

    enc, sc = table("encoding").first(), table("scalars").first()
    spec = feature_ops.FeatureSpec(
        numeric=tuple(enc["numeric"]),
        medians=dict(enc["medians"]),
        room_levels=tuple(enc["room_levels"]),
        property_top=tuple(zip(enc["top_levels"], enc["top_counts"], strict=True)),
        property_levels=tuple(enc["property_levels"]),
        n_rows=enc["n_rows"],
        dropped=tuple(enc["dropped"]),
        neighbourhood_counts=table("neighbourhood_counts"),
        property_counts=table("property_counts"),
    )
    fit = hedonic_ops.HedonicFit(
        names=tuple(enc["names"]),
        effects=tuple(enc["effects"]),
        coefficients=table("coefficients"),
        fixed_effects=table("fixed_effects"),
        vif=table("vif"),
        factors=spec.factors,
        **{f: int(sc[f]) if f in _COUNTS else sc[f] for f in _SCALARS},
    )
    answers = tuple(
        table(f"peer_answers_{k}") for k in range(len(peer_ops.lookup_columns(params)))
    )
    peers = peer_ops.PeerTables(
        enc["median_price"], tuple(enc["capacities"]), answers, table("peer_groups"),
        table("peer_leaves"),
    )
    return Advisor(spec, fit, peers, params)


def fit_advisor(listings: DataFrame, params: Params = DEFAULTS) -> Advisor:
    """Learn features, fit the regression and reduce the market to peer tables.

    The feature table and the peer histogram are read repeatedly, so each is written once.
    """
    spec = feature_ops.learn_features(listings, params)
    frame = stage(feature_ops.design_frame(listings, spec, params), "features")
    fit = hedonic_ops.fit_hedonic(frame, spec.names, factors=spec.factors)
    fit = dataclasses.replace(fit, fixed_effects=stage(fit.fixed_effects, "fixed_effects"))
    return Advisor(spec, fit, peer_ops.fit_peers(listings, params), params)


def _pooled_location(requests: DataFrame, advisor: Advisor) -> DataFrame:
    """The location a request is modelled at, counting the request's own row."""
    params = advisor.params
    counted = join_same(
        requests, advisor.spec.neighbourhood_counts, ["neighbourhood"], ["n"]
    )
    enough = F.coalesce(F.col("n"), F.lit(0)) + 1 >= params.min_neighbourhood_rows
    pooled = F.when(
        F.col("neighbourhood").isNotNull() & ~enough, params.pooled_level
    ).otherwise(F.col("neighbourhood"))
    return counted.withColumn("_location", pooled).drop("n")


def _kept_property(requests: DataFrame, advisor: Advisor) -> DataFrame:
    """The property level a request keeps, counting the request's own row.

    Only the K + 1 most frequent levels can stand in a level's way, so they are enough.
    """
    params = advisor.params
    level = feature_ops.property_level(params)
    named = requests.withColumn("_property", level)
    counts = advisor.spec.property_counts.select(F.col("property_type").alias("_property"), "n")
    counted = join_same(named, counts, ["_property"], ["n"])
    own = F.coalesce(F.col("n"), F.lit(0)) + 1
    ahead = F.lit(0)
    for other, n in advisor.spec.property_top:
        beats = (F.col("_property") != other) & (
            (F.lit(n) > own) | ((F.lit(n) == own) & (F.lit(other) < F.col("_property")))
        )
        ahead = ahead + beats.cast("int")
    kept = F.when(ahead < params.property_levels, F.col("_property")).otherwise(
        params.pooled_level
    )
    return counted.withColumn("_property", kept).drop("n")


def hedonic_prices(requests: DataFrame, advisor: Advisor) -> DataFrame:
    """Add ``hedonic_price`` and ``neighbourhood_in_model`` to requests."""
    spec, fit, params = advisor.spec, advisor.fit, advisor.params
    ready = _kept_property(_pooled_location(requests, advisor), advisor)
    for name in spec.numeric:
        if name not in ready.columns:  # requests carry no coordinates: the market median
            ready = ready.withColumn(name, F.lit(None).cast("double"))
    design = feature_ops.numbers(spec)
    levels = {feature_ops.ROOM: feature_ops.fold_room(params),
              feature_ops.PROPERTY: F.col("_property")}
    # Numbers under private names: a request keeps its own columns as they came.
    weights = dict(zip(fit.names, fit.effects, strict=True))
    numeric = F.lit(fit.intercept)
    for name, column in design.items():
        numeric = numeric + column * F.lit(weights.pop(name))
    ready, indicated = hedonic_ops.linear_part(
        ready.withColumns(levels), list(weights), list(weights.values()), fit.factors
    )
    log_price = numeric + indicated
    known = fit.fixed_effects.select(
        F.col("neighbourhood").alias("_location"), "fixed_effect", F.lit(True).alias("_seen")
    )
    joined = join_same(ready, known, ["_location"], ["fixed_effect", "_seen"])
    seen = F.coalesce("_seen", F.lit(False)) & F.col("_location").isNotNull()
    price = F.exp(log_price + F.coalesce("fixed_effect", F.lit(0.0))) * F.lit(fit.smearing)
    in_model = seen & F.coalesce(F.col("_location") != params.pooled_level, F.lit(False))
    return joined.select(
        *requests.columns, price.alias("hedonic_price"), in_model.alias("neighbourhood_in_model")
    )


def position_label(percentile: Column, params: Params = DEFAULTS) -> Column:
    return (
        F.when(percentile < params.below_percentile, "below market")
        .when(percentile > params.above_percentile, "above market")
        .otherwise("in line")
    )


def rejection_reason(hedonic: Column, median: Column, iqr: Column, percentile: Column) -> Column:
    """Why a row cannot be priced, or NULL."""

    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return (
        F.when(~finite(hedonic) | ~finite(median), "hedonic price and peer median must be finite")
        .when(median <= 0, "peer median must be positive")
        .when(iqr.isNull() | F.isnan(iqr) | (iqr < 0), "peer IQR must not be negative")
        .when(
            percentile.isNull() | F.isnan(percentile) | ~percentile.between(0.0, 1.0),
            "price percentile must lie in [0, 1]",
        )
    )


def price_range(df: DataFrame, hedonic="hedonic_price", median="shrunk_median", iqr="iqr",
                percentile="price_percentile", params: Params = DEFAULTS,
                on_invalid: str = "raise") -> DataFrame:
    """Add low, anchor, high, position_label.

    ``on_invalid="raise"`` fails the query on a row that cannot be priced; ``"flag"`` keeps it
    with a ``reject_reason`` and no range.
    """
    h, m, i, p = (F.col(c).cast("double") for c in (hedonic, median, iqr, percentile))
    anchor = h * params.model_weight + m * (1 - params.model_weight)
    # Columns of their own, so that what they stand on is computed once for all that use them.
    made = ["_reason", "_anchor", "_half"]
    df = df.withColumns(dict(zip(
        made, (rejection_reason(h, m, i, p), anchor, i * params.band_share_of_iqr)
    )))
    reason, anchor, half = map(F.col, made)
    ranges = {
        "low": F.greatest(anchor - half, anchor * params.floor_share_of_anchor),
        "anchor": anchor,
        "high": anchor + half,
        "position_label": position_label(p, params),
    }
    if on_invalid == "flag":
        return df.withColumns(
            {"reject_reason": reason, **{k: F.when(reason.isNull(), v) for k, v in ranges.items()}}
        ).drop(*made)
    if on_invalid != "raise":
        raise ValueError(f"on_invalid is 'raise' or 'flag', not {on_invalid!r}")
    return df.withColumns(
        {
            k: F.when(reason.isNotNull(), F.raise_error(reason)).otherwise(v)
            for k, v in ranges.items()
        }
    ).drop(*made)


def drivers_column(coefficients: DataFrame, k: int) -> Column:
    """The top drivers as one array value, largest effect first (k entries)."""
    top = hedonic_ops.top_drivers(coefficients, k)
    ordered = F.array_sort(
        F.collect_list(F.struct(F.col("feature").alias("name"), "effect")),
        lambda a, b: F.when(F.abs(a["effect"]) > F.abs(b["effect"]), -1)
        .when(F.abs(a["effect"]) < F.abs(b["effect"]), 1)
        .when(a["name"] < b["name"], -1)
        .otherwise(1),
    )
    return top.agg(ordered.alias("v")).scalar()


def advise(advisor: Advisor, requests: DataFrame, detrended: DataFrame,
           on_invalid: str = "raise") -> DataFrame:
    """One advice row per request: range, peer position, drivers, demand and honesty flags."""
    params = advisor.params
    # A current price of zero or less counts as not given; a NaN as missing.
    given = F.nanvl(F.col("current_price").cast("double"), F.lit(None).cast("double"))
    priced = hedonic_prices(requests, advisor).withColumns(
        {
            "cap_bucket": capacity_bucket(
                F.col("accommodates").cast("double"), params.capacity_buckets
            ),
            "target_price": F.coalesce(F.when(given > 0, given), F.col("hedonic_price")),
        }
    )
    # Written once: the model's price is named many times below, and lookups start from the table.
    placed = peer_ops.position_requests(stage(priced, "priced"), advisor.peers, params)
    context = demand_ops.seasonal_context(detrended, params=params).select(
        F.struct("demand_note", "events", "magnitudes_are_lower_bounds", "dropped_edge",
                 "top_dates")
    ).scalar()
    ranged = price_range(placed, params=params, on_invalid=on_invalid)
    return ranged.withColumns(
        {
            "top_drivers": drivers_column(advisor.fit.coefficients, params.drivers_shown),
            "demand_note": context.getField("demand_note"),
            "events": context.getField("events"),
            "top_dates": context.getField("top_dates"),
            "magnitudes_are_lower_bounds": context.getField("magnitudes_are_lower_bounds"),
            "dropped_edge": context.getField("dropped_edge"),
            "caveats": F.array(F.lit(CAVEAT)),
        }
    ).drop("target_price", "tier")
