"""Typed model features from curated listings.

``learn_features`` reads what the encoding needs from the market (medians, levels, counts);
``feature_frame`` applies it. Applying it to a request table later uses the same learned values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerband.functions.buckets import capacity_bucket
from peerband.operators.distribution import (
    histogram,
    histogram_quantiles,
    join_same,
    level_counts,
    top_levels,
)
from peerband.operators.gram import MOST_COLUMNS
from peerband.params import DEFAULTS, Params
from peerband.session import stage

NUMERIC = ("accommodates", "bedrooms", "bathrooms_num", "min_nights")
DISTANCE = "distance_to_beach_km"
FLAGS = ("host_is_superhost", "superhost_missing", "no_review_history")
ROOM, PROPERTY = "room_level", "property_level"


@dataclass(frozen=True)
class FeatureSpec:
    """What the market taught the encoder. Driver-side parts are bounded by the model width."""

    numeric: tuple[str, ...]
    medians: dict[str, float]
    room_levels: tuple[str, ...]  # sorted; the first is the baseline
    property_top: tuple[tuple[str, int], ...]  # the K + 1 most frequent levels with counts
    property_levels: tuple[str, ...]  # after collapsing, sorted; the first is the baseline
    n_rows: int
    dropped: tuple[str, ...]
    neighbourhood_counts: DataFrame
    property_counts: DataFrame

    @property
    def factors(self) -> dict[str, dict[str, str]]:
        """The level columns of ``design_frame``: each level but the first, and its design name."""
        return {
            ROOM: {v: f"room_type_{v}" for v in self.room_levels[1:]},
            PROPERTY: {v: f"property_type_{v}" for v in self.property_levels[1:]},
        }

    @property
    def names(self) -> tuple[str, ...]:
        rooms, kinds = self.factors.values()
        return (*self.numeric, *rooms.values(), *kinds.values(), *FLAGS)


def priced(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("price") > 0)


def _number(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def fold_room(params: Params = DEFAULTS, column: str = "room_type") -> Column:
    """Fold the tiny hotel level into entire homes (features only; peers keep it)."""
    small, into = params.fold_room_type
    return F.when(F.col(column) == small, into).otherwise(F.col(column))


def property_level(params: Params = DEFAULTS) -> Column:
    return F.coalesce(F.col("property_type").cast("string"), F.lit(params.pooled_level))


def collapse_top_levels(df: DataFrame, level: str, k: int, other: str = "Other") -> DataFrame:
    """Keep the k most frequent levels, the rest (and NULL) becoming ``other``."""
    named = df.withColumn(level, F.coalesce(F.col(level), F.lit(other)))
    kept = top_levels(named, level, k).select(F.col(level).alias("_kept"))
    # At most k rows, k a parameter.
    joined = named.join(F.broadcast(kept), F.col(level) == F.col("_kept"), "left")
    return joined.withColumn(level, F.coalesce("_kept", F.lit(other))).drop("_kept")


def pool_rare_levels(df: DataFrame, level: str, counts: DataFrame, least: int,
                     other: str = "Other") -> DataFrame:
    """Levels with fewer than ``least`` rows in ``counts`` become ``other``; NULL stays NULL."""
    joined = join_same(df, counts, [level], ["n"])
    rare = F.col(level).isNotNull() & (F.coalesce(F.col("n"), F.lit(0)) < least)
    return joined.withColumn(level, F.when(rare, other).otherwise(F.col(level))).drop("n")


def column_medians(df: DataFrame, names) -> DataFrame:
    """Exact median of each named column, one row per column with any value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), _number(c).alias("v")) for c in names])
    long = df.select(F.explode(pairs).alias("p")).select("p.name", "p.v")
    return histogram_quantiles(
        histogram(long, ["name"], F.col("v")), ["name"], {"median": 0.5}
    )


def impute_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns(
        {name: F.coalesce(_number(name), F.lit(value)) for name, value in medians.items()}
    )


def learn_features(listings: DataFrame, params: Params = DEFAULTS,
                   use: tuple[str, ...] | None = None) -> FeatureSpec:
    """Read medians, levels and counts. Every collect here is as long as the model is wide."""
    market = priced(listings)
    numeric = tuple(use) if use else NUMERIC + ((DISTANCE,) if DISTANCE in market.columns else ())
    rows = column_medians(market, numeric).collect()
    medians = {r["name"]: r["median"] for r in rows}
    empty = [c for c in numeric if c not in medians]
    if empty:
        raise ValueError(
            f"no priced row has a value of {', '.join(empty)}: "
            "its median, which fills gaps, is unknown"
        )
    levels = F.array(*[
        F.struct(F.lit(kind).alias("kind"), level.alias("level"))
        for kind, level in (
            ("room", fold_room(params)), ("property", property_level(params)),
            ("neighbourhood", F.col("neighbourhood")),
        )
    ])
    # Every count of levels from one scan.
    counts = stage(
        market.select(F.explode(levels).alias("k")).groupBy("k.kind", "k.level")
        .agg(F.count(F.lit(1)).alias("n")),
        "level_counts",
    )
    # A model cannot be wider, so no more levels are ever fetched.
    rooms = [r["level"] for r in counts.where("kind = 'room' and level is not null")
             .limit(MOST_COLUMNS + 1).collect()]
    if len(rooms) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} room types")
    kinds = counts.where("kind = 'property'").select("level", "n")
    top = kinds.orderBy(F.desc("n"), F.asc("level")).limit(params.property_levels + 1).collect()
    kept = {r["level"] for r in top[: params.property_levels]}
    if len(top) > params.property_levels:
        kept.add(params.pooled_level)
    return FeatureSpec(
        numeric=numeric,
        medians={c: medians[c] for c in numeric},
        room_levels=tuple(sorted(rooms)),
        property_top=tuple((r["level"], r["n"]) for r in top),
        property_levels=tuple(sorted(kept)),
        n_rows=kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0],
        dropped=params.excluded_columns,
        neighbourhood_counts=counts.where("kind = 'neighbourhood'").select(
            F.col("level").alias("neighbourhood"), "n"
        ),
        property_counts=kinds.select(F.col("level").alias("property_type"), "n"),
    )


def _flag(cond: Column) -> Column:
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def numbers(spec: FeatureSpec) -> dict[str, Column]:
    """The design columns that hold numbers, for rows of listings or of requests."""
    superhost = _number("host_is_superhost")
    flags = (
        F.coalesce(superhost, F.lit(0.0)),
        superhost.isNull().cast("double"),
        (F.coalesce(_number("number_of_reviews"), F.lit(0.0)) == 0).cast("double"),
    )
    return {
        **{c: F.coalesce(_number(c), F.lit(spec.medians[c])) for c in spec.numeric},
        **dict(zip(FLAGS, flags, strict=True)),
    }


def encode(spec: FeatureSpec, property_kept: Column, params: Params = DEFAULTS) -> list[Column]:
    """All design columns in order, indicators too.

    ``property_kept`` is the row's property level after collapsing.
    """
    number, level = numbers(spec), {ROOM: fold_room(params), PROPERTY: property_kept}
    flags = {
        name: _flag(level[factor] == v)
        for factor, known in spec.factors.items() for v, name in known.items()
    }
    return [(number | flags)[name].alias(name) for name in spec.names]


def _modelled(listings: DataFrame, spec: FeatureSpec, params: Params
              ) -> tuple[DataFrame, list, Column, Column]:
    """Priced rows at pooled locations, their leading columns, property level and guest bucket."""
    market = pool_rare_levels(
        priced(listings), "neighbourhood", spec.neighbourhood_counts,
        params.min_neighbourhood_rows, params.pooled_level,
    )
    kept = [level for level, _ in spec.property_top[: params.property_levels]]
    level = property_level(params)
    collapsed = F.when(level.isin(kept), level).otherwise(params.pooled_level)
    key = ["listing_id"] if "listing_id" in listings.columns else []
    log_price = F.ln(F.col("price").cast("double")).alias("log_price")
    bucket = capacity_bucket(
        F.coalesce(_number("accommodates"), F.lit(spec.medians.get("accommodates"))),
        params.capacity_buckets,
    )
    return market, [*key, log_price, "neighbourhood"], collapsed, bucket.alias("cap_bucket")


def feature_frame(listings: DataFrame, spec: FeatureSpec, params: Params = DEFAULTS) -> DataFrame:
    """listing_id (if any), log_price, pooled neighbourhood, design columns, cap_bucket."""
    market, leading, collapsed, bucket = _modelled(listings, spec, params)
    return market.select(*leading, *encode(spec, collapsed, params), bucket)


def design_frame(listings: DataFrame, spec: FeatureSpec, params: Params = DEFAULTS) -> DataFrame:
    """As ``feature_frame``, with the two level columns of ``spec.factors`` for all indicators.

    Its width does not depend on the number of levels.
    """
    market, leading, collapsed, bucket = _modelled(listings, spec, params)
    return market.select(
        *leading,
        *[c.alias(name) for name, c in numbers(spec).items()],
        fold_room(params).alias(ROOM), collapsed.alias(PROPERTY), bucket,
    )


def model_matrix(listings: DataFrame, params: Params = DEFAULTS) -> tuple[DataFrame, FeatureSpec]:
    spec = learn_features(listings, params)
    return feature_frame(listings, spec, params), spec


def feature_metadata(spec: FeatureSpec, spark) -> DataFrame:
    """One row: model rows, design columns, and columns kept out on purpose."""
    return spark.createDataFrame(
        [(spec.n_rows, list(spec.names), list(spec.dropped))],
        "n_rows long, columns array<string>, dropped array<string>",
    )


def dot(names, weights) -> Column:
    """Linear combination of design columns."""
    terms = [
        "`" + name.replace("`", "``") + f"` * ({float(weight)!r}D)"
        for name, weight in zip(names, weights, strict=True)
        if weight
    ]
    return F.expr(" + ".join(["0D", *terms]))
