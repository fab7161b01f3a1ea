"""Declarative table contracts, checked with one aggregate plus one key count.

A table that is about to be written is measured by that write; only its keys are read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, TEXT = T.LongType(), T.DoubleType(), T.StringType()
BOOL, DATE = T.BooleanType(), T.DateType()


class ContractError(ValueError):
    """A table breaks its contract."""


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    nullable: bool = True
    above: float | None = None  # exclusive
    at_least: float | None = None
    at_most: float | None = None
    required: bool = True

    def rules(self) -> list[tuple[str, Column]]:
        """(rule name, condition of a violating row); NULL never violates a range."""
        col = F.col(self.name)
        out = []
        if not self.nullable:
            out.append((f"{self.name} not null", col.isNull()))
        if self.above is not None:
            out.append((f"{self.name} > {self.above:g}", ~(col > self.above)))
        if self.at_least is not None:
            out.append((f"{self.name} >= {self.at_least:g}", ~(col >= self.at_least)))
        if self.at_most is not None:
            out.append((f"{self.name} <= {self.at_most:g}", ~(col <= self.at_most)))
        return out


@dataclass(frozen=True)
class Contract:
    table: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]


LISTINGS = Contract(
    "listings",
    ("listing_id",),
    (
        Field("listing_id", LONG, nullable=False),
        Field("neighbourhood", TEXT, nullable=False),
        Field("room_type", TEXT, nullable=False),
        Field("price", DOUBLE, nullable=False, above=0),
        Field("accommodates", LONG, at_least=0),
        Field("min_nights", LONG, at_least=0),
        Field("number_of_reviews_ltm", LONG, at_least=0),
        Field("host_is_superhost", BOOL),
        Field("instant_bookable", BOOL),
        Field("host_response_rate", DOUBLE, at_least=0, at_most=1),
        Field("host_acceptance_rate", DOUBLE, at_least=0, at_most=1),
        Field("review_scores_rating", DOUBLE, at_least=0, at_most=5),
        Field("distance_to_beach_km", DOUBLE, at_least=0, required=False),
    ),
)
OCCUPANCY = Contract(
    "occupancy",
    ("listing_id",),
    (
        Field("listing_id", LONG, nullable=False),
        Field("occupancy_est", DOUBLE, nullable=False, at_least=0, at_most=1),
    ),
)
SEASONALITY = Contract(
    "calendar_seasonality",
    ("listing_id", "month", "dow"),
    (
        Field("listing_id", LONG, nullable=False),
        Field("month", LONG, nullable=False, at_least=1, at_most=12),
        Field("dow", LONG, nullable=False, at_least=0, at_most=6),
        Field("median_cal_price", DOUBLE, at_least=0),
        Field("booked_rate", DOUBLE, nullable=False, at_least=0, at_most=1),
    ),
)
DETRENDED = Contract(
    "calendar_seasonality_detrended",
    ("date",),
    (
        Field("date", DATE, nullable=False),
        Field("dow", LONG, nullable=False, at_least=0, at_most=6),
        Field("horizon_days", LONG, nullable=False),
        Field("unavail_rate", DOUBLE, nullable=False, at_least=0, at_most=1),
        Field("baseline", DOUBLE, nullable=False, at_least=0, at_most=1),
        Field("event_uplift", DOUBLE, nullable=False, at_least=-1, at_most=1),
        Field("is_edge", BOOL, nullable=False),
    ),
)


def coerce(df: DataFrame, contract: Contract) -> DataFrame:
    """Cast to the contract's types; extra columns stay, absent optional ones are skipped.

    NaN becomes NULL, so a missing number cannot pass a range check.
    """
    missing = [f.name for f in contract.fields if f.required and f.name not in df.columns]
    if missing:
        raise ContractError(f"{contract.table}: missing column(s) {missing}")
    casts = {}
    for field in contract.fields:
        if field.name in df.columns:
            value = F.col(field.name)
            if isinstance(df.schema[field.name].dataType, (T.DoubleType, T.FloatType)):
                value = F.nanvl(value, F.lit(None).cast("double"))
            casts[field.name] = value.cast(field.type)
    return df.withColumns(casts)


def _rules(df: DataFrame, contract: Contract) -> list[tuple[str, Column]]:
    present = [f for f in contract.fields if f.name in df.columns]
    return [rule for field in present for rule in field.rules()]


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Violating-row count per rule, and repeated keys, as (rule, violations) rows."""
    df = coerce(df, contract)
    rules = _rules(df, contract)
    counts = df.agg(*[F.count_if(bad).alias(f"r{i}") for i, (_, bad) in enumerate(rules)])
    rows = counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
                    for i, (name, _) in enumerate(rules)
                ]
            )
        ).alias("r")
    ).select("r.*")
    return rows.unionByName(repeated_keys(df, contract))


def repeated_keys(df: DataFrame, contract: Contract) -> DataFrame:
    """One row (rule, violations): the rows beyond one of each key."""
    return (
        df.groupBy(*contract.key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        .select(F.lit(f"unique {', '.join(contract.key)}").alias("rule"), "violations")
    )


def _refuse(contract: Contract, rule: str, rows: int) -> None:
    if rows:
        raise ContractError(f"{contract.table}: {rows} row(s) break '{rule}'")


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """The coerced table, or ContractError naming the first broken rule."""
    coerced = coerce(df, contract)
    for row in violations(df, contract).collect():  # one row per rule of the contract
        _refuse(contract, row["rule"], row["violations"])
    return coerced


def write_checked(df: DataFrame, contract: Contract, path: str) -> tuple[DataFrame, int]:
    """Write the coerced table as Parquet; return it read back, and its rows.

    Rows and broken rules are counted by the write itself, and only the keys are read after it. A
    broken rule raises ContractError and leaves what was written.
    """
    coerced = coerce(df, contract)
    rules = _rules(coerced, contract)
    seen = Observation()
    coerced.observe(
        seen, F.count(F.lit(1)).alias("rows"),
        *[F.count_if(bad).alias(f"r{i}") for i, (_, bad) in enumerate(rules)],
    ).write.parquet(path)
    counts = seen.get
    for i, (rule, _) in enumerate(rules):
        _refuse(contract, rule, counts[f"r{i}"])
    written = df.sparkSession.read.parquet(path)
    found = repeated_keys(written, contract).first()
    _refuse(contract, found["rule"], found["violations"])
    return written, counts["rows"]


def validate_listings(df: DataFrame) -> DataFrame:
    return validate(df, LISTINGS)


def validate_occupancy(df: DataFrame) -> DataFrame:
    return validate(df, OCCUPANCY)


def validate_seasonality(df: DataFrame) -> DataFrame:
    return validate(df, SEASONALITY)


def validate_detrended(df: DataFrame) -> DataFrame:
    return validate(df, DETRENDED)
