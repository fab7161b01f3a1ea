"""Raw dumps to validated curated tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from peerband.operators import calendar as cal
from peerband.operators import contracts
from peerband.operators.listings import curate_listings
from peerband.operators.occupancy import estimate_occupancy
from peerband.params import DEFAULTS, Params
from peerband.session import stage
from peerband.sources import curated, raw


@dataclass(frozen=True)
class Market:
    tables: dict[str, DataFrame]
    manifest: DataFrame


def curate_market(
    raw_listings: DataFrame, raw_calendar: DataFrame, snapshot_date: str, folder: str,
    params: Params = DEFAULTS,
) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The four curated tables and their rows, each written once to ``folder`` and checked."""
    tables, rows = {}, {}

    def add(df: DataFrame, contract: contracts.Contract) -> DataFrame:
        name = contract.table
        tables[name], rows[name] = contracts.write_checked(
            df, contract, f"{folder}/{name}.parquet"
        )
        return tables[name]

    listings = add(curate_listings(raw_listings, params), contracts.LISTINGS)
    cube = add(cal.calendar_cube(raw_calendar), contracts.SEASONALITY)
    add(cal.detrend(raw_calendar, snapshot_date, params.rolling_window), contracts.DETRENDED)
    booked = cal.booked_rate_by_listing(cube)
    add(estimate_occupancy(listings, booked, params), contracts.OCCUPANCY)
    return tables, rows


def publish_market(
    spark: SparkSession, raw_listings: DataFrame, raw_calendar: DataFrame, files: DataFrame,
    out_dir: str, snapshot_date: str, source: str, params: Params = DEFAULTS,
) -> Market:
    """Curate into a folder of its own beside earlier builds, then point to it.

    Fingerprints, contracts and the manifest come first; a failure there publishes nothing. Every
    table is written once, and readers see one whole build at any moment.
    """
    build = curated.Build(spark, out_dir, f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}")
    try:
        files = build.store(files, "raw_files")
        tables, rows = curate_market(
            raw_listings, raw_calendar, snapshot_date, build.path("")[:-1], params
        )
        build.write_manifest(curated.manifest(tables, rows, snapshot_date, source, files))
        build.publish()
    finally:
        build.clear()
    return Market(curated.read_curated(spark, out_dir), curated.read_manifest(spark, out_dir))


def build_market(spark: SparkSession, raw_dir: str, out_dir: str, snapshot_date: str,
                 source: str | None = None, params: Params = DEFAULTS) -> Market:
    """Build and publish a market from ``listings.csv.gz`` and ``calendar.csv.gz``."""
    raw.check_snapshot_date(snapshot_date)
    paths = [f"{raw_dir}/{name}.csv.gz" for name in ("listings", "calendar")]
    listings, calendar = (
        stage(raw.spread(raw.read_text_csv(spark, p)), f"raw_{n}")
        for n, p in zip(("listings", "calendar"), paths, strict=True)
    )
    return publish_market(
        spark, listings, calendar, raw.fingerprints(spark, paths), out_dir, snapshot_date,
        source or paths[0], params,
    )
