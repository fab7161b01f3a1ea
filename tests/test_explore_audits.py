import numpy as np
import pytest
from pyspark.sql import functions as F

from peerband.operators import audits, explore
from tests.markets import make_market, to_spark


@pytest.fixture(scope="module")
def pdf():
    return make_market()


@pytest.fixture(scope="module")
def market(spark, pdf):
    return to_spark(spark, pdf)


def test_busiest_levels(market, pdf):
    got = explore.median_price_of_top_levels(market, k=2).collect()
    top = pdf["neighbourhood"].value_counts().head(2).index
    want = pdf[pdf["neighbourhood"].isin(top)].groupby("neighbourhood")["price"].median()
    assert [r["neighbourhood"] for r in got] == list(want.sort_values().index)
    assert [r["median_price"] for r in got] == pytest.approx(sorted(want))


def test_histograms_cover_every_row(spark, market, pdf):
    bins = explore.price_histogram(market, 60).collect()
    assert sum(r["n"] for r in bins) == len(pdf)
    lo, hi = pdf["price"].quantile([0.01, 0.99])
    want, _ = np.histogram(pdf["price"].clip(lo, hi), bins=60)
    got = np.zeros(60, int)
    for r in bins:
        got[r["bin"]] = r["n"]
    assert list(got) == list(want)
    flat = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert [(r["bin"], r["n"]) for r in explore.fixed_width_histogram(flat, "x", 10).collect()] \
        == [(0, 2)]


def test_summaries(market, pdf):
    row = explore.price_summary(market).first()
    assert row["q1"] == pytest.approx(pdf["price"].quantile(0.25))
    assert row["winsor_high"] == pytest.approx(pdf["price"].quantile(0.99))
    described = explore.describe_column(market, "price").first()
    assert described["median"] == pytest.approx(pdf["price"].median())
    assert described["mean"] == pytest.approx(pdf["price"].mean())


def scans(df, path):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[-1].count(path)


def test_summaries_read_their_source_once(spark, pdf, tmp_path, monkeypatch):
    """What is asked of a plan reads stored histograms only; the source was read to store them."""
    path = str(tmp_path / "source.parquet")
    to_spark(spark, pdf).write.parquet(path)
    source, stored = spark.read.parquet(path), []
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    real = explore.stage
    monkeypatch.setattr(explore, "stage", lambda df, n: stored.append(scans(df, path)) or real(df, n))
    for made in (
        explore.median_price_of_top_levels(source, k=2), explore.price_histogram(source, 60),
        explore.describe_column(source, "price"),
        explore.fixed_width_histogram(source, "price", 10),
        explore.group_deviation(source, "neighbourhood", "price"),
    ):
        assert scans(made, path) == 0 and made.count()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert stored == [1] * 5


def test_null_values_and_levels(spark):
    rows = spark.createDataFrame(
        [("a", None), ("a", None), ("a", 4.0), ("b", 1.0), ("b", 3.0), (None, 9.0), (None, 9.0),
         (None, 9.0), (None, 9.0), ("c", None)], "neighbourhood string, price double")
    got = explore.median_price_of_top_levels(rows, k=2).collect()
    assert [tuple(r) for r in got] == [("b", 2, 2.0), ("a", 1, 4.0)]
    assert explore.describe_column(rows.where("price is null"), "price").first()["n"] == 0


def test_audits(spark, market, pdf):
    nulls = {r["column"]: r["nulls"] for r in audits.null_profile(market).collect()}
    assert nulls["bedrooms"] == pdf["bedrooms"].isna().sum() and nulls["price"] == 0
    dup = audits.duplicate_keys(market.unionByName(market.limit(3)), ["listing_id"]).first()
    assert (dup["duplicated_keys"], dup["excess_rows"]) == (3, 3)
    facts = spark.createDataFrame([(1,), (1,), (2,), (10**6,)], "listing_id long")
    gap = audits.referential_gap(facts, market, "listing_id").first()
    assert (gap["orphan_keys"], gap["orphan_rows"], gap["orphan_share"]) == (1, 1, 0.25)
    census = audits.level_census(market, "neighbourhood", thin=20).first()
    assert census["thin_levels"] == (pdf["neighbourhood"].value_counts() < 20).sum()
    joint = audits.jointly_null(
        market.withColumn("x", F.when(F.col("listing_id") < 0, 1)), ["bedrooms", "x"]).first()
    assert joint["jointly_null"] == nulls["bedrooms"]


def test_circularity_and_control(spark):
    rng = np.random.default_rng(4)
    n = 400
    z = rng.normal(0, 1, n)
    x = z + rng.normal(0, 0.5, n)
    y = 2 * z + rng.normal(0, 0.1, n)
    rows = spark.createDataFrame(
        [(float(a), float(b), float(c), "g") for a, b, c in zip(x, z, y)],
        "x double, z double, y double, g string")
    got = {r["design"]: r["effect"] for r in
           audits.slope_with_control(rows, "y", "x", "z", "g").collect()}
    assert got["alone"] > 1.0 and abs(got["controlled"]) < 0.1
    sales = rows.select(F.lit(2.0).alias("p"), F.lit(3.0).alias("q"),
                        F.when(F.col("x") > 0, 6.0).otherwise(12.0).alias("r"))
    row = audits.circularity(sales, "r", "p", "q").first()
    assert row["equal_share"] == pytest.approx((x > 0).mean())
    assert row["median_ratio"] in (1.0, 2.0, 1.5)
