import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerband.operators import distribution as dist

PROBS = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 6000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["x", "y", "z"], n))
    value = np.round(rng.lognormal(5, 1, n), 2)
    value[rng.random(n) < 0.3] = 100.0  # one value repeated very often
    frame = pd.DataFrame({"k": key, "v": value})
    frame.loc[rng.random(n) < 0.02, "k"] = None
    return frame, spark.createDataFrame(
        [(None if k is None else k, float(v)) for k, v in zip(frame["k"], frame["v"])],
        "k string, v double",
    )


def test_grouped_quantiles_match_numpy(spark, skewed):
    pdf, sdf = skewed
    got = {r["k"]: r for r in
           dist.exact_quantiles(sdf, ["k"], F.col("v"), PROBS).collect()}
    groups = pdf.assign(k=pdf["k"].fillna("<null>")).groupby("k")["v"]
    assert {k or "<null>" for k in got} == set(groups.groups)
    for k, values in groups:
        row = got[None if k == "<null>" else k]
        assert row["n"] == len(values)
        for name, p in PROBS.items():
            assert row[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_global_quantiles_match_numpy(spark, skewed):
    pdf, sdf = skewed
    row = dist.exact_quantiles(sdf, [], F.col("v"), PROBS).first()
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.quantile(pdf["v"], p), rel=1e-12)


def test_many_large_groups_are_exact(spark):
    """More than a thousand groups, each over several ranges or sharing one."""
    rng = np.random.default_rng(11)
    n = 1200 * 40
    key, value = np.arange(n) % 1200, np.round(rng.normal(0, 50, n), 1)
    df = spark.createDataFrame(pd.DataFrame({"k": key, "v": value}))
    got = {r["k"]: (r["n"], r["m"]) for r in
           dist.exact_quantiles(df, ["k"], F.col("v"), {"m": 0.3}).collect()}
    for k, values in pd.DataFrame({"k": key, "v": value}).groupby("k")["v"]:
        assert got[k] == (40, pytest.approx(np.quantile(values, 0.3), abs=1e-9))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_one_huge_group_is_dealt_to_many_ranges(spark, keys):
    """All rows have one key, and still no range holds more than about its share of them."""
    n, before = 20_000, spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    df = spark.range(n).selectExpr("'one' as k", "cast((id * 7919) % 20011 as double) as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, held = dist.value_ranges(dist.histogram(df, keys, F.col("v")), keys)
        sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert len(sizes) == parts and max(sizes) < 1.5 * n / parts
        starts = [(r["_start"], r["_n"], r["total"]) for r in held.orderBy("_part").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [a for a, _, _ in starts] == [sum(n for _, n, _ in starts[:i]) for i in range(parts)]
    assert {t for *_, t in starts} == {n}
    values = [(i * 7919) % 20011 for i in range(n)]
    got = dist.exact_quantiles(df, keys, F.col("v"), PROBS).first()
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.quantile(values, p))


def test_nothing_but_nulls(spark):
    empty = spark.createDataFrame([("a", None)], "k string, v double")
    row = dist.exact_quantiles(empty, [], F.col("v"), {"m": 0.5}).first()
    assert (row["n"], row["m"]) == (0, None)


def test_share_strictly_below(spark, skewed):
    pdf, sdf = skewed
    hist = dist.histogram(sdf.where("k is not null"), ["k"], F.col("v"))
    targets = [("hot", 100.0), ("hot", 0.0), ("hot", 1e9), ("x", 100.0), ("x", 55.5),
               ("nowhere", 5.0)]
    asked = spark.createDataFrame(targets, "k string, value double")
    got = {(r["k"], r["value"]): r["share"] for r in
           dist.share_below(hist, asked, ["k"]).collect()}
    assert len(got) == len(targets)
    for k, v in targets[:-1]:
        assert got[k, v] == pytest.approx((pdf.loc[pdf["k"] == k, "v"] < v).mean())
    assert got["nowhere", 5.0] is None


def test_top_levels_break_ties_by_name(spark):
    rows = spark.createDataFrame([(x,) for x in "bbaaccd"] + [(None,)], "l string")
    got = [(r["l"], r["n"]) for r in dist.top_levels(rows, "l", 2).collect()]
    assert got == [("a", 2), ("b", 2)]
