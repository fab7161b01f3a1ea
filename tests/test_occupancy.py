import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from peerband.operators import occupancy as occ


def keyed(spark, values, name="v"):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"listing_id long, {name} double")


def test_review_proxy(spark):
    rows = keyed(spark, [12, 1000, 0, None], "r")
    got = [x["o"] for x in rows.select("listing_id", occ.review_occupancy(rows["r"]).alias("o"))
           .orderBy("listing_id").collect()]
    assert got == pytest.approx([12 / 0.5 * 4 / 365, 0.70, 0.0, 0.0])


def test_blend_rules(spark):
    listings = keyed(spark, [None, 12, 0, None, None, 1000], "number_of_reviews_ltm")
    booked = spark.createDataFrame(
        [(1, 0.6), (2, 0.2), (4, 0.6), (5, 1.0), (99, 0.9)], "listing_id long, booked_rate double")
    got = {r[0]: r[1] for r in occ.estimate_occupancy(listings, booked).collect()}
    assert got[0] == 0.0  # neither signal
    assert got[1] == pytest.approx((12 * 8 / 365 + 0.6) / 2)
    assert got[2] == pytest.approx(0.1)
    assert got[4] == pytest.approx(0.3)  # no reviews is a real zero
    assert got[5] == 0.70  # capped
    assert set(got) == set(range(6))


def test_agreement_matches_pandas(spark):
    rng = np.random.default_rng(3)
    p = np.clip(rng.normal(0.3, 0.3, 400), 0, 0.7).round(2)
    b = np.clip(p + rng.normal(0, 0.2, 400), 0, 0.699).round(2)
    row = occ.occupancy_agreement(keyed(spark, p, "p"), keyed(spark, b, "b")).first()
    ps, bs = pd.Series(p), pd.Series(b)
    assert row["pearson"] == pytest.approx(ps.corr(bs))
    assert row["spearman"] == pytest.approx(ps.rank().corr(bs.rank()))
    assert row["mae"] == pytest.approx((ps - bs).abs().mean())
    assert row["bias"] == pytest.approx((ps - bs).mean())
    assert row["structural_zero_frac"] == pytest.approx((bs == 0).mean())
    assert row["proxy_cap_hit_frac"] == pytest.approx((ps >= 0.699 - 1e-6).mean())
    assert row["benchmark_cap_hit_frac"] == pytest.approx((bs >= 0.699 - 1e-6).mean())
    assert row["shared_input_warning"] is True and row["n"] == 400


def test_constant_sides_have_no_correlation(spark):
    zeros = [0.0] * 50
    row = occ.occupancy_agreement(keyed(spark, zeros, "p"), keyed(spark, zeros, "b")).first()
    assert (row["pearson"], row["spearman"]) == (None, None)
    assert row["mae"] == 0.0 and row["structural_zero_frac"] == 1.0


def test_known_offset(spark):
    proxy, bench = [0.3] * 80 + [0.0] * 20, [0.2] * 80 + [0.0] * 20
    row = occ.occupancy_agreement(keyed(spark, proxy, "p"), keyed(spark, bench, "b")).first()
    assert row["bias"] == pytest.approx(0.08)
    assert row["structural_zero_frac"] == pytest.approx(0.2)


def test_mismatch_and_empty_fail(spark):
    with pytest.raises(PySparkException, match="one to one"):
        occ.occupancy_agreement(keyed(spark, [0.1, 0.2], "p"), keyed(spark, [0.1], "b")).collect()
    with pytest.raises(PySparkException, match="non-empty"):
        occ.occupancy_agreement(keyed(spark, [], "p"), keyed(spark, [], "b")).collect()
