import numpy as np
import pandas as pd
import pytest

from peerband.operators import peers
from tests.markets import make_market, peer_table, to_spark

REQUEST = "request_id long, neighbourhood string, room_type string, cap_bucket string," \
          " target_price double"


def requests():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        rows.append((i, str(rng.choice(["Quay", "Ridge", "Vale", "Rare", "Exactly29"])),
                     str(rng.choice(["Entire home/apt", "Private room", "Hotel room"])),
                     str(rng.choice(["1-2", "3-4", "5-6", "7+"])),
                     float(rng.choice([150.0, 400.0, 612.5, 900.0, 5000.0]))))
    rows += [
        (1000, "Nowhere", "Castle", "9-10", 600.0), (1001, None, "Private room", "1-2", 600.0),
        (1002, "Vale", None, "1-2", 600.0), (1003, "Vale", "Private room", None, 600.0),
        (1004, "Nowhere", "Entire home/apt", "3-4", 600.0), (1005, "Vale", "Solo", "7+", 100.0),
    ]
    return rows


def test_positions_equal_a_table_of_all_tiers(spark):
    market = make_market()
    market.loc[len(market)] = {**market.iloc[0], "listing_id": 9999, "neighbourhood": "Vale",
                               "room_type": "Solo", "accommodates": 8.0, "price": 800.0}
    asked = requests()
    got = {r["request_id"]: r for r in peers.peer_positions(
        spark.createDataFrame(asked, REQUEST), to_spark(spark, market)).collect()}
    assert len(got) == len(asked)
    names = [c.split()[0] for c in REQUEST.split(", ")]
    want = peer_table(market, pd.DataFrame(asked, columns=names))
    assert len(want) == len(asked)
    for i, row in want.to_dict("index").items():
        assert got[i]["tier_used"] == row["tier_used"]
        assert got[i]["n_effective"] == row["n_effective"]
        assert got[i]["has_peer_signal"] == (row["n_effective"] > 0)
        for name in ("shrunk_median", "iqr", "price_percentile"):
            assert got[i][name] == pytest.approx(row[name], rel=1e-12, abs=1e-9), (i, name)
        assert got[i]["cv"] == (None if row["cv"] is None else pytest.approx(row["cv"]))
    assert got[1005]["n_effective"] == 1 and got[1005]["cv"] is None
    assert got[1000]["price_percentile"] == 0.5 and got[1000]["has_peer_signal"] is False
    assert "cap_bucket" not in got[1003]["tier_used"]


def test_thin_slice_shrinks(spark):
    rng = np.random.default_rng(7)
    rows = [(float(max(p, 50)), "Quay", "Entire home/apt", "3-4")
            for p in rng.normal(500, 100, 200)]
    rows += [(3000.0, "Quay", "Entire home/apt", "7+"),
             (50.0, "Quay", "Entire home/apt", "7+")]
    market = spark.createDataFrame(
        rows, "price double, neighbourhood string, room_type string, cap_bucket string")
    row = peers.peer_positions(market.where("price = 3000"), market).first()
    assert row["shrunk_median"] < 1200 and row["cv"] is not None


def test_input_order_and_duplicates_do_not_matter(spark):
    market = to_spark(spark, make_market())
    asked = spark.createDataFrame(requests()[:20] * 3, REQUEST)
    got = peers.peer_positions(asked, market)
    assert got.count() == 60 and got.distinct().count() == 20
