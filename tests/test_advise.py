import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from peerband.operators import advise
from peerband.plans.report import persona_report
from tests.markets import design, dummy_fit, expected_advice, make_market, to_spark
from tests.test_demand import series

FIELDS = [c.strip().split()[0] for c in advise.REQUEST_SCHEMA.split(",")]


def request(i, hood="Quay", room="Entire home/apt", kind="Kind 0", guests=4.0, beds=2.0,
            baths=1.0, nights=2.0, superhost=True, reviews=12.0, price=None):
    return (i, hood, room, kind, guests, beds, baths, nights, superhost, reviews, price)


REQUESTS = [
    request(0, price=500.0), request(1, "Ridge", price=700.0), request(2, "Atlantis"),
    request(3, "Atlantis", "Treehouse", "Yurt"), request(4, "Exactly29"), request(5, "Rare"),
    request(6, "Other"), request(7, room="Hotel room"), request(8, kind="Kind 7"),
    request(9, kind="Kind 8"), request(10, kind="Kind 9"), request(11, kind=None),
    request(12, kind="Other"), request(13, beds=None), request(14, baths=None, nights=None),
    request(15, guests=None), request(16, superhost=None), request(17, reviews=0.0),
    request(18, reviews=None), request(19, price=0.0), request(20, price=-5.0),
    request(21, "Vale", "Private room", guests=8.0, price=90.0), request(22, guests=1500.0),
    request(23, None), request(24, room=None), request(25, kind="Brand new"),
]


@pytest.fixture(scope="module")
def calendar(spark):
    return series(spark, ("2026-12-31", 0.30, False), ("2026-12-20", 0.02, False))


@pytest.mark.parametrize("distance", [None, 3.0])
def test_batch_advice_equals_a_table_of_expected_answers(spark, calendar, distance):
    market = make_market(distance=distance)
    advisor = advise.fit_advisor(to_spark(spark, market))
    x, y, hood = design(market)
    fitted = dummy_fit(x, y, hood)
    asked = spark.createDataFrame(REQUESTS, advise.REQUEST_SCHEMA)
    got = {r["request_id"]: r for r in advise.advise(advisor, asked, calendar).collect()}
    assert len(got) == len(REQUESTS)
    named = [dict(zip(FIELDS, values)) for values in REQUESTS]
    wanted = expected_advice(market, fitted, list(x.columns), named)
    assert len(wanted) == len(REQUESTS)
    for i, want in wanted.to_dict("index").items():
        for name, value in want.items():
            if isinstance(value, float):
                assert got[i][name] == pytest.approx(value, rel=1e-7, abs=1e-9), (i, name)
            else:
                assert got[i][name] == value, (i, name)
    assert got[4]["neighbourhood_in_model"] is False  # kept by its own row, but never fitted
    assert got[6]["neighbourhood_in_model"] is False
    first = got[0]
    assert first["low"] <= first["anchor"] <= first["high"] and first["hedonic_price"] > 100
    assert len(first["top_drivers"]) == 5 and "Occupancy" in first["caveats"][0]
    sizes = [abs(d["effect"]) for d in first["top_drivers"]]
    assert sizes == sorted(sizes, reverse=True)
    assert "Réveillon +30%" in first["demand_note"] and first["events"] == {"Réveillon": 0.30}
    lone = got[3]
    assert lone["low"] == lone["anchor"] == lone["high"] and lone["price_percentile"] == 0.5
    assert not hasattr(first, "revpan_max_price")


def test_save_and_load(spark, calendar, tmp_path):
    advisor = advise.fit_advisor(to_spark(spark, make_market()))
    advisor.save(str(tmp_path / "model"))
    again = advise.load_advisor(spark, str(tmp_path / "model"))
    asked = spark.createDataFrame(REQUESTS, advise.REQUEST_SCHEMA)
    key = "request_id"
    one = advise.advise(advisor, asked, calendar).orderBy(key).drop("events").collect()
    two = advise.advise(again, asked, calendar).orderBy(key).drop("events").collect()
    assert one == two and again.adj_r2 == advisor.adj_r2
    report = persona_report(again, calendar).collect()
    assert [r["request_id"] for r in report] == [1, 2, 3, 4]
    assert all(r["low"] <= r["anchor"] <= r["high"] for r in report)


def test_far_market_is_cheaper_without_coordinates(spark, calendar):
    asked = spark.createDataFrame([request(0)], advise.REQUEST_SCHEMA)
    near, far = (
        advise.hedonic_prices(asked, advise.fit_advisor(
            to_spark(spark, make_market(distance=d)))).first()["hedonic_price"]
        for d in (1.0, 9.0)
    )
    assert near > far * 1.03


RANGE = "hedonic_price double, shrunk_median double, iqr double, price_percentile double"


def ranged(spark, *rows, **kwargs):
    return advise.price_range(spark.createDataFrame(list(rows), RANGE), **kwargs).collect()


def test_range_policy(spark):
    got = ranged(spark, (600.0, 400.0, 200.0, 0.1), (600.0, 500.0, 5000.0, 0.5),
                 (600.0, 500.0, 200.0, 0.9), (600.0, 500.0, 200.0, 0.33),
                 (600.0, 500.0, 200.0, 0.66))
    assert got[0]["anchor"] == 500.0 and got[0]["high"] - got[0]["low"] == 200.0
    assert got[1]["low"] == 0.5 * got[1]["anchor"]
    assert [r["position_label"] for r in got] == [
        "below market", "in line", "above market", "in line", "in line"]


BAD = [(600.0, 500.0, -1.0, 0.5), (600.0, 500.0, 1.0, 1.5), (600.0, 0.0, 1.0, 0.5),
       (float("nan"), 500.0, 1.0, 0.5), (600.0, None, 1.0, 0.5), (float("inf"), 500.0, 1.0, 0.5)]


@pytest.mark.parametrize("row", BAD)
def test_bad_rows_fail(spark, row):
    with pytest.raises(PySparkException, match="must"):
        ranged(spark, row)


def test_bad_rows_can_be_kept_with_a_reason(spark):
    got = ranged(spark, *BAD, (600.0, 500.0, 200.0, 0.5), on_invalid="flag")
    assert all(r["reject_reason"] and r["anchor"] is None for r in got[:-1])
    assert got[-1]["reject_reason"] is None and got[-1]["anchor"] == 550.0
    with pytest.raises(ValueError):
        ranged(spark, BAD[0], on_invalid="ignore")
