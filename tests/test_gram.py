import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerband.operators import advise, audits, features, gram, hedonic
from tests.markets import dummy_fit, make_market, to_spark
from tests.test_hedonic import frame_of


def plans(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    return text, physical


def wide(spark, width, rows=50):
    rng = np.random.default_rng(width)
    columns = {f"x{i}": rng.normal(size=rows) for i in range(width)}
    return frame_of(spark, **columns, g=np.array(["a", "b"] * (rows // 2), dtype=object))


@pytest.mark.parametrize("width", [3, 17, 60, 130])
def test_one_scan_and_one_exchange_at_any_width(spark, width, tmp_path):
    path = str(tmp_path / "wide.parquet")
    wide(spark, width).write.parquet(path)
    frame = spark.read.parquet(path)
    dense = [F.col(f"x{i}") for i in range(width)]
    sums = gram.group_moments(frame, dense, [], F.col("g"))
    _, physical = plans(sums)
    final = physical.split("Initial Plan")[-1]
    assert final.count("FileScan") == 1 and final.count("Exchange") == 1
    assert "Join" not in final
    pdf = frame.toPandas()
    x = np.column_stack([pdf[[f"x{i}" for i in range(width)]], np.ones(len(pdf))])
    for g in ("a", "b"):
        got = np.zeros((width + 1, width + 1))
        for r in sums.where(F.col("g") == g).collect():
            for k, v in enumerate(r["s"]):
                if r["block"] * gram.BLOCK + k <= width:
                    got[r["a"], r["block"] * gram.BLOCK + k] = v
        own = x[(pdf["g"] == g).to_numpy()]
        assert np.allclose(got, own.T @ own, rtol=1e-12, atol=1e-12)


def many_rooms(rows=4000, rooms=201, kinds=7, seed=5):
    """Rents with a level for each of many room types, town and kind; the last room is rare."""
    rng = np.random.default_rng(seed)
    room = rng.integers(0, rooms, rows)
    room[:rooms] = np.arange(rooms)
    kind, town = rng.integers(0, kinds, rows), rng.integers(0, 3, rows)
    stay = rng.uniform(1, 5, rows)
    y = 5 + 0.2 * stay + 0.01 * room - 0.05 * kind + 0.3 * town + rng.normal(0, 0.1, rows)
    return pd.DataFrame({
        "stay": stay, "room": np.char.add("r", room.astype(str)).astype(object),
        "kind": np.char.add("k", kind.astype(str)).astype(object),
        "neighbourhood": np.array(["Quay", "Ridge", "Vale"], dtype=object)[town], "log_price": y,
    })


def test_a_fit_with_201_levels_equals_dummies(spark):
    pdf = many_rooms()
    frame = frame_of(spark, **{c: pdf[c].to_numpy() for c in pdf})
    factors = {
        c: {v: f"{c}_{v}" for v in sorted(pdf[c].unique())[1:]} for c in ("room", "kind")
    }
    names = ["stay", *factors["room"].values(), *factors["kind"].values()]
    fit = hedonic.fit_hedonic(frame, names, factors=factors)
    x = pd.DataFrame({"stay": pdf["stay"], **{
        name: (pdf[c] == v).astype(float) for c, known in factors.items()
        for v, name in known.items()
    }})
    want = dummy_fit(x, pdf["log_price"], pdf["neighbourhood"])
    got = {r["feature"]: r for r in fit.coefficients.collect()}
    for name in names:
        assert got[name]["effect"] == pytest.approx(want["beta"][name], abs=1e-8)
        assert got[name]["std_err"] == pytest.approx(want["se"][name], rel=1e-7)
    assert fit.adj_r2 == pytest.approx(want["adj_r2"], rel=1e-9)
    assert fit.smearing == pytest.approx(want["smearing"], rel=1e-9)
    predicted = hedonic.predict(frame, fit).select("predicted_log_price", "log_price").toPandas()
    assert np.allclose(
        np.sort(predicted["log_price"] - predicted["predicted_log_price"]),
        np.sort(want["resid"]), atol=1e-8,
    )


def test_factors_and_dense_indicators_agree(spark):
    market = to_spark(spark, make_market(distance=2.0))
    spec = features.learn_features(market)
    dense = hedonic.fit_hedonic(features.feature_frame(market, spec), spec.names)
    sparse = hedonic.fit_hedonic(
        features.design_frame(market, spec), spec.names, factors=spec.factors
    )
    assert np.allclose(dense.effects, sparse.effects, rtol=1e-9, atol=1e-10)
    one = {r["feature"]: r for r in dense.coefficients.collect()}
    for r in sparse.coefficients.collect():
        assert r["std_err"] == pytest.approx(one[r["feature"]]["std_err"], rel=1e-9)
    for a, b in zip(sorted(dense.vif.collect()), sorted(sparse.vif.collect())):
        assert a["vif"] == pytest.approx(b["vif"], rel=1e-8)
    assert sparse.adj_r2 == pytest.approx(dense.adj_r2, rel=1e-11)
    assert sparse.model_mae == pytest.approx(dense.model_mae, rel=1e-10)


def test_advice_with_many_room_types(spark):
    """A market of 201 room types is fitted and scored, and the design keeps its width."""
    pdf = make_market(n=2600)
    room = np.array([f"Room {i % 201:03d}" for i in range(len(pdf))], dtype=object)
    market = to_spark(spark, pdf.assign(room_type=room))
    spec = features.learn_features(market)
    assert len(spec.room_levels) == 201
    assert len(features.design_frame(market, spec).columns) < 20
    advisor = advise.fit_advisor(market)
    asked = spark.createDataFrame(
        [(i, "Quay", r, "Kind 0", 4.0, 2.0, 1.0, 2.0, True, 12.0, None)
         for i, r in enumerate(("Room 000", "Room 150", "Unheard of"))], advise.REQUEST_SCHEMA)
    got = {r["request_id"]: r["hedonic_price"]
           for r in advise.hedonic_prices(asked, advisor).collect()}
    effect = dict(zip(advisor.fit.names, advisor.fit.effects))["room_type_Room 150"]
    assert got[1] / got[0] == pytest.approx(np.exp(effect), rel=1e-9)
    assert got[2] == pytest.approx(got[0], rel=1e-12)  # an unknown level is the baseline


def test_too_many_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(features, "MOST_COLUMNS", 1)
    with pytest.raises(ValueError, match="room types"):
        features.learn_features(to_spark(spark, make_market()))
    monkeypatch.setattr(gram, "MOST_COLUMNS", 1)
    with pytest.raises(ValueError, match="columns"):
        gram.design_moments(wide(spark, 3), ["x0", "x1"], F.col("x2"), F.col("g"))


def test_nested_designs_need_one_scan(spark, monkeypatch):
    pdf = many_rooms(600, rooms=4)
    frame = frame_of(spark, **{c: pdf[c].to_numpy() for c in pdf if c != "kind"},
                     other=np.random.default_rng(1).normal(size=600))
    calls, scan = [], gram.group_moments
    monkeypatch.setattr(gram, "group_moments", lambda *a: calls.append(1) or scan(*a))
    factors = {"room": {v: f"room_{v}" for v in ("r1", "r2", "r3")}}
    names = ["stay", "other", "room_r1", "room_r2", "room_r3"]
    lift = audits.feature_lift(frame, names, "stay", factors=factors).first()
    slopes = audits.slope_with_control(frame, "log_price", "stay", "other", "neighbourhood")
    assert len(calls) == 2
    part = [c for c in names if c != "stay"]
    full = hedonic.fit_hedonic(frame, names, factors=factors)
    without = hedonic.fit_hedonic(frame, part, factors=factors)
    assert lift["adj_r2_with"] == pytest.approx(full.adj_r2, rel=1e-9)
    assert lift["adj_r2_without"] == pytest.approx(without.adj_r2, rel=1e-9)
    assert lift["effect"] == pytest.approx(full.effects[0], rel=1e-9)
    alone = hedonic.fit_hedonic(frame, ["stay"])
    row = {r["design"]: r for r in slopes.collect()}["alone"]
    assert row["effect"] == pytest.approx(alone.effects[0], rel=1e-9)
    assert row["r2"] == pytest.approx(alone.r2, rel=1e-9)


def test_vif_of_deficient_designs():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    full = np.column_stack([x, x[:, 0] + x[:, 1], np.zeros(200)])
    c = full - full.mean(axis=0)
    got = gram.vif_values(c.T @ c)
    assert got[0] is got[1] is got[3] is got[4] is None
    rest = np.column_stack([np.ones(200), x[:, :2]])
    resid = x[:, 2] - rest @ np.linalg.lstsq(rest, x[:, 2], rcond=None)[0]
    r2 = 1 - (resid**2).sum() / ((x[:, 2] - x[:, 2].mean()) ** 2).sum()
    assert got[2] == pytest.approx(1 / (1 - r2), rel=1e-9)
