import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from peerband.operators import features, hedonic, student
from tests.markets import design, dummy_fit, make_market, to_spark


def frame_of(spark, **columns):
    pdf = pd.DataFrame(columns)
    schema = ", ".join(f"{c} {'string' if pdf[c].dtype == object else 'double'}" for c in pdf)
    return spark.createDataFrame([tuple(r) for r in pdf.astype(object).itertuples(index=False)],
                                 schema)


TOWNS = ("Quay", "Ridge", "Vale")


def line(spark, rows=360, spread=0.15, slope=-0.7, steps=(0.0, 1.1, -0.4), seed=77):
    """Log price falls along a grid of stays; each town has its own level and all share a slope."""
    rng = np.random.default_rng(seed)
    stay = np.linspace(0.5, 3.5, rows)
    town = np.arange(rows) % len(TOWNS)
    y = 9.0 + slope * stay + np.array(steps)[town] + spread * rng.standard_t(12, rows)
    return frame_of(spark, stay=stay, neighbourhood=np.array(TOWNS, dtype=object)[town],
                    log_price=y)


def test_equals_explicit_dummies(spark):
    market = make_market(distance=3.0)
    frame, spec = features.model_matrix(to_spark(spark, market))
    fit = hedonic.fit_hedonic(frame, spec.names)
    x, y, hood = design(market)
    want = dummy_fit(x, y, hood)
    got = {r["feature"]: r for r in fit.coefficients.collect()}
    for name in spec.names:
        assert got[name]["effect"] == pytest.approx(want["beta"][name], abs=1e-8)
        assert got[name]["std_err"] == pytest.approx(want["se"][name], rel=1e-7)
        assert got[name]["ci_low"] < got[name]["effect"] < got[name]["ci_high"]
    effects = {r["neighbourhood"]: r["fixed_effect"] for r in fit.fixed_effects.collect()}
    for level in want["levels"][1:]:
        assert effects[level] == pytest.approx(want["beta"][f"fe_{level}"], abs=1e-8)
    assert fit.intercept == pytest.approx(want["beta"]["const"], abs=1e-8)
    assert fit.adj_r2 == pytest.approx(want["adj_r2"], rel=1e-9)
    assert fit.smearing == pytest.approx(want["smearing"], rel=1e-9)
    assert fit.model_mae == pytest.approx(np.abs(want["resid"]).mean(), rel=1e-9)
    groups = y.groupby(hood).transform("median")
    assert fit.baseline_group_mae == pytest.approx((y - groups).abs().mean(), rel=1e-9)
    assert fit.baseline_median_mae == pytest.approx((y - y.median()).abs().mean(), rel=1e-9)
    vif = {r["feature"]: r["vif"] for r in fit.vif.collect()}
    for name in spec.names:
        others = np.column_stack([np.ones(len(x)), x.drop(columns=name)])
        resid = x[name] - others @ np.linalg.lstsq(others, x[name], rcond=None)[0]
        r2 = 1 - (resid**2).sum() / ((x[name] - x[name].mean()) ** 2).sum()
        assert vif[name] == pytest.approx(1 / (1 - r2), rel=1e-7)


def test_recovers_truth_and_beats_baselines(spark):
    fit = hedonic.fit_hedonic(line(spark), ["stay"])
    row = fit.coefficients.first()
    assert abs(row["effect"] + 0.7) < 4 * row["std_err"] < 0.05 and row["p_value"] < 1e-6
    assert row["ci_low"] < row["effect"] < row["ci_high"] < 0
    steps = {r["neighbourhood"]: r["fixed_effect"] for r in fit.fixed_effects.collect()}
    assert steps == {"Quay": 0.0, "Ridge": pytest.approx(1.1, abs=0.07),
                     "Vale": pytest.approx(-0.4, abs=0.07)}
    assert fit.model_mae < fit.baseline_group_mae < fit.baseline_median_mae


def test_p_values_agree_with_mllib(spark):
    frame = line(spark, rows=45, spread=1.2, slope=0.1).withColumns(
        {t: (F.col("neighbourhood") == t).cast("double") for t in TOWNS[1:]})
    ready = VectorAssembler(inputCols=["stay", *TOWNS[1:]], outputCol="x").transform(frame)
    summary = LinearRegression(featuresCol="x", labelCol="log_price", solver="normal").fit(
        ready).summary
    row = hedonic.fit_hedonic(frame, ["stay"]).coefficients.first()
    assert row["p_value"] == pytest.approx(summary.pValues[0], rel=1e-6)
    assert row["std_err"] == pytest.approx(summary.coefficientStandardErrors[0], rel=1e-8)


def test_a_constant_target_has_no_r2(spark):
    frame = frame_of(spark, a=np.arange(6.0), neighbourhood=np.array(["x"] * 6, dtype=object),
                     log_price=np.full(6, 2.0))
    fit = hedonic.fit_hedonic(frame, ["a"])
    assert fit.r2 is None and fit.adj_r2 is None
    assert fit.summary().first()["adj_r2"] is None


def test_t_distribution_known_values():
    assert student.critical_value(10) == pytest.approx(2.2281388519649385, rel=1e-10)
    assert student.critical_value(1e7) == pytest.approx(1.959964, rel=1e-5)
    assert student.two_sided_p(1.0, 1) == pytest.approx(0.5)
    assert student.two_sided_p(0.0, 5) == 1.0


def test_collinear_pair(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 300), rng.normal(0, 1, 300)
    frame = frame_of(spark, a=a, near=a + rng.normal(0, 1e-3, 300), b=b, same=2 * b,
                     none=np.zeros(300))
    vif = {r[0]: r[1] for r in hedonic.vif_table(frame, ["a", "near", "b"]).collect()}
    assert vif["a"] > 10 and vif["b"] < 5
    exact = {r[0]: r[1] for r in hedonic.vif_table(frame, ["b", "same", "none"]).collect()}
    assert exact == {"b": None, "same": None, "none": None}


def test_rank_deficient_design_predicts_like_the_dummy_fit(spark):
    rng = np.random.default_rng(9)
    n = 200
    a = rng.normal(0, 1, n)
    nb = rng.choice(["A", "B", "C"], n).astype(object)
    y = 1 + a + (nb == "C") * 0.5 + rng.normal(0, 0.1, n)
    x = pd.DataFrame({"a": a, "twice": 2 * a, "zero": 0.0})
    frame = frame_of(spark, **x, neighbourhood=nb, log_price=y, i=np.arange(n, dtype=float))
    fit = hedonic.fit_hedonic(frame, list(x.columns))
    want = dummy_fit(x, pd.Series(y), pd.Series(nb))
    assert fit.rank == 1 and fit.n_rows - fit.rank - fit.n_levels == want["df"]
    assert fit.adj_r2 == pytest.approx(want["adj_r2"], rel=1e-9)
    got = hedonic.predict(frame, fit).orderBy("i").toPandas()["predicted_log_price"]
    assert np.allclose(got, y - want["resid"], atol=1e-8)
    assert dict(zip(fit.names, fit.effects))["zero"] == 0.0


def test_smearing_and_unseen_location(spark):
    fit = hedonic.fit_hedonic(line(spark, rows=900, spread=0.5), ["stay"])
    assert fit.smearing > 1.05
    asked = spark.createDataFrame([("Quay", 2.0), ("Elsewhere", 2.0), (None, 2.0)],
                                  "neighbourhood string, stay double")
    got = {r["neighbourhood"]: r for r in hedonic.predict(asked, fit).collect()}
    assert got["Quay"]["predicted_log_price"] == pytest.approx(9.0 - 1.4, abs=0.1)
    for r in got.values():  # the unknown towns are scored at the baseline town
        assert r["predicted_log_price"] == got["Quay"]["predicted_log_price"]
        assert r["predicted_price"] == pytest.approx(
            np.exp(r["predicted_log_price"]) * fit.smearing)


def test_dominant_location_and_large_offsets(spark):
    rng = np.random.default_rng(2)
    n = 3000
    nb = np.where(rng.random(n) < 0.8, "hot", rng.choice([f"n{i}" for i in range(40)], n))
    x = 1e6 + rng.normal(0, 1, n) + (nb == "hot") * 500
    y = 1e4 + 0.3 * x + rng.normal(0, 1, n)
    fit = hedonic.fit_hedonic(
        frame_of(spark, x=x, neighbourhood=nb.astype(object), log_price=y), ["x"])
    want = dummy_fit(pd.DataFrame({"x": x - 1e6}), pd.Series(y), pd.Series(nb))
    assert fit.effects[0] == pytest.approx(want["beta"]["x"], rel=1e-7)


def test_top_drivers(spark):
    rows = spark.createDataFrame(
        [("a", 0.1, 0.0, 0.0, 0.0, 0.0), ("b", -0.5, 0.0, 0.0, 0.0, 0.0),
         ("c", 0.1, 0.0, 0.0, 0.0, 0.0)], hedonic.COEFFICIENTS)
    got = hedonic.top_drivers(rows, 2).collect()
    assert [r["feature"] for r in got] == ["b", "a"]
    assert got[0]["percent_effect"] == pytest.approx(np.expm1(-0.5))
