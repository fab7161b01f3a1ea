"""Searches without lambdas, quantiles from slices, and ladders that move numbers only."""

import math

from pyspark.sql import functions as F

from peerband.operators import distribution as D


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searched_counts_like_a_scan_in_generated_code(spark):
    rows = [([float(i // 2) for i in range(n)], float(v))
            for n in (0, 1, 2, 3, 64, 1000) for v in (-1, 0, 1, 31.5, 32, 499, 1e9)]
    rows += [(None, 1.0), ([1.0], None), ([1.0, float("nan")], float("nan"))]
    df = spark.createDataFrame(rows, "steps array<double>, v double")
    for below in ("<", "<="):
        scan = f"aggregate(steps, 0, (n, x) -> n + if(x {below} v, 1, 0))"
        found = D.searched(df, "got", "steps", "v", below, 1000)
        assert "lambda" not in _plan(found)
        got = found.selectExpr("got", f"coalesce({scan}, 0) as want").collect()
        assert all(r.got == r.want for r in got)


def test_selected_quantiles_are_the_exact_ones(spark):
    inf, nan = math.inf, math.nan
    groups = {
        "one": [3.0], "same": [2.0] * 9, "skew": [*[i / 1e6 for i in range(500)], 1e12],
        "ends": [-inf, 1.0, 2.0, 3.0, inf], "low": [-inf, 1.0, 2.0], "high": [1.0, 2.0, 5.0, inf],
        "wide": [-1.7e308, 0.0, 1.0, 1.7e308], "nan": [1.0, 4.0, 6.0, nan], "zero": [-0.0, 0.0, 1.0],
        None: [5.0, 6.0, 6.0, 7.0], "even": [float(i * i) for i in range(2000)], "none": [None],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = {"q": 0.25, "m": 0.5, "z": 0.9, "lo": 0.0, "hi": 1.0}
    want = {r.g: r for r in D.exact_quantiles(df, ["g"], F.col("v"), probs).collect()}
    got = D.selected_quantiles(df, ["g"], F.col("v"), probs).collect()
    assert len(got) == len(want) == len(groups) - 1
    for r in got:
        assert [str(x) for x in r] == [str(x) for x in want[r.g]], r.g


def test_ladders_move_numbers_of_groups(spark):
    rows = spark.range(300).selectExpr(
        "concat('group ', id % 7) as g", "cast(id as double) as value", "id % 3 + 1 as weight")
    plan = _plan(D.ladders(rows, ["g"]))
    assert "rangepartitioning(group" in plan and "rangepartitioning(g#" not in plan
