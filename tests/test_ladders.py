import numpy as np
import pandas as pd
import pytest

from peerband.operators import distribution as D


def test_search_counts_like_a_scan(spark):
    """By halving: its work depends on ``SEARCH_STEPS``, not on how long the array is."""
    rows = [([float(i // 2) for i in range(n)], float(v))
            for n in (0, 1, 2, 3, 64, 1000) for v in (-1, 0, 1, 31.5, 32, 499, 1e9)]
    rows += [(None, 1.0), ([1.0], None), ([1.0, float("nan")], float("nan"))]
    df = spark.createDataFrame(rows, "steps array<double>, v double")
    for below in ("<", "<="):
        scan = f"aggregate(steps, 0, (n, x) -> n + if(x {below} v, 1, 0))"
        got = df.selectExpr(f"{D.search('steps', 'v', below)} as got",
                            f"coalesce({scan}, 0) as want").collect()
        assert all(r.got == r.want for r in got)


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_ladders_rank_groups_over_batches_and_ranges(spark, batch):
    """One pass over unordered rows with repeated values gives ranks, quantiles and sums."""
    rng = np.random.default_rng(5)
    data = pd.DataFrame({
        "g": ["a"] * 3000 + ["b"] * 40 + ["c"], "h": 1,
        "value": np.round(np.concatenate([rng.normal(0, 9, 3000), rng.normal(5, 1, 40), [7.0]]), 1),
        "weight": rng.integers(1, 4, 3041),
    })
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": batch,
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        leaves = D.stage(D.ladders(spark.createDataFrame(data), ["g", "h"]), "leaves")
        index = D.ladder_index(leaves, ["g", "h"])
        stats = {r.g: r for r in D.ladder_quantiles(
            leaves, index, ["g", "h"], {"q": 0.25, "m": 0.5}, ["sum(sum) as s"]).collect()}
        kept = index.join(leaves.select("id", "steps", "cum"), "id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r.id for r in kept}) == len(kept)
    for g, part in data.groupby("g"):
        every = np.sort(np.repeat(part["value"], part["weight"]))
        mine = sorted((r for r in kept if r.g == g), key=lambda r: r.low)
        assert [x for r in mine for x in r.steps] == sorted(part["value"].unique())
        for r in mine:
            assert r.steps[0] == r.low and r.cum[-1] == r.n and r.total == len(every)
            assert [r.start + c for c in r.cum[:-1]] == np.searchsorted(every, r.steps).tolist()
            inside = every[r.start:r.start + r.n]
            assert r.squares == pytest.approx(((inside - inside.mean()) ** 2).sum(), abs=1e-9)
        assert stats[g].n == len(every) and stats[g].s == pytest.approx(every.sum())
        assert stats[g].q == pytest.approx(np.quantile(every, 0.25))
        assert stats[g].m == pytest.approx(np.quantile(every, 0.5))


def test_ladders_of_no_rows(spark):
    none = spark.createDataFrame([], "g string, value double, weight bigint")
    leaves = D.stage(D.ladders(none, ["g"]), "leaves")
    assert D.ladder_quantiles(leaves, D.ladder_index(leaves, ["g"]), ["g"], {"m": 0.5}).count() == 0
