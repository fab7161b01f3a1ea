import numpy as np
import pytest
from pyspark.sql import types as T

from peerband.llm import whitening as wh
from tests.llm.shapes import rows_of

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("id", T.StringType()),
    T.StructField("v", T.StringType()),
    T.StructField("width", T.LongType()),
    T.StructField("a.b c", T.StringType()),
])


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v],
             "7", "v", i, "c") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(vectors):
    """Distinct integer rows, their mean, and the eigenpairs of the explicit covariance."""
    x = np.floor(256 * np.array(vectors, np.float32).astype(float))
    u = np.unique(x, axis=0)
    c = u - u.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(u))
    return x.astype(np.int64), u.astype(np.int64), values[::-1], axes[:, ::-1]


def spread(rng, n, width):
    """Vectors whose variances fall slowly, so that the filter has work to do."""
    return rng.normal(size=(n, width)) * np.linspace(0.4, 0.3, width)


@pytest.mark.parametrize("n,width,copies", [(400, 40, 3), (60, 20, 1), (30, 3, 5), (12, 25, 2)])
def test_whitening_equals_the_explicit_eigenvectors(spark, n, width, copies):
    rng = np.random.default_rng(n)
    base = spread(rng, n, width).astype(np.float32)
    vectors = np.concatenate([base, np.repeat(base[:5], copies - 1, axis=0)])
    got = wh.whiten(frame(spark, list(enumerate(vectors)))).toPandas()
    x, u, values, axes = plain(vectors)
    k = min(4, width)
    assert sorted(got.component.unique()) == list(range(1, k + 1))
    assert len(got) == k * len(vectors) and (got.n == len(u)).all()
    sums = u.sum(axis=0)
    far = ((len(u) * x - sums) ** 2).sum(axis=1)
    for c in range(k):
        some = got[got.component == c + 1].sort_values("id")
        want = (x - u.mean(axis=0)) @ axes[:, c] / np.sqrt(values[c])
        sign = np.sign(want @ some.whitened.to_numpy())
        assert np.abs(sign * some.whitened.to_numpy() - want).max() < 1e-9
        assert np.allclose(some.explained, values[c] / values.sum(), rtol=1e-12)
        assert [int(d) for d in some.deviation] == far.tolist()
    assert (got.identity_error < 1e-9).all() and got.identity_error.nunique() == 1


def test_filter_is_used_and_certified(spark):
    rng = np.random.default_rng(5)
    vectors = spread(rng, 500, 48)
    source = frame(spark, list(enumerate(vectors))).selectExpr("cast(embedding as array<double>) v")
    model = wh.fit_whitener(wh.fit_list(source).persist(), 48)
    assert model.rounds >= 1 and model.residuals.max() <= wh.STALLED


def test_chebyshev_damps_the_unwanted_spectrum():
    values = np.array([10.0, 8, 5, 4, 3, 2])
    block = np.eye(6)
    out = np.diag(wh.chebyshev(lambda b: values[:, None] * b, block, values[:, None] * block,
                               2.0, 5.0, 10.0, 8))
    assert out[0] == pytest.approx(1.0)
    assert np.abs(out[2:]).max() < 1e-4 < out[1]


def test_floor_is_below_the_smallest_variance():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 30))
    v = a.T @ a / 200
    assert 0 <= wh.spectrum_floor(lambda b: v @ b, rng.normal(size=30)) <= np.linalg.eigvalsh(v)[0]


def test_bad_vectors_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [(n, v) for n, v in enumerate(spread(rng, 40, 6))]
    other = [(n, v) for n, v in enumerate(spread(rng, 20, 2), 100)]
    bad = [(50, None), (51, []), (52, [nan] * 6), (53, [1, 2, 3, 4, 5, inf]),
           (54, [1, None, 3, 4, 5, 6]), (55, [None] * 6)]
    odd = [(None, good[0][1]), (3, good[3][1]), (3, good[3][1])]
    got = wh.whiten(frame(spark, good + bad + odd + other)).toPandas()
    assert set(got.id.dropna()) == {float(n) for n, _ in good + other}
    assert (got[got.id < 100].n == 40).all() and (got[got.id >= 100].n == 20).all()
    assert got.id.isna().sum() == 4 and (got.id == 3).sum() == 12
    nulls = got[got.id.isna()].sort_values("component").whitened.to_numpy()
    assert (nulls == got[got.id == 0].sort_values("component").whitened.to_numpy()).all()
    assert got[got.id >= 100].component.max() == 2


def test_no_variance_gives_no_components(spark):
    assert wh.whiten(frame(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    assert wh.whiten(frame(spark, [])).count() == 0
    line = [(n, [n, 2 * n, 3 * n]) for n in range(20)]
    got = wh.whiten(frame(spark, line)).toPandas()
    assert (got.component == 1).all() and np.allclose(got.explained, 1.0)


def test_large_entries_are_exact(spark):
    vectors = [(1, [1e12, 3]), (2, [-2e12, 5]), (3, [5e11, 9]), (4, [3e38, 1])]
    got = wh.whiten(frame(spark, vectors[:3])).toPandas()
    x, u, *_ = plain([v for _, v in vectors[:3]])
    sums = [sum(int(r[j]) for r in u) for j in range(2)]
    want = {i: sum((3 * int(r[j]) - sums[j]) ** 2 for j in range(2)) for i, r in zip((1, 2, 3), x)}
    assert {r.id: int(r.deviation) for r in got.itertuples()} == want
    assert wh.whiten(frame(spark, vectors)).where("id = 4").count() >= 1


def test_smallest_integer_kind_holds_every_row():
    rows = np.array([[1, -5], [40000, 0], [2**40, 1], [-2**15, 2**15 - 1]], np.int64)
    assert wh._kind(rows).tolist() == [0, 1, 2, 0]


def test_rows_of_one_vector_agree(spark):
    got = wh.whiten(frame(spark, [(n, [n % 3, n % 2, 1]) for n in range(12)]))
    by = {}
    for i, c, w in rows_of(got, "id", "component", "whitened"):
        by.setdefault((i % 6, c), set()).add(w)
    assert all(len(v) == 1 for v in by.values())
