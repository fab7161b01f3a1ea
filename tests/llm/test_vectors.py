import math

import numpy as np
import pytest

from peerband.llm import vectors as vec


def brute(rows, cosine):
    """(n_links, component) of each row by comparing all pairs."""
    units = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        v = np.array(v, float) / np.abs(np.array(v, float)).max() if ok else None
        units.append(v / np.linalg.norm(v) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine - 1e-15]
            for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i]] + [label[j] for j in near[i]])
            changed |= low < label[i]
            label[i] = low
    lowest = {}
    for i, (vid, _) in enumerate(rows):
        if vid is not None:
            lowest[label[i]] = min(vid, lowest.get(label[i], vid))
    return [(vid, len(near[i]), lowest.get(label[i])) for i, (vid, _) in enumerate(rows)]


def cloud(rng, n, width, spread):
    centre = rng.normal(size=width)
    return [(centre + rng.normal(size=width) * spread).tolist() for _ in range(n)]


@pytest.mark.parametrize("block", [8, 1024])
def test_links_by_brute_force(spark, block):
    rng = np.random.default_rng(1)
    many = rng.normal(size=(150, 16)).tolist()
    many += cloud(rng, 60, 16, 0.05) + cloud(rng, 25, 16, 0.12)
    many += [many[0]] * 7 + [[2 * x for x in many[1]]]
    many += [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] + [1.0] * 15,
             [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.1], [1e300] * 16, [1e-300] * 16]
    rows = [(i * 3 + 5, v) for i, v in enumerate(many)]
    rows[2] = (None, rows[2][1])
    rows[9] = (rows[8][0], rows[9][1])
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows],
                               "vec_id long, embedding array<double>, key string, n long")
    got = vec.near_vectors(df.repartition(3), block=block).collect()
    want = sorted(brute(rows, 0.95), key=str)
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_empty_table_and_nothing_to_link(spark):
    schema = "vec_id long, embedding array<float>"
    assert vec.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = vec.near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], schema)).collect()
    assert sorted((r.id, r.n_links, r.component_id, r.kept) for r in got) == [
        (1, 0, 1, True), (2, 0, 2, True)]


def test_recall_of_pairs_at_the_limit(spark):
    """Pairs just at the limit are the hardest; at least nine in ten must be found."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.9502 * a + math.sqrt(1 - 0.9502**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in vec.near_vectors(df).collect()) / 2
    assert 0.95 * 400 <= found <= 400


def test_layout_is_calibrated():
    small, large = vec.Layout.calibrated(100), vec.Layout.calibrated(10**8)
    assert small.tables <= large.tables and small.lines < large.lines
    for layout in (small, large):
        missed = (1 - vec.same_cell(math.sqrt(0.1)) ** layout.lines) ** layout.tables
        assert missed <= 0.01 + 1e-12
