import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators.density import density_clusters, neighbouring_cells


def brute_force(points, n, eps, least):
    near = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near @ n >= least
    label = np.where(core, np.arange(len(n)), -1)
    while True:
        new = np.array([min(label[near[i] & core]) if core[i] else -1 for i in range(len(n))])
        if (new == label).all():
            return core, label, [set(label[near[i] & core]) for i in range(len(n))]
        label = new


def compare(spark, rows, eps, least):
    """Core points have the same clusters but for their numbers; others the lowest number within reach, or none."""
    columns = [f"c{i}" for i in range(rows.shape[1])]
    counted, n = np.unique(rows, axis=0, return_counts=True)
    core, label, reach = brute_force(counted, n, eps, least)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{c} double" for c in columns))
    out = {tuple(r[c] for c in columns): (r.n, r.cluster) for r in density_clusters(df, columns, eps, least).collect()}
    assert len(out) == len(counted) and all(out[tuple(p)][0] == k for p, k in zip(counted.tolist(), n))
    ours, names = [out[tuple(p)][1] for p in counted.tolist()], {}
    for i in np.flatnonzero(core):
        assert names.setdefault(label[i], ours[i]) == ours[i]
    assert sorted(names.values()) == list(range(len(names)))
    for i in np.flatnonzero(~core):
        assert ours[i] == min([names[x] for x in reach[i]], default=-1)
    return len(names), int((~core).sum())


@pytest.mark.parametrize(("width", "eps", "least"), [(2, 0.2, 5), (4, 0.5, 5), (4, 0.5, 9)])
def test_against_brute_force(spark, width, eps, least):
    rng = np.random.default_rng(width + least)
    centres = rng.uniform(-2, 2, (6, width))
    rows = np.concatenate([c + rng.normal(scale=eps / 2, size=(70, width)) for c in centres] + [rng.uniform(-3, 3, (60, width))]).round(3)
    rows = np.concatenate([rows, rows[:20]])
    found, others = compare(spark, rows, eps, least)
    assert found > 1 and others > 20


def test_codes_that_lie_on_a_lattice(spark):
    rng = np.random.default_rng(1)
    rows = np.stack([rng.integers(0, 6, 300) * 0.5, rng.integers(0, 3, 300) * 1.2, rng.integers(0, 40, 300) * 0.05], axis=1)
    compare(spark, rows, 0.5, 5)


def test_crowded_and_odd_points(spark):
    one = np.zeros((50, 3))
    assert compare(spark, one, 0.5, 5) == (1, 0)
    assert compare(spark, np.arange(8.0).reshape(8, 1), 0.5, 2) == (0, 8)
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (float("nan"), 1.0)], "x double, y double")
    assert density_clusters(df, ["x", "y"]).count() == 0
    zero = spark.createDataFrame([(0.0,), (-0.0,)] * 3, "x double")
    assert [(r.n, r.cluster) for r in density_clusters(zero, ["x"]).collect()] == [(6, 0)]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5])
def test_neighbouring_cells(spark, width):
    rng = np.random.default_rng(width)
    cells = np.unique(rng.integers(-4, 5, (60, width)), axis=0)
    gap = np.maximum(np.abs(cells[:, None, :] - cells[None, :, :]) - 1, 0)
    want = {(tuple(cells[i].tolist()), tuple(cells[j].tolist())) for i, j in np.argwhere((gap**2).sum(axis=2) <= width)}
    df = spark.createDataFrame([(c.tolist(),) for c in cells], "cell array<long>")
    got = [(tuple(r.a), tuple(r.b)) for r in neighbouring_cells(df, width).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_points_are_never_paired(spark):
    """A crowded cell beside sparse points costs parts of it, not its points."""
    rng = np.random.default_rng(5)
    crowd = rng.uniform(0, 0.3, (3000, 2)).round(6)
    rows = np.concatenate([crowd, [[0.55, 0.1], [0.1, 0.62], [0.79, 0.79], [2.0, 2.0]]])
    columns = ["x", "y"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double")
    out = {(r.x, r.y): r.cluster for r in density_clusters(df, columns, 0.5, 5).collect()}
    assert {out[tuple(map(float, r))] for r in crowd} == {0}
    assert (out[0.55, 0.1], out[0.1, 0.62], out[2.0, 2.0]) == (0, 0, -1)
    assert df.filter(F.col("x") > 1).count() == 1
