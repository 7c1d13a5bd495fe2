"""Oriented boxes against numpy's eigenvectors, and where no direction is unique."""

import numpy as np
import pytest

from scenelake.operators import oriented

DDL = "room string, x double, y double, z double, n int"


def turned(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def plain(points):
    """Center and extents along numpy's eigenvectors, largest variance first."""
    mean = points.mean(0)
    _, v = np.linalg.eigh(np.cov((points - mean).T, bias=True))
    v = v[:, ::-1]
    d = (points - mean) @ v
    return mean + v @ ((d.min(0) + d.max(0)) / 2), np.ptp(d, 0), v


def boxes(spark, groups, **more):
    rows = [(g, *map(float, p), 7) for g, pts in groups.items() for p in pts]
    return {r.room: r for r in oriented.oriented_boxes(spark.createDataFrame(rows, DDL).repartition(3), ["room"], **more).collect()}


def test_rotated_boxes_equal_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {}
    for k, far in enumerate((0, 10, 1e5, -3e4)):
        q = turned(rng)
        groups[f"r{k}"] = rng.uniform(-1, 1, (200, 3)) * [4, 2, 0.5] @ q.T + far
    groups[None] = groups["r1"] + 1
    got = boxes(spark, groups)
    assert got.keys() == groups.keys()
    for g, pts in groups.items():
        center, extent, v = plain(np.asarray(pts))
        r = got[g]
        assert r.oriented and r.n == 200
        assert r.center == pytest.approx(center, abs=1e-5) and r.extent == pytest.approx(extent, abs=1e-5)
        a = np.array(r.axes)
        assert np.abs(a @ v) == pytest.approx(np.eye(3), abs=1e-5) and np.linalg.det(a) == pytest.approx(1, abs=1e-6)


def test_planes_are_flat(spark):
    rng = np.random.default_rng(5)
    q = turned(rng)
    pts = np.column_stack([rng.uniform(-3, 3, 100), rng.uniform(-1, 1, 100), np.zeros(100)]) @ q.T
    r = boxes(spark, {"p": pts})["p"]
    center, extent, _ = plain(pts)
    assert r.oriented and r.extent == pytest.approx(extent, abs=1e-6) and r.center == pytest.approx(center, abs=1e-6) and min(r.extent) < 1e-6


@pytest.mark.parametrize("pts", [[(1, 2, 3)], [(1, 2, 3)] * 9, [(k, 2 * k, 0) for k in range(9)], [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], [(0, 0, 0), (2, 1, 0), (0, 3, 5)]])
def test_fall_back_to_upright_boxes(spark, pts):
    r = boxes(spark, {"g": pts})["g"]
    low, high = np.min(pts, 0), np.max(pts, 0)
    assert not r.oriented and r.axes == np.eye(3).tolist()
    assert r.center == pytest.approx((low + high) / 2, abs=1e-9) and r.extent == pytest.approx(high - low, abs=1e-9)


def test_nulls_and_empty_tables(spark):
    rows = [("a", 0.0, None, 0.0, 1), ("b", None, None, None, 1), ("a", 1.0, 1.0, 1.0, 1)]
    got = oriented.oriented_boxes(spark.createDataFrame(rows, DDL), ["room"]).collect()
    assert [(r.room, r.n, r.center, r.extent) for r in got] == [("a", 1, [1.0] * 3, [0.0] * 3)]
    assert oriented.oriented_boxes(spark.createDataFrame([], DDL), ["room"]).collect() == []
