"""Points of frames keep their pixels and scales; labels near an object."""

import numpy as np

from scenelake.operators import points as P
from scenelake.plans.graph import neighbours


def test_points_keep_pixels_and_the_scale_of_their_frame(spark):
    turn = 0.7
    pose = np.eye(4)
    pose[:3, :3] = [[np.cos(turn), 0, np.sin(turn)], [0, 1, 0], [-np.sin(turn), 0, np.cos(turn)]]
    k = np.array([[50.0, 0, 32], [0, 50.0, 24], [0, 0, 1]])
    scales = {1: 1000.0, 30000: 6553.5}
    rows = [(f, u, v, s * (1 + u / 64), 0, 0, 0) for f, s in scales.items() for u in range(64) for v in range(48)]
    pixels = spark.createDataFrame(rows, "frame_index int, u int, v int, depth double, r int, g int, b int")
    frames = spark.createDataFrame([(f, pose.ravel().tolist(), k.ravel().tolist(), s) for f, s in scales.items()], "frame_index int, pose array<double>, k array<double>, depth_scale double")
    got = {(r.frame_index, r.u, r.v): (r.x, r.y, r.z) for r in P.from_depth(pixels, frames, 0.3, 4.0, True, None, keep=("u", "v")).collect()}
    assert len(got) == len(rows)
    for f, u, v, d, *_ in rows[::97]:
        z = d / scales[f]
        at = pose @ np.array([(u - 32) * z / 50, (v - 24) * z / 50, z, 1])
        assert np.allclose(got[f, u, v], at[:3])


def test_neighbours_equal_the_pairs(spark):
    rows = [(1, 10, "a"), (1, 11, "a"), (1, 12, "b"), (1, 13, None), (2, 20, "a"), (3, 30, "c"), (3, 31, "c"), (4, 40, "x"), (4, 41, None)]
    got = {r.object_id: r.nearby for r in neighbours(spark.createDataFrame(rows, "room_id long, object_id long, label string")).collect()}
    want = {i: sorted({y for q, j, y in rows if q == room and j != i and y is not None}) for room, i, _ in rows if sum(q == room for q, *_ in rows) > 1}
    assert got == want
