"""Masks as runs against plain pixel arrays."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scenelake.operators import mask_runs as R
from scenelake.operators import masks as M

H, W = 40, 150


def images():
    """Three images: random blobs; nested, equal and touching ones; masks that hold each other in chains."""
    rng = np.random.default_rng(4)
    out = {0: {}, 1: {}, 2: {}}
    for i in range(14):
        m = np.zeros((H, W), bool)
        for _ in range(2):
            y, x = rng.integers(0, H - 12), rng.integers(40, 90)
            m[y : y + rng.integers(3, 12), x : x + rng.integers(5, 60)] = True
        out[0][i] = m
    def box(y0, x0, y1, x1):
        m = np.zeros((H, W), bool)
        m[y0:y1, x0:x1] = True
        return m
    out[1] = {0: box(2, 2, 30, 140), 1: box(5, 5, 20, 80), 2: box(5, 5, 20, 80), 3: box(6, 10, 12, 60), 4: box(5, 80, 20, 120), 5: box(2, 2, 30, 139), 6: np.zeros((H, W), bool)}
    out[2] = {5: box(0, 0, 30, 128), 4: box(1, 1, 25, 100), 3: box(2, 2, 20, 70), 7: box(3, 3, 10, 40), 8: box(4, 4, 8, 20), 1: box(12, 4, 18, 64)}
    return out


@pytest.fixture(scope="module")
def shapes():
    return images()


@pytest.fixture(scope="module")
def runs(spark, shapes):
    rows = [(k, i, int(y), int(x)) for k, ms in shapes.items() for i, m in ms.items() for y, x in np.argwhere(m)]
    return R.line_runs(spark.createDataFrame([*rows, rows[0]], "image_id int, id long, y int, x int").repartition(5)).persist()


def arrays(runs):
    out = {}
    for r in R.run_pixels(runs).collect():
        m = out.setdefault((r.image_id, r.id), np.zeros((H, W), int))
        m[r.y, r.x] += 1
    return out


def test_runs_are_pixels(shapes, runs):
    got = arrays(runs)
    assert all((got.get((k, i), np.zeros((H, W))) == m).all() for k, ms in shapes.items() for i, m in ms.items())
    assert runs.count() < sum(m.sum() for ms in shapes.values() for m in ms.values()) / 10


def test_overlaps(shapes, runs):
    got = {(r.image_id, r.a_id, r.b_id): (r.shared, r.iou) for r in R.run_overlaps(runs).collect()}
    want = {}
    for k, ms in shapes.items():
        for i in ms:
            for j in ms:
                if i < j and (s := int((ms[i] & ms[j]).sum())):
                    want[k, i, j] = (s, s / ((ms[i] | ms[j]).sum() + 1e-6))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


@pytest.mark.parametrize("most", [0.5, 0.2, 0.05])
def test_suppression_in_order_of_scores(spark, shapes, runs, most):
    score = lambda k, i: None if (k, i) == (0, 3) else float((i * 7 + k) % 5)
    df = spark.createDataFrame([(k, i, score(k, i), "x") for k, ms in shapes.items() for i in ms], "image_id int, id long, score double, shared string").repartition(3)
    got = {(r.image_id, r.id) for r in R.suppressed_masks(runs, df, most).collect()}
    want = set()
    for k, ms in shapes.items():
        kept = []
        for i in sorted(ms, key=lambda i: (float("inf") if score(k, i) is None else -score(k, i), i)):
            if all((ms[i] & ms[j]).sum() / ((ms[i] | ms[j]).sum() + 1e-6) <= most for j in kept):
                kept.append(i)
        want |= {(k, i) for i in kept}
    assert got == want and len(want) < len(df.collect())


def test_contained_masks_are_subtracted_in_turn(spark, shapes, runs):
    rows, want = [], {}
    for k, ms in shapes.items():
        boxes = {}
        for i, m in ms.items():
            at = np.argwhere(m)
            y0, x0, y1, x1 = (*at.min(0), *(at.max(0) + 1)) if len(at) else (0, 0, 0, 0)
            boxes[i] = (float(x0), float(y0), float(x1), float(y1))
        rows += [(k, i, *b) for i, b in boxes.items()]
        now = {i: m.copy() for i, m in ms.items()}
        for i in sorted(ms):
            for j in sorted(ms):
                a, b = boxes[i], boxes[j]
                s = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
                if i != j and s > 0.8 * (b[2] - b[0]) * (b[3] - b[1]) and s < 0.7 * (a[2] - a[0]) * (a[3] - a[1]):
                    now[i] &= ~now[j]
        want |= {(k, i): m for i, m in now.items()}
    boxes = spark.createDataFrame(rows, "image_id int, id long, x1 double, y1 double, x2 double, y2 double")
    left = R.subtracted_in_turn(runs, boxes)
    got = arrays(left)
    assert got.keys() == {x for x, m in want.items() if m.any()}
    assert all((got[x] == want[x]).all() for x in got)
    assert any((want[k, i] != m).any() for k, ms in shapes.items() for i, m in ms.items())
    touching = left.alias("a").join(left.alias("b"), F.expr("a.image_id = b.image_id and a.id = b.id and a.y = b.y and a.x1 = b.x0"))
    assert touching.count() == 0
    assert R.subtracted_in_turn(runs.limit(0), boxes).count() == 0


def test_run_length_text(spark, shapes):
    """A known text, and there and back for every mask, an empty and a full one."""
    known = spark.createDataFrame([(0, [6, 1, 40, 4, 5, 4, 5, 4, 21])], "mask_id int, counts array<long>")
    assert known.select(R.coco_text(F.col("counts")).alias("text")).first().text == "61X13mN000`0"
    back = R.coco_counts(spark.createDataFrame([(0, "61X13mN000`0"), (1, ""), (2, None)], "mask_id int, text string"))
    assert {r.mask_id: r.counts for r in back.collect()} == {0: [6, 1, 40, 4, 5, 4, 5, 4, 21], 1: [], 2: []}
    with pytest.raises(PySparkException):
        R.coco_counts(spark.createDataFrame([(0, "61P")], "mask_id int, text string")).collect()
    rng = np.random.default_rng(1)
    masks = [m for ms in shapes.values() for m in ms.values()] + [np.ones((H, W), bool), rng.random((H, W)) < 0.3, rng.random((H, W)) < 0.97]
    pixels = spark.createDataFrame([(n, int(y), int(x)) for n, m in enumerate(masks) for y, x in np.argwhere(m)], "mask_id int, y int, x int")
    size = spark.createDataFrame([(n, H, W) for n in range(len(masks))], "mask_id int, h int, w int")
    counts = M.run_lengths(pixels, size).persist()
    texts = counts.select("mask_id", R.coco_text(F.col("counts")).alias("text"))
    for r in R.coco_counts(texts).collect():
        values = np.arange(len(r.counts)) % 2
        assert (np.repeat(values, r.counts).reshape(W, H).T == masks[r.mask_id]).all()
