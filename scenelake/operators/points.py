"""Point clouds as long tables: fusion, voxels, slices, boxes, projection and distance joins."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.work import batches, gathered, in_order, rounded, stored


def voxel_means(points: DataFrame, size: float, by: Sequence[str] = (), values: Sequence[str] = ("x", "y", "z"), origin: Sequence[float] | None = None) -> DataFrame:
    """Mean of the values in each voxel, with how many points it has.

    Without an origin, voxels begin half a size below each group's least
    coordinates. Means are partial before rows move.
    """
    if origin is None:
        low = points.groupBy(*by).agg(*(F.min(c).alias(f"_{c}") for c in "xyz"))
        points = points.join(low, list(by)) if by else points.crossJoin(F.broadcast(low))
        start = [F.col(f"_{c}") - size / 2 for c in "xyz"]
    else:
        start = [F.lit(float(o)) for o in origin]
    keyed = points.withColumns({f"v{c}": G.cell(F.col(c), size, o) for c, o in zip("xyz", start, strict=True)})
    return keyed.groupBy(*by, "vx", "vy", "vz").agg(*(F.avg(c).alias(c) for c in values), F.count("*").alias("n"))


def every_kth(frames: DataFrame, k: int, index: str = "frame_index") -> DataFrame:
    return frames.filter(F.pmod(F.col(index), F.lit(k)) == 0)


def slice_points(points: DataFrame, low: float | None, high: float | None, axis: str = "y") -> DataFrame:
    """low <= value < high; None is unbounded."""
    if low is not None:
        points = points.filter(F.col(axis) >= low)
    return points.filter(F.col(axis) < high) if high is not None else points


def assign_first(rows: DataFrame, bands: DataFrame, value: str, keys: Sequence[str], margin: float = 0.0) -> DataFrame:
    """Each row with the first band (band, low, high, ord) that holds its value, bounds included; null band without one.

    Bands are few by nature (floors of a building); their number is checked.
    """
    n = bands.count()
    if n > 10_000:
        raise ValueError(f"{n} bands; at most 10000 are sent to the workers")
    listed = bands.agg(F.array_sort(F.collect_list(F.struct("ord", "band", "low", "high"))).alias("_bands"))
    first = F.get(F.filter("_bands", lambda b: (F.col(value) >= b.low - margin) & (F.col(value) <= b.high + margin)), F.lit(0))
    return rows.crossJoin(F.broadcast(listed)).withColumn("band", first.band).drop("_bands")


#: Bands that are sent to the workers at once.
BANDS_AT_ONCE = 1000


def in_bands(rows: DataFrame, bands: DataFrame, value: str, key: str) -> DataFrame:
    """Each row with every band (low, high, further columns) that holds its value, bounds included; bands go in blocks, so any number of them."""
    blocks = max(1, -(-bands.count() // BANDS_AT_ONCE))
    each = [bands if blocks == 1 else bands.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, (rows.join(F.broadcast(b), F.col(value).between(F.col("low"), F.col("high"))) for b in each))


def boxes(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Axis-aligned box, centre of it, point mean and count of each group."""
    aggs = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return points.groupBy(*by).agg(*aggs, F.count("*").alias("n")).withColumns({f"center_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "xyz"})


def from_depth(pixels: DataFrame, frames: DataFrame, low: float, high: float, inclusive: bool = False, scale: float | None = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """Points of pixels (frame_index, u, v, depth, r, g, b) by their frames' pose and k.

    Depths outside the range, bounds excluded or included, give no point;
    colours are divided by 255. The frames' matrices come by an equi-join.
    scale None: each frame's own depth_scale. keep: pixel columns that the points keep.
    """
    own = [] if scale is not None else ["depth_scale"]
    d = F.col("depth") / (F.lit(scale) if scale is not None else F.col("depth_scale"))
    inside = (d >= low) & (d <= high) if inclusive else (d > low) & (d < high)
    rows = pixels.filter(F.col("depth") > 0).join(frames.select("frame_index", "pose", "k", *own), "frame_index").filter(inside)
    world = G.transformed(F.col("pose"), G.unprojected(F.col("u"), F.col("v"), d, F.col("k")))
    return rows.select("frame_index", *keep, *(w.alias(c) for w, c in zip(world, "xyz", strict=True)), *((F.col(c) / 255).alias(c) for c in "rgb" if c in pixels.columns))


def masked_points(pixels: DataFrame, mask: DataFrame, frames: DataFrame, low: float, high: float, scale: float = 1.0) -> DataFrame:
    """Points of the pixels that a mask (frame_index, u, v) holds."""
    return from_depth(pixels.join(mask.select("frame_index", "u", "v").distinct(), ["frame_index", "u", "v"], "left_semi"), frames, low, high, scale=scale)


def projected(points: DataFrame, frames: DataFrame, on: Sequence[str], nearest: float = 0.1) -> DataFrame:
    """Points (of frames with the same `on`) with pixel u, v and depth z in each frame, if in front of the camera and inside."""
    rows = points.join(frames, list(on))
    xyz = G.transformed(G.rigid_inverse(F.col("pose")), [F.col(c) for c in "xyz"])
    rows = rows.withColumns({"cx": xyz[0], "cy": xyz[1], "cz": xyz[2]})
    u, v = G.projected([F.col("cx"), F.col("cy"), F.col("cz")], F.col("k"))
    rows = rows.withColumns({"u": u.cast("int"), "v": v.cast("int")})
    inside = (F.col("cz") > nearest) & (F.col("u") >= 0) & (F.col("u") < F.col("w")) & (F.col("v") >= 0) & (F.col("v") < F.col("h"))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(False)))


def visible_share(points: DataFrame, frames: DataFrame, depth: DataFrame, on: Sequence[str] = ("room_id",), tolerance: float = 0.05) -> DataFrame:
    """object_id, frame_index and the share of all its points that the depth image confirms."""
    seen = projected(points, frames, on).select("object_id", "frame_index", "u", "v", "cz", "inside")
    met = seen.join(depth.select("frame_index", "u", "v", "depth"), ["frame_index", "u", "v"], "left")
    ok = F.col("inside") & (F.col("depth") > 0) & (F.abs(F.col("cz") - F.col("depth")) < tolerance)
    return met.groupBy("object_id", "frame_index").agg(F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("share"))


def pixel_masks(points: DataFrame, frames: DataFrame, on: Sequence[str] = ("room_id",), least: int = 20) -> DataFrame:
    """Pixels of each object in each frame in which at least so many of its points fall."""
    inside = projected(points, frames, on).filter("inside")
    return inside.groupBy("object_id", "frame_index").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.struct("v", "u"))).alias("pixels")).filter(F.col("n") >= least)


def label_boxes(points: DataFrame, frames: DataFrame, on: Sequence[str] = ("room_id",)) -> DataFrame:
    """Box and short label of each object in each frame: 3 points, 1 of 2000 of the image's pixels and sides of 4 at least."""
    inside = projected(points, frames, on).filter("inside")
    out = inside.groupBy("object_id", "label", "frame_index", "h", "w").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{k}") for c in "uv" for k, f in ((1, F.min), (2, F.max))))
    out = out.filter((F.col("n") >= 3) & (F.col("n") >= (0.0005 * F.col("h") * F.col("w")).cast("int")) & (F.col("u2") - F.col("u1") >= 4) & (F.col("v2") - F.col("v1") >= 4))
    return out.withColumn("short", F.substring_index("label", ",", 2))


def near_ratio(a: DataFrame, b: DataFrame, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Share of a's points with a point of b closer than the radius, and the other way, and the greater.

    a and b: by, pid, x, y, z. Points meet through cells of the radius: b's
    points are dealt to the 27 cells around them, a's keep their own, so the
    join is by equal keys, whatever the clouds' sizes.
    """
    cells = lambda df, p: df.select(*by, F.col("pid").alias(f"{p}pid"), *(F.col(c).cast("double").alias(f"{p}{c}") for c in "xyz"), *(G.cell(F.col(c), radius).alias(f"c{c}") for c in "xyz"))

    def matched(p: DataFrame, q: DataFrame) -> DataFrame:
        steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
        around = cells(q, "q")
        for c in "xyz":
            around = around.withColumn("_s", F.explode(steps)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_s")).drop("_s")
        own = cells(p, "p")
        met = own.join(around, [*by, "cx", "cy", "cz"])
        d = sum(((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "xyz"), F.lit(0.0))
        return met.filter(d < radius * radius).select(*by, "ppid").distinct().groupBy(*by).agg(F.count("*").alias("m"))

    def share(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        total = p.groupBy(*by).agg(F.count("*").alias("n"))
        got = matched(p, q)
        joined = total.join(got, list(by), "left") if by else total.crossJoin(got)
        return joined.select(*by, F.try_divide(F.coalesce("m", F.lit(0)), F.col("n")).alias(name))

    x, y = share(a, b, "a_share"), share(b, a, "b_share")
    out = x.join(y, list(by), "full") if by else x.crossJoin(y)
    zero = F.lit(0.0)
    return out.select(*by, F.coalesce("a_share", zero).alias("a_share"), F.coalesce("b_share", zero).alias("b_share"), F.greatest(F.coalesce("a_share", zero), F.coalesce("b_share", zero)).alias("ratio"))


def overlapping_boxes(items: DataFrame, size: float, dims: Sequence[str] = ("x", "y", "z"), by: Sequence[str] = ()) -> DataFrame:
    """Pairs a < b of boxes (id, min_*, max_*) that overlap, through cells of the given size.

    A box goes to each cell that it meets; a pair counts in the cell that holds
    the low corner of what it shares, so no pair appears twice and none is lost.
    """
    first = dims[:2]
    keyed = items
    for c in first:
        keyed = keyed.withColumn(f"_c{c}", F.explode(F.sequence(G.cell(F.col(f"min_{c}"), size), G.cell(F.col(f"max_{c}"), size))))
    side = lambda p: keyed.select(*by, *(f"_c{c}" for c in first), *(F.col(n).alias(f"{p}_{n}") for n in items.columns if n not in by))
    met = side("a").join(side("b"), [*by, *(f"_c{c}" for c in first)]).filter("a_id < b_id")
    for c in dims:
        met = met.filter((F.col(f"a_min_{c}") < F.col(f"b_max_{c}")) & (F.col(f"b_min_{c}") < F.col(f"a_max_{c}")))
    for c in first:
        met = met.filter(F.col(f"_c{c}") == G.cell(F.greatest(f"a_min_{c}", f"b_min_{c}"), size))
    return met.drop(*(f"_c{c}" for c in first))


#: Boxes of a strip, and of a block that it meets at once; pairs whose rounded similarities a task puts in order at once.
BOXES_OF_A_STRIP, BOXES_AT_ONCE, BOX_PAIRS_AT_ONCE = 256, 8192, 1 << 22


def box_similarities(items: DataFrame, contained: bool = False, least: float | None = None, digits: int | None = None) -> DataFrame:
    """a_id, b_id (a_id < b_id) and similarity of boxes (id, min_*, max_*) that overlap: intersection over union, or over the smaller if that is greater.

    Boxes are ordered along x and stored; a task takes strips of them and goes
    through what is stored behind each, block by block, so nothing is dealt by
    cells that many boxes share and each pair is met once. least: only greater
    similarities. Pairs are as many as overlap, a square where boxes crowd; if
    digits are given, they leave a task in stretches ordered by similarity.
    """
    spark, dims = items.sparkSession, [f"{m}_{c}" for m in ("min", "max") for c in "xyz"]
    kind, strip, most, held = dict(items.dtypes)["id"], BOXES_OF_A_STRIP, BOXES_AT_ONCE, BOX_PAIRS_AT_ONCE
    boxes = items.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in dims)).dropna()
    tasks = 4 * spark.sparkContext.defaultParallelism
    ordered = boxes.repartitionByRange(tasks, "min_x").sortWithinPartitions("min_x")
    path = stored(ordered.withColumn("row", F.monotonically_increasing_id()), "boxes")
    kept = spark.read.parquet(path)
    tasks = max(tasks, -(-kept.count() // most))

    def run(parts):
        for columns in in_order(met(parts), digits, held):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a_id", "b_id", "similarity"])

    def met(parts):
        columns = ["row", "id", *dims]
        for mine in gathered(parts, most):
            a = [mine[c].to_numpy() for c in columns]
            cuts = [slice(i, i + strip) for i in range(0, len(a[0]), strip)]
            for block in batches(path, columns, most):
                b = [block[c].to_numpy() for c in columns]
                for cut in cuts:
                    yield from pairs([x[cut] for x in a], b)

    def pairs(a, b):
        mask = b[0] > a[0].min()
        for k in (2, 3, 4):
            mask &= (b[k] < a[k + 3].max()) & (b[k + 3] > a[k].min())
        if not mask.any():
            return
        b = [x[mask] for x in b]
        both = a[0][:, None] < b[0]
        for k in (2, 3, 4):
            both &= a[k][:, None] < b[k + 3]
            both &= b[k] < a[k + 3][:, None]
        i, j = np.nonzero(both)
        va, vb = ((x[5] - x[2]) * (x[6] - x[3]) * (x[7] - x[4]) for x in (a, b))
        for n in range(0, len(i), 262_144):
            p, q = i[n : n + 262_144], j[n : n + 262_144]
            side = [np.minimum(a[k + 3][p], b[k + 3][q]) - np.maximum(a[k][p], b[k][q]) for k in (2, 3, 4)]
            shared = side[0] * side[1] * side[2]
            shared[shared == 0] = np.nan  # too small for a number
            if contained:
                value = np.maximum(shared / (va[p] + vb[q] - shared), shared / np.minimum(va[p], vb[q]))
            else:
                value = shared / (va[p] + vb[q] - shared + 1e-8)
            x, y = a[1][p], b[1][q]
            good = (shared > 0) & (x != y)
            if least is not None:
                good &= value > least
            x, y, value = x[good], y[good], value[good]
            yield np.minimum(x, y), np.maximum(x, y), rounded(value, digits)

    dealt = kept.repartition(tasks, F.floor(F.col("row") / strip)).sortWithinPartitions("row")
    out = dealt.mapInArrow(run, "a_id long, b_id long, similarity double")
    return out.select(F.col("a_id").cast(kind).alias("a_id"), F.col("b_id").cast(kind).alias("b_id"), "similarity")


def box_of(p: str) -> G.Box:
    return [F.col(f"{p}_min_{c}") for c in "xyz"], [F.col(f"{p}_max_{c}") for c in "xyz"]


def rank_window(by: Sequence[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
