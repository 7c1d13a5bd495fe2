"""Gap clusters, density clusters, robust scaling, medoids and height histograms."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vectors as V


def gap_clusters(rows: DataFrame, by: Sequence[str], value: str, gap: float, ties: Sequence[str] = ()) -> DataFrame:
    """Cluster numbers from 0 along a value, split where neighbours are more than gap apart (density clusters in one dimension of at least one point)."""
    w = Window.partitionBy(*by).orderBy(value, *ties)
    fresh = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_f", fresh).withColumn("cluster", F.sum("_f").over(w)).drop("_f")


def robust_scaled(rows: DataFrame, columns: Sequence[str], clip: tuple[float, float] = (0.01, 0.99), spread: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Infinite values missing, clipped at percentiles, medians for missing, then (x - median) / (spread of percentiles, 1 if none).

    Percentiles are exact; each is one number a column.
    """
    clean = rows.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c).cast("double")) for c in columns})
    limits = clean.agg(*(F.percentile(c, F.array(*map(F.lit, clip))).alias(f"_q{c}") for c in columns))
    out = clean.crossJoin(F.broadcast(limits))
    out = out.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_q{c}")[1]), F.col(f"_q{c}")[0])) for c in columns}).drop(*(f"_q{c}" for c in columns))
    middle = out.agg(*(F.median(c).alias(f"_m{c}") for c in columns))
    out = out.crossJoin(F.broadcast(middle)).withColumns({c: F.coalesce(c, f"_m{c}", F.lit(0.0)) for c in columns}).drop(*(f"_m{c}" for c in columns))
    scale = out.agg(*(F.percentile(c, F.array(F.lit(0.5), *map(F.lit, spread))).alias(f"_s{c}") for c in columns))
    width = lambda c: F.col(f"_s{c}")[2] - F.col(f"_s{c}")[1]
    return out.crossJoin(F.broadcast(scale)).withColumns({c: (F.col(c) - F.col(f"_s{c}")[0]) / F.when(width(c) == 0, 1.0).otherwise(width(c)) for c in columns}).drop(*(f"_s{c}" for c in columns))


#: Rows of one cluster that meet in one task, about.
MEDOID_BLOCK = 1024


def medoids(rows: DataFrame, by: Sequence[str], key: str, vec: str, digits: int = 9) -> DataFrame:
    """The row of each cluster with the least sum of distances to the others.

    All pairs of a cluster count. A cluster of any size is cut in blocks, each
    two of which meet in one task, so that a task's rows are bounded and sums,
    not pairs, leave it; the distances still grow with a cluster's square.
    """
    from pyspark.sql import types as T

    rows = rows.select(*by, F.col(key).alias("_key"), V.doubles(F.col(vec)).alias("_vec"))
    many = rows.groupBy(*by).agg(F.ceil(F.count("*") / MEDOID_BLOCK).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64("_key"), F.col("_blocks").cast("long")).cast("int")
    met = rows.join(many, list(by)).withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).select(*by, "_i", "_j", "_block", "_key", "_vec")

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        x, first = np.array(pair["_vec"].tolist(), np.float64), (pair["_block"] == pair["_i"]).to_numpy()
        total, other = np.zeros(len(x)), np.flatnonzero(~first if pair["_i"].iloc[0] != pair["_j"].iloc[0] else first)
        mine = np.flatnonzero(first)
        for i in range(0, len(mine), 64):
            a = mine[i : i + 64]
            for j in range(0, len(other), 512):
                b = other[j : j + 512]
                d = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2))
                total[a] += d.sum(1)
                if not first[b[0]]:
                    total[b] += d.sum(0)
        return pair[[*by, "_key"]].assign(_sum=total)

    kind = T.StructType([*(rows.schema[c] for c in (*by, "_key")), T.StructField("_sum", T.DoubleType())])
    # without it, rows dealt by cluster for the join stay so, and a cluster is one task
    sums = met.repartition(*by, "_i", "_j").groupBy(*by, "_i", "_j").applyInPandas(run, kind)
    total = sums.groupBy(*by, "_key").agg(F.round(F.sum("_sum"), digits).alias("total"))
    return total.groupBy(*by).agg(F.min(F.struct("total", "_key")).alias("m")).select(*by, F.col("m._key").alias(key), F.col("m.total").alias("total"))


def histogram(rows: DataFrame, value: str, size: float, by: Sequence[str] = ()) -> DataFrame:
    """Dense bins from the least to the greatest value: bin, n (0 for empty ones)."""
    span = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    bins = F.greatest(F.floor((F.col("_hi") - F.col("_lo")) / size), F.lit(1))
    span = span.withColumn("_n", bins)
    keyed = rows.join(span, list(by)) if by else rows.crossJoin(F.broadcast(span))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / F.col("_n"))), F.col("_n") - 1)
    counts = keyed.groupBy(*by, F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    dense = span.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("bin"))
    return dense.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def smoothed(hist: DataFrame, sigma: float = 2.0, truncate: float = 4.0, by: Sequence[str] = ()) -> DataFrame:
    """The histogram with a Gaussian over neighbouring bins, mirrored at the ends. A histogram has few rows."""
    radius = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = w.orderBy("bin")
    last = F.max("bin").over(w)
    # mirrored bins are values of the same window, so one collected frame serves both ends
    near = F.collect_list("n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    total = F.lit(0.0)
    for k, x in zip(range(-radius, radius + 1), weights, strict=True):
        period = 2 * (F.col("_last") + 1)
        j = F.pmod(F.col("bin") + k, period)
        at = F.when(j <= F.col("_last"), j).otherwise(period - 1 - j)
        total = total + F.get("_all", at.cast("int")) * float(x)
    return hist.withColumn("_last", last).withColumn("_all", near).withColumn("smooth", total).drop("_last", "_all")


def peaks(values: np.ndarray, distance: int, height: float) -> np.ndarray:
    """Local maxima of at least the height; of those closer than the distance, the higher stays, the later of equals."""
    n, found, i = len(values), [], 1
    while i < n - 1:
        if values[i - 1] < values[i]:
            j = i
            while j + 1 < n and values[j + 1] == values[i]:
                j += 1
            if j + 1 < n and values[j + 1] < values[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    at = np.array([p for p in found if values[p] >= height], np.int64)
    keep = np.ones(len(at), bool)
    for k in np.argsort(values[at], kind="stable")[::-1]:
        if keep[k]:
            close = np.abs(at - at[k]) < distance
            close[k] = False
            keep &= ~close
    return at[keep]


def floors(points: DataFrame, resolution: float = 0.01, sigma: float = 2.0, distance: int = 20, percentile: float = 90, storey: float = 2.5, axis: str = "y") -> DataFrame:
    """floor_id, low, high of a building's storeys, from peaks of its height histogram.

    Peaks pair up from below; an odd last one reaches a storey up; without
    peaks there is one floor. The first and last reach to the middle of their
    edge and the cloud's end. Only the histogram, some thousand rows by the
    building's height, comes to the driver.
    """
    spark = points.sparkSession
    lo, hi = points.agg(F.min(axis), F.max(axis)).first()
    if lo is None:
        return spark.createDataFrame([], "floor_id string, low double, high double")
    hist = smoothed(histogram(points, axis, resolution), sigma).orderBy("bin").select("smooth").toPandas()["smooth"].to_numpy()
    width = (hi - lo) / max(len(hist), 1)
    at = peaks(hist, distance, np.percentile(hist, percentile)) if len(hist) else np.zeros(0, np.int64)
    levels = gap_levels(lo + (at + 0.5) * width)
    bounds = [[levels[k], levels[k + 1] if k + 1 < len(levels) else levels[k] + storey] for k in range(0, len(levels), 2)] or [[lo, hi]]
    if levels:
        bounds[0][0] = (bounds[0][0] + lo) / 2
        bounds[-1][1] = (bounds[-1][1] + hi) / 2 if len(levels) % 2 == 0 else max(bounds[-1][1], hi)
    return spark.createDataFrame([(str(k), float(a), float(b)) for k, (a, b) in enumerate(bounds)], "floor_id string, low double, high double")


def gap_levels(heights: Sequence[float], gap: float = 0.2) -> list[float]:
    """One level, the highest, of peaks that follow one another within the gap."""
    out: list[float] = []
    for h in sorted(heights):
        if out and h - out[-1] <= gap:
            out[-1] = h
        else:
            out.append(h)
    return out


def dbscan(points: DataFrame, eps: float, least: int, folder: str, key: str = "pid", dims: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """key and cluster (smallest key of its core points; null is noise).

    Neighbours meet through cells of eps; cores within eps are edges, whose
    components are found by passing on the least label, each round written to
    the folder. A border point joins its neighbour core with the least label.
    """
    from pyspark.sql import types as T

    cells = [G.cell(F.col(c), eps).alias(f"c{c}") for c in dims]
    own = points.select(F.col(key).cast(T.LongType()).alias("a"), *(F.col(c).cast("double").alias(f"a{c}") for c in dims), *cells)
    around = points.select(F.col(key).cast(T.LongType()).alias("b"), *(F.col(c).cast("double").alias(f"b{c}") for c in dims), *cells)
    for c in dims:
        around = around.withColumn("_s", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_s")).drop("_s")
    d = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in dims), F.lit(0.0))
    run = f"{folder.rstrip('/')}/dbscan-{uuid.uuid4().hex}"
    near = _kept(own.join(around, [f"c{c}" for c in dims]).filter(d <= eps * eps).select("a", "b"), f"{run}/near")
    core = _kept(near.groupBy("a").count().filter(F.col("count") >= least).select("a"), f"{run}/core")
    edges = _kept(near.join(core, "a", "left_semi").join(core.withColumnRenamed("a", "b"), "b", "left_semi").filter("a <> b").select("a", "b"), f"{run}/edges")
    label = core.select("a", F.col("a").alias("cluster"))
    for k in range(1000):
        label = _kept(label, f"{run}/label-{k}")
        nearest = edges.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("cluster").alias("m"))
        step = label.join(nearest, "a", "left").select("a", F.least("cluster", "m").alias("l"), "cluster")
        jump = step.join(step.select(F.col("a").alias("l"), F.col("l").alias("ll")), "l", "left").select("a", F.coalesce("ll", "l").alias("cluster"), F.col("cluster").alias("before"))
        jump = _kept(jump, f"{run}/step-{k}")
        label = jump.select("a", "cluster")
        if jump.filter("cluster <> before").isEmpty():
            break
    else:
        raise RuntimeError("the clusters did not settle")
    border = near.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("cluster").alias("near"))
    out = points.select(F.col(key).cast(T.LongType()).alias("a")).join(label, "a", "left").join(border, "a", "left")
    return out.select(F.col("a").alias(key), F.coalesce("cluster", "near").alias("cluster"))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def condensed_clusters(distance: np.ndarray, min_cluster_size: int, min_samples: int | None = None) -> np.ndarray:
    """Hierarchical density clusters of a distance matrix; -1 is noise."""
    return clusters_by(lambda i, j: distance[i:j], len(distance), min_cluster_size, min_samples)


def clusters_by(distances: Callable[[int, int], np.ndarray], n: int, min_cluster_size: int, min_samples: int | None = None) -> np.ndarray:
    """Hierarchical density clusters of n rows; -1 is noise. distances(i, j): those from the rows i to j - 1 to all, asked for a few rows at a time.

    Mutual reachability, its minimum spanning tree, the condensed tree of
    clusters of at least min_cluster_size, and the selection of greatest excess
    of mass (Campello, Moulavi and Sander 2013); the root is no cluster. The
    time grows with the square of n, the memory with n.
    """
    if n < 2 or n < min_cluster_size:
        return np.full(n, -1)
    k, few = min(min_samples or min_cluster_size, n) - 1, max(1, (1 << 20) // n)
    core = np.concatenate([np.partition(distances(i, min(i + few, n)), k, axis=1)[:, k].copy() for i in range(0, n, few)])
    # rows not yet in the tree, in order
    rest, best, parent, tree, node = np.arange(1, n), np.full(n - 1, np.inf), np.zeros(n - 1, np.int64), [], 0
    for _ in range(n - 1):
        reach = np.maximum(np.maximum(core[node], core[rest]), distances(node, node + 1)[0][rest])
        closer = reach < best
        best[closer], parent[closer] = reach[closer], node
        at = int(np.argmin(best))
        node = int(rest[at])
        tree.append((best[at], parent[at], node))
        rest, best, parent = (np.delete(x, at) for x in (rest, best, parent))
    # single linkage: children and height of each merge
    tree.sort(key=lambda e: e[0])
    root, size, left, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (d, a, b) in enumerate(tree, n):
        a, b = find(a), find(b)
        left[k], height[k], size[k] = (a, b), d, size[a] + size[b]
        root[a] = root[b] = k

    def members_of(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            todo.extend(left[y]) if y >= n else out.append(y)
        return out

    births, stable, children, points = {}, {}, {}, {}

    def grow(top: int, birth: float) -> int:
        """A condensed cluster from a linkage node; follows the large child until both are large."""
        c = len(births)
        births[c], stable[c], children[c], points[c] = birth, 0.0, [], []
        todo = top
        while todo >= n:
            lam = 1 / height[todo] if height[todo] > 0 else np.inf
            a, b = left[todo]
            big = [x for x in (a, b) if size[x] >= min_cluster_size]
            lam = min(lam, 1e12)
            if len(big) == 2:
                stable[c] += (lam - births[c]) * size[todo]
                for x in (a, b):
                    pending.append((x, lam, c))
                return c
            for x in (a, b):
                if x not in big:
                    gone = members_of(x)
                    stable[c] += (lam - births[c]) * len(gone)
                    points[c] += gone
            if not big:
                return c
            todo = big[0]
        points[c].append(todo)
        return c

    pending: list[tuple[int, float, int]] = []
    grow(2 * n - 2, 0.0)
    while pending:
        x, lam, up = pending.pop()
        children[up].append(grow(x, lam))
    chosen, value = {}, {}
    for c in sorted(births, reverse=True):
        below = sum(value[k] for k in children[c])
        chosen[c] = c != 0 and stable[c] >= below
        value[c] = stable[c] if chosen[c] else below
    labels, k = np.full(n, -1), 0
    todo = [0]
    while todo:
        c = todo.pop()
        if chosen[c]:
            inside = [c]
            while inside:
                x = inside.pop()
                labels[points[x]] = k
                inside += children[x]
            k += 1
        else:
            todo += children[c][::-1]
    return labels


def pose_features(pose: Column) -> Column:
    """Shift and quaternion of a pose, as one array."""
    return F.concat(F.array(*(pose[4 * r + 3] for r in range(3))), G.quaternion(pose))


def keyframes(poses: DataFrame, min_cluster_size: int = 15, rotation_weight: float = 1.5, min_samples: int | None = None) -> DataFrame:
    """room_id, frame_index of each room's keyframes: medoids of density clusters of scaled poses; all frames where there is no cluster.

    poses: room_id, frame_index, pose. A room's frames are one group, some
    thousand by nature; rooms are dealt over the cluster.
    """
    rows = poses.select("room_id", "frame_index", pose_features(F.col("pose")).alias("f"))

    def pick(room: pd.DataFrame) -> pd.DataFrame:
        room = room.sort_values("frame_index").reset_index(drop=True)
        keep = representative(np.array(room["f"].tolist(), np.float64), min_cluster_size, rotation_weight, min_samples)
        return room.iloc[keep][["room_id", "frame_index"]]

    return rows.groupBy("room_id").applyInPandas(pick, rows.select("room_id", "frame_index").schema)


def representative(x: np.ndarray, min_cluster_size: int = 15, rotation_weight: float = 1.5, min_samples: int | None = None) -> list[int]:
    """Positions of the medoids of density clusters of poses (shift and quaternion, a row each); all where there is no cluster."""
    x = x * np.repeat([1, rotation_weight], [3, x.shape[1] - 3])
    x = scaled_features(x)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(size > 0, size, 1)
    columns = np.ascontiguousarray(unit.T)

    def distances(i: int, j: int) -> np.ndarray:
        """By cosine, summed in one order whatever the rows."""
        total = np.zeros((j - i, len(x)))
        for c in columns:
            if c.any():
                total += c[i:j, None] * c
        return np.clip(1 - total, 0, 2)

    labels = clusters_by(distances, len(x), min_cluster_size, min_samples)
    out = []
    for k in range(labels.max() + 1):
        at = np.flatnonzero(labels == k)
        d, few = np.zeros(len(at)), max(1, (1 << 18) // len(at))
        for i in range(0, len(at), few):
            d[i : i + few] = np.linalg.norm(x[at[i : i + few], None] - x[None, at], axis=2).sum(1)
        out.append(int(at[np.argmin(np.round(d, 9))]))
    return sorted(out) if out else list(range(len(x)))


def scaled_features(x: np.ndarray) -> np.ndarray:
    """robust_scaled for one room's matrix."""
    x = np.where(np.isfinite(x), x, np.nan)
    x[:, np.isnan(x).all(0)] = 0
    x = np.clip(x, *np.nanpercentile(x, [1, 99], axis=0))
    middle = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), middle, x)
    low, high = np.percentile(x, [5, 95], axis=0)
    return (x - np.median(x, axis=0)) / np.where(high > low, high - low, 1)


def largest_cluster(labels: np.ndarray) -> int:
    """The label, noise aside, with most members, the first seen of equals; -1 without one."""
    seen = [v for v in dict.fromkeys(labels.tolist()) if v >= 0]
    return max(seen, key=lambda v: (labels == v).sum(), default=-1)


def local_dbscan(x: np.ndarray, eps: float, least: int, cosine: bool = False) -> np.ndarray:
    """Density clusters of one small group; -1 is noise."""
    if cosine:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    labels, k = np.full(len(x), -1), 0
    near = [np.flatnonzero((1 - x @ p if cosine else np.linalg.norm(x - p, axis=1)) <= eps) for p in x]
    core = np.array([len(m) >= least for m in near], bool)
    for i in range(len(x)):
        if core[i] and labels[i] < 0:
            labels[i], todo = k, [i]
            while todo:
                for j in near[todo.pop()]:
                    if labels[j] < 0:
                        labels[j] = k
                        if core[j]:
                            todo.append(int(j))
            k += 1
    return labels


def denoised(points: DataFrame, by: str, eps: float, least: int) -> DataFrame:
    """Each object's points in its largest density cluster; all of them below five points or where all are noise. One object is one group."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) < 5:
            return group
        labels = local_dbscan(group[["x", "y", "z"]].to_numpy(), eps, least)
        k = largest_cluster(labels)
        return group if k < 0 else group[labels == k]

    return points.groupBy(by).applyInPandas(keep, points.schema)


def denoised_mean(vectors: DataFrame, by: str, eps: float = 0.1, least: int = 2) -> DataFrame:
    """Mean vector of each group's largest cluster by cosine, of all where there is none."""

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["vec"].tolist(), np.float64)
        labels = local_dbscan(x, eps, least, cosine=True)
        k = largest_cluster(labels)
        return pd.DataFrame({by: [group[by].iloc[0]], "vec": [(x if k < 0 else x[labels == k]).mean(0).tolist()]})

    return vectors.select(by, "vec").groupBy(by).applyInPandas(mean, f"{by} {dict(vectors.dtypes)[by]}, vec array<double>")


def without_outliers(points: DataFrame, by: str, neighbours: int = 50, ratio: float = 1.0) -> DataFrame:
    """Points whose mean distance to their nearest neighbours is at most mean + ratio * deviation over their object."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        x = group[["x", "y", "z"]].to_numpy(np.float64)
        k = min(neighbours, len(x) - 1)
        if k < 1:
            return group
        mean = np.concatenate([np.sort(np.linalg.norm(x[i : i + 512, None] - x[None], axis=2), axis=1)[:, 1 : k + 1].mean(1) for i in range(0, len(x), 512)])
        return group[mean <= mean.mean() + ratio * mean.std(ddof=1 if len(x) > 1 else 0)]

    return points.groupBy(by).applyInPandas(keep, points.schema)

