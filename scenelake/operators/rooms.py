"""Rooms of a floor from its walls, and the assignment of poses to rooms."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import points as P


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothed along both axes, edges mirrored."""
    r = max(int(4 * sigma + 0.5), 1)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        pad = np.pad(image.astype(np.float64), [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        image = sum(x * np.take(pad, np.arange(k, k + image.shape[axis]), axis=axis) for k, x in enumerate(w))
    return image


def closed(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    """Dilation, then erosion, by a square."""

    def grow(m: np.ndarray) -> np.ndarray:
        pad = np.pad(m, radius)
        return np.any([pad[i : i + m.shape[0], j : j + m.shape[1]] for i in range(2 * radius + 1) for j in range(2 * radius + 1)], axis=0)

    return ~grow(~np.pad(grow(np.pad(mask, radius)), radius))[2 * radius : -2 * radius, 2 * radius : -2 * radius]


def distances(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each set cell to the nearest unset one, by lower envelopes of parabolas along each axis."""
    far = float(sum(mask.shape)) ** 2
    out = np.where(mask, far, 0.0)
    for axis in (0, 1):
        rows = out if axis else out.T
        n, at = rows.shape[1], np.arange(rows.shape[1])
        step = max(1, int(4e6 // max(n * n, 1)))
        cost = (at[:, None] - at[None]) ** 2
        rows = np.concatenate([(rows[k : k + step, None, :] + cost[None]).min(2) for k in range(0, len(rows), step)])
        out = rows if axis else rows.T
    return np.sqrt(out)


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The threshold of greatest variance between two classes."""
    n, edges = np.histogram(values, bins)
    mid = (edges[1:] + edges[:-1]) / 2
    w = np.cumsum(n)
    m = np.cumsum(n * mid)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return float(mid[np.nanargmax(between)]) if np.isfinite(between).any() else float(values.max())


def labelled(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 of connected regions (four neighbours)."""
    out, k = np.zeros(mask.shape, np.int64), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if not out[start]:
            k += 1
            out[start], todo = k, [start]
            while todo:
                y, x = todo.pop()
                for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                        out[p] = k
                        todo.append(p)
    return out


def flooded(height: np.ndarray, seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Watershed: seeds grow over the mask, lowest cells first, in the order in which they are met."""
    out, heap, k = np.where(mask, seeds, 0), [], 0
    for y, x in zip(*np.nonzero(out), strict=True):
        heapq.heappush(heap, (height[y, x], k, y, x))
        k += 1
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= p[0] < out.shape[0] and 0 <= p[1] < out.shape[1] and mask[p] and not out[p]:
                out[p] = out[y, x]
                heapq.heappush(heap, (height[p], k, *p))
                k += 1
    return out


def outline(region: np.ndarray) -> list[tuple[int, int]]:
    """Corners of a region's outer border, in order."""
    edges: dict[tuple, list[tuple]] = {}
    cells = set(zip(*np.nonzero(region), strict=True))
    for y, x in cells:
        for (dy, dx), a, b in (((-1, 0), (y, x), (y, x + 1)), ((0, 1), (y, x + 1), (y + 1, x + 1)), ((1, 0), (y + 1, x + 1), (y + 1, x)), ((0, -1), (y + 1, x), (y, x))):
            if (y + dy, x + dx) not in cells:
                edges.setdefault(a, []).append(b)
    if not edges:
        return []
    start = min(edges)
    path, at, before = [start], edges[start].pop(), start
    while at != start:
        path.append(at)
        options = edges[at]
        # at a corner where two borders touch, turn right to stay outside
        turn = lambda p, a=at, b=before: (a[0] - b[0]) * (p[1] - a[1]) - (a[1] - b[1]) * (p[0] - a[0])
        after = max(options, key=turn)
        options.remove(after)
        before, at = at, after
    return [p for k, p in enumerate(path) if (path[k - 1][0] - p[0], path[k - 1][1] - p[1]) != (p[0] - path[(k + 1) % len(path)][0], p[1] - path[(k + 1) % len(path)][1])]


def segmented(walls: np.ndarray, inside: np.ndarray, resolution: float, least_side: float = 0.5) -> np.ndarray:
    """Room numbers of a floor's cells: regions far from walls seed a watershed over what is inside."""
    free = inside & ~walls
    if not free.any():
        return np.zeros(free.shape, np.int64)
    d = gaussian(distances(free), 1.0) * free
    seeds = labelled(d > otsu(d[free]))
    size = np.bincount(seeds.ravel())
    small = np.flatnonzero(size < (least_side / resolution) ** 2)
    seeds[np.isin(seeds, small)] = 0
    return flooded(-d, seeds, free)


ROOMS = "floor_id string, room_id string, polygon array<struct<x:double,z:double>>, zero_level double, height double"


def rooms(points: DataFrame, floors: DataFrame, resolution: float = 0.05, wall_share: float = 0.25) -> DataFrame:
    """Rooms of each floor: floor_id, room_id, polygon, zero_level, height.

    points: x, y, z; floors: floor_id, low, high. Walls are cells with many
    points from 1.5 m above the floor to 0.3 m below its top. Cells are counted
    before rows move, so a floor's image, bounded by its area, is its group.
    """
    cells = P.in_bands(points, floors, "y", "floor_id")
    wall = (F.col("y") >= F.col("low") + 1.5) & (F.col("y") < F.col("high") - 0.3)
    counted = cells.groupBy("floor_id", "low", "high", G.cell(F.col("x"), resolution).alias("i"), G.cell(F.col("z"), resolution).alias("j")).agg(F.count_if(F.col("y") < F.col("high") - 0.2).alias("n"), F.count_if(wall).alias("w"))

    def run(floor: pd.DataFrame) -> pd.DataFrame:
        border = 10
        i0, j0 = floor["i"].min() - border, floor["j"].min() - border
        shape = (int(floor["i"].max() - i0) + border + 1, int(floor["j"].max() - j0) + border + 1)
        n, w = np.zeros(shape), np.zeros(shape)
        at = (floor["i"] - i0).to_numpy(), (floor["j"] - j0).to_numpy()
        n[at], w[at] = floor["n"], floor["w"]
        w = gaussian(w, 1.0)
        found = segmented(w > wall_share * w.max() if w.max() > 0 else w > 0, filled(closed(gaussian(n, 1.0) > 0.05, 2)), resolution)
        low, high, name = floor["low"].iloc[0], floor["high"].iloc[0], floor["floor_id"].iloc[0]
        rows = []
        for k, label in enumerate(x for x in np.unique(found) if x):
            path = [{"x": float((y + i0) * resolution), "z": float((x + j0) * resolution)} for y, x in outline(found == label)]
            rows.append({"floor_id": name, "room_id": f"{name}_{k}", "polygon": path, "zero_level": low, "height": high - low})
        return pd.DataFrame(rows, columns=["floor_id", "room_id", "polygon", "zero_level", "height"])

    return counted.groupBy("floor_id").applyInPandas(run, ROOMS)


def filled(mask: np.ndarray) -> np.ndarray:
    """With its holes: all that the border's outside doesn't reach."""
    free = np.pad(~mask, 1, constant_values=True)
    outside = labelled(free)
    return ~(outside == outside[0, 0])[1:-1, 1:-1]


def single_floor_room(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One floor '0' with one room '0_0' over the whole cloud."""
    low, high = F.min("y"), F.max("y")
    floor = points.filter(~F.isnan("y")).agg(low.alias("low"), high.alias("high")).select(F.lit("0").alias("floor_id"), "low", "high")
    return floor, floor.select("floor_id", F.lit("0_0").alias("room_id"), F.col("low").alias("zero_level"), (F.col("high") - F.col("low")).alias("height"))


def points_in_rooms(points: DataFrame, room_table: DataFrame, margin: float = 0.1) -> DataFrame:
    """room_id with the points of its height, a margin more, and inside its polygon. Rooms are few; their number is checked."""
    if room_table.count() > 10_000:
        raise ValueError("at most 10000 rooms are sent to the workers")
    met = points.join(F.broadcast(room_table.select("room_id", "polygon", "zero_level", "height")), F.col("y").between(F.col("zero_level") - margin, F.col("zero_level") + F.col("height") + margin))
    return met.filter(G.in_polygon_column(F.col("x"), F.col("z"), F.col("polygon"))).select("room_id", *points.columns)


def poses_in_rooms(poses: DataFrame, floors: DataFrame, room_table: DataFrame, shares: DataFrame | None = None, margin: float = 0.5, least: float = 0.5) -> DataFrame:
    """frame_index, floor_id, room_id: the first floor of a pose's height and, of that floor, the first room around it.

    shares: frame_index, room_id, share of the frame's points in the room; it
    must reach `least`. A floor with one room needs neither. A pose of a floor
    without a fitting room belongs to none, also if a later floor would fit.
    """
    rows = poses.withColumns({"x": F.col("pose")[3], "y": F.col("pose")[7], "z": F.col("pose")[11]})
    bands = floors.select(F.col("floor_id").alias("ord"), F.col("floor_id").alias("band"), "low", "high")
    rows = P.assign_first(rows, bands, "y", ["frame_index"], margin).withColumnRenamed("band", "floor_id").filter("floor_id is not null")
    many = room_table.groupBy("floor_id").agg(F.count("*").alias("rooms"))
    met = rows.join(room_table.join(many, "floor_id").select("floor_id", "room_id", "polygon", "rooms"), "floor_id")
    if shares is not None:
        met = met.join(shares, ["frame_index", "room_id"], "left").withColumn("ok", F.coalesce("share", F.lit(0.0)) >= least)
    else:
        met = met.withColumn("ok", F.lit(True))
    fits = (F.col("rooms") == 1) | (G.in_polygon_column(F.col("x"), F.col("z"), F.col("polygon")) & F.col("ok"))
    return met.filter(fits).groupBy("frame_index", "floor_id").agg(F.min("room_id").alias("room_id"))
