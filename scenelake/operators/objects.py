"""Object merging, functional parts, labels, descriptions and statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import points as P


def structural(label: Column) -> Column:
    """Walls, floors and windows."""
    return F.lower(label).rlike("wall|floor|window")


def shown(objects: DataFrame, least: int = 20) -> DataFrame:
    """Objects to show: no walls, floors or ceilings, and enough points."""
    return objects.filter(~F.lower("label").rlike("wall|floor|ceiling") & (F.col("n_points") >= least))


def merged_label(labels: Column) -> Column:
    """Sorted distinct names of comma-separated labels."""
    names = F.flatten(F.transform(labels, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y))))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))), ", ")


def _hits(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Which points (columns) of each cloud have one of the other closer than the radius, a block of points at a time."""
    near_a, near_b = np.zeros(a.shape[1], bool), np.zeros(b.shape[1], bool)
    if not near_a.size or not near_b.size:
        return near_a, near_b
    slack = radius * (1 + 1e-9)
    # blocks of a along its greatest side meet slabs of b
    side = int(np.argmax(a.max(1) - a.min(1)))
    order_a = np.argsort(a[side], kind="stable")
    order_b = np.argsort(b[side], kind="stable") if len(order_a) > 256 else None
    along = b[side] if order_b is None else b[side][order_b]
    for i in range(0, len(order_a), 64):
        rows = order_a[i : i + 64]
        p = a[:, rows]
        low, high = p.min(1) - slack, p.max(1) + slack
        if order_b is None:
            at = np.flatnonzero((along >= low[side]) & (along <= high[side]))
        else:
            at = order_b[np.searchsorted(along, low[side]) : np.searchsorted(along, high[side], "right")]
        for k in range(3):
            if k != side:
                v = b[k, at]
                at = at[(v >= low[k]) & (v <= high[k])]
        for j in range(0, len(at), 4096):
            q = at[j : j + 4096]
            d = (b[0, q] - p[0][:, None]) ** 2
            d += (b[1, q] - p[1][:, None]) ** 2
            d += (b[2, q] - p[2][:, None]) ** 2
            close = d < radius * radius
            near_a[rows] |= close.any(1)
            near_b[q] |= close.any(0)
    return near_a, near_b


def _near(a: np.ndarray, b: np.ndarray, radius: float) -> float:
    """The greater share of points (columns) with one of the other cloud closer than the radius."""
    if not a.shape[1] or not b.shape[1]:
        return 0.0
    return max(float(h.sum()) / len(h) for h in _hits(a, b, radius))


#: Voxels along a side that a key holds.
_SIDE = 1 << 21


class _Cloud:
    """One object's points as columns. Points that join it touch their own voxels, unless its corner moves."""

    def __init__(self, points: np.ndarray) -> None:
        self.x, self.keys, self.origin = np.ascontiguousarray(points.T), None, None
        self._measured()

    def _measured(self) -> None:
        some = self.x.shape[1] > 0
        self.low = self.x.min(1) if some else np.full(3, np.inf)
        self.high = self.x.max(1) if some else np.full(3, -np.inf)
        side = self.high - self.low
        self.volume = float(side[0] * side[1] * side[2]) if some else 0.0

    @staticmethod
    def _key(x: np.ndarray, origin: np.ndarray, size: float) -> np.ndarray:
        cell = np.floor((x - origin[:, None]) / size)
        if not ((cell >= 0) & (cell < _SIDE)).all():
            raise ValueError(f"a cloud is more than {_SIDE} voxels long, or has infinite points")
        i, j, k = cell.astype(np.int64)
        return (i * _SIDE + j) * _SIDE + k

    def _means(self, x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells, of = np.unique(keys, return_inverse=True)
        return cells, np.stack([np.bincount(of, weights=c) / np.bincount(of) for c in x])

    def join(self, more: np.ndarray, size: float) -> None:
        """Takes points (columns) in and has the mean of each voxel then; voxels begin half a size below the least coordinates."""
        if not more.shape[1] and not self.x.shape[1]:
            return
        if self.keys is not None and (not more.shape[1] or (more.min(1) >= self.low).all()):
            keys = self._key(more, self.origin, size)
            cells = np.unique(keys)
            at = np.searchsorted(self.keys, cells)
            there = at < len(self.keys)
            there[there] = self.keys[at[there]] == cells[there]
            held = at[there]
            _, means = self._means(np.concatenate([self.x[:, held], more], 1), np.concatenate([cells[there], keys]))
            self.x[:, held] = means[:, there]
            self.x = np.insert(self.x, at[~there], means[:, ~there], axis=1)
            self.keys = np.insert(self.keys, at[~there], cells[~there])
            whole = bool((self._key(means, self.origin, size) == cells).all())
        else:
            x = np.concatenate([self.x, more], 1)
            _, self.x = self._means(x, self._key(x, x.min(1) - size / 2, size))
            self.keys, whole = None, True
        self._measured()
        if self.keys is None or not whole or (self.low - size / 2 != self.origin).any():
            self.origin = self.low - size / 2
            keys = self._key(self.x, self.origin, size)
            self.keys = keys if (np.diff(keys) > 0).all() else None


def _overlaps(low: np.ndarray, high: np.ndarray, volume: float, lows: np.ndarray, highs: np.ndarray, volumes: np.ndarray) -> np.ndarray:
    """Intersection of a box over union or over the smaller with each of many (a row each); 0 without overlap or volume."""
    side = np.maximum(np.minimum(highs, high) - np.maximum(lows, low), 0)
    shared = side[:, 0] * side[:, 1] * side[:, 2]
    out, at = np.zeros(len(lows)), np.flatnonzero((shared > 0) & (volumes > 0)) if volume > 0 else []
    if len(at):
        s, v = shared[at], volumes[at]
        out[at] = np.maximum(s / (volume + v - s), s / np.minimum(volume, v))
    return out


def _similar(a: _Cloud, b: _Cloud, radius: float, box: float) -> float:
    """Share of near points where the boxes overlap by at least `box`, else 0."""
    overlap = _overlaps(a.low, a.high, a.volume, b.low[None], b.high[None], np.array([b.volume]))[0]
    return _near(a.x, b.x, radius) if overlap > 0 and overlap >= box else 0.0


def _cloud(value) -> np.ndarray:
    return np.array([list(p) for p in value], np.float64).reshape(-1, 3)


MERGED = "room_id string, object_id string, label string, xyz array<array<double>>, frame_indices array<int>, merged_from array<string>"


def merge(objects: DataFrame, threshold: float = 0.5, structural_share: float = 0.5, radius: float = 0.02, box: float = 0.1, voxel: float = 0.01, again: float = 0.65, rounds: int = 2) -> DataFrame:
    """Objects of each room merged greedily, then by overlapping pairs.

    objects: room_id, pos, object_id, label, xyz, frame_indices. In input order
    an object joins the most similar one before it (the first of equals) if the
    similarity exceeds the threshold, a share of it for walls, floors and
    windows; clouds grow as they are joined, so the order is part of the result.
    Then pairs by box overlap, greatest first, join the second where both are
    left. Similarity depends on clouds already joined, so a room is one group;
    rooms are dealt over the cluster.
    """

    def run(room: pd.DataFrame) -> pd.DataFrame:
        nodes: list[dict] = []
        lows, highs, volumes = np.empty((len(room), 3)), np.empty((len(room), 3)), np.empty(len(room))

        def measured(k: int) -> None:
            c = nodes[k]["cloud"]
            lows[k], highs[k], volumes[k] = c.low, c.high, c.volume

        for row in room.sort_values("pos").to_dict("records"):
            cloud, n = _Cloud(_cloud(row["xyz"])), len(nodes)
            fixed = any(w in row["label"].lower() for w in ("wall", "floor", "window"))
            score, best = threshold * (structural_share if fixed else 1), -1
            overlap = _overlaps(cloud.low, cloud.high, cloud.volume, lows[:n], highs[:n], volumes[:n])
            for k in np.flatnonzero((overlap >= box) & (overlap > 0)):
                if score >= 1:  # no share is greater
                    break
                if (near := _near(cloud.x, nodes[k]["cloud"].x, radius)) > score:
                    score, best = near, int(k)
            own = {"id": row["object_id"], "labels": [row["label"]], "cloud": cloud, "frames": list(row["frame_indices"]), "from": [row["object_id"]]}
            if best >= 0:
                _join(nodes[best], own, voxel)
                measured(best)
            else:
                nodes.append(own)
                measured(n)
        for _ in range(rounds):
            n = len(nodes)
            for k in range(n):
                measured(k)
            pairs = []
            for i in range(n):
                overlap = _overlaps(lows[i], highs[i], volumes[i], lows[i + 1 : n], highs[i + 1 : n], volumes[i + 1 : n])
                pairs += [(-float(overlap[j]), i, int(i + 1 + j)) for j in np.flatnonzero(overlap > box)]
            gone: set[int] = set()
            for _overlap, i, j in sorted(pairs):
                if i not in gone and j not in gone and _similar(nodes[i]["cloud"], nodes[j]["cloud"], radius, box) > again:
                    _join(nodes[j], nodes[i], voxel)
                    gone.add(i)
            nodes = [n for k, n in enumerate(nodes) if k not in gone]
        room_id = room["room_id"].iloc[0]
        return pd.DataFrame([{"room_id": room_id, "object_id": n["id"], "label": _names(n["labels"]), "xyz": n["cloud"].x.T.tolist(), "frame_indices": n["frames"], "merged_from": n["from"]} for n in nodes])

    return objects.select("room_id", "pos", "object_id", "label", "xyz", "frame_indices").groupBy("room_id").applyInPandas(run, MERGED)


def _names(labels: Sequence[str]) -> str:
    return ", ".join(sorted({y.strip() for x in labels for y in x.split(",") if y.strip()}))


def _join(target: dict, source: dict, voxel: float) -> None:
    target["labels"] += source["labels"]
    target["cloud"].join(source["cloud"].x, voxel)
    target["frames"] += source["frames"]
    target["from"] += source["from"]


def linked(objects: DataFrame, threshold: float = 0.5, radius: float = 0.02, box: float = 0.1, cell: float = 1.0) -> DataFrame:
    """Similar pairs of objects of a room, whatever the order: room_id, a_id, b_id, similarity.

    objects: room_id, id, pid, x, y, z in long form. Boxes meet through cells, and
    only points of pairs whose boxes overlap enough meet in the distance join.
    """
    boxes = P.boxes(objects, ["room_id", "id"])
    pairs = P.overlapping_boxes(boxes, cell, by=["room_id"])
    pairs = pairs.filter(G.iou_or_contained(P.box_of("a"), P.box_of("b")) >= box).select("room_id", "a_id", "b_id")
    side = lambda p: pairs.join(objects.select("room_id", F.col("id").alias(f"{p}_id"), "pid", "x", "y", "z"), ["room_id", f"{p}_id"])
    near = P.near_ratio(side("a"), side("b"), radius, by=["room_id", "a_id", "b_id"])
    return near.filter(F.col("ratio") > threshold).select("room_id", "a_id", "b_id", F.col("ratio").alias("similarity"))


def parts_of_objects(pairs: DataFrame, elements: DataFrame, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Functional elements with the most similar object above the threshold, and those promoted to objects.

    pairs: element_id, object_id, object_pos, similarity; the first of equals wins.
    """
    best = pairs.filter(F.col("similarity") > threshold).groupBy("element_id").agg(F.max_by(F.struct("object_id", "similarity"), F.struct("similarity", -F.col("object_pos"))).alias("m"))
    children = elements.join(best.select("element_id", "m.object_id", "m.similarity"), "element_id")
    return children, elements.join(best, "element_id", "left_anti")


def best_descriptions(descriptions: DataFrame, by: Sequence[str] = ("object_id",)) -> DataFrame:
    """The description of each object with the greatest confidence above 0, the first of equals. descriptions: by, confidence, frame_pos, object_pos, ..."""
    pick = F.max_by(F.struct(*descriptions.columns), F.struct("confidence", -F.col("frame_pos"), -F.col("object_pos")))
    return descriptions.filter("confidence > 0").groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(pick.alias("m")).select("m.*")


def described(nodes: DataFrame, descriptions: DataFrame, by: Sequence[str] = ("room_id", "object_id"), relabel: bool = False) -> DataFrame:
    """Nodes with their description; an own one (vlm_description) stays. relabel takes a name that is not blank."""
    found = best_descriptions(descriptions, by).select(*by, F.col("description").alias("_d"), F.trim("name").alias("_n"))
    out = nodes.join(found, list(by), "left").withColumn("vlm_description", F.coalesce("vlm_description", "_d"))
    if relabel:
        out = out.withColumn("label", F.when(F.col("_n") != "", F.col("_n")).otherwise(F.col("label")))
    return out.drop("_d", "_n")


def statistics(objects: DataFrame) -> DataFrame:
    """One row: totals, and counts by label as an array in label order.

    objects: label, n_points, n_masks, n_functional, n_detections.
    """
    each = objects.groupBy("label").agg(F.count("*").alias("n"), *(F.count_if(F.col(c) > k).alias(c) for c, k in (("n_points", 0), ("n_masks", 0), ("n_functional", 0), ("n_detections", 1))), F.sum("n_points").alias("points"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("label").alias("distinct_labels"),
        F.coalesce(F.sum("n_points"), F.lit(0)).alias("with_points"),
        F.coalesce(F.sum("n_masks"), F.lit(0)).alias("with_masks"),
        F.coalesce(F.sum("n_functional"), F.lit(0)).alias("with_functional"),
        F.coalesce(F.sum("n_detections"), F.lit(0)).alias("multiple_detections"),
        F.coalesce(F.try_divide(F.sum("points"), F.sum("n_points")), F.lit(0.0)).alias("average_points"),
        F.array_sort(F.collect_list(F.struct("label", "n"))).alias("labels"),
    )


def keyframes_of(object_frames: DataFrame, keyframes: DataFrame) -> DataFrame:
    """object_id, frame_index, room_id, path, description of each object's keyframes.

    A keyframe counts if it lists the object or if its index is among the
    object's frames (object_id, frame_index); of one index in several rooms the
    first room's stays; the labelled path is preferred.
    """
    listed = keyframes.select(F.explode("object_ids").alias("object_id"), *keyframes.columns)
    seen = keyframes.join(object_frames.select("object_id", "frame_index").distinct(), "frame_index").select("object_id", *keyframes.columns)
    both = listed.unionByName(seen).withColumn("_r", P.rank_window(["object_id", "frame_index"], F.col("room_pos"), F.col("room_id"))).filter("_r = 1")
    return both.select("object_id", "frame_index", "room_id", F.coalesce("labeled_path", "path").alias("path"), F.substring("description", 1, 200).alias("description"))
