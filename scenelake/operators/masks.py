"""Image masks as pixel tables: run lengths, overlaps, suppression and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_lengths(pixels: DataFrame, size: DataFrame) -> DataFrame:
    """mask_id and counts: lengths of runs of unset and set pixels in column order, beginning with unset ones.

    pixels: mask_id, y, x of set pixels; size: mask_id, h, w. One mask's pixels
    are ordered together, at most its image.
    """
    at = pixels.join(size, "mask_id").select("mask_id", "h", "w", (F.col("x") * F.col("h") + F.col("y")).alias("p")).distinct()
    w = Window.partitionBy("mask_id").orderBy("p")
    runs = at.withColumn("_run", F.col("p") - F.row_number().over(w)).groupBy("mask_id", "h", "w", "_run").agg(F.min("p").alias("first"), F.count("*").alias("n"))
    gaps = runs.withColumn("gap", F.col("first") - F.coalesce(F.lag(F.col("first") + F.col("n")).over(Window.partitionBy("mask_id").orderBy("first")), F.lit(0)))
    lists = gaps.groupBy("mask_id", "h", "w").agg(F.array_sort(F.collect_list(F.struct("first", "gap", "n"))).alias("r"), F.max(F.col("first") + F.col("n")).alias("end"))
    counts = F.concat(F.flatten(F.transform("r", lambda r: F.array(r.gap, r.n))), F.when(F.col("end") < F.col("h") * F.col("w"), F.array(F.col("h") * F.col("w") - F.col("end"))).otherwise(F.array().cast("array<bigint>")))
    empty = size.join(at.select("mask_id").distinct(), "mask_id", "left_anti").select("mask_id", F.array((F.col("h") * F.col("w")).cast("long")).alias("counts"))
    return lists.select("mask_id", counts.alias("counts")).unionByName(empty)


def run_islands(rows: DataFrame, by: str, position: str, value: str) -> DataFrame:
    """by, first, length and value of runs of equal values along a position."""
    w = Window.partitionBy(by).orderBy(position)
    fresh = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    return rows.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w)).groupBy(by, "_g").agg(F.min(position).alias("first"), F.count("*").alias("length"), F.first(value).alias("value")).drop("_g")


def overlaps(a: DataFrame, b: DataFrame, image: str = "image_id") -> DataFrame:
    """a_id, b_id, shared pixels, iou of masks (image, id, y, x) that share a pixel."""
    count = lambda m, p: m.groupBy(image, F.col("id").alias(f"{p}_id")).agg(F.count("*").alias(f"{p}_n"))
    met = a.withColumnRenamed("id", "a_id").join(b.withColumnRenamed("id", "b_id"), [image, "y", "x"]).groupBy(image, "a_id", "b_id").agg(F.count("*").alias("shared"))
    out = met.join(count(a, "a"), [image, "a_id"]).join(count(b, "b"), [image, "b_id"])
    return out.withColumn("iou", F.col("shared") / (F.col("a_n") + F.col("b_n") - F.col("shared")))


def best_match(found: DataFrame, projected: DataFrame, least: float = 0.025) -> DataFrame:
    """For each found mask the projected one of greatest overlap above the least."""
    return overlaps(found, projected).filter(F.col("iou") > least).groupBy("image_id", "a_id").agg(F.max_by(F.struct("b_id", "iou"), F.struct("iou", -F.col("b_id"))).alias("m")).select("image_id", "a_id", "m.b_id", "m.iou")


def box_iou(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Of boxes with x1, y1, x2, y2."""
    zero = F.lit(0.0)
    shared = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), zero) * F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), zero)
    area = lambda x: (x.x2 - x.x1) * (x.y2 - x.y1)
    return shared / (area(a) + area(b) - shared + eps)


def suppressed(detections: DataFrame, by: str, most: float = 0.5) -> DataFrame:
    """Greedy suppression within an image: by score down, then position; a box goes if it overlaps a kept one by more than most.

    detections: by, pos, score, x1, y1, x2, y2. Kept rows come with their pos.
    One image's boxes, some hundreds by nature, fold in one row.
    """
    item = F.struct((-F.col("score")).alias("s"), "pos", "score", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    kind = "array<struct<s:double,pos:bigint,score:double,x1:double,y1:double,x2:double,y2:double>>"
    kept = F.aggregate("b", F.array().cast(kind), lambda out, x: F.when(F.exists(out, lambda k: box_iou(k, x) > most), out).otherwise(F.concat(out, F.array(x))))
    rows = detections.groupBy(by).agg(F.array_sort(F.collect_list(item)).cast(kind).alias("b")).select(by, F.explode(kept).alias("k"))
    return rows.select(by, "k.pos", "k.score", "k.x1", "k.y1", "k.x2", "k.y2")


def not_full_image(boxes: DataFrame) -> DataFrame:
    """Without boxes that reach within a tenth of all four borders. boxes: x1, y1, x2, y2, w, h."""
    return boxes.filter(~((F.col("x1") < 0.1 * F.col("w")) & (F.col("y1") < 0.1 * F.col("h")) & (F.col("x2") > 0.9 * F.col("w")) & (F.col("y2") > 0.9 * F.col("h"))))


def without_contained(pixels: DataFrame, boxes: DataFrame, inner: float = 0.8, outer: float = 0.7) -> DataFrame:
    """Masks less the pixels of masks whose boxes they contain: the shared area is over `inner` of the other box and under `outer` of their own.

    All subtractions use the masks as given.
    """
    item = F.struct("x1", "y1", "x2", "y2")
    side = lambda p: boxes.select("image_id", F.col("id").alias(f"{p}_id"), item.alias(p))
    a, b = F.col("a"), F.col("b")
    zero = F.lit(0.0)
    shared = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), zero) * F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), zero)
    area = lambda x: (x.x2 - x.x1) * (x.y2 - x.y1)
    pairs = side("a").join(side("b"), "image_id").filter((F.col("a_id") != F.col("b_id")) & (shared > inner * area(b)) & (shared < outer * area(a))).select("image_id", "a_id", "b_id")
    gone = pixels.withColumnRenamed("id", "b_id").join(pairs, ["image_id", "b_id"]).select("image_id", F.col("a_id").alias("id"), "y", "x").distinct()
    return pixels.join(gone, ["image_id", "id", "y", "x"], "left_anti")


def edge_and_size(pixels: DataFrame, size: DataFrame) -> DataFrame:
    """id, boundary (least distance to the image's border, of half its shorter side) and area share of each mask."""
    h, w = F.col("h"), F.col("w")
    rows = pixels.join(size, "image_id")
    edge = F.least(F.col("y"), h - 1 - F.col("y"), F.col("x"), w - 1 - F.col("x"))
    return rows.groupBy("image_id", "id", "h", "w").agg((F.min(edge) / F.greatest(F.least(F.floor(h / 2), F.floor(w / 2)), F.lit(1))).alias("boundary"), (F.count("*") / (h * w)).alias("area"))


def best_mask(scored: DataFrame, by: str = "object_id") -> DataFrame:
    """The row of each object with the greatest boundary + 25 * area, the first of equals."""
    best = F.max_by(F.struct(*scored.columns), F.struct((F.col("boundary") + 25 * F.col("area")).alias("s"), -F.col("pos")))
    return scored.groupBy(F.col(by).alias("_k")).agg(best.alias("m")).select("m.*")


def spread(pixels: DataFrame, size: DataFrame, bins: int = 30) -> DataFrame:
    """Divergence of each mask's angles and radii about the image's centre from those of the whole image's disc."""
    rows = pixels.join(size, "image_id")
    dy, dx = F.col("y") - (F.col("h") - 1) / 2, F.col("x") - (F.col("w") - 1) / 2
    radius = F.sqrt(dx * dx + dy * dy) / F.sqrt((F.col("h") * F.col("h") + F.col("w") * F.col("w")) / 4)
    angle = (F.atan2(dy, dx) + math.pi) / (2 * math.pi)
    rows = rows.withColumns({"a": F.least(F.floor(angle * bins), F.lit(bins - 1)), "r": F.least(F.floor(radius * bins), F.lit(bins - 1))})
    total = Window.partitionBy("image_id", "id")

    def divergence(c: str, ideal: Column, name: str) -> DataFrame:
        counted = rows.groupBy("image_id", "id", c).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(total))
        return counted.groupBy("image_id", "id").agg(F.sum(F.col("p") * F.log(F.col("p") / ideal)).alias(name))

    flat = divergence("a", F.lit(1 / bins), "angle_divergence")
    rings = divergence("r", (2 * F.col("r") + 1) / (bins * bins), "radius_divergence")
    return flat.join(rings, ["image_id", "id"])
