"""Grounding hits by threshold and split, and label-map metrics from one confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The seven flags that annotations are split by (fixed values of the annotation format).
SPLITS = ("mentions_target_class", "uses_object_lang", "uses_spatial_lang", "uses_color_lang", "uses_shape_lang", "is_easy", "is_view_dep")


def hits(rows: DataFrame, thresholds: Sequence[float], splits: Sequence[str] = SPLITS) -> DataFrame:
    """split, value, threshold, total, hits: over all rows and by each flag; a null flag is false; empty buckets count 0.

    rows: iou and the flags. Each row is read once and counted in place; nothing
    is joined with thresholds.
    """
    flag = lambda s: F.coalesce(F.col(s), F.lit(False))
    buckets = [("overall", "all", F.lit(True)), *((s, str(v).lower(), flag(s) if v else ~flag(s)) for s in splits for v in (False, True))]
    iou = F.coalesce("iou", F.lit(0.0))
    counts = [F.count_if(cond).alias(f"n{i}") for i, (_, _, cond) in enumerate(buckets)]
    counts += [F.count_if(cond & (iou >= t)).alias(f"h{i}_{j}") for i, (_, _, cond) in enumerate(buckets) for j, t in enumerate(thresholds)]
    row = rows.agg(*counts)
    out = F.array(*(F.struct(F.lit(s).alias("split"), F.lit(v).alias("value"), F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("total"), F.col(f"h{i}_{j}").alias("hits")) for i, (s, v, _) in enumerate(buckets) for j, t in enumerate(thresholds)))
    return row.select(F.inline(out))


def failed(rows: DataFrame, threshold: float = 0.1, recompute: Column | None = None) -> DataFrame:
    """Rows below the threshold; where iou is 0 it is computed anew if the boxes are there."""
    iou = F.coalesce("iou", F.lit(0.0))
    if recompute is not None:
        iou = F.when(iou == 0, F.coalesce(recompute, F.lit(0.0))).otherwise(iou)
    return rows.withColumn("iou", iou).filter(F.col("iou") < threshold)


def confusion(pixels: DataFrame, truth: str = "gt", found: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """gt, pred, n."""
    return pixels.groupBy(*by, F.col(truth).alias("gt"), F.col(found).alias("pred")).agg(F.count("*").alias("n"))


def same_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """Label maps (image_id, y, x, label) as pixels with gt and pred; maps of other sizes are an error."""
    both = a.withColumnRenamed("label", "gt").join(b.withColumnRenamed("label", "pred"), ["image_id", "y", "x"], "full")
    ok = F.col("gt").isNotNull() & F.col("pred").isNotNull()
    return both.withColumn("gt", F.when(ok, F.col("gt")).otherwise(F.raise_error("label maps of different sizes").cast("int")))


def class_counts(table: DataFrame) -> DataFrame:
    """class, inter, gt, pred of each class on either side."""
    g = table.groupBy(F.col("gt").alias("class")).agg(F.sum("n").alias("gt_n"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("inter"))
    p = table.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("pred_n"))
    zero = F.lit(0)
    return g.join(p, "class", "full").select("class", F.coalesce("inter", zero).alias("inter"), F.coalesce("gt_n", zero).alias("gt_n"), F.coalesce("pred_n", zero).alias("pred_n"))


def class_iou(table: DataFrame, ignore: Sequence[int] = ()) -> DataFrame:
    """class and iou of every class on either side; classes on one side only score 0."""
    rows = class_counts(table).filter(~F.col("class").isin(*ignore)) if ignore else class_counts(table)
    return rows.select("class", (F.col("inter") / (F.col("gt_n") + F.col("pred_n") - F.col("inter"))).alias("iou"))


def summary(table: DataFrame, ignore: Sequence[int] = ()) -> DataFrame:
    """pixel_accuracy, mean_accuracy, mean_iou and frequency_weighted_iou as one row.

    Accuracy runs over classes of the truth. mean_iou sums classes on both
    sides and divides by the truth's classes that are not ignored; the weighted
    one divides by all pixels that are not ignored.
    """
    c = class_counts(table).withColumn("use", ~F.col("class").isin(*ignore) if ignore else F.lit(True))
    real = (F.col("gt_n") > 0) & F.col("use")
    both = real & (F.col("pred_n") > 0)
    iou = F.col("inter") / (F.col("gt_n") + F.col("pred_n") - F.col("inter"))
    total = lambda cond, value: F.sum(F.when(cond, value).otherwise(0.0))
    return c.agg(
        F.try_divide(total(real, F.col("inter").cast("double")), total(real, F.col("gt_n").cast("double"))).alias("pixel_accuracy"),
        F.avg(F.when(real, F.col("inter") / F.col("gt_n"))).alias("mean_accuracy"),
        F.try_divide(total(both, iou), F.count_if(real).cast("double")).alias("mean_iou"),
        F.try_divide(total(both, F.col("gt_n") * iou), total(real, F.col("gt_n").cast("double"))).alias("frequency_weighted_iou"),
    )
