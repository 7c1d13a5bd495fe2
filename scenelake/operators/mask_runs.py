"""Image masks as runs along lines: overlaps, suppression, subtraction of contained masks, and run-length text.

A run is image_id, id, y, x0, x1: pixels x0 to x1 - 1 of line y of a mask. Runs
of one mask don't overlap. Work meets by image, line and stretch of a line, so
no task holds an image's pixels. ids are integers, unique within an image; rows
without image_id or id take no part, and masks without pixels have no runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pixels of a line that meet in a join.
STRETCH = 64


def line_runs(pixels: DataFrame) -> DataFrame:
    """Runs of set pixels (image_id, id, y, x); repeated pixels count once."""
    along = Window.partitionBy("image_id", "id", "y").orderBy("x")
    rows = pixels.select("image_id", "id", "y", "x").distinct().withColumn("_g", F.col("x") - F.row_number().over(along))
    return rows.groupBy("image_id", "id", "y", "_g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_g")


def run_pixels(runs: DataFrame) -> DataFrame:
    return runs.filter("x1 > x0").select("image_id", "id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))


def joined_runs(runs: DataFrame) -> DataFrame:
    """Runs of which those that touch in a line are one."""
    along = Window.partitionBy("image_id", "id", "y").orderBy("x0")
    fresh = F.coalesce((F.lag("x1").over(along) != F.col("x0")).cast("int"), F.lit(1))
    rows = runs.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(along))
    return rows.groupBy("image_id", "id", "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def run_overlaps(runs: DataFrame) -> DataFrame:
    """image_id, a_id < b_id, shared pixels and iou (1e-6 in the union) of masks that share a pixel.

    Runs are joined by stretches of a line; two runs meet in several, and are
    counted where their common part begins.
    """
    stretch = lambda x: F.floor(x / STRETCH)
    dealt = runs.filter("x1 > x0").withColumn("s", F.explode(F.sequence(stretch(F.col("x0")), stretch(F.col("x1") - 1))))
    side = lambda p: dealt.select("image_id", "y", "s", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "x1")))
    start, end = F.greatest("a_x0", "b_x0"), F.least("a_x1", "b_x1")
    met = side("a").join(side("b"), ["image_id", "y", "s"]).filter((F.col("a_id") < F.col("b_id")) & (start < end) & (stretch(start) == F.col("s")))
    shared = met.groupBy("image_id", "a_id", "b_id").agg(F.sum(end - start).alias("shared"))
    area = runs.groupBy("image_id", "id").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))
    for p in "ab":
        shared = shared.join(area.select("image_id", F.col("id").alias(f"{p}_id"), F.col("n").alias(f"{p}_n")), ["image_id", f"{p}_id"])
    return shared.select("image_id", "a_id", "b_id", "shared", (F.col("shared") / (F.col("a_n") + F.col("b_n") - F.col("shared") + 1e-6)).alias("iou"))


def suppressed_masks(runs: DataFrame, scores: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of scores (image_id, id, score, ...) that stay: by score down, then id, a mask goes if its iou with a kept one is over most.

    No score, or one that is no number, comes last. A mask that overlaps none
    before it stays whatever else happens; only the others, with the ids they
    overlap, are folded in order, an image at a time.
    """
    rank = F.struct(F.coalesce(-F.col("score").cast("double"), F.lit(float("inf"))), "id")
    ranks = scores.select("image_id", "id", rank.alias("rank"))
    side = lambda p: ranks.select("image_id", F.col("id").alias(f"{p}_id"), F.col("rank").alias(p))
    met = run_overlaps(runs).filter(F.col("iou") > most).join(side("a"), ["image_id", "a_id"]).join(side("b"), ["image_id", "b_id"])
    later = F.when(F.col("a") < F.col("b"), F.struct(F.col("b").alias("rank"), F.col("a_id").alias("over"))).otherwise(F.struct(F.col("a").alias("rank"), F.col("b_id").alias("over")))
    before = met.select("image_id", later.alias("x")).groupBy("image_id", F.col("x.rank").alias("rank")).agg(F.collect_list("x.over").alias("over"))
    kind = dict(scores.dtypes)["id"]
    gone = F.aggregate("m", F.array().cast(f"array<{kind}>"), lambda out, x: F.when(F.size(F.array_except(x["over"], out)) > 0, F.array_append(out, x["rank"]["id"])).otherwise(out))
    folded = before.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "over"))).alias("m"))
    return scores.join(folded.select("image_id", F.explode(gone).alias("id")), ["image_id", "id"], "left_anti")


def contained_boxes(boxes: DataFrame, inner: float = 0.8, outer: float = 0.7) -> DataFrame:
    """image_id, a_id, b_id where the shared area is over `inner` of b's box and under `outer` of a's. boxes: image_id, id, x1, y1, x2, y2."""
    side = lambda p: boxes.select("image_id", F.col("id").alias(f"{p}_id"), F.struct("x1", "y1", "x2", "y2").alias(p))
    a, b, zero = F.col("a"), F.col("b"), F.lit(0.0)
    shared = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), zero) * F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), zero)
    area = lambda x: (x.x2 - x.x1) * (x.y2 - x.y1)
    return side("a").join(side("b"), "image_id").filter((F.col("a_id") != F.col("b_id")) & (shared > inner * area(b)) & (shared < outer * area(a))).select("image_id", "a_id", "b_id")


def subtracted_in_turn(runs: DataFrame, boxes: DataFrame, inner: float = 0.8, outer: float = 0.7) -> DataFrame:
    """Runs less the masks whose boxes theirs contain, in the order of ids.

    A mask loses what a contained mask of smaller id has left after its own
    turn, and what one of greater id was given. Lines are cut where a run of a
    concerned mask begins or ends, and each piece is decided by the masks over
    it alone.
    """
    pairs = contained_boxes(boxes, inner, outer)
    inside = pairs.groupBy("image_id", F.col("a_id").alias("id")).agg(F.collect_set("b_id").alias("inside"))
    concerned = inside.join(pairs.select("image_id", F.col("b_id").alias("id")).distinct(), ["image_id", "id"], "full")
    rows = runs.filter("x1 > x0").select("image_id", "id", "y", "x0", "x1")
    turned = rows.join(concerned, ["image_id", "id"])
    cuts = turned.select("image_id", "y", F.explode(F.array("x0", "x1")).alias("s0")).distinct()
    pieces = cuts.withColumn("s1", F.lead("s0").over(Window.partitionBy("image_id", "y").orderBy("s0"))).filter("s1 is not null")
    over = turned.join(pieces, ["image_id", "y"]).filter("s0 >= x0 and s1 <= x1")
    kind = dict(runs.dtypes)["id"]
    none = F.array().cast(f"array<{kind}>")
    masks = over.groupBy("image_id", "y", "s0", "s1").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("inside", none).alias("inside")))).alias("m"))
    after = F.filter("m", lambda m: ~F.exists(m["inside"], lambda j: (j > m["id"]) & F.array_contains(F.col("m.id"), j)))
    left = F.aggregate(after, none, lambda out, m: F.when(F.exists(m["inside"], lambda j: (j < m["id"]) & F.array_contains(out, j)), out).otherwise(F.array_append(out, m["id"])))
    decided = masks.select("image_id", F.explode(left).alias("id"), "y", F.col("s0").alias("x0"), F.col("s1").alias("x1"))
    return joined_runs(rows.join(concerned.select("image_id", "id"), ["image_id", "id"], "left_anti").unionByName(decided))


def coco_text(counts: Column) -> Column:
    """Run lengths (see masks.run_lengths) as text: from the fourth on less the length two before, in groups of five bits, lowest first.

    A character is 48 plus the group, plus 32 if another follows; the last
    group's highest bit is the sign.
    """

    def text(x: Column) -> Column:
        bound = lambda n: F.pow(F.lit(2.0), 5 * n - 1)
        groups = F.element_at(F.filter(F.sequence(F.lit(1), F.lit(10)), lambda n: (x >= -bound(n)) & (x < bound(n))), 1)
        group = lambda k: F.pmod(F.floor(x / F.pow(F.lit(32.0), k)), F.lit(32))
        return F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), lambda k: F.char(group(k) + F.when(k < groups - 1, 80).otherwise(48))), "")

    return F.array_join(F.transform(counts, lambda x, i: text(x - F.when(i > 2, F.get(counts, i - 2)).otherwise(0))), "")


def coco_counts(rows: DataFrame) -> DataFrame:
    """mask_id and counts of run-length texts (mask_id, text; one row a mask). Characters that end no number are an error; no text has no counts."""
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([P-o]*[0-O])"))
    whole = F.array_join(pieces, "") == F.coalesce("text", F.lit(""))
    tokens = F.when(whole, pieces).otherwise(F.raise_error(F.lit("a run-length text is broken")).cast("array<string>"))
    group = lambda k: F.ascii(F.substring(F.col("t"), k, F.lit(1))) - 48
    digits = F.aggregate(F.sequence(F.lit(1), F.length("t")), F.lit(0).cast("long"), lambda s, k: s + (F.pmod(group(k), F.lit(32)) * F.pow(F.lit(32.0), k - 1)).cast("long"))
    negative = F.pmod(group(F.length("t")), F.lit(32)) >= 16
    value = digits - F.when(negative, F.pow(F.lit(32.0), F.length("t")).cast("long")).otherwise(0)
    listed = rows.select("mask_id", F.posexplode(tokens).alias("i", "t")).select("mask_id", "i", value.alias("d"))
    # every second length from the second on is a sum of differences; the first stands alone
    chain = Window.partitionBy("mask_id", F.when(F.col("i") == 0, -1).otherwise(F.col("i") % 2)).orderBy("i")
    ordered = listed.withColumn("n", F.sum("d").over(chain)).groupBy("mask_id").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("r"))
    return rows.select("mask_id").join(ordered, "mask_id", "left").select("mask_id", F.coalesce(F.col("r.n"), F.array().cast("array<bigint>")).alias("counts"))
