"""Spatial relations between targets and anchors, and the text made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(objects: DataFrame, top: int) -> DataFrame:
    """Best targets with best anchors of each query: t_* and a_* columns, without an object and itself.

    objects: query_id, role (target, anchor), pos, score and whatever is related. A query has top * top pairs at most.
    """
    w = Window.partitionBy("query_id", "role").orderBy(F.desc("score"), "pos")
    best = objects.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    side = lambda role, p: best.filter(F.col("role") == role).select("query_id", *(F.col(c).alias(f"{p}_{c}") for c in best.columns if c not in ("query_id", "role")))
    return side("target", "t").join(side("anchor", "a"), "query_id").filter("t_pos <> a_pos")


def signed(df: DataFrame, scene: DataFrame | None = None) -> DataFrame:
    """distance, dx, dy, dz of centres (x, y, z) and, with a scene's centre, the distances to it, as text with three decimals."""
    d = {c: F.col(f"t_{c}") - F.col(f"a_{c}") for c in "xyz"}
    out = df.withColumn("distance", F.sqrt(sum((v * v for v in d.values()), F.lit(0.0)))).withColumns({f"d{c}": v for c, v in d.items()})
    shown = ["distance", "dx", "dy", "dz"]
    if scene is not None:
        out = out.crossJoin(F.broadcast(scene.select(*(F.col(c).alias(f"s_{c}") for c in "xyz")).limit(1)))
        for p, name in (("t", "target_scene_dist"), ("a", "anchor_scene_dist")):
            out = out.withColumn(name, F.sqrt(sum(((F.col(f"{p}_{c}") - F.col(f"s_{c}")) * (F.col(f"{p}_{c}") - F.col(f"s_{c}")) for c in "xyz"), F.lit(0.0))))
            shown.append(name)
    return out.withColumn("text", F.concat_ws(", ", *(F.concat(F.lit(f"{s}="), F.format_string("%.3f", F.col(s))) for s in shown)))


def predicates(df: DataFrame, margin: float = 0.2, touch: float = 0.3) -> DataFrame:
    """Named relations of target to anchor from centres (x, y, z) and heights (h), and horizontal distance.

    Differences beyond the margin give sides; a target whose centre is above
    the anchor's by less than `touch` times both heights is on top of it.
    """
    d = {c: F.col(f"t_{c}") - F.col(f"a_{c}") for c in "xyz"}
    when = lambda cond, name: F.when(cond, F.lit(name))
    names: list[Column] = [
        F.when(F.abs(d["x"]) > margin, F.when(d["x"] > 0, "to the right of").otherwise("to the left of")),
        F.when(F.abs(d["y"]) > margin, F.when(d["y"] > 0, "above").otherwise("below")),
        F.when(F.abs(d["z"]) > margin, F.when(d["z"] > 0, "in front of").otherwise("behind")),
        when((F.abs(d["y"]) < (F.col("t_h") + F.col("a_h")) * touch) & (d["y"] > 0), "on top of"),
    ]
    found = F.array_compact(F.array(*names))
    out = df.withColumn("relations", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("near"))))
    return out.withColumn("horizontal", F.sqrt(d["x"] * d["x"] + d["z"] * d["z"])).withColumn("text", F.concat(F.array_join("relations", ", "), F.lit(" ("), F.format_string("%.2f", F.col("horizontal")), F.lit(" m)")))


def numbered(lines: Column) -> Column:
    """Lines with numbers from 1."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def context(*sections: tuple[str, Column]) -> Column:
    """Titled sections that have text, with blank lines between."""
    return F.concat_ws("\n\n", *(F.when(body != "", F.concat(F.lit(f"{title}:\n"), body)) for title, body in sections))
