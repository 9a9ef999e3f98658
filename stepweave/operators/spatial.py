"""Binding of points to boxes, and selection of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.geometry import area, contains
from stepweave.functions.text import clean, view_id_leaf, widget_leaf
from stepweave.operators.scoring import keeps_node

BOX = "l int, t int, r int, b int"


def smallest_containing(nodes: Column, x: Column, y: Column) -> Column:
    """Of an array of nodes (box, depth, label, pos) the one of the smallest box that holds the point; then the deepest, then the first."""
    inside = F.filter(nodes, lambda n: contains(n["box"], x, y))
    return F.array_min(F.transform(inside, lambda n: F.struct(area(n["box"]).alias("area"), (-n["depth"]).alias("minus_depth"), n["pos"].alias("pos"), n["label"].alias("label"))))


def nearest(nodes: Column, x: Column, y: Column) -> Column:
    """Of the boxes that hold the point, or of all if none does, the one whose centre is nearest; then the first."""
    inside = F.filter(nodes, lambda n: contains(n["box"], x, y))
    pool = F.when(F.size(inside) > 0, inside).otherwise(nodes)
    gap = lambda n: F.hypot((n["box"]["l"] + n["box"]["r"]) / 2 - x, (n["box"]["t"] + n["box"]["b"]) / 2 - y)
    return F.array_min(F.transform(pool, lambda n: F.struct(gap(n).alias("distance"), n["pos"].alias("pos"), n["label"].alias("label"))))


def label_of(text: Column, description: Column, view_id: Column) -> Column:
    """A node's text, else its description, else its id's leaf."""
    return F.coalesce(clean(text), clean(description), view_id_leaf(view_id))


def with_boxes(nodes: DataFrame) -> DataFrame:
    """Flat nodes with box parsed, and label."""
    box = F.from_json("bbox", BOX)
    label = label_of(F.col("text"), F.col("content_description"), F.col("view_id_resource_name"))
    return nodes.withColumn("box", F.when(box["r"].isNotNull() & box["l"].isNotNull() & box["t"].isNotNull() & box["b"].isNotNull(), box)).withColumn("label", label)


def bind_points(points: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Each point (keys, point_id, x, y) with the smallest box of its screen that holds it: area, label, node_no; null without one.

    The screen's keys bring point and nodes together, so that only one screen's nodes are
    compared; the best is an aggregate, which is combined before the shuffle, and only its
    label is made. nodes: flat nodes with their leaves as text.
    """
    box = F.from_json("bbox", BOX)
    said = ("text", "content_description", "view_id_resource_name")
    boxes = nodes.select(*keys, "window_no", "node_no", box.alias("box"), F.coalesce(F.expr("try_cast(depth as int)"), F.lit(0)).alias("depth"), *said).where("box.l is not null and box.t is not null and box.r is not null and box.b is not null")
    inside = points.join(boxes, keys).where(contains(F.col("box"), F.col("x"), F.col("y")))
    best = inside.groupBy("point_id").agg(F.min(F.struct(area(F.col("box")).alias("area"), (-F.col("depth")).alias("d"), "window_no", "node_no", *said)).alias("best"))
    return points.join(best, "point_id", "left").select("point_id", *keys, "x", "y", F.col("best.area").alias("area"), label_of(*[F.col(f"best.{k}") for k in said]).alias("label"), F.col("best.node_no").alias("node_no"))


def candidates(nodes: DataFrame, most: int = 128, stored: int = 192, screens: DataFrame | None = None) -> DataFrame:
    """Per screen the `most` best of its `stored` best nodes: actionable before named before small before deep, then in order.

    Stored are nodes that keeps_node keeps, the first of each (box, text, description,
    class, view id); of those the best of each (box, name, role with its flags) is a
    candidate. screens: record_id, step_index, width, height; a screen of unknown size takes
    no node for large. Without screens its size is that of the farthest corner of a visible
    node.
    """
    screen = ["record_id", "step_index"]
    on = lambda c: F.coalesce(F.col(c) == "true", F.lit(False)) if c in nodes.columns else F.lit(False)
    n = with_boxes(nodes).where("box is not null").withColumn("role", widget_leaf(F.col("class_name"))).withColumn("area", area(F.col("box")))
    if screens is None:
        seen = F.when(F.coalesce(F.col("visible"), F.lit("true")) != "false", F.col("box.r").cast("bigint") * F.col("box.b"))
        n = n.withColumn("screen", F.max(seen).over(Window.partitionBy(*screen)))
    else:
        n = n.join(screens.select(*screen, F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width").cast("bigint") * F.col("height")).alias("screen")), screen, "left")
    text, description, class_name, view_id = clean(F.col("text")), clean(F.col("content_description")), clean(F.col("class_name")), view_id_leaf(clean(F.col("view_id_resource_name")))
    flags = ("editable", "clickable", "scrollable", "checkable", "checked")
    parts = F.array_distinct(F.array_compact(F.array("t", "d", "v")))
    n = n.withColumns({"t": text, "d": description, "c": class_name, "v": view_id, "leaf": widget_leaf(class_name), **{f"is_{k}": on(k) for k in flags}})
    node = F.struct("box", (F.coalesce(F.col("visible"), F.lit("true")) != "false").alias("visible"), *[F.col(f"is_{k}").alias(k) for k in flags[:4]], F.col("t").alias("text"), F.col("d").alias("description"), F.col("v").alias("view_id"), F.col("leaf").alias("widget"))
    n = n.where(keeps_node(node, F.col("screen")))
    n = n.withColumn("first", F.row_number().over(Window.partitionBy(*screen, "box", "t", "d", "c", "v").orderBy("window_no", "node_no"))).where("first = 1")
    n = n.withColumn("name", F.nullif(F.rtrim(F.substring(F.array_join(F.slice(parts, 1, 2), " | "), 1, 160)), F.lit(""))).withColumn("kind", F.concat_ws(" ", "leaf", *[F.when(F.col(f"is_{k}"), F.lit(k)) for k in flags]))
    actionable = F.col("is_editable") | F.col("is_clickable") | F.col("is_scrollable") | F.col("is_checkable")
    size = F.when(F.col("screen") > 0, F.col("area")).otherwise(F.lit(0))
    n = n.withColumn("place", F.row_number().over(Window.partitionBy(*screen).orderBy(actionable.desc(), F.col("name").isNotNull().desc(), size, F.coalesce(F.expr("try_cast(depth as int)"), F.lit(0)).desc(), "window_no", "node_no"))).where(F.col("place") <= stored)
    n = n.withColumn("first", F.row_number().over(Window.partitionBy(*screen, "box", "name", "kind").orderBy("place"))).where("first = 1")
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(*screen).orderBy("place"))).where(F.col("rank") <= most).select(*screen, "window_no", "node_no", "label", "role", "area", "rank")


def farthest_points(vectors: list, share: float, block: int = 1024) -> list[int]:
    """Greedy choice of max(1, round(share * n)) vectors by cosine distance, each the farthest from those chosen; sorted positions.

    Distances are made in blocks and for each chosen vector anew, so that memory grows with n, not with its square.
    """
    import numpy as np

    x = np.asarray(vectors, float)
    n = len(x)
    if not n:
        return []
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    # the second smallest distance of each vector, the smallest being that to itself
    second = np.concatenate([np.partition(1 - unit[i : i + block] @ unit.T, min(1, n - 1), axis=1)[:, min(1, n - 1)] for i in range(0, n, block)])
    chosen = [int(np.argmax(second))]
    gap = 1 - unit @ unit[chosen[0]]
    gap[chosen] = -np.inf
    while len(chosen) < max(1, round(share * n)):
        i = int(np.argmax(gap))
        chosen.append(i)
        gap = np.minimum(gap, 1 - unit @ unit[i])
        gap[chosen] = -np.inf
    return sorted(chosen)


def farthest_by_group(vectors: DataFrame, group: str, key: str, features: str, share: float) -> DataFrame:
    """group, key of the vectors that farthest_points chooses in each group, in the order of key. A group is one screen's or text's vectors and stands in one task."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pdf.iloc[farthest_points(list(pdf[features]), share)][[group, key]]

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.where(F.col(features).isNotNull()).select(group, key, features).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}")


def draft_tree(scores: DataFrame, roots: DataFrame, levels: int, per_level: int, total: int) -> DataFrame:
    """Best nodes of a tree that grows by scores: tree_id, node, parent, depth, score.

    scores: tree_id, parent, node, score (log-probability of the step); roots: tree_id, node.
    Each level keeps the per_level nodes of the highest summed score that follow the level
    before; of all levels the `total` best are kept, ties by node. A parent scores at least
    as high as its children, so that a kept node's ancestors are kept.
    """
    level = roots.select("tree_id", "node", F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth"), F.lit(0.0).alias("score"))
    grown = None
    step = scores.select("tree_id", F.col("parent").alias("from"), F.col("node").alias("to"), F.least(F.col("score"), F.lit(0.0)).alias("gain"))
    for depth in range(1, levels + 1):
        below = level.withColumnRenamed("node", "from").join(step, ["tree_id", "from"]).select("tree_id", F.col("to").alias("node"), F.col("from").alias("parent"), F.lit(depth).alias("depth"), (F.col("score") + F.col("gain")).alias("score"))
        rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "node"))
        level = below.withColumn("rank", rank).where(F.col("rank") <= per_level).drop("rank")
        grown = level if grown is None else grown.unionByName(level)
    best = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "depth", "node"))
    return grown.withColumn("rank", best).where(F.col("rank") <= total).drop("rank")
