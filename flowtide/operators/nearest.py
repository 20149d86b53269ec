"""Nearest neighbours by a quadtree that is as deep as its places are dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_M, flat_m
from ..session import materialized

#: Halvings of the plane between two levels of the tree, its deepest level (about a metre), and the most targets of a leaf above it.
STEP, DEEPEST, LEAF = 2, 26, 16
CELL = ["_level", "_y", "_x"]


def _cell(level: Column | int) -> tuple[Column, Column]:
    """Cell numbers on a level; places beyond the globe lie in its outermost cells."""
    level = F.lit(level) if isinstance(level, int) else level
    side = F.pow(F.lit(2.0), level)
    at = lambda x, low, width: F.least(F.greatest(F.floor((F.col(x) - low) / width * side), F.lit(0)), side.cast("long") - 1)
    return at("_tlat", -90.0, 180.0), at("_tlon", -180.0, 360.0)


def tree(targets: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of targets (target columns, _tlat, _tlon). nodes: CELL, its parent's cell, the box of its targets, whether it is a leaf; only those that the tree has: the
    root, and children of nodes with more than ``leaf`` targets. leaves: the targets with the CELL of their leaf."""
    y, x = _cell(F.col("_level"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEEPEST), F.lit(STEP)))
    placed = targets.withColumn("_level", levels).withColumns({"_y": y, "_x": x})
    box = [f(c).alias(n) for n, f, c in (("_s", F.min, "_tlat"), ("_n", F.max, "_tlat"), ("_w", F.min, "_tlon"), ("_e", F.max, "_tlon"))]
    cells = placed.groupBy(*CELL).agg(F.count("*").alias("_held"), *box)
    ends = (F.col("_held") <= leaf) | (F.col("_level") == DEEPEST)
    up = [(F.col("_level") - STEP).alias("_plevel"), *(F.shiftright(c, STEP).alias(p) for c, p in (("_y", "_py"), ("_x", "_px")))]
    cells = materialized(cells.select(*CELL, *up, "_s", "_n", "_w", "_e", ends.alias("_is_leaf")), "quadtree")
    inner = cells.where("not _is_leaf").select(*[F.col(c).alias(p) for c, p in zip(CELL, ("_plevel", "_py", "_px"))])
    nodes = materialized(cells.where("_level = 0").unionByName(cells.join(inner, ["_plevel", "_py", "_px"], "left_semi").select(cells.columns)), "quadtree-nodes")
    return nodes, placed.join(nodes.where("_is_leaf").select(*CELL), CELL)


def _bounds() -> tuple[Column, Column]:
    """Metres from (lat, lon) to the nearest and the farthest place of a node's box, as flat_m() measures: the cosine of the mean latitude is least at an end of the box, and greatest there or at the equator."""
    lat, lon = F.col("lat"), F.col("lon")
    out = lambda at, low, high: F.greatest(low - at, at - high, F.lit(0.0))
    far = lambda at, low, high: F.greatest(F.abs(at - low), F.abs(at - high))
    ends = [F.cos(F.radians((lat + F.col(c)) / 2)) for c in ("_s", "_n")]
    least = F.greatest(F.least(*ends), F.lit(0.0))
    most = F.when((lat + F.col("_s")) * (lat + F.col("_n")) <= 0, F.lit(1.0)).otherwise(F.greatest(*ends))
    metres = lambda y, x, cos: EARTH_M * F.sqrt(F.pow(F.radians(y), 2) + F.pow(F.radians(x) * cos, 2))
    return metres(out(lat, F.col("_s"), F.col("_n")), out(lon, F.col("_w"), F.col("_e")), least), metres(far(lat, F.col("_s"), F.col("_n")), far(lon, F.col("_w"), F.col("_e")), most)


def candidates(points: DataFrame, targets: DataFrame, key: str, target: str, leaf: int = LEAF) -> DataFrame:
    """(key, lat, lon, target, _tlat, _tlon): the pairs among which each point's nearest target is.

    Each point goes down the tree from the root. At each level its nodes become their children, and those whose box is farther than the farthest place of another of
    its boxes are dropped, so a point meets a few leaves, whether its targets are spread over a country or lie in one street. Points and nodes of one place are
    dealt by the node, and Spark may split a node with very many points.
    """
    nodes, leaves = tree(targets.select(target, F.col("lat").alias("_tlat"), F.col("lon").alias("_tlon")).where("_tlat is not null and _tlon is not null"), leaf)
    box = ["_s", "_n", "_w", "_e", "_is_leaf"]
    near, far = _bounds()
    root = F.broadcast(nodes.where("_level = 0").select(*CELL, *box))
    front = points.select(key, "lat", "lon").where("lat is not null and lon is not null").distinct().crossJoin(root)  # one row
    # bounds and distances are rounded apart in their last digits
    slack = lambda c: c * (1 + 1e-9) + 1e-6
    own = Window.partitionBy(key, "lat", "lon")
    children = nodes.withColumnsRenamed(dict(zip(CELL, ("_l", "_cy", "_cx"))) | {b: f"_c{b}" for b in box}).select("_plevel", "_py", "_px", "_l", "_cy", "_cx", *[f"_c{b}" for b in box])
    level = 0
    while True:
        front = materialized(front, "quadtree-front")
        open_ = front.where("not _is_leaf")
        if level == DEEPEST or open_.isEmpty():
            break
        on = (F.col("_level") == F.col("_plevel")) & (F.col("_y") == F.col("_py")) & (F.col("_x") == F.col("_px"))
        below = open_.select(key, "lat", "lon", *CELL).join(children, on).select(key, "lat", "lon", F.col("_l").alias("_level"), F.col("_cy").alias("_y"), F.col("_cx").alias("_x"), *[F.col(f"_c{b}").alias(b) for b in box])
        all_ = front.where("_is_leaf").unionByName(below)
        front = all_.withColumns({"_near": near, "_far": far}).withColumn("_most", F.min("_far").over(own)).where(F.col("_near") <= slack(F.col("_most"))).drop("_near", "_far", "_most")
        level += STEP
    return front.select(key, "lat", "lon", *CELL).join(leaves, CELL).select(key, "lat", "lon", target, "_tlat", "_tlon")


def nearest(points: DataFrame, targets: DataFrame, key: str, target: str, leaf: int = LEAF) -> DataFrame:
    """For each point (key, lat, lon) the nearest target (target, lat, lon) on a plane, ties by name: (key, target, metres). Points and targets without a place are left out."""
    pairs = candidates(points, targets, key, target, leaf).withColumn("metres", flat_m("lat", "lon", "_tlat", "_tlon"))
    best = pairs.groupBy(key).agg(F.min(F.struct("metres", target)).alias("b"))
    return best.select(key, F.col(f"b.{target}").alias(target), F.col("b.metres").alias("metres"))
