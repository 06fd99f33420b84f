"""Spatial joins of points with nodes and edges, by grid cells: an equi-join on the cell that a point lies in, refined by the exact box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geo

#: Degrees; about the length of an edge or a few.
CELL = 0.004


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def _covered(low: Column, high: Column, size: float) -> Column:
    return F.sequence(_cell(low, size), _cell(high, size))


def _margins(lat: Column, distance: float) -> tuple[Column, Column]:
    """Degrees of longitude and latitude that surely cover the half boxes of points within reach of this latitude."""
    dy = 1.01 * math.degrees(distance / math.sqrt(2) / 6335000.0)
    return F.lit(dy) / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(89.99), F.abs(lat) + F.lit(2 * dy))))), F.lit(dy)


_BOX = ("_west", "_east", "_south", "_north")


def _boxed(points: DataFrame, distance: float, size: float) -> DataFrame:
    """Points with their cell and the bounds of their box: worked out once a point, so that a pair costs comparisons alone."""
    hx, hy = geo.half_box("lat", distance)
    lon, lat = F.col("lon"), F.col("lat")
    return points.withColumns({"_cx": _cell(lon, size), "_cy": _cell(lat, size), "_west": lon - hx, "_east": lon + hx, "_south": lat - hy, "_north": lat + hy})


def edges_near(points: DataFrame, fat_edges: DataFrame, distance: float, size: float = CELL) -> DataFrame:
    """Every point (lon, lat, ...) with each edge whose envelope meets the point's box.  Only edges are dealt to several cells, so no pair comes twice."""
    x1, x2 = F.least("lon1", "lon2"), F.greatest("lon1", "lon2")
    y1, y2 = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    dx, dy = _margins(F.greatest(F.abs(y1), F.abs(y2)), distance)
    dealt = fat_edges.withColumn("_cx", F.explode(_covered(x1 - dx, x2 + dx, size))).withColumn("_cy", F.explode(_covered(y1 - dy, y2 + dy, size)))
    meets = (x1 <= F.col("_east")) & (x2 >= F.col("_west")) & (y1 <= F.col("_north")) & (y2 >= F.col("_south"))
    return _boxed(points, distance, size).join(dealt, ["_cx", "_cy"]).where(meets).drop("_cx", "_cy", *_BOX)


def nodes_near(points: DataFrame, nodes: DataFrame, distance: float, size: float = CELL) -> DataFrame:
    """Every point with each node (node_id, node_lon, node_lat) in its box."""
    dx, dy = _margins(F.col("node_lat"), distance)
    near = nodes.select("node_id", F.col("lon").alias("node_lon"), F.col("lat").alias("node_lat"))
    dealt = near.withColumn("_cx", F.explode(_covered(F.col("node_lon") - dx, F.col("node_lon") + dx, size))).withColumn("_cy", F.explode(_covered(F.col("node_lat") - dy, F.col("node_lat") + dy, size)))
    inside = F.col("node_lon").between(F.col("_west"), F.col("_east")) & F.col("node_lat").between(F.col("_south"), F.col("_north"))
    return _boxed(points, distance, size).join(dealt, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy", *_BOX)


def in_box(rows: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Nodes, or fat edges by their envelope, that meet a box; plain comparisons, so that file statistics prune."""
    if "lon1" in rows.columns:
        return rows.where((F.least("lon1", "lon2") <= east) & (F.greatest("lon1", "lon2") >= west) & (F.least("lat1", "lat2") <= north) & (F.greatest("lat1", "lat2") >= south))
    return rows.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def _nearest_listed(points: DataFrame, near: DataFrame, key: str, width: float) -> DataFrame:
    """Each key's nearest node as a struct b, of the nodes in its cell and those around."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    dealt = near.withColumn("_cx", F.explode(F.transform(around, lambda i: _cell(F.col("_nx"), width) + i))).withColumn("_cy", F.explode(F.transform(around, lambda i: _cell(F.col("_ny"), width) + i)))
    lists = dealt.groupBy("_cx", "_cy").agg(F.collect_list(F.struct("_nx", "_ny", "node_id")).alias("_n"))
    own = points.withColumn("_cx", _cell(F.col("lon"), width)).withColumn("_cy", _cell(F.col("lat"), width)).join(lists, ["_cx", "_cy"])
    each = F.transform("_n", lambda n: F.struct(F.sqrt(F.pow(n["_nx"] - F.col("lon"), 2) + F.pow(n["_ny"] - F.col("lat"), 2)).alias("distance"), n["node_id"].alias("node_id")))
    return own.select(key, F.array_min(each).alias("b")).groupBy(key).agg(F.min("b").alias("b"))


def nearest_node(points: DataFrame, nodes: DataFrame, key: str, size: float = CELL, rings: int = 12) -> DataFrame:
    """key, node_id and planar distance (degrees) of the nearest node, ties to the smaller id.

    Cells are searched in growing rings: a point is done when its best distance is within the ring that was searched.  Each ring doubles, and only
    points that aren't done go on, so dense places cost one join.
    """
    found, left, width = None, points.select(key, "lon", "lat"), size
    near = nodes.select("node_id", F.col("lon").alias("_nx"), F.col("lat").alias("_ny"))
    for ring in range(rings):
        if ring == 0:  # few nodes are near: they are listed by cell, so that points are neither multiplied nor sorted with each of them
            best = _nearest_listed(left, near, key, width)
        own = left.withColumn("_cx", F.explode(F.sequence(_cell(F.col("lon"), width) - 1, _cell(F.col("lon"), width) + 1)))
        own = own.withColumn("_cy", F.explode(F.sequence(_cell(F.col("lat"), width) - 1, _cell(F.col("lat"), width) + 1)))
        dealt = near.withColumn("_cx", _cell(F.col("_nx"), width)).withColumn("_cy", _cell(F.col("_ny"), width))
        d = F.sqrt(F.pow(F.col("_nx") - F.col("lon"), 2) + F.pow(F.col("_ny") - F.col("lat"), 2))
        if ring > 0:
            best = own.join(dealt, ["_cx", "_cy"]).groupBy(key).agg(F.min(F.struct(d.alias("distance"), "node_id")).alias("b"))
        done = best.where(F.col("b.distance") <= width).select(key, F.col("b.node_id").alias("node_id"), F.col("b.distance").alias("distance"))
        done = done.cache()
        found = done if found is None else found.union(done)
        left = left.join(done.select(key), key, "left_anti")
        if ring + 1 < rings and not left.take(1):
            return found
        width *= 4
    return found


def projected(points: DataFrame, fat_edges: DataFrame, distance: float) -> DataFrame:
    """edges_near with the point's projection on the edge: fraction, px, py and metres; edges without length are left out."""
    near = edges_near(points, fat_edges, distance).withColumn("fraction", geo.along("lon", "lat", "lon1", "lat1", "lon2", "lat2")).where("fraction is not null")
    near = geo.with_interpolated(near, "px", "py", ("lon1", "lat1", "lon2", "lat2"), "fraction")
    return near.withColumn("metres", geo.haversine("lon", "lat", "px", "py"))


def nearest_of(near: DataFrame, *keys: str) -> DataFrame:
    """Of projections, each key's nearest as a struct b; those within a micrometre of it tie, and the smaller edge wins."""
    near = near.withColumn("_least", F.min("metres").over(Window.partitionBy(*keys))).where(F.col("metres") <= F.col("_least") + F.lit(1e-6))
    return near.groupBy(*keys).agg(F.min(F.struct("source", "target", "metres", "px", "py", "fraction")).alias("b"))


def nearest_projected(points: DataFrame, fat_edges: DataFrame, key: str, distance: float) -> DataFrame:
    """The nearest projection of each point within the box, to a micrometre; ties to the smaller edge."""
    best = nearest_of(projected(points, fat_edges, distance), key)
    return best.select(key, F.col("b.source"), F.col("b.target"), F.col("b.px").alias("lon"), F.col("b.py").alias("lat"), F.col("b.metres"), F.col("b.fraction"))


def emission_cost(metres: Column, zeta: float = 100.0, beta: float = 1.0) -> Column:
    """100 at 0 m, growing with the root of the distance; rounded at the ninth place before it is cut, so engines agree."""
    score = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.exp(-F.sqrt(metres / 25.0))))
    return F.floor(F.round(F.lit(zeta) * F.pow(F.lit(1.0) / score, F.lit(beta)), 9)).cast("long")


def candidates(points: DataFrame, fat_edges: DataFrame, distance: float = 50.0) -> DataFrame:
    """points (trip, layer, lon, lat) to candidates, numbered in each layer by edge."""
    rows = projected(points, fat_edges, distance).withColumn("emission", emission_cost(F.col("metres")))
    node = (F.row_number().over(Window.partitionBy("trip", "layer").orderBy("source", "target")) - 1).cast("int")
    return rows.select("trip", "layer", node.alias("node"), "source", "target", "way_id", "weight", "px", "py", "fraction", "metres", "emission", "lon1", "lat1", "lon2", "lat2")


def layer_pairs(cand: DataFrame, fanout: int | None = None) -> DataFrame:
    """All pairs of candidates of layers that follow each other; with fanout, each candidate's nearest ones only."""
    a = cand.select("trip", F.col("layer").alias("layer"), *(F.col(c).alias(f"a_{c}") for c in cand.columns if c not in ("trip", "layer")))
    b = cand.select("trip", (F.col("layer") - 1).alias("layer"), *(F.col(c).alias(f"b_{c}") for c in cand.columns if c not in ("trip", "layer")))
    pairs = a.join(b, ["trip", "layer"]).withColumn("straight", geo.haversine("a_px", "a_py", "b_px", "b_py"))
    if fanout is None:
        return pairs
    order = Window.partitionBy("trip", "layer", "a_node").orderBy("straight", "b_node")
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= fanout).drop("_r")


def display_order(cand: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates (trip, layer, node, emission) by emission for display, each with its new place, and whether it is the one that chosen (trip, layer, node) has."""
    place = (F.row_number().over(Window.partitionBy("trip", "layer").orderBy("emission", "node")) - 1).cast("int")
    own = chosen.select("trip", "layer", "node", F.lit(True).alias("_chosen"))
    return cand.withColumn("place", place).join(own, ["trip", "layer", "node"], "left").withColumn("chosen", F.coalesce("_chosen", F.lit(False))).drop("_chosen")
