"""Time zones of places: exact polygons, bounding boxes, or cells.  Zones are dealt to grid cells that their boxes cover, so only near ones are tested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import cells

GRID = 10.0


def boxes(zones: DataFrame) -> DataFrame:
    """zones (tzid, polygons array<array<array<struct<lon, lat>>>>: polygons of rings, the first one outer) with their bounds."""
    flat = F.flatten(F.flatten("polygons"))
    lon, lat = F.transform(flat, lambda p: p["lon"]), F.transform(flat, lambda p: p["lat"])
    return zones.withColumns({"west": F.array_min(lon), "east": F.array_max(lon), "south": F.array_min(lat), "north": F.array_max(lat)})


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a ring (array<struct<lon, lat>>, closed or not) holds a point, by crossings."""

    def crossed(a: Column, i: Column) -> Column:
        b = F.get(ring, F.when(i + 1 == F.size(ring), F.lit(0)).otherwise(i + 1))
        at = (b["lon"] - a["lon"]) * (y - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return F.when((a["lat"] > y) != (b["lat"] > y), x < at).otherwise(F.lit(False))

    return F.size(F.filter(ring, crossed)) % 2 == 1


def _near(points: DataFrame, zones: DataFrame) -> DataFrame:
    dealt = boxes(zones).withColumn("_gx", F.explode(F.sequence(F.floor(F.col("west") / GRID), F.floor(F.col("east") / GRID)))).withColumn("_gy", F.explode(F.sequence(F.floor(F.col("south") / GRID), F.floor(F.col("north") / GRID))))
    own = points.withColumn("_gx", F.floor(F.col("lon") / GRID)).withColumn("_gy", F.floor(F.col("lat") / GRID))
    box = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return own.join(dealt, ["_gx", "_gy"]).where(box).drop("_gx", "_gy")


def exact(points: DataFrame, zones: DataFrame) -> DataFrame:
    """points (key, lon, lat) with every zone whose polygons hold them; points in none are left out."""

    x, y = F.col("lon"), F.col("lat")
    held = F.exists("polygons", lambda rings: inside(x, y, F.get(rings, F.lit(0))) & ~F.exists(F.slice(rings, 2, F.size(rings)), lambda hole: inside(x, y, hole)))
    return _near(points, zones).where(held).select("key", "tzid")


def nearest_box(points: DataFrame, zones: DataFrame) -> DataFrame:
    """The zone whose bounding box is nearest, ties by name: always an answer.  Zones are a fixed table of a few hundred rows of five numbers."""
    b = F.broadcast(boxes(zones).select("tzid", "west", "east", "south", "north"))
    dx = F.greatest(F.col("west") - F.col("lon"), F.lit(0.0), F.col("lon") - F.col("east"))
    dy = F.greatest(F.col("south") - F.col("lat"), F.lit(0.0), F.col("lat") - F.col("north"))
    return points.crossJoin(b).groupBy("key").agg(F.min_by("tzid", F.struct((dx * dx + dy * dy).alias("d"), "tzid")).alias("tzid"))


def by_cells(points: DataFrame, zone_cells: DataFrame, depth: int = 13) -> DataFrame:
    """zone_cells (quadkey, depth, tzid) to every distinct zone of a point's cells, the finest first: key, place, tzid."""
    levels = F.array(*(F.struct(F.lit(k).alias("depth"), cells.quadkey("lon", "lat", k).alias("quadkey")) for k in range(1, depth + 1)))
    rows = points.select("key", F.explode(levels).alias("c")).select("key", "c.depth", "c.quadkey").join(zone_cells, ["depth", "quadkey"])
    fine = rows.groupBy("key", "tzid").agg(F.max("depth").alias("depth"))
    return fine.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.col("depth").desc(), "tzid"))).select("key", "place", "tzid")


def settle_cells(claims: DataFrame) -> DataFrame:
    """claims (cell, tz_index, holds_centre): one zone a cell: one that holds its centre, else the first."""
    return claims.groupBy("cell").agg(F.min_by("tz_index", F.struct(~F.col("holds_centre"), "tz_index")).alias("tz_index"))


def primary_offset(zone: Column) -> Column:
    """struct<seconds, minutes, hours> of a zone's standard time: the smaller of the offsets in January and in July 2024; parts are cut."""
    seconds = []
    for day in ("2024-01-01 12:00:00", "2024-07-01 12:00:00"):
        at = F.lit(day).cast("timestamp")
        seconds.append((F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)).cast("int"))
    least = F.least(*seconds)
    return F.struct(least.alias("seconds"), (least / 60).cast("int").alias("minutes"), (least / 3600).cast("int").alias("hours"))
