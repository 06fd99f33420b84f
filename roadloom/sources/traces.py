"""Traces and zones in text formats: GeoJSON, WKT, snapshots of coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import from_wkt

FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:array<array<double>>>"
ZONES = "features array<struct<properties:struct<tzid:string>,geometry:struct<type:string,coordinates:string>>>"


def geojson_trace(spark: SparkSession, path: str) -> DataFrame:
    """(file, layer, lon, lat) of files with one LineString feature each; anything else is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", FEATURE).alias("f"))
    bad = F.col("f.type").isNull() | (F.col("f.type") != "Feature") | (F.col("f.geometry.type") != "LineString")
    rows = rows.select("file", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a trace must be one LineString feature"))).otherwise(F.col("f.geometry.coordinates")).alias("c"))
    return rows.select("file", F.posexplode("c").alias("layer", "p")).select("file", "layer", F.get("p", 0).alias("lon"), F.get("p", 1).alias("lat"))


def wkt_trace(rows: DataFrame, key: str = "trip", text: str = "wkt") -> DataFrame:
    return rows.select(key, F.posexplode(from_wkt(F.col(text))).alias("layer", "p")).select(key, "layer", "p.lon", "p.lat")


def to_geojson(points: DataFrame, key: str = "trip") -> DataFrame:
    """(key, value): a LineString feature of each trip's points (layer, lon, lat), ready for write.text."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("layer", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    rows = points.groupBy(key).agg(line.alias("c"))
    return rows.select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates")).alias("geometry"))).alias("value"))


def zones(spark: SparkSession, path: str) -> DataFrame:
    """(tzid, polygons) of a feature collection of Polygons and MultiPolygons; features without a zone are skipped."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", ZONES)["features"]).alias("f")).where("f.properties.tzid is not null")
    ring = "array<array<array<double>>>"
    many = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", f"array<{ring}>")).otherwise(F.array(F.from_json("f.geometry.coordinates", ring)))
    places = F.transform(many, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.struct(F.get(c, 0).alias("lon"), F.get(c, 1).alias("lat")))))
    return rows.where(F.col("f.geometry.type").isin("Polygon", "MultiPolygon")).select(F.col("f.properties.tzid").alias("tzid"), places.alias("polygons"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(file, layer, lon, lat) of text files: a head between lines of ---, then a longitude and a latitude a line."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", "").alias("body"))
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    at = rows.select("file", F.posexplode(lines).alias("layer", "x"))
    return at.select("file", "layer", F.split(F.trim("x"), r"\s+")[0].cast("double").alias("lon"), F.split(F.trim("x"), r"\s+")[1].cast("double").alias("lat"))


def difference(before: DataFrame, after: DataFrame, key: str = "file") -> DataFrame:
    """Files added, removed, modified or unchanged between two snapshots."""

    def whole(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("layer", "lon", "lat"))).alias(name))

    both = whole(before, "a").join(whole(after, "b"), key, "full")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified")
    return both.select(key, kind.alias("change"))


def magnitude(before: DataFrame, after: DataFrame, key: str = "file") -> DataFrame:
    """How far the points of one line are from the other line's points: the largest of the smallest distances, in metres."""
    from roadloom.functions.geo import haversine

    pairs = after.select(key, "layer", "lon", "lat").join(before.select(key, F.col("lon").alias("lon0"), F.col("lat").alias("lat0")), key)
    near = pairs.groupBy(key, "layer").agg(F.min(haversine("lon", "lat", "lon0", "lat0")).alias("d"))
    return near.groupBy(key).agg(F.max("d").alias("metres"))


def latest(files: DataFrame, key: str, order: str) -> DataFrame:
    """Of result files with the same key, the later one's row."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return files.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
