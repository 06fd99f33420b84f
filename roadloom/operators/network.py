"""Road networks as tables: nodes (node_id, lon, lat), directed edges (source, target, weight, way_id, direction), way_meta (way_id, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo, tags

NODES = "node_id bigint, lon double, lat double"
EDGES = "source bigint, target bigint, weight int, way_id bigint, direction string"


@dataclass
class Network:
    nodes: DataFrame
    edges: DataFrame
    way_meta: DataFrame | None = None

    def fat_edges(self) -> DataFrame:
        """Edges with the places of both ends; edges with an unknown end are left out."""
        a = self.nodes.select(F.col("node_id").alias("source"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
        b = self.nodes.select(F.col("node_id").alias("target"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
        return self.edges.join(a, "source").join(b, "target")

    def thin_edges(self, fat: DataFrame) -> DataFrame:
        """Fat edges as ids and attributes again; all are outgoing."""
        return fat.select("source", "target", "weight", "way_id", F.lit("Outgoing").alias("direction"))

    def edge_between(self, pairs: DataFrame) -> DataFrame:
        """pairs (source, target, ...) with the edge between them; pairs without one are left out."""
        return pairs.join(self.edges, ["source", "target"])

    def edge_details(self, pairs: DataFrame) -> DataFrame:
        """pairs (source, target) with their edge's attributes: way, length in metres, number of lanes and the first limit in km/h; names are empty."""
        own = self.edge_between(pairs.select("source", "target"))
        own = Network(self.nodes, own).fat_edges().withColumn("metres", geo.haversine("lon1", "lat1", "lon2", "lat2"))
        if self.way_meta is not None:
            have = self.way_meta.columns
            extra = [F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("lane_count", "int"), ("speed_kmh", "int"))]
            own = own.join(self.way_meta.select("way_id", *extra), "way_id", "left")
        else:
            own = own.withColumns({"lane_count": F.lit(None).cast("int"), "speed_kmh": F.lit(None).cast("int")})
        return own.select("source", "target", "way_id", "metres", "lane_count", "speed_kmh", F.array().cast("array<string>").alias("names"))

    def supports(self, candidates: DataFrame) -> DataFrame:
        """(trip, supported): whether this network knows both ends of every candidate edge (trip, source, target) of a trip."""
        ends = candidates.select("trip", F.explode(F.array("source", "target")).alias("node_id")).distinct()
        known = self.nodes.select("node_id", F.lit(True).alias("_known"))
        return ends.join(known, "node_id", "left").groupBy("trip").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("supported"))

    def counts(self) -> DataFrame:
        n = self.nodes.agg(F.count("*").alias("num_nodes"))
        e = self.edges.agg(F.count("*").alias("num_edges"))
        return n.join(e)  # a row each

    def out_of(self, of: DataFrame) -> DataFrame:
        return of.join(self.edges.withColumnRenamed("source", "node_id"), "node_id")

    def into(self, of: DataFrame) -> DataFrame:
        return of.join(self.edges.withColumnRenamed("target", "node_id"), "node_id")

    def successors(self, mode: str = "motorcar", allow_private: bool = False) -> DataFrame:
        """Fat edges that the mode may use, with their length cut to whole centimetres; edges of ways without attributes are closed if there are attributes at all."""
        fat = self.fat_edges()
        if self.way_meta is not None:
            open_ = self.way_meta.select("way_id", "access")
            way = F.when(F.col("direction") == "Incoming", F.lit("backward")).otherwise(F.lit("forward"))
            fat = fat.join(open_, "way_id").where(tags.accessible(F.col("access"), mode, way, allow_private)).drop("access")
        return fat.withColumn("cm", F.floor(geo.haversine("lon1", "lat1", "lon2", "lat2") * 100).cast("long"))

    def resolve(self, lists: DataFrame, ids: str = "ids") -> DataFrame:
        """Lists of node ids (key, ids) to array<struct<lon, lat>> in order; unknown ids are dropped."""
        rows = lists.select("key", F.posexplode(ids).alias("pos", "node_id")).join(self.nodes, "node_id")
        return rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).select("key", F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


def way_edges(ways: DataFrame, strict_reference: bool = True) -> DataFrame:
    """ways (way_id, refs, tags) to edges, `place` telling the order of ingest.  Both directions unless one-way; oneway=-1 is turned only without strict_reference."""
    road = ways.withColumn("weight", tags.road_weight(F.col("tags")["highway"])).where("weight is not null")
    single = tags.one_way(F.col("tags")["oneway"], F.col("tags")["junction"], strict_reference)
    pairs = F.transform(F.sequence(F.lit(0), F.size("refs") - 2), lambda i: F.struct(F.get("refs", i).alias("a"), F.get("refs", i + 1).alias("b"), i.alias("i")))
    rows = road.where(F.size("refs") > 1).select("way_id", "weight", single.alias("single"), F.coalesce(F.col("tags")["oneway"] == "-1", F.lit(False)).alias("turned"), F.explode(pairs).alias("p")).select("way_id", "weight", "single", "turned", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.i").alias("i"))
    turned = F.col("turned") & F.lit(not strict_reference)
    ahead = F.struct(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("target"), F.lit("Outgoing").alias("direction"))
    back = F.struct(F.col("b").alias("source"), F.col("a").alias("target"), F.lit("Incoming").alias("direction"))
    each = F.when(F.col("single"), F.array(ahead)).otherwise(F.array(ahead, back))
    return rows.select("way_id", "weight", F.col("i").alias("place"), F.explode(each).alias("e")).select("e.source", "e.target", "weight", "way_id", "e.direction", "place")


def last_wins(edges: DataFrame, *order: str) -> DataFrame:
    """One edge for each ordered pair of nodes: the last in order."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("e")
    return edges.groupBy("source", "target").agg(last).select("source", "target", *(F.col(f"e.{c}").alias(c) for c in rest))


def from_ways(nodes: DataFrame, ways: DataFrame, strict_reference: bool = True) -> Network:
    edges = last_wins(way_edges(ways, strict_reference), "way_id", "place", "direction")
    meta = ways.where(tags.road_weight(F.col("tags")["highway"]).isNotNull()).select(
        "way_id", F.col("tags")["highway"].alias("road_class"), F.col("tags")["lanes"].try_cast("int").alias("lane_count"),
        tags.speed_limits(F.col("tags")).alias("speed_limit"), tags.access_rules(F.col("tags")).alias("access"),
    )
    return Network(nodes.select("node_id", "lon", "lat"), edges.select("source", "target", "weight", "way_id", "direction"), meta)


def save(network: Network, path: str) -> None:
    network.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    network.edges.write.mode("overwrite").parquet(f"{path}/edges")
    if network.way_meta is not None:
        network.way_meta.write.mode("overwrite").parquet(f"{path}/way_meta")


def load(spark: SparkSession, path: str, with_meta: bool = True) -> Network:
    return Network(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/way_meta") if with_meta else None)


class Builder:
    """Small networks for tests: ways count from 1, a two-way edge is one way, all edges are outgoing and open."""

    def __init__(self):
        self.points, self.lines, self.way = [], [], 0

    def node(self, node_id: int, lon: float, lat: float) -> Builder:
        self.points.append((node_id, float(lon), float(lat)))
        return self

    def edge(self, a: int, b: int, weight: int = 1, both: bool = False) -> Builder:
        self.way += 1
        self.lines.append((a, b, weight, self.way, "Outgoing"))
        if both:
            self.lines.append((b, a, weight, self.way, "Outgoing"))
        return self

    def build(self, spark: SparkSession) -> Network:
        return Network(spark.createDataFrame(self.points, NODES), spark.createDataFrame(self.lines, EDGES))


