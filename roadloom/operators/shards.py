"""Geographic shards: cells, selections with padding, the admission of nodes and edges, and the union of loaded shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import cells, geo
from roadloom.operators.network import Network


def cells_of(nodes: DataFrame, precision: int = 5) -> DataFrame:
    """Distinct cells with a node in them."""
    return nodes.select(cells.geohash("lon", "lat", precision).alias("cell")).distinct()


def contains(box: Sequence[float]) -> Column:
    west, south, east, north = box
    return F.col("lon").between(west, east) & F.col("lat").between(south, north)


def selected(box: Sequence[float], padding: float, loaded: Sequence[str] = (), precision: int = 5) -> Column:
    """Whether a place is in a padded box or in a loaded cell."""
    west, south, east, north = box
    dx, dy = geo.padding(padding, F.lit((south + north) / 2))
    padded = F.col("lon").between(F.lit(west) - dx, F.lit(east) + dx) & F.col("lat").between(F.lit(south) - dy, F.lit(north) + dy)
    return padded | cells.geohash("lon", "lat", precision).isin(list(loaded)) if loaded else padded


def admit(network: Network, rule: Column) -> Network:
    """Nodes that the rule takes, edges that start at them, and the nodes where those end."""
    own = network.nodes.where(rule)
    edges = network.edges.join(own.select(F.col("node_id").alias("source")), "source", "left_semi")
    more = network.nodes.join(edges.select(F.col("target").alias("node_id")).distinct(), "node_id", "left_semi")
    return Network(own.unionByName(more).dropDuplicates(["node_id"]), edges, network.way_meta)


def build(network: Network, padding: float = 1000.0, precision: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every shard at once: nodes and edges, each with all the cells whose padded bounds hold it; write them with partitionBy("shard")."""
    w, h = 360.0 / (1 << ((5 * precision + 1) // 2)), 180.0 / (1 << (5 * precision // 2))
    dx, dy = geo.padding(padding, "lat")
    xs = F.sequence(F.floor((F.col("lon") - dx + 180) / w), F.floor((F.col("lon") + dx + 180) / w))
    ys = F.sequence(F.floor((F.col("lat") - dy + 90) / h), F.floor((F.col("lat") + dy + 90) / h))
    near = network.nodes.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(ys))
    near = near.withColumn("shard", cells.geohash(F.col("_x") * w - 180 + w / 2, F.col("_y") * h - 90 + h / 2, precision)).drop("_x", "_y")
    own = near.join(cells_of(network.nodes, precision).withColumnRenamed("cell", "shard"), "shard", "left_semi")
    edges = network.edges.join(own.select("shard", F.col("node_id").alias("source")), "source")
    ends = edges.select("shard", F.col("target").alias("node_id")).join(network.nodes, "node_id")
    return own.unionByName(ends.select(*own.columns)).dropDuplicates(["shard", "node_id"]), edges


def write(network: Network, path: str, padding: float = 1000.0, precision: int = 5) -> None:
    nodes, edges = build(network, padding, precision)
    nodes.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/edges")


def load(spark, path: str, loaded: Sequence[str]) -> Network:
    """The union of some shards; only their folders are read."""
    nodes = spark.read.parquet(f"{path}/nodes").where(F.col("shard").isin(list(loaded)))
    edges = spark.read.parquet(f"{path}/edges").where(F.col("shard").isin(list(loaded)))
    return composite(nodes, edges)


def composite(nodes: DataFrame, edges: DataFrame) -> Network:
    """Distinct nodes and edges of several shards; the first shard's row stays."""
    rest = [c for c in nodes.columns if c not in ("shard", "node_id")]
    one = nodes.groupBy("node_id").agg(F.min_by(F.struct(*rest), "shard").alias("n")).select("node_id", *(F.col(f"n.{c}").alias(c) for c in rest))
    rest = [c for c in edges.columns if c not in ("shard", "source", "target")]
    kept = edges.groupBy("source", "target").agg(F.min_by(F.struct(*rest), "shard").alias("e")).select("source", "target", *(F.col(f"e.{c}").alias(c) for c in rest))
    return Network(one, kept)


def recenter(loaded: Column, wanted: Column) -> tuple[Column, Column]:
    """Cells to fetch and cells to evict when a window moves."""
    return F.array_except(wanted, loaded), F.array_except(loaded, wanted)
