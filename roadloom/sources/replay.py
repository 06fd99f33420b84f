"""Replay files: a CSV of vehicle positions, as a batch or as a stream of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.hashing import fnv1a64

COLUMNS = "VehicleID string, Provider string, EventTime string, Latitude double, Longitude double"


def event_time(text: Column) -> Column:
    """Times of either format, with whole or with broken seconds; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss z")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S] z")))


def replay_rows(raw: DataFrame) -> DataFrame:
    """vehicle_id, ts, lon, lat; rows without a vehicle or with an unreadable time are dropped."""
    rows = raw.where("VehicleID is not null").select(fnv1a64(F.col("VehicleID")).alias("vehicle_id"), event_time(F.col("EventTime")).alias("ts"), F.col("Longitude").alias("lon"), F.col("Latitude").alias("lat"))
    return rows.where("ts is not null")


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """In order of time."""
    return replay_rows(spark.read.csv(path, header=True).select("VehicleID", "Provider", "EventTime", F.col("Latitude").cast("double"), F.col("Longitude").cast("double"))).orderBy("ts")


def stream_replay(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return replay_rows(spark.readStream.schema(COLUMNS).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder))
