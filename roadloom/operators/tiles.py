"""Vector tiles: filtered points placed on tiles, as structured layers or as encoded bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import cells


def within(value: Column, low, high, inclusive: bool = True) -> Column:
    return value.between(low, high) if inclusive else (value > low) & (value < high)


def dated(ts: Column, first: str, last: str, weekdays: Column | None = None) -> Column:
    """Days within a range, and on one of the weekdays (Monday 0) if there are any."""
    day = F.to_date(ts)
    out = day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return out if weekdays is None else out & F.array_contains(weekdays, F.weekday(ts).cast("int"))


def weekday_list(text: Column) -> Column:
    """0-4-6 to [0, 4, 6]."""
    return F.transform(F.split(text, "-"), lambda d: d.cast("int"))


def features(points: DataFrame, zoom: int) -> DataFrame:
    """points (id, lon, lat, ...) with tile x and y and the place in the tile, dx and dy."""
    x, y, dx, dy = cells.tile_place("lon", "lat", zoom)
    return points.withColumns({"x": x.cast("int"), "y": y.cast("int"), "dx": dx.cast("int"), "dy": dy.cast("int")})


def row_key(x: Column, y: Column, zoom: int, day: Column) -> Column:
    """Key of a tile's day in a range-scanned store: Hilbert number, a mark, the day."""
    return F.format_string("%012d/ex/%s", cells.hilbert(x, y, zoom), F.date_format(day, "yyMMdd"))


def row_ranges(tiles: DataFrame, zoom: int, detail: int, first: str, last: str) -> DataFrame:
    """tiles (x, y) of a zoom to the closed key ranges (x, y, start_key, end_key) of the finer tiles that hold their data, for a range of days."""
    cell = F.explode(cells.tile_children(F.col("x"), F.col("y"), detail - zoom)).alias("t")
    keys = [row_key(F.col("t.x"), F.col("t.y"), detail, F.lit(day).cast("date")) for day in (first, last)]
    return tiles.select("x", "y", cell).select("x", "y", keys[0].alias("start_key"), keys[1].alias("end_key"))


def in_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (row_key, ...) whose key is in one of the ranges: equi-joined on the key's cell, so that no range meets rows of other cells."""
    cell = F.substring_index("row_key", "/", 1)
    own = ranges.select(F.substring_index("start_key", "/", 1).alias("_cell"), "start_key", "end_key").distinct()
    return rows.withColumn("_cell", cell).join(own, "_cell").where(F.col("row_key").between(F.col("start_key"), F.col("end_key"))).drop("_cell", "start_key", "end_key").distinct()


def _varint(n: int) -> bytes:
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def _field(number: int, kind: int, body: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(body)) + body if kind == 2 else body)


def _value(v) -> bytes:
    if isinstance(v, str):
        return _field(1, 2, v.encode())
    if isinstance(v, float):
        return _field(3, 1, struct.pack("<d", v))
    return _field(6, 0, _varint((int(v) << 1) ^ (int(v) >> 63)))


def encode_layer(name: str, items: list[tuple[int, int, int, dict]], extent: int = cells.TILE_EXTENT) -> bytes:
    """A version-2 layer of points (id, dx, dy, attributes), in the public vector tile format."""
    keys: dict[str, int] = {}
    values: dict = {}
    body = b""
    for ident, dx, dy, attributes in items:
        tags = b"".join(_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault((type(v), v), len(values))) for k, v in attributes.items())
        line = _varint(1 << 3 | 1) + _varint((dx << 1) ^ (dx >> 31)) + _varint((dy << 1) ^ (dy >> 31))
        body += _field(2, 2, _field(1, 0, _varint(ident)) + _field(2, 2, tags) + _field(3, 0, _varint(1)) + _field(4, 2, line))
    head = _field(15, 0, _varint(2)) + _field(1, 2, name.encode())
    tail = b"".join(_field(3, 2, k.encode()) for k in keys) + b"".join(_field(4, 2, _value(v)) for _, v in values) + _field(5, 0, _varint(extent))
    return head + body + tail


def encoded(rows: DataFrame, name: str, attributes: list[str]) -> DataFrame:
    """features() by tile to bytes: x, y, count, tile."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("id")
        items = [(int(r["id"]), int(r["dx"]), int(r["dy"]), {a: r[a] for a in attributes}) for r in tile.to_dict("records")]
        layer = _field(3, 2, encode_layer(name, items))
        return pd.DataFrame({"x": [tile["x"].iloc[0]], "y": [tile["y"].iloc[0]], "count": [len(tile)], "tile": [layer]})

    return rows.groupBy("x", "y").applyInPandas(run, "x int, y int, count bigint, tile binary")
