"""Cells of the earth: geohashes, quadtree keys, map tiles and Hilbert numbers, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.functions.geo import c

# Fixed values.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
TILE_EXTENT = 4096
DEGREE = 0.0174533
MAX_ZOOM = 24


def _bin(value, low: float, high: float, bits: int) -> Column:
    """The number of the bin, of 2**bits equal ones; values outside go to the edge bins."""
    n = 1 << bits
    return F.least(F.greatest(F.floor((c(value) - F.lit(low)) / F.lit(high - low) * F.lit(float(n))), F.lit(0)), F.lit(n - 1)).cast("long")


def geohash(lon, lat, precision: int) -> Column:
    bits = 5 * precision
    x_bits, y_bits = (bits + 1) // 2, bits // 2
    x, y = _bin(lon, -180, 180, x_bits), _bin(lat, -90, 90, y_bits)
    letters = []
    for k in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5):
            i = 5 * k + b  # bits alternate, longitude first
            bit = F.shiftright(x, x_bits - 1 - i // 2) if i % 2 == 0 else F.shiftright(y, y_bits - 1 - i // 2)
            value = value * 2 + bit.bitwiseAND(1)
        letters.append(F.substring(F.lit(BASE32), value.cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def geohash_bounds(text: Column, precision: int) -> list[Column]:
    """min_lon, min_lat, max_lon, max_lat of a geohash of known precision."""
    value = [F.instr(F.lit(BASE32), F.substring(text, k + 1, 1)) - 1 for k in range(precision)]
    x = y = F.lit(0).cast("long")
    for i in range(5 * precision):
        bit = F.shiftright(value[i // 5], 4 - i % 5).bitwiseAND(1)
        if i % 2 == 0:
            x = x * 2 + bit
        else:
            y = y * 2 + bit
    w, h = 360.0 / (1 << ((5 * precision + 1) // 2)), 180.0 / (1 << (5 * precision // 2))
    return [x * F.lit(w) - 180, y * F.lit(h) - 90, (x + 1) * F.lit(w) - 180, (y + 1) * F.lit(h) - 90]


def geohash_neighbours(lon, lat, precision: int) -> Column:
    """The distinct cells around the one that holds a point; none beyond the poles or the date line."""
    w, h = 360.0 / (1 << ((5 * precision + 1) // 2)), 180.0 / (1 << (5 * precision // 2))
    x = F.floor((c(lon) + 180) / w) * w - 180 + w / 2
    y = F.floor((c(lat) + 90) / h) * h - 90 + h / 2
    near = []
    for dy in (1, 0, -1):
        for dx in (-1, 0, 1):
            if dx or dy:
                px, py = x + F.lit(dx * 0.75 * w), y + F.lit(dy * 0.75 * h)
                near.append(F.when(px.between(-180, 180) & py.between(-90, 90), geohash(px, py, precision)))
    return F.array_distinct(F.array_compact(F.array(*near)))


def geohash_number(text: Column) -> Column:
    """Eight letters of a geohash, each as its five bits at the head of a byte; the first letter is the last byte."""
    out = F.lit(0).cast("long")
    for k in range(8):
        out = out.bitwiseOR(F.shiftleft((F.instr(F.lit(BASE32), F.substring(text, k + 1, 1)) - 1).cast("long"), 8 * k + 3))
    return out


def quadkey_of(x: Column, y: Column, depth: int) -> Column:
    """Two bits a level, the first level lowest: east is 1, north is 2."""
    out = F.lit(0).cast("long")
    for level in range(depth):
        q = F.shiftright(x, depth - 1 - level).bitwiseAND(1) + 2 * F.shiftright(y, depth - 1 - level).bitwiseAND(1)
        out = out + F.shiftleft(q, 2 * level)
    return out


def quadkey(lon, lat, depth: int) -> Column:
    return quadkey_of(_bin(lon, -180, 180, depth), _bin(lat, -90, 90, depth), depth)


def quadkey_place(key: Column, depth: int) -> tuple[Column, Column]:
    """The column and row of a key's cell, from the west and the south."""
    x = y = F.lit(0).cast("long")
    for level in range(depth):
        x = x * 2 + F.shiftright(key, 2 * level).bitwiseAND(1)
        y = y * 2 + F.shiftright(key, 2 * level + 1).bitwiseAND(1)
    return x, y


def quadkey_bounds(key: Column, depth: int) -> list[Column]:
    """min_lon, min_lat, max_lon, max_lat of a key's cell."""
    (x, y), w, h = quadkey_place(key, depth), 360.0 / (1 << depth), 180.0 / (1 << depth)
    return [x * F.lit(w) - 180, y * F.lit(h) - 90, (x + 1) * F.lit(w) - 180, (y + 1) * F.lit(h) - 90]


def quadkey_neighbours(key: Column, depth: int) -> Column:
    """Keys of the cells around a key's, from north clockwise; none beyond the poles or the date line."""
    (x, y), n = quadkey_place(key, depth), 1 << depth
    near = []
    for dx, dy in ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)):
        inside = (x + dx).between(0, n - 1) & (y + dy).between(0, n - 1)
        near.append(F.when(inside, quadkey_of(x + dx, y + dy, depth)))
    return F.array_compact(F.array(*near))


def tile_place(lon, lat, zoom: int) -> list[Column]:
    """x, y, and the offsets within the tile."""
    n = float(1 << zoom)
    x = F.lit(n) * ((c(lon) + 180.0) / 360.0)
    phi = c(lat) * F.lit(DEGREE)
    y = F.lit(n) * (F.lit(1.0) - F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / F.lit(math.pi)) / F.lit(2.0)
    return [F.floor(x), F.floor(y), F.floor(F.lit(float(TILE_EXTENT)) * (x - F.floor(x))), F.floor(F.lit(float(TILE_EXTENT)) * (y - F.floor(y)))]


def tile_children(x: Column, y: Column, levels: int) -> Column:
    """The tiles that a tile has so many levels further on, as array<struct<x, y>>."""
    n = 1 << levels
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.struct((x * n + i % n).cast("long").alias("x"), (y * n + F.floor(i / n)).cast("long").alias("y")))


def hilbert(x: Column, y: Column, zoom: int) -> Column:
    """The place of a cell on the Hilbert curve of a 2**zoom grid."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        side = F.element_at(F.array(*(F.lit(1 << i).cast("long") for i in range(zoom))), k)
        rx, ry = (s["x"].bitwiseAND(side) > 0).cast("long"), (s["y"].bitwiseAND(side) > 0).cast("long")
        d = s["d"] + side * side * (3 * rx).bitwiseXOR(ry)
        # a quadrant is turned, and mirrored if it is on the right
        fx = F.when((ry == 0) & (rx == 1), F.lit((1 << zoom) - 1) - s["x"]).otherwise(s["x"])
        fy = F.when((ry == 0) & (rx == 1), F.lit((1 << zoom) - 1) - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(zoom), F.lit(1), F.lit(-1)), start, step, lambda s: s["d"])


def zigzag(value: Column) -> Column:
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 31))
