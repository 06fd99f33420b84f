"""OpenStreetMap PBF files as a data source: a partition for each blob, found by walking the headers without decoding the data.

    spark.dataSource.register(PbfSource)
    spark.read.format("osmpbf").option("path", path).option("kind", "ways").load()

Blobs are read at their offset through the file's store (a path of Spark's, read by `files`), so a task reads its own range.  Payloads that aren't
stored raw or by zlib raise an error.  Coordinates are scaled once from whole numbers, offsets included, for plain nodes as for dense ones.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "nodes": "node_id bigint, lon double, lat double, tags map<string,string>",
    "ways": "way_id bigint, refs array<bigint>, tags map<string,string>",
    "relations": "relation_id bigint, members array<struct<id:bigint,role:string,kind:string>>, tags map<string,string>",
}
MEMBERS = ("node", "way", "relation")


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers, or bytes."""
    at, end = 0, len(data)
    while at < end:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} in a PBF message")
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = varint(data, at)
        out.append(n)
    return out


def running(data: bytes) -> np.ndarray:
    """Packed signed differences to values."""
    return np.cumsum(np.array([signed(n) for n in packed(data)], np.int64))


def inflate(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError(f"a PBF blob is stored in an unsupported way (fields {sorted(parts)})")


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def _tags(keys: list[int], values: list[int], strings: list[bytes]) -> dict[str, str]:
    return {_text(strings[k]): _text(strings[v]) for k, v in zip(keys, values, strict=True)}


def elements(block: bytes, kind: str) -> Iterator[tuple]:
    """Rows of a decoded block."""
    parts = list(fields(block))
    strings = [s for n, table in parts if n == 1 for _, s in fields(table)]
    single = {n: v for n, v in parts if n not in (1, 2)}
    grain, lat0, lon0 = single.get(17, 100), single.get(19, 0), single.get(20, 0)
    lat0, lon0 = ((x - (1 << 64) if x >> 63 else x) for x in (lat0, lon0))

    def degrees(raw, offset):
        return 1e-9 * (offset + grain * raw)

    for number, group in parts:
        if number != 2:
            continue
        for what, body in fields(group):
            if kind == "nodes" and what == 2:
                f = dict(fields(body))
                ids, lats, lons = running(f[1]), running(f[8]), running(f[9])
                tags: list[dict] = [{} for _ in ids]
                if f.get(10):
                    i, flat = 0, packed(f[10])
                    at = 0
                    while at < len(flat):
                        if flat[at] == 0:
                            i, at = i + 1, at + 1
                        else:
                            tags[i][_text(strings[flat[at]])] = _text(strings[flat[at + 1]])
                            at += 2
                yield from zip(ids.tolist(), degrees(lons, lon0).tolist(), degrees(lats, lat0).tolist(), tags, strict=True)
            elif kind == "nodes" and what == 1:
                f = dict(fields(body))
                yield signed(f[1]), degrees(signed(f[9]), lon0), degrees(signed(f[8]), lat0), _tags(packed(f.get(2, b"")), packed(f.get(3, b"")), strings)
            elif kind == "ways" and what == 3:
                f = dict(fields(body))
                yield f[1], running(f.get(8, b"")).tolist(), _tags(packed(f.get(2, b"")), packed(f.get(3, b"")), strings)
            elif kind == "relations" and what == 4:
                f = dict(fields(body))
                rows = [{"id": int(i), "role": _text(strings[r]), "kind": MEMBERS[k]} for i, r, k in zip(running(f.get(9, b"")), packed(f.get(8, b"")), packed(f.get(10, b"")), strict=True)]
                yield f[1], rows, _tags(packed(f.get(2, b"")), packed(f.get(3, b"")), strings)


def blobs(read, size: int) -> Iterator[tuple[str, int, int]]:
    """(type, start, length) of each blob; read(start, n) gives bytes."""
    at = 0
    while at < size:
        n = struct.unpack(">I", read(at, 4))[0]
        head = dict(fields(read(at + 4, n)))
        start = at + 4 + n
        yield head[1].decode(), start, head[3]
        at = start + head[3]


def files(path: str):
    """(open, size) of a file in any store that pyarrow knows, or a local one."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner), store.get_file_info(inner).size


@dataclass
class BlobRange(InputPartition):
    start: int
    length: int


class PbfReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[BlobRange]:
        file, size = files(self.path)
        with file:
            return [BlobRange(s, n) for what, s, n in blobs(lambda at, n: file.read_at(n, at), size) if what == "OSMData"]

    def read(self, partition: BlobRange) -> Iterator[tuple]:
        file, _ = files(self.path)
        with file:
            yield from elements(inflate(file.read_at(partition.length, partition.start)), self.kind)


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "nodes")]

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], self.options.get("kind", "nodes"))


def ingest(spark, path: str, saved: str, strict_reference: bool = True):
    """The network of a PBF file, from the saved tables if they are there, else built and saved."""
    from roadloom.operators import network

    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{saved}/way_meta/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.dataSource.register(PbfSource)
        nodes = spark.read.format("osmpbf").option("path", path).option("kind", "nodes").load()
        ways = spark.read.format("osmpbf").option("path", path).option("kind", "ways").load()
        network.save(network.from_ways(nodes, ways, strict_reference), saved)
    return network.load(spark, saved)
