"""Matching as events arrive: one state for each vehicle, late events dropped, what is settled emitted with a revision.

Each vehicle keeps its last observations with their candidates.  A new batch drops events that aren't later than the last one seen, cuts the history at
a long gap or jump, and matches the observations that are left as one trip; rows are emitted for every observation of the trip, with the batch's last
event as revision, so that later, better matches override earlier ones (operators.history.merged).  Observations before the convergence point can't
change any more and leave the state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadloom.operators import spatial, trellis
from roadloom.operators.network import Network
from roadloom.operators.tables import written

#: dropped: whether late, repeated or old observations were left out of the trip.
OUT = "vehicle_id bigint, ts timestamp, revision timestamp, source bigint, target bigint, lon double, lat double, dropped boolean"
STATE = "ts array<timestamp>, lon array<double>, lat array<double>"
R = 6371008.8


def _haversine(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = np.radians(a[1]), np.radians(b[1])
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b[0] - a[0]) / 2) ** 2
    return float(2 * R * np.arcsin(np.sqrt(min(1.0, h))))


def context(history: list[tuple], fresh: list[tuple], window: int, gap_s: float, jump_m: float) -> list[tuple]:
    """The newest observations (ts, lon, lat), back to the first gap or jump, in order of time; late and repeated ones are dropped."""
    rows = list(history)
    for row in sorted(fresh, key=lambda r: r[0]):
        if not rows or row[0] > rows[-1][0]:
            rows.append(row)
    rows = rows[-window:]
    for i in range(len(rows) - 1, 0, -1):
        a, b = rows[i - 1], rows[i]
        if (b[0] - a[0]).total_seconds() > gap_s or _haversine(a[1:], b[1:]) > jump_m:
            return rows[i:]
    return rows


#: Degrees of a cell of the grid in which a task looks up edges.
CELL = 0.004


def _far(ax, ay, bx, by):
    """Great-circle metres between arrays of places."""
    p, q = np.radians(ay), np.radians(by)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(bx - ax) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.minimum(1.0, h)))


class Roads:
    """A network around the vehicles, as arrays with a grid over them: what a task needs to match them.  It's built once a worker."""

    COLUMNS = ("source", "target", "weight", "cm", "lon1", "lat1", "lon2", "lat2")

    def __init__(self, edges: pd.DataFrame, search: float, reach: float):
        from roadloom.operators.reach import search as walk

        edges = edges.sort_values(["source", "target"])
        self.e = {c: edges[c].to_numpy() for c in self.COLUMNS}
        self.search, self.reach, self.walk = search, reach, walk
        self.out: dict[int, list[tuple[int, int, int]]] = {}
        for s, t, w, cm in zip(*(self.e[c].tolist() for c in self.COLUMNS[:4]), strict=True):
            self.out.setdefault(s, []).append((t, w, cm))
        self.near: dict[int, tuple[Iterator[tuple], dict[int, int]]] = {}
        self.grid: dict[tuple[int, int], list[int]] = {}
        x, y = np.sort((self.e["lon1"], self.e["lon2"]), 0), np.sort((self.e["lat1"], self.e["lat2"]), 0)
        low, high = np.floor((x[0] / CELL, y[0] / CELL)).astype(int).T, np.floor((x[1] / CELL, y[1] / CELL)).astype(int).T
        for i, ((x1, y1), (x2, y2)) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            for cx in range(x1, x2 + 1):
                for cy in range(y1, y2 + 1):
                    self.grid.setdefault((cx, cy), []).append(i)

    def candidates(self, lon: float, lat: float) -> dict[str, np.ndarray]:
        phi = np.radians(lat)
        hx, hy = np.degrees(self.search / np.sqrt(2) / (R * np.cos(phi))), np.degrees(self.search / np.sqrt(2) / R)
        near = {i for cx in range(int((lon - hx) // CELL), int((lon + hx) // CELL) + 1) for cy in range(int((lat - hy) // CELL), int((lat + hy) // CELL) + 1) for i in self.grid.get((cx, cy), ())}
        c = {k: v[sorted(near)] for k, v in self.e.items()}
        hit = (np.minimum(c["lon1"], c["lon2"]) <= lon + hx) & (np.maximum(c["lon1"], c["lon2"]) >= lon - hx) & (np.minimum(c["lat1"], c["lat2"]) <= lat + hy) & (np.maximum(c["lat1"], c["lat2"]) >= lat - hy)
        dx, dy = c["lon2"] - c["lon1"], c["lat2"] - c["lat1"]
        hit &= (dx != 0) | (dy != 0)
        c, dx, dy = {k: v[hit] for k, v in c.items()}, dx[hit], dy[hit]
        f = np.clip(((lon - c["lon1"]) * dx + (lat - c["lat1"]) * dy) / (dx * dx + dy * dy), 0, 1)
        px, py = c["lon1"] + f * dx, c["lat1"] + f * dy
        return c | {"fraction": f, "px": px, "py": py, "emission": np.floor(100 / np.maximum(1e-6, np.exp(-np.sqrt(_far(lon, lat, px, py) / 25))))}

    def length(self, root: int, dest: int) -> float:
        """Metres from root to dest; a search goes on from where it was left, and no farther than it is asked."""
        if root not in self.near:
            self.near[root] = self.walk(root, self.out, self.reach * 100), {}
        steps, taken = self.near[root]
        while dest not in taken:
            step = next(steps, None)
            if step is None:
                return np.inf
            taken[step[0]] = step[3]
        return taken[dest] / 100

    def boundary(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
        def rows(x: np.ndarray) -> np.ndarray:
            return x[:, None]

        straight = _far(rows(a["px"]), rows(a["py"]), b["px"], b["py"])
        same = (rows(a["source"]) == b["source"]) & (rows(a["target"]) == b["target"]) & (rows(a["fraction"]) <= b["fraction"])
        (ends, i), (starts, j) = np.unique(a["target"], return_inverse=True), np.unique(b["source"], return_inverse=True)
        between = np.array([[self.length(t, s) for s in starts.tolist()] for t in ends.tolist()])[i][:, j]
        route = between + rows(_far(a["px"], a["py"], a["lon2"], a["lat2"])) + _far(b["lon1"], b["lat1"], b["px"], b["py"])
        route = np.where(same, straight, route)
        direct = np.where(route <= 0, 1.0, straight / np.where(route <= 0, 1.0, route))
        score = np.sqrt(np.clip(direct, 1e-6, 1) * np.clip(np.minimum(1.0, rows(a["weight"]) / b["weight"]), 1e-6, 1))
        return np.where(np.isfinite(route), np.floor(100 / np.maximum(score, 1e-6)), np.inf)

    def match(self, rows: list[tuple]) -> tuple[list[tuple], int]:
        """(ts, source, target, lon, lat) of the observations, and how many of them are settled; unanchored ones are left out, a break starts anew."""
        layers = [(ts, c) for ts, lon, lat in rows if len((c := self.candidates(lon, lat))["source"])]
        while layers:
            bounds = [self.boundary(a, b) for (_, a), (_, b) in zip(layers, layers[1:], strict=False)]
            broken = [k for k, w in enumerate(bounds) if not np.isfinite(w).any()]
            if broken:
                layers = layers[broken[-1] + 1 :]
                continue
            found = trellis.solve([len(c["source"]) for _, c in layers], [c["emission"] for _, c in layers], bounds)
            if found is None:
                layers = layers[1:]
                continue
            _, path, settled = found
            out = [(ts, int(c["source"][k]), int(c["target"][k]), float(c["px"][k]), float(c["py"][k])) for (ts, c), k in zip(layers, path, strict=True)]
            return out, settled or 0
        return [], 0


def _frame(vehicle: int, matched: list[tuple], revision, dropped: bool) -> pd.DataFrame:
    return pd.DataFrame({"vehicle_id": vehicle, "ts": [m[0] for m in matched], "revision": revision, "source": [m[1] for m in matched], "target": [m[2] for m in matched], "lon": [m[3] for m in matched], "lat": [m[4] for m in matched], "dropped": dropped})


def processor(edges: pd.DataFrame, window: int = 30, gap_s: float = 120.0, jump_m: float = 2000.0, search: float = 50.0, reach: float = 1000.0, ttl_ms: int | None = 900_000):
    """The stateful function of a stream; edges: fat edges with cm, of the area that the stream covers; ttl_ms: how long an idle vehicle is kept, None for ever."""
    roads: list[Roads] = []

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if not roads:
            roads.append(Roads(edges, search, reach))
        history = list(zip(*(list(x) for x in state.get), strict=True)) if state.exists else []
        fresh = [(ts.to_pydatetime(), float(x), float(y)) for f in batches for ts, x, y in zip(f["ts"], f["lon"], f["lat"], strict=True)]
        rows = context(history, fresh, window, gap_s, jump_m)
        matched, settled = roads[0].match(rows)
        keep = rows[settled:] if len(matched) == len(rows) else rows
        state.update(([r[0] for r in keep], [r[1] for r in keep], [r[2] for r in keep]))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        if matched:
            yield _frame(key[0], matched, rows[-1][0], len(rows) < len(history) + len(fresh))

    return run


def match_stream(events: DataFrame, edges: pd.DataFrame, ttl_ms: int | None = 900_000, **options) -> DataFrame:
    """A streaming DataFrame (vehicle_id, ts, lon, lat) to emissions.

    With a ttl_ms the stream asks for batch after batch to evict idle vehicles, so a run that is to end with its input (availableNow) never would: such a run
    takes ttl_ms=None, or spark.sql.streaming.noDataMicroBatches.enabled=false.
    """
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("vehicle_id").applyInPandasWithState(processor(edges, ttl_ms=ttl_ms, **options), OUT, STATE, "append", timeout)


#: Edges of an area that are sent to every task of a stream at most; larger areas are split by shard, a stream each.
MOST_EDGES = 2_000_000


def area_edges(network: Network) -> pd.DataFrame:
    """The network of a stream's area, for its tasks."""
    fat = network.successors().select("source", "target", "weight", "cm", "lon1", "lat1", "lon2", "lat2")
    if (n := fat.count()) > MOST_EDGES:
        raise ValueError(f"an area of {n} edges; run a stream for each shard (operators.shards)")
    return fat.toPandas()


#: Degrees of the cells by which vehicles and edges of a batch are dealt, and about how many events meet in a task.
HOME, FINE, EVENTS = 0.1, 0.02, 50_000


def _dealt(rows: DataFrame, fat: DataFrame, search: float, reach: float) -> DataFrame:
    """Each group's edges, from rows (g, lon, lat): all that are near a place of the group, or near enough to the end of such an edge to be on a way of this reach."""

    def cell(c: str | Column) -> Column:
        return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(FINE)).cast("long")

    def covering(edges: DataFrame, x1: Column, x2: Column, y1: Column, y2: Column, metres: float) -> DataFrame:
        dx, dy = spatial._margins(F.greatest(F.abs(y1), F.abs(y2)), metres)
        return edges.withColumn("_cx", F.explode(F.sequence(cell(x1 - dx), cell(x2 + dx)))).withColumn("_cy", F.explode(F.sequence(cell(y1 - dy), cell(y2 + dy))))

    places = rows.select("g", cell("lon").alias("_cx"), cell("lat").alias("_cy")).distinct()
    close = covering(fat, F.least("lon1", "lon2"), F.greatest("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lat1", "lat2"), search)
    close = written(close.join(places, ["_cx", "_cy"]).drop("_cx", "_cy").distinct())
    roots = close.select("g", cell("lon2").alias("_cx"), cell("lat2").alias("_cy")).distinct()
    # margins are those of a box of half the diagonal: a circle of the reach needs the root of two more
    on_ways = covering(fat, F.col("lon1"), F.col("lon1"), F.col("lat1"), F.col("lat1"), math.sqrt(2) * reach).join(roots, ["_cx", "_cy"]).drop("_cx", "_cy")
    return on_ways.unionByName(close).distinct()


def match_batch(events: DataFrame, network: Network, gap_s: float = 1e12, jump_m: float = 2000.0, search: float = 50.0, reach: float = 1000.0) -> DataFrame:
    """The same over a table: each vehicle's events as one batch without a history.  Vehicles are dealt by the cell that they start in, with the edges around
    all their places: no task, nor the driver, holds the network."""

    def run(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        roads, out = Roads(edges, search, reach), []
        for vehicle, own in rows.groupby("vehicle_id", sort=False):
            seen = context([], list(zip((ts.to_pydatetime() for ts in own["ts"]), own["lon"].tolist(), own["lat"].tolist(), strict=True)), 10**9, gap_s, jump_m)
            matched, _ = roads.match(seen)
            if matched:
                out.append(_frame(vehicle, matched, seen[-1][0], False))
        return pd.concat(out) if out else pd.DataFrame(columns=["vehicle_id", "ts", "revision", "source", "target", "lon", "lat", "dropped"])

    own = events.select("vehicle_id", F.col("ts").cast("timestamp").alias("ts"), "lon", "lat")
    first = own.groupBy("vehicle_id").agg(F.min(F.struct("ts", F.floor(F.col("lon") / HOME).alias("x"), F.floor(F.col("lat") / HOME).alias("y"))).alias("c"), F.count("*").alias("n"))
    homes = first.groupBy("c.x", "c.y").agg(F.ceil(F.sum("n") / EVENTS).alias("parts"))
    group = F.struct("x", "y", F.pmod(F.xxhash64("vehicle_id"), F.col("parts")).alias("part"))
    groups = first.select("vehicle_id", "c.x", "c.y").join(homes, ["x", "y"]).select("vehicle_id", group.alias("g"))
    rows = written(own.join(groups, "vehicle_id"))
    fat = network.successors().select(*Roads.COLUMNS)
    return rows.groupBy("g").cogroup(_dealt(rows, fat, search, reach).groupBy("g")).applyInPandas(run, OUT)
