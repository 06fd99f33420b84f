import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from roadloom.operators import history
from roadloom.operators.network import Builder
from roadloom.streaming import matcher

T0 = dt.datetime(2026, 1, 1)
#: Along a road that climbs two steps to the north-east.
POINTS = [(9.0002, 48.001), (9.0001, 48.005), (9.004, 48.0081), (9.010, 48.0079), (9.0121, 48.012), (9.018, 48.0161)]


def stairs(spark):
    n = Builder().node(1, 9.0, 48.0).node(2, 9.0, 48.008).node(3, 9.012, 48.008).node(4, 9.012, 48.016).node(5, 9.024, 48.016)
    return n.edge(1, 2).edge(2, 3).edge(3, 4).edge(4, 5).build(spark)


def events(points=POINTS, first=0):
    return [(7, T0 + dt.timedelta(seconds=10 * (first + i)), x, y) for i, (x, y) in enumerate(points)]


SCHEMA = "vehicle_id bigint, ts timestamp, lon double, lat double"


def test_stream_ends_like_the_batch(spark, tmp_path):
    network, folder = stairs(spark), tmp_path / "in"
    for part, name in ((events()[:3], "a"), (events()[2:3] + events()[3:], "b")):  # the third event comes twice
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        q = matcher.match_stream(spark.readStream.schema(SCHEMA).parquet(str(folder)), matcher.area_edges(network), ttl_ms=None, gap_s=1e6, reach=3000.0)
        run = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").start()
        assert run.awaitTermination(120)
    out = history.merged(spark.read.parquet(str(tmp_path / "out")))
    whole = matcher.match_batch(spark.createDataFrame(events(), SCHEMA), network, reach=3000.0)

    def rows(df):
        return sorted((r["ts"], r["source"], r["target"]) for r in df.collect())

    assert rows(out) == rows(whole) and len(rows(whole)) == 6


class State:
    """What the stream's function sees of a vehicle's state."""

    def __init__(self, value=None, timed_out=False):
        self.get, self.hasTimedOut, self.ttl = value, timed_out, None

    @property
    def exists(self):
        return self.get is not None

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def setTimeoutDuration(self, ms):
        self.ttl = ms


def test_idle_vehicles_are_forgotten(spark):
    edges = matcher.area_edges(stairs(spark))
    run, state = matcher.processor(edges, ttl_ms=5000, gap_s=1e6, reach=3000.0), State()
    frame = pd.DataFrame(events(), columns=["vehicle_id", "ts", "lon", "lat"])
    (out,) = run((7,), iter([frame]), state)
    assert len(out) == 6 and state.ttl == 5000 and state.exists
    state.hasTimedOut = True
    assert not list(run((7,), iter([]), state)) and not state.exists
    kept = State()
    list(matcher.processor(edges, ttl_ms=None, gap_s=1e6, reach=3000.0)((7,), iter([frame]), kept))
    assert kept.exists and kept.ttl is None


def test_late_events_and_gaps():
    a = [(T0 + dt.timedelta(seconds=s), 0.0, 0.0) for s in (0, 10, 20)]
    assert matcher.context(a, [(T0 + dt.timedelta(seconds=5), 0.0, 0.0)], 30, 120, 2000) == a
    late = [(T0 + dt.timedelta(seconds=500), 0.0, 0.0)]
    assert matcher.context(a, late, 30, 120, 2000) == late
    assert matcher.context(a, [], 2, 120, 2000) == a[1:]


def test_history_operators(spark):
    rows = spark.createDataFrame([(1, 1, T0, 0.0, 0.0), (1, 2, T0 - dt.timedelta(seconds=1), 0.0, 0.0), (1, 3, T0 + dt.timedelta(seconds=9), 0.0, 0.0)], "vehicle_id bigint, seq bigint, ts timestamp, lon double, lat double")
    assert sorted(r["seq"] for r in history.fresh(rows).collect()) == [1, 3]
    trip, past = F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 3, 4)))
    assert spark.range(1).select(history.overlap(trip, past).alias("k")).first()["k"] == 2


def test_a_batch_needs_no_area(spark, monkeypatch):
    """A table's vehicles are matched by groups, each with the edges around it; the network as a whole may be larger than a stream's area."""
    network = stairs(spark)
    far = [(8, T0 + dt.timedelta(seconds=10 * i), x, y) for i, (x, y) in enumerate(POINTS[::-1])] + [(9, T0, 9.02, 48.016), (9, T0 + dt.timedelta(seconds=9), 120.0, 10.0)]
    table = spark.createDataFrame(events() + far, SCHEMA)
    roads = matcher.Roads(matcher.area_edges(network), 50.0, 3000.0)
    want = set()
    for vehicle in (7, 8, 9):
        rows = matcher.context([], [(r["ts"], r["lon"], r["lat"]) for r in table.where(F.col("vehicle_id") == vehicle).collect()], 10**9, 1e12, 2000.0)
        want |= {(vehicle, source, target, lon, lat) for _, source, target, lon, lat in roads.match(rows)[0]}
    monkeypatch.setattr(matcher, "MOST_EDGES", 1)
    monkeypatch.setattr(matcher, "EVENTS", 5)
    got = matcher.match_batch(table, network, reach=3000.0).collect()
    assert want and {(r["vehicle_id"], r["source"], r["target"], r["lon"], r["lat"]) for r in got} == want
