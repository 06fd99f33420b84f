"""Clusters, pairs, placements and zones whose right answers are known, also where many points share one place."""

import random

from pyspark.sql import functions as F

from roadloom.functions import hashing
from roadloom.operators import clusters, placement, timezones


def crowd(spark, seed=5, n=240):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(9) * 0.5, rng.randrange(9) * 0.5 + 20 * rng.randrange(2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, x double, y double")


def labels_of(rows, eps, least):
    near = {a: {b for b, bx, by in rows if (ax - bx) ** 2 + (ay - by) ** 2 < eps * eps} for a, ax, ay in rows}
    core, out = {a for a in near if len(near[a]) >= least}, {}
    for a in sorted(core):
        if a not in out:
            left = [a]
            while left:
                at = left.pop()
                if at in core and at not in out:
                    out[at] = a
                    left += near[at]
    return near, out


def test_clusters_of_crowded_places(spark):
    rows, points = crowd(spark)
    near, want = labels_of(rows, 0.6, 9)
    assert {r["id"]: r["cluster"] for r in clusters.dbscan(points, 0.6, 9).collect()} == want
    assert {r["id"] for r in clusters.core_points(points, 0.6, 9).collect()} == set(want)
    pairs = [(r["a"], r["b"]) for r in clusters.neighbours(points, 0.6).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in near for b in near[a]}


def test_copies_of_a_place_are_never_paired_for_clusters(spark):
    """20,000 points at one place would be 400,000,000 pairs."""
    points = spark.range(20_000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    got = clusters.dbscan(points, 1.0, 8)
    assert got.count() == 20_000 and [r["cluster"] for r in got.select("cluster").distinct().collect()] == [0]
    assert clusters._near(clusters._places(points), 1.0, None).count() == 1


def test_pairs_of_a_crowded_place_come_from_chunks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CHUNK", 7)
    points = spark.range(50).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    pairs = [(r["a"], r["b"]) for r in clusters.neighbours(points, 2.0, lambda ax, ay, bx, by: F.greatest(F.abs(ax - bx), F.abs(ay - by))).collect()]
    assert sorted(pairs) == [(a, b) for a in range(50) for b in range(50)]


def test_hulls_keep_sizes_and_corners(spark):
    rows, points = crowd(spark)
    _, want = labels_of(rows, 0.6, 9)
    at = {i: (x, y) for i, x, y in rows}
    found = clusters.hulls(points, clusters.dbscan(points, 0.6, 9)).collect()
    assert found
    for r in found:
        own = [at[i] for i, c in want.items() if c == r["cluster"]]
        assert r["size"] == len(own) and [(p["lon"], p["lat"]) for p in r["hull"]] == clusters.convex_hull(own)


def test_placement_within_the_row(spark):
    mask = 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * hashing.MIX_1 & mask
        x = (x ^ (x >> 27)) * hashing.MIX_2 & mask
        return x ^ (x >> 31)

    rng = random.Random(2)
    keys = [(i, rng.randrange(-(2**63), 2**63)) for i in range(300)] + [(0, 5), (900, None)]
    stores = [(f"s{i}", rng.randrange(-(2**63), 2**63)) for i in range(9)]
    want = {}
    for k, h in keys:
        best = max(((-1 if h is None else mix(h & mask ^ s & mask), s & mask, name) for name, s in stores))
        want[k] = max(want.get(k, best), best)
    got = placement.placed(spark.createDataFrame(keys, "k bigint, h bigint"), spark.createDataFrame(stores, "store string, seed bigint"), "k", "store")
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # each key was listed with every store
    assert {r["k"]: r["store"] for r in got.collect()} == {k: b[2] for k, b in want.items()}


def test_zones_of_points(spark, tmp_path):
    from roadloom.plans.queries import QUERIES

    spark.createDataFrame([(k, 1) for k in (20, 50, 40 * 700 + 10, 40 * 700 + 31)], "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["key"]: r["tzid"] for r in QUERIES["timezone_of"](spark, str(tmp_path)).collect()}
    assert got == {50: "Zone/West", 40 * 700 + 10: "Zone/West", 40 * 700 + 31: "Zone/East"}  # 34.95 north; zones ended at 34.8
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    zones = spark.createDataFrame([("A", [[[{"lon": x, "lat": y} for x, y in r] for r in (square, hole)]])], "tzid string, polygons array<array<array<struct<lon:double,lat:double>>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.0, 1.5), (4, 5.0, 1.0)], "key bigint, lon double, lat double")
    assert sorted(r["key"] for r in timezones.exact(points, zones).collect()) == [1, 3]
