import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("geohash_encode", "hilbert_index", "hash_splitmix", "way_edges", "viterbi_cost", "viterbi_path", "candidates", "access_allowed", "speed_kmh", "opening_open_at", "gap_cut", "emission_merge", "dbscan_clusters", "shard_admit", "percentiles_nearest_rank", "timezone_of")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(plain(tuple(r)) for r in df.select(*cols).collect()) == sorted(plain(r) for r in cur.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).take(1)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
