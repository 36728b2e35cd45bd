"""Every catalogue query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import math
import random

import duckdb
import pytest

from inkspark.plans.catalog import QUERIES, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, D)
    names = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    got = con.execute(SQL[name])
    at = [d[0] for d in got.description]
    assert sorted(at) == names
    assert mine == sorted(repr([plain(r[at.index(c)]) for c in names]) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_range_join_takes_all_orders(spark, tmp_path):
    rnd, day = random.Random(4), datetime.datetime(2024, 1, 1)
    at = lambda: day + datetime.timedelta(seconds=rnd.randrange(9 * 86400))
    orders = [(k, at()) for k in range(40, 160)] + [(200, day), (201, day + datetime.timedelta(days=30))]
    events = [(i, "click", i % 5, at(), float(i % 17)) for i in range(300)] + [(300, "view", 1, day, 1.0), (301, "view", 1, day + datetime.timedelta(days=1), 2.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(events, "event_id long, event_type string, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for k, low in orders:
        some = [e[4] for e in events if low <= e[3] <= low + datetime.timedelta(days=1)]
        if some:
            want[k] = (len(some), pytest.approx(sum(some) / len(some), abs=1e-6))
    got = {r["o_orderkey"]: (r["n"], r["mean"]) for r in QUERIES["j2_range_join"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 100 and 201 not in want


def test_number_formats_take_sizes_of_any_length(spark, tmp_path):
    want = {0: "0 B", 1023: "1023 B", 1024: "1.00 KB", 999_999: "976.56 KB", 1_000_000: "976.56 KB", 1024**2: "1.00 MB", 5 * 1024**2 // 2: "2.50 MB", 1024**3: "1.00 GB", 3 * 1024**3 // 2: "1.50 GB", None: None}
    rows = spark.createDataFrame(list(enumerate(want)), "doc_id long, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["size"] for r in QUERIES["f_number_formats"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_overlaps_are_rounded_as_in_sql(spark):
    d, db = "/root/testdata/sf0.1", duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    mine = {tuple(r) for r in QUERIES["g15_polygon_iou"](spark, d).collect()}
    assert mine == set(db.execute(SQL["g15_polygon_iou"]).fetchall())
