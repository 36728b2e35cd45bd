"""Queries that apply the engine's operators to the test tables, each with DuckDB SQL for the same rows.

Inputs that the tables lack (images, maps, boxes, traces) are derived from them by arithmetic that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspark.functions import formats
from inkspark.operators import decode, evaluate, geometry, inventory, monitor, relief, tiling, traces
from inkspark.plans import pipeline
from inkspark.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# Derived inputs.


def trace(spark: SparkSession, d: str) -> DataFrame:
    us = readers.epoch_us(F.col("ts"))
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), (F.col("user_id") % 8).alias("core_id"), (F.col("user_id") % 4 + 1).alias("parallelism"), us.alias("start_us"), "value")
    return rows.withColumn("end_us", F.col("start_us") + F.floor(F.col("value") * 1000))


TRACE = """trace AS (SELECT event_id, event_type AS model, user_id % 8 AS core_id, user_id % 4 + 1 AS parallelism, epoch_us(ts) AS start_us, value,
  epoch_us(ts) + CAST(floor(value * 1000) AS BIGINT) AS end_us FROM events)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", readers.epoch_us(F.col("ts")).alias("time_us"), F.col("event_type").alias("metric_name"), "value")


METRICS = "metrics AS (SELECT event_id, epoch_us(ts) AS time_us, event_type AS metric_name, value FROM events)"


def pixels(spark: SparkSession, d: str, least: float = -0.125) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("map_id"), F.posexplode("embedding").alias("i", "e"))
    return rows.select("map_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "e", F.when(F.col("e") > least, 1).otherwise(0).alias("v"))


PIXELS = """pixels AS (SELECT map_id, i % 8 AS x, i // 8 AS y, embedding[i + 1] AS e, CASE WHEN embedding[i + 1] > {least} THEN 1 ELSE 0 END AS v
  FROM (SELECT vec_id AS map_id, embedding, unnest(range(64)) AS i FROM embeddings))"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    """8 steps of 8 classes for each vector."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, F.lit(8)), lambda x: F.abs(x)))
    return table(spark, d, "embeddings").select("vec_id", rows.alias("steps"))


STEPS = """raw AS (SELECT vec_id, s, [abs(x) FOR x IN embedding[s * 8 + 1:s * 8 + 8]] AS p FROM (SELECT vec_id, embedding, unnest(range(8)) AS s FROM embeddings)),
steps AS (SELECT vec_id, s, list_max(p)::DOUBLE AS p, list_position(p, list_max(p)) - 1 AS c FROM raw),
marked AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY s) AS before FROM steps),
islands AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM c THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY s) AS run FROM marked),
runs AS (SELECT vec_id, run, c, max(p) AS p FROM islands GROUP BY vec_id, run, c),
looked AS (SELECT *, lead(c) OVER (PARTITION BY vec_id ORDER BY run) AS after FROM runs),
chars AS (SELECT *, lead(run) OVER (PARTITION BY vec_id ORDER BY run) IS NULL AS last FROM looked WHERE c <> 0)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    at = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.round(F.get("embedding", 2 * i) * 100.0) + 0.0).alias("x"), (F.round(F.get("embedding", 2 * i + 1) * 100.0) + 0.0).alias("y")))
    return table(spark, d, "embeddings").select("vec_id", at.cast(geometry.POINTS).alias("points"))


POINTS = """points AS (SELECT vec_id, i, round(embedding[2 * i + 1]::DOUBLE * 100) + 0.0 AS x, round(embedding[2 * i + 2]::DOUBLE * 100) + 0.0 AS y
  FROM (SELECT vec_id, embedding, unnest(range(32)) AS i FROM embeddings)),
ring AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM points WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""".replace("lead(x) OVER w", "lead(x) OVER (PARTITION BY vec_id ORDER BY i)").replace("lead(y) OVER w", "lead(y) OVER (PARTITION BY vec_id ORDER BY i)")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (33 + (F.col("p_partkey") * 37) % 4000).cast("int").alias("width"), (33 + (F.col("p_size") * 41) % 4000).alias("height"))


SIZES = "sizes AS (SELECT p_partkey, 33 + (p_partkey * 37) % 4000 AS width, 33 + (p_size * 41) % 4000 AS height FROM part)"


def boxes(spark: SparkSession, d: str, at: int) -> DataFrame:
    """Rectangles with whole corners, one for each vector, dealt over 50 images."""
    e = lambda i: F.floor(F.abs(F.get("embedding", F.lit(at + i))) * 400.0).cast("double")
    rect = F.struct(e(0).alias("x"), e(1).alias("y"), (e(3) + 20).alias("height"), (e(2) + 20).alias("width"))
    return table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("image"), F.col("vec_id").alias("id"), rect.alias("rect"), (F.col("label") != 0).alias("care"))


BOXES = """{name} AS (SELECT vec_id % 50 AS image, vec_id AS id, floor(abs(embedding[{a}]::DOUBLE) * 400) AS x, floor(abs(embedding[{b}]::DOUBLE) * 400) AS y,
  floor(abs(embedding[{c}]::DOUBLE) * 400) + 20 AS w, floor(abs(embedding[{d}]::DOUBLE) * 400) + 20 AS h, label <> 0 AS care FROM embeddings)"""
GT, DET = BOXES.format(name="gt", a=1, b=2, c=3, d=4), BOXES.format(name="det", a=5, b=6, c=7, d=8)
OVERLAP = "greatest(least(g.x + g.w, d.x + d.w) - greatest(g.x, d.x), 0) * greatest(least(g.y + g.h, d.y + d.h) - greatest(g.y, d.y), 0)"


# Traces.


@query("a1_throughput", f"WITH {TRACE} SELECT model, count(*) AS n, round(count(*) / nullif((max(end_us) - min(start_us)) / 1e6, 0), 6) AS per_sec, round(avg((end_us - start_us) / 1e3), 6) AS latency_ms FROM trace GROUP BY model")
def a1(spark, d):
    return rounded(traces.throughput(trace(spark, d), "model"))


@query("a2_batch_throughput", f"WITH {TRACE} SELECT model, parallelism, sum(core_id + 1) AS n, round(sum(core_id + 1) / nullif((max(end_us) - min(start_us)) / 1e6, 0), 6) AS per_sec, round(avg((end_us - start_us) / 1e3), 6) AS latency_ms FROM trace GROUP BY ALL")
def a2(spark, d):
    return rounded(traces.throughput(trace(spark, d), "model", "parallelism", batch=F.col("core_id") + 1))


@query("a4_metric_means", f"WITH {TRACE} SELECT parallelism, round(avg(value), 6) AS value, round(avg(core_id), 6) AS core_id, round(avg(end_us - start_us), 4) AS took FROM trace GROUP BY parallelism")
def a4(spark, d):
    return trace(spark, d).groupBy("parallelism").agg(F.round(F.avg("value"), 6).alias("value"), F.round(F.avg("core_id"), 6).alias("core_id"), F.round(F.avg(F.col("end_us") - F.col("start_us")), 4).alias("took"))


@query("a5_first_value", f"WITH {TRACE} SELECT model, arg_min(value, (start_us, event_id)) AS first FROM trace GROUP BY model")
def a5(spark, d):
    return trace(spark, d).groupBy("model").agg(F.min_by("value", F.struct("start_us", "event_id")).alias("first"))


VARIANCE = f"""WITH {TRACE}, cores AS (SELECT parallelism, core_id, var_samp(value) AS v, avg(value) AS m FROM trace GROUP BY ALL),
intra AS (SELECT parallelism, avg(v) AS intra, min(m) AS lowest, max(m) AS highest FROM cores GROUP BY ALL),
total AS (SELECT parallelism, var_samp(value) AS total, stddev_samp(value) AS std FROM trace GROUP BY ALL)
SELECT parallelism, round(total, 5) AS total, round(std, 5) AS std, round(intra, 5) AS intra, round(greatest(0, total - intra), 5) AS heterogeneity,
  round(CASE WHEN total = 0 THEN 0 ELSE 100 * greatest(0, total - intra) / total END, 5) AS pct, round(lowest, 5) AS lowest, round(highest, 5) AS highest, round(highest - lowest, 5) AS spread
FROM total JOIN intra USING (parallelism)"""


@query("a6_a9_variance", VARIANCE)
def a6(spark, d):
    return rounded(traces.variance_parts(trace(spark, d), "value", "parallelism", "core_id"), 5)


@query("a10_fastest_slowest", f"WITH {TRACE}, cores AS (SELECT model, core_id, round(avg(value), 9) AS m FROM trace GROUP BY ALL) SELECT model, arg_min(core_id, (m, core_id)) AS fastest, arg_max(core_id, (m, -core_id)) AS slowest FROM cores GROUP BY model")
def a10(spark, d):
    return traces.fastest_slowest(trace(spark, d), "model", "core_id", "value")


@query("a11_row_of_max", f"WITH {TRACE}, cores AS (SELECT parallelism, core_id, avg(value) AS m FROM trace GROUP BY ALL), spread AS (SELECT parallelism, max(m) - min(m) AS s FROM cores GROUP BY ALL) SELECT parallelism, round(s, 6) AS spread FROM spread ORDER BY s DESC LIMIT 1")
def a11(spark, d):
    rows = traces.variance_parts(trace(spark, d), "value", "parallelism", "core_id")
    return rows.orderBy(F.desc("spread")).limit(1).select("parallelism", F.round("spread", 6).alias("spread"))


@query("a12_common_range", f"WITH {TRACE} SELECT event_id FROM trace WHERE start_us <= (SELECT min(m) FROM (SELECT max(start_us) AS m FROM trace GROUP BY model))")
def a12(spark, d):
    return traces.common_range(trace(spark, d), "model", "start_us").select("event_id")


HOUR = 3_600_000_000
BINS = f"""WITH {TRACE}, found AS (SELECT parallelism, (start_us + (end_us - start_us) // 2) // {HOUR} AS bin, count(*) AS n, avg(value) AS mean FROM trace GROUP BY ALL),
ends AS (SELECT parallelism, min(bin) AS b0, max(bin) AS b1 FROM found GROUP BY ALL), spine AS (SELECT parallelism, b0, unnest(range(b0 + 1, b1)) AS bin FROM ends)
SELECT parallelism, bin, coalesce(n, 0) AS n, round(mean, 6) AS mean, (bin - b0) * 3600.0::DOUBLE AS time_s FROM spine LEFT JOIN found USING (parallelism, bin)"""


@query("a14_a15_resample", BINS)
def a14(spark, d):
    rows = traces.binned(trace(spark, d), traces.midpoint(), "parallelism", HOUR, F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return rounded(rows.withColumn("n", F.coalesce("n", F.lit(0))))


@query("a16_conditional_sums", f"WITH {TRACE}, s AS (SELECT parallelism, sum(value) FILTER (WHERE core_id < 4) AS inst, sum(value) FILTER (WHERE core_id >= 4) AS cyc FROM trace GROUP BY ALL) SELECT parallelism, round(inst, 4) AS inst, round(cyc, 4) AS cyc, round(inst / nullif(cyc, 0), 6) AS ipc FROM s")
def a16(spark, d):
    low, high = F.sum(F.when(F.col("core_id") < 4, F.col("value"))), F.sum(F.when(F.col("core_id") >= 4, F.col("value")))
    rows = trace(spark, d).groupBy("parallelism").agg(low.alias("inst"), high.alias("cyc"))
    return rows.select("parallelism", F.round("inst", 4).alias("inst"), F.round("cyc", 4).alias("cyc"), F.round(F.try_divide("inst", "cyc"), 6).alias("ipc"))


COUNTERS = "c AS (SELECT l_orderkey, l_linenumber, l_partkey AS inst, CAST(l_quantity AS BIGINT) % 5 * 100 AS clk, l_suppkey % 3 * 10 AS ref, l_linenumber AS a, l_linenumber * 2 AS b, l_linenumber * 3 AS e, l_suppkey % 50 AS f FROM lineitem)"


def counters(spark, d):
    t = table(spark, d, "lineitem")
    return t.selectExpr("l_orderkey", "l_linenumber", "l_partkey AS inst", "CAST(l_quantity AS BIGINT) % 5 * 100 AS clk", "l_suppkey % 3 * 10 AS ref", "l_linenumber AS a", "l_linenumber * 2 AS b", "l_linenumber * 3 AS e", "l_suppkey % 50 AS f")


@query("a17_p_core", f"""WITH {COUNTERS} SELECT l_orderkey, l_linenumber, {", ".join(f"round(CASE WHEN clk <> 0 THEN {v} ELSE 0 END, 6) AS {k}" for k, v in {"ipc": "inst / clk", "freq_ratio": "CASE WHEN ref <> 0 THEN clk / ref ELSE 0 END", "dram_bound_pct": "100 * a / clk", "l3_bound_pct": "100 * (b - a) / clk", "l2_bound_pct": "100 * (e - b) / clk", "l1_bound_pct": "100 * greatest(f - e, 0) / clk"}.items())} FROM c""")
def a17(spark, d):
    made = traces.p_core_metrics(*[F.col(c) for c in ("inst", "clk", "ref", "a", "b", "e", "f")])
    return rounded(counters(spark, d).select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in made.items()]))


_SHARE = "CASE WHEN f <> 0 THEN greatest((f - a) / clk, 0) / f ELSE 0 END"


@query("a18_e_core", f"""WITH {COUNTERS} SELECT l_orderkey, l_linenumber, {", ".join(f"round(CASE WHEN clk <> 0 THEN {v} ELSE 0 END, 6) AS {k}" for k, v in {"ipc": "inst / clk", "freq_ratio": "CASE WHEN ref <> 0 THEN clk / ref ELSE 0 END", "dram_bound_pct": f"100 * (a / clk - {_SHARE} * a)", "l3_bound_pct": f"100 * (b / clk - {_SHARE} * b)", "l2_bound_pct": f"100 * (e / clk - {_SHARE} * e)", "l1_bound_pct": "100 * b / clk"}.items())} FROM c""")
def a18(spark, d):
    c = {k: F.col(k) for k in ("inst", "clk", "ref", "a", "b", "e", "f")}
    made = traces.e_core_metrics(c["inst"], c["clk"], c["ref"], c["a"], c["b"], c["f"], c["a"], c["b"], c["e"])
    return rounded(counters(spark, d).select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in made.items()]))


@query("a19_bandwidth", f"WITH {TRACE} SELECT parallelism, round(64 * sum(core_id) / (max(end_us) - min(start_us)) * 1e6 / 1e9, 12) AS gbps FROM trace GROUP BY parallelism")
def a19(spark, d):
    return trace(spark, d).groupBy("parallelism").agg(F.round(traces.bandwidth_gbps(F.sum("core_id"), (F.max("end_us") - F.min("start_us")) / 1e6), 12).alias("gbps"))


@query("r4_trim", f"WITH {TRACE}, span AS (SELECT model, min(start_us) + {HOUR} AS low, max(end_us) - {HOUR} AS high FROM trace GROUP BY model) SELECT event_id, model FROM trace JOIN span USING (model) WHERE start_us + (end_us - start_us) // 2 BETWEEN low AND high")
def r4(spark, d):
    return traces.trimmed(trace(spark, d), HOUR, "model").select("event_id", "model")


@query("p5_p10_projections", f"WITH {TRACE} SELECT event_id, CASE WHEN core_id < 4 THEN 'P' ELSE 'E' END AS kind, start_us + (end_us - start_us) // 2 AS mid_us, (end_us - start_us) / 1000 AS ms, [10, 20, 30, 40][parallelism] AS divider, len(range(parallelism)) AS n_cores FROM trace WHERE model = 'click' AND core_id < 6 AND parallelism <= 3")
def p5(spark, d):
    rows = trace(spark, d).where("model = 'click' AND core_id < 6 AND parallelism <= 3")
    return rows.select("event_id", F.when(F.col("core_id") < 4, "P").otherwise("E").alias("kind"), traces.midpoint().alias("mid_us"), ((F.col("end_us") - F.col("start_us")) / 1000).alias("ms"), F.element_at(F.array(*map(F.lit, (10, 20, 30, 40))), F.col("parallelism").cast("int")).alias("divider"), F.size(F.sequence(F.lit(1), F.col("parallelism"))).alias("n_cores"))


PER = f"{TRACE}, per AS (SELECT model, parallelism, round(avg(value), 9) AS m FROM trace GROUP BY ALL)"


def per_level(spark, d):
    return trace(spark, d).groupBy("model", "parallelism").agg(F.round(F.avg("value"), 9).alias("m"))


@query("p12_against_baseline", f"WITH {PER} SELECT model, parallelism, round((m / first_value(m) OVER w - 1) * 100, 5) AS pct FROM per WINDOW w AS (PARTITION BY model ORDER BY parallelism)")
def p12(spark, d):
    return traces.against_baseline(per_level(spark, d), "parallelism", "m", "model").select("model", "parallelism", F.round("pct", 5).alias("pct"))


@query("w1_marginal", f"WITH {PER} SELECT model, parallelism, round((m - lag(m) OVER w) / first_value(m) OVER w, 6) AS marginal FROM per WINDOW w AS (PARTITION BY model ORDER BY parallelism)")
def w1(spark, d):
    return traces.marginal(per_level(spark, d), "parallelism", "m", "model").select("model", "parallelism", F.round("marginal", 6).alias("marginal"))


@query("w3_snapshot_deltas", f"WITH {TRACE} SELECT event_id, start_us - lag(start_us) OVER (PARTITION BY model, core_id ORDER BY start_us, event_id) AS delta FROM trace")
def w3(spark, d):
    return trace(spark, d).select("event_id", (F.col("start_us") - F.lag("start_us").over(Window.partitionBy("model", "core_id").orderBy("start_us", "event_id"))).alias("delta"))


@query("w10_inner_rows", f"WITH {TRACE}, n AS (SELECT event_id, row_number() OVER (PARTITION BY model ORDER BY start_us, event_id) AS a, row_number() OVER (PARTITION BY model ORDER BY start_us DESC, event_id DESC) AS b FROM trace) SELECT event_id FROM n WHERE a > 1 AND b > 1")
def w10(spark, d):
    up, down = Window.partitionBy("model").orderBy("start_us", "event_id"), Window.partitionBy("model").orderBy(F.desc("start_us"), F.desc("event_id"))
    return trace(spark, d).withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down)).where("a > 1 and b > 1").select("event_id")


@query("j1_left_join", f"WITH {TRACE}, t AS (SELECT parallelism, count(*) AS n FROM trace GROUP BY ALL), b AS (SELECT parallelism, round(avg(value), 6) AS bw FROM trace WHERE parallelism > 2 GROUP BY ALL) SELECT parallelism, n, bw FROM t LEFT JOIN b USING (parallelism)")
def j1(spark, d):
    t = trace(spark, d)
    bw = t.where("parallelism > 2").groupBy("parallelism").agg(F.round(F.avg("value"), 6).alias("bw"))
    return t.groupBy("parallelism").agg(F.count(F.lit(1)).alias("n")).join(bw, "parallelism", "left")


DAY = 24 * HOUR


@query("j2_range_join", f"WITH {TRACE}, runs AS (SELECT o_orderkey, epoch_us(o_orderdate) AS low, epoch_us(o_orderdate) + {DAY} AS high FROM orders) SELECT o_orderkey, count(*) AS n, round(avg(value), 6) AS mean FROM runs JOIN trace ON start_us BETWEEN low AND high GROUP BY o_orderkey")
def j2(spark, d):
    low = readers.epoch_us(F.col("o_orderdate"))
    runs = table(spark, d, "orders").select("o_orderkey", low.alias("low"), (low + DAY).alias("high"))
    rows = traces.range_join(trace(spark, d), runs, "start_us", "low", "high", DAY)
    return rows.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("j2_runs_by_type", f"WITH {TRACE}, runs AS (SELECT model AS run, min(start_us) AS low, min(start_us) + {7 * DAY} AS high FROM trace GROUP BY model) SELECT run, count(*) AS n FROM runs JOIN trace ON start_us BETWEEN low AND high GROUP BY run")
def j2b(spark, d):
    t = trace(spark, d)
    runs = t.groupBy(F.col("model").alias("run")).agg(F.min("start_us").alias("low"), (F.min("start_us") + 7 * DAY).alias("high"))
    return traces.range_join(t, runs, "start_us", "low", "high", DAY).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query("j11_ordinal_pairs", f"WITH {TRACE}, s AS (SELECT start_us, row_number() OVER (ORDER BY start_us, event_id) AS k FROM trace WHERE model = 'click'), r AS (SELECT end_us, row_number() OVER (ORDER BY end_us, event_id) AS k FROM trace WHERE model = 'view') SELECT r.k, end_us - start_us AS took FROM r JOIN s ON s.k = least(r.k, (SELECT max(k) FROM s))")
def j11(spark, d):
    t = trace(spark, d)
    s = t.where("model = 'click'").select("start_us", F.row_number().over(Window.orderBy("start_us", "event_id")).cast("long").alias("k"))
    r = t.where("model = 'view'").select("end_us", F.row_number().over(Window.orderBy("end_us", "event_id")).cast("long").alias("rk"))
    last = s.agg(F.max("k").alias("n"))
    return r.crossJoin(F.broadcast(last)).withColumn("k", F.least("rk", "n")).join(s, "k").select(F.col("rk").alias("k"), (F.col("end_us") - F.col("start_us")).alias("took"))


@query("j12_sweep", "SELECT m.n_name AS model, p.r_regionkey + 1 AS cores FROM nation m CROSS JOIN region p")
def j12(spark, d):
    cores = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("cores"))
    return table(spark, d, "nation").select(F.col("n_name").alias("model")).crossJoin(F.broadcast(cores))  # a sweep's settings are few and fixed


# Sort, limit, set operations, reshaping.


@query("o1_o4_first_rows", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25")
def o1(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey").limit(25)


@query("o2_s13_numbered", "SELECT page_id, CAST(regexp_extract(url, '/([0-9]+)', 1) AS INT) AS num FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) <> '' ORDER BY num, page_id LIMIT 40")
def o2(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("int").alias("num")).where("num is not null")
    return rows.orderBy("num", "page_id").limit(40)


@query("o5_a29_histogram", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY event_type ORDER BY n DESC")
def o5(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct")).orderBy(F.desc("n"))


@query("o6_last_100", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def o6(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


@query("o8_u3_core_lists", "SELECT n_nationkey, array_to_string((range(0, 16, 2) || range(16, 28) || range(1, 16, 2))[1:n_nationkey], ',') AS cores FROM nation")
def o8(spark, d):
    cores = F.concat(F.sequence(F.lit(0), F.lit(14), F.lit(2)), F.sequence(F.lit(16), F.lit(27)), F.sequence(F.lit(1), F.lit(15), F.lit(2)))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.slice(cores, F.lit(1), F.col("n_nationkey")).cast("array<string>"), ",").alias("cores"))


@query("u1_union_all", "SELECT event_type AS model, value FROM events WHERE user_id % 8 = 1 UNION ALL SELECT event_type, value FROM events WHERE user_id % 8 IN (1, 2)")
def u1(spark, d):
    t = trace(spark, d).select("model", "value", "core_id")
    return t.where("core_id = 1").unionByName(t.where("core_id in (1, 2)")).drop("core_id")


@query("u2_distinct", "SELECT DISTINCT user_id % 4 + 1 AS parallelism FROM events ORDER BY 1")
def u2(spark, d):
    return trace(spark, d).select("parallelism").distinct().orderBy("parallelism")


@query("r1_pivot", f"WITH {TRACE} SELECT parallelism, {', '.join(f'''count(*) FILTER (WHERE model = '{m}') AS "{m}"''' for m in ('click', 'view', 'absent'))} FROM trace GROUP BY parallelism")
def r1(spark, d):
    return trace(spark, d).groupBy("parallelism").pivot("model", ["click", "view", "absent"]).count().fillna(0)


@query("r2_unpivot", "SELECT event_id, metric, v FROM (SELECT event_id, value, user_id * 1.0::DOUBLE AS user FROM events) UNPIVOT (v FOR metric IN (value, user))")
def r2(spark, d):
    rows = table(spark, d, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user"))
    return rows.unpivot("event_id", ["value", "user"], "metric", "v")


# Monitoring.


@query("a13_time_bucket", f"WITH {METRICS} SELECT metric_name, time_us // 600000000 * 600000000 AS bucket_us, round(avg(value), 6) AS avg_value FROM metrics GROUP BY ALL")
def a13(spark, d):
    return rounded(monitor.bucket_average(metrics(spark, d), 600_000_000))


@query("a13_memory_gib", f"WITH {METRICS} SELECT metric_name, time_us // 10000000 * 10000000 AS bucket_us, round(avg(value * 1e9) / pow(2, 30), 6) AS avg_value FROM metrics WHERE time_us >= (SELECT min(time_us) FROM metrics) + {DAY} GROUP BY ALL")
def a13b(spark, d):
    rows = metrics(spark, d).withColumn("value", F.col("value") * 1e9)
    low = rows.agg(F.min("time_us")).first()[0]
    return rounded(monitor.bucket_average(rows, 10_000_000, low=low + DAY, divide=2.0**30))


@query("a20_a21_gauges", f"WITH {METRICS} SELECT metric_name, time_us // {HOUR} AS bucket, round(avg(value), 6) AS average, count(*) / 3600.0::DOUBLE AS per_sec FROM metrics GROUP BY ALL")
def a20(spark, d):
    rows = metrics(spark, d).groupBy("metric_name", F.floor(F.col("time_us") / HOUR).alias("bucket")).agg(F.round(monitor.gauge_average(F.col("value")), 6).alias("average"), (F.count(F.lit(1)) / 3600.0).alias("per_sec"))
    return rows


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
HISTOGRAM = f"counts AS (SELECT metric_name, b.le, count(*) FILTER (WHERE value <= b.le) AS n FROM metrics, (SELECT unnest([{', '.join(map(str, BOUNDS))}, 'inf'::DOUBLE]) AS le) b GROUP BY ALL)"
QUANTILE = f"""WITH {METRICS}, {HISTOGRAM}, total AS (SELECT metric_name, max(n) AS total FROM counts GROUP BY ALL),
steps AS (SELECT c.*, q, q * total AS rank, coalesce(lag(c.le) OVER w, 0) AS low, coalesce(lag(c.n) OVER w, 0) AS below
  FROM counts c JOIN total USING (metric_name), (SELECT unnest([0.5::DOUBLE, 0.9, 0.9999]) AS q) WINDOW w AS (PARTITION BY metric_name, q ORDER BY c.le)),
hit AS (SELECT metric_name, q, rank, arg_min(struct_pack(le, n, low, below), le) AS h FROM steps WHERE n >= rank GROUP BY ALL)
SELECT metric_name, q, round(CASE WHEN isinf(h.le) THEN {BOUNDS[-1]} ELSE h.low + (h.le - h.low) * (rank - h.below) / nullif(h.n - h.below, 0) END, 6) AS quantile FROM hit"""


@query("a22_histogram_quantile", QUANTILE)
def a22(spark, d):
    counts = monitor.bucket_counts(metrics(spark, d), BOUNDS, "metric_name")
    return rounded(monitor.histogram_quantiles(counts, [0.5, 0.9, 0.9999], "metric_name").withColumn("q", F.col("q").cast("double")))


@query("a23_bucket_increase", f"WITH {METRICS} SELECT metric_name, time_us // {DAY} AS day, {', '.join(f'count(*) FILTER (WHERE value <= {b}) AS le_{b:g}' for b in BOUNDS)}, count(*) AS le_inf FROM metrics GROUP BY ALL")
def a23(spark, d):
    counts = [F.count_if(F.col("value") <= b).alias(f"le_{b:g}") for b in BOUNDS]
    return metrics(spark, d).groupBy("metric_name", F.floor(F.col("time_us") / DAY).alias("day")).agg(*counts, F.count(F.lit(1)).alias("le_inf"))


@query("a24_last_gauge", f"WITH {METRICS} SELECT metric_name, time_us // {HOUR} AS bucket, arg_max(value, (time_us, event_id)) AS last_value FROM metrics GROUP BY ALL")
def a24(spark, d):
    return monitor.last_values(metrics(spark, d), HOUR, "event_id")


@query("w9_trailing_rate", f"WITH {METRICS} SELECT event_id, count(*) OVER (PARTITION BY metric_name ORDER BY time_us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) / 600.0::DOUBLE AS rate FROM metrics")
def w9(spark, d):
    return monitor.trailing_rate(metrics(spark, d), 600, "metric_name").select("event_id", "rate")


@query("f11_after_warmup", f"WITH {TRACE} SELECT event_id FROM trace WHERE start_us - (SELECT min(start_us) FROM trace) >= {DAY}")
def f11(spark, d):
    t = trace(spark, d)
    return t.crossJoin(F.broadcast(t.agg(F.min("start_us").alias("s0")))).where(F.col("start_us") - F.col("s0") >= DAY).select("event_id")


# Decoding.


@query("t1_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS at FROM embeddings")
def t1(spark, d):
    return table(spark, d, "embeddings").select("vec_id", decode.index_of_max(F.col("embedding")).alias("at"))


@query("t2_t3_ctc", f"""WITH {STEPS}, counted AS (SELECT vec_id, count(*) AS n_chars, string_agg(c::VARCHAR, '-' ORDER BY run) AS classes,
  exp(avg(ln(p)) FILTER (WHERE last OR coalesce(after, 0) <> 0)) AS confidence FROM chars GROUP BY vec_id)
SELECT vec_id, coalesce(n_chars, 0) AS n_chars, coalesce(classes, '') AS classes, round(coalesce(confidence, 0), 8) AS confidence FROM embeddings LEFT JOIN counted USING (vec_id)""")
def t2(spark, d):
    rows = steps(spark, d).select("vec_id", decode.decode(F.col("steps")).alias("r"))
    return rows.select("vec_id", F.col("r.n_chars").alias("n_chars"), F.array_join(F.col("r.classes").cast("array<string>"), "-").alias("classes"), F.round("r.confidence", 8).alias("confidence"))


@query("t3_all_chars", f"WITH {STEPS} SELECT vec_id, round(exp(avg(ln(p))), 8) AS confidence FROM chars GROUP BY vec_id")
def t3(spark, d):
    rows = steps(spark, d).select("vec_id", decode.decode(F.col("steps"), all_chars=True).alias("r"))
    return rows.where("r.n_chars > 0").select("vec_id", F.round("r.confidence", 8).alias("confidence"))


DICTIONARY = "chars AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS idx, n_name AS ch FROM nation UNION ALL SELECT 0, chr(0) UNION ALL SELECT count(*) + 1, ' ' FROM nation)"


@query("s15_dictionary", "WITH chars AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS idx, n_name AS ch FROM nation UNION ALL SELECT count(*) + 1, ' ' FROM nation) SELECT idx, ch FROM chars")
def s15(spark, d):
    return decode.dictionary(table(spark, d, "nation"), "n_name", "n_nationkey").where("idx > 0")


@query("t4_j10_index_to_char", f"WITH {DICTIONARY} SELECT l_orderkey, l_linenumber, coalesce(ch, '?') AS ch FROM lineitem LEFT JOIN chars ON idx = l_partkey % 40 + 1")
def t4(spark, d):
    chars = decode.dictionary(table(spark, d, "nation"), "n_name", "n_nationkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40 + 1).alias("class"))
    return decode.to_chars(rows, chars).select("l_orderkey", "l_linenumber", "ch")


@query("p4_trim", "SELECT conv_id, turn, regexp_replace(regexp_replace('  ' || role || chr(9), '^\\s+', ''), '\\s+$', '') AS text FROM conversations")
def p4(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", formats.trimmed(F.concat(F.lit("  "), "role", F.lit("\t"))).alias("text"))


# Tiling and tensors.


@query("i1_tiles", f"WITH {SIZES}, n AS (SELECT *, CAST(ceil((width - 32) / 608) AS INT) AS nx, CAST(ceil((height - 32) / 608) AS INT) AS ny FROM sizes), r AS (SELECT *, unnest(range(ny)) AS tile_row FROM n), c AS (SELECT *, unnest(range(nx)) AS tile_col FROM r) SELECT p_partkey, tile_row, tile_col, tile_col * 608 AS x, tile_row * 608 AS y, 640 AS w, 640 AS h FROM c")
def i1(spark, d):
    return tiling.plan_tiles(sizes(spark, d)).drop("width", "height")


@query("i2_i9_extent_scale", f"WITH {SIZES}, n AS (SELECT p_partkey, width, height, CAST(ceil((width - 32) / 608) AS INT) * 608 + 32 AS tw, CAST(ceil((height - 32) / 608) AS INT) * 608 + 32 AS th FROM sizes) SELECT p_partkey, tw AS tiled_width, th AS tiled_height, round(least(tw / width, th / height), 9) AS scale FROM n")
def i2(spark, d):
    rows = tiling.tiled_extent(tiling.plan_tiles(sizes(spark, d)), "p_partkey", "width", "height")
    scale = tiling.undo_scale(*[F.col(c) for c in ("width", "height", "tiled_width", "tiled_height")])
    return rows.select("p_partkey", "tiled_width", "tiled_height", F.round(scale, 9).alias("scale"))


@query("i4_i6_normalize", f"WITH {PIXELS.format(least=-0.125)}, p AS (SELECT *, floor(abs(e::DOUBLE) * 255) AS byte, (x + y) % 3 AS c FROM pixels) SELECT map_id, x, y, (c * 8 + y) * 8 + x AS chw, round((byte - [123.675, 116.28, 103.53][c + 1]) / [58.395, 57.12, 57.375][c + 1], 6) AS detect, round((byte - 127.5) / 127.5, 6) AS read FROM p")
def i4(spark, d):
    rows = pixels(spark, d).withColumn("byte", F.floor(F.abs(F.col("e").cast("double")) * 255)).withColumn("c", (F.col("x") + F.col("y")) % 3)
    byte, c = F.col("byte"), F.col("c")
    return rows.select("map_id", "x", "y", tiling.chw_index(c, F.col("y"), F.col("x"), F.lit(8), F.lit(8)).alias("chw"), F.round(tiling.normalized(byte, c), 6).alias("detect"), F.round(tiling.normalized(byte, c, tiling.READ_MEANS, tiling.READ_STDS), 6).alias("read"))


@query("i8_tile_merge", f"WITH {PIXELS.format(least=-0.125)} SELECT map_id % 10 AS image, x, y, greatest(max(e::DOUBLE), 0) AS v FROM pixels GROUP BY ALL")
def i8(spark, d):
    rows = pixels(spark, d).select((F.col("map_id") % 10).alias("image"), "x", "y", F.col("e").cast("double").alias("v"))
    return tiling.merge_tiles(rows, "image", "x", "y")


@query("i10_intensity", f"WITH {PIXELS.format(least=-0.125)} SELECT map_id, x, y, CAST(floor(abs(e::DOUBLE) * 255) AS INT) AS l8, CAST(floor(floor(abs(e::DOUBLE) * 255) / 2) AS INT) AS alpha FROM pixels")
def i10(spark, d):
    l8 = F.floor(F.abs(F.col("e").cast("double")) * 255)
    return pixels(spark, d).select("map_id", "x", "y", l8.cast("int").alias("l8"), F.floor(l8 / 2).cast("int").alias("alpha"))


@query("i12_data_uri", "SELECT n_nationkey, 'data:image/png;base64,' || base64(encode(n_name)) AS uri FROM nation")
def i12(spark, d):
    return table(spark, d, "nation").select("n_nationkey", tiling.data_uri(F.col("n_name").cast("binary")).alias("uri"))


@query("i13_output_shape", f"WITH {SIZES} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string([1, height, width], 'x') ELSE array_to_string([1, width // 8, 6625], 'x') END AS shape FROM sizes")
def i13(spark, d):
    even = F.col("p_partkey") % 2 == 0
    shape = tiling.output_shape(F.when(even, "dbnet").otherwise("svtr"), F.array(F.lit(1), F.lit(3), F.when(even, F.col("height")).otherwise(48), F.col("width")))
    return sizes(spark, d).select("p_partkey", F.array_join(shape.cast("array<string>"), "x").alias("shape"))


@query("f2_pool_size", "SELECT n_nationkey, CAST(ceil(1.5 * (n_nationkey + n_regionkey)) AS BIGINT) AS size FROM nation")
def f2(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.ceil(1.5 * (F.col("n_nationkey") + F.col("n_regionkey"))).alias("size"))


# Relief maps.

_FRAME = "BETWEEN 1 PRECEDING AND 1 FOLLOWING"


def _morph(pick: str, source: str, out: str, border: bool) -> str:
    v = "CASE WHEN x IN (0, 7) OR y IN (0, 7) THEN 0 ELSE m END" if border else "m"
    return f"""{out}_a AS (SELECT map_id, x, y, {pick}(v) OVER (PARTITION BY map_id, y ORDER BY x ROWS {_FRAME}) AS m FROM {source}),
{out}_b AS (SELECT map_id, x, y, {pick}(m) OVER (PARTITION BY map_id, x ORDER BY y ROWS {_FRAME}) AS m FROM {out}_a), {out} AS (SELECT map_id, x, y, {v} AS v FROM {out}_b)"""


P = PIXELS.format(least=-0.125)


@query("m1_binarize", "SELECT map_id, x, y, CASE WHEN v >= 0.2::FLOAT THEN 1 ELSE 0 END AS b FROM (SELECT map_id, i % 8 AS x, i // 8 AS y, abs(embedding[i + 1]) AS v FROM (SELECT vec_id AS map_id, embedding, unnest(range(64)) AS i FROM embeddings))")
def m1(spark, d):
    return pixels(spark, d).select("map_id", "x", "y", relief.binarize(F.abs("e")).alias("b"))


@query("m2_erode", f"WITH {P}, {_morph('min', 'pixels', 'er', True)} SELECT * FROM er")
def m2(spark, d):
    return relief.erode(pixels(spark, d), "map_id").select("map_id", "x", "y", "v")


@query("m3_dilate", f"WITH {PIXELS.format(least=0.125)}, {_morph('max', 'pixels', 'di', False)} SELECT * FROM di")
def m3(spark, d):
    return relief.dilate(pixels(spark, d, 0.125), "map_id").select("map_id", "x", "y", "v")


OPENED = f"{P}, {_morph('min', 'pixels', 'er', True)}, {_morph('max', 'er', 'op', False)}"


@query("m4_w7_opening", f"WITH {OPENED} SELECT * FROM op")
def m4(spark, d):
    return relief.opening(pixels(spark, d), "map_id").select("map_id", "x", "y", "v")


@query("m5_neighbors", "WITH o AS (SELECT dx, dy FROM (SELECT unnest([-1, 0, 1]) AS dx) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) WHERE dx <> 0 OR dy <> 0), p AS (SELECT vec_id AS map_id, i % 8 AS x, i // 8 AS y FROM (SELECT vec_id, unnest(range(64)) AS i FROM embeddings)) SELECT map_id, x, y, x + dx AS nx, y + dy AS ny FROM p CROSS JOIN o WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7")
def m5(spark, d):
    return relief.neighbors(pixels(spark, d).withColumns({"width": F.lit(8), "height": F.lit(8)}), "map_id")


@query("m6_boundary", f"WITH {OPENED}, {_morph('min', 'op', 'lo', False)} SELECT map_id, op.x, op.y, op.v = 1 AND (op.x IN (0, 7) OR op.y IN (0, 7) OR lo.v = 0) AS on_boundary FROM op JOIN lo USING (map_id, x, y)".replace("op.x, op.y", "x, y").replace("op.x IN", "x IN").replace("op.y IN", "y IN"))
def m6(spark, d):
    return relief.boundary_pixels(relief.opening(pixels(spark, d), "map_id"), "map_id").select("map_id", "x", "y", "on_boundary")


@query("m7_flood_fill", f"""WITH RECURSIVE {OPENED}, fg AS (SELECT map_id, x, y, y * 8 + x AS n FROM op WHERE v = 1),
reach(map_id, x, y, shape) AS (SELECT map_id, x, y, n FROM fg UNION SELECT f.map_id, f.x, f.y, r.shape FROM reach r JOIN fg f ON f.map_id = r.map_id AND abs(f.x - r.x) + abs(f.y - r.y) = 1)
SELECT map_id, x, y, min(shape) AS shape FROM reach GROUP BY ALL""")
def m7(spark, d):
    return relief.components(relief.opening(pixels(spark, d), "map_id").select("map_id", "x", "y", "v"))


@query("m8_m9_trace")
def m9(spark, d):
    maps = table(spark, d, "embeddings").select(F.col("vec_id").alias("map_id"), F.transform("embedding", lambda x: x + F.lit(0.325).cast("float")).alias("data"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return relief.trace_boundaries(maps)


# Geometry.


@query("g2_g6_scale_clamp", f"WITH {POINTS} SELECT vec_id, i, greatest(0, least(x * 2.5, 60)) AS x, greatest(0, least(y * 2.5, 40)) AS y FROM points")
def g2(spark, d):
    at = geometry.clamp(geometry.scale(F.col("points"), F.lit(2.5)), F.lit(40.0), F.lit(60.0))
    return points(spark, d).select("vec_id", F.posexplode(at).alias("i", "p")).select("vec_id", "i", "p.x", "p.y")


@query("g3_g5_offset", f"WITH {POINTS}, m AS (SELECT vec_id, sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS around, abs(sum(x * y2 - x2 * y)) / 2 AS area FROM ring GROUP BY vec_id) SELECT vec_id, round(around, 6) AS perimeter, round(area, 6) AS area, round(area * 1.5 / nullif(around, 0), 6) AS offset_by FROM m")
def g3(spark, d):
    p = F.col("points")
    return rounded(points(spark, d).select("vec_id", geometry.perimeter(p).alias("perimeter"), geometry.area(p).alias("area"), geometry.offset_amount(p).alias("offset_by")))


@query("g7_hull", f"""WITH {POINTS}, u AS (SELECT DISTINCT vec_id, x, y FROM points),
edges AS (SELECT a.vec_id, a.x, a.y, b.x AS bx, b.y AS by FROM u a JOIN u b ON a.vec_id = b.vec_id AND (a.x <> b.x OR a.y <> b.y)),
good AS (SELECT e.vec_id, e.x, e.y FROM edges e JOIN u c ON c.vec_id = e.vec_id GROUP BY e.vec_id, e.x, e.y, e.bx, e.by
  HAVING bool_and((e.bx - e.x) * (c.y - e.y) - (e.by - e.y) * (c.x - e.x) > 0 OR (e.bx - e.x) * (c.y - e.y) - (e.by - e.y) * (c.x - e.x) = 0 AND (c.x - e.x) * (c.x - e.bx) + (c.y - e.y) * (c.y - e.by) <= 0))
SELECT vec_id, x, y FROM good""")
def g7(spark, d):
    return points(spark, d).select("vec_id", F.explode(geometry.hull_udf("points")).alias("p")).select("vec_id", "p.x", "p.y")


@query("g8_min_rectangle", f"""WITH {POINTS}, u AS (SELECT DISTINCT vec_id, x, y FROM points),
edges AS (SELECT a.vec_id, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS l FROM u a JOIN u b ON a.vec_id = b.vec_id AND (a.x <> b.x OR a.y <> b.y)),
sides AS (SELECT e.vec_id, e.x, e.y, e.dx, e.dy, max((c.x * dx + c.y * dy) / l) - min((c.x * dx + c.y * dy) / l) AS w, max((c.y * dx - c.x * dy) / l) - min((c.y * dx - c.x * dy) / l) AS h
  FROM edges e JOIN u c ON c.vec_id = e.vec_id GROUP BY ALL HAVING min(dx * (c.y - e.y) - dy * (c.x - e.x)) >= 0)
SELECT vec_id, round(min(w * h), 4) AS area FROM sides GROUP BY vec_id""")
def g8(spark, d):
    return points(spark, d).select("vec_id", geometry.min_rect_udf("points").alias("r")).select("vec_id", F.round(F.col("r.width") * F.col("r.height"), 4).alias("area"))


RECTS = """rects AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, abs(embedding[3]::DOUBLE) * 100 + 1 AS w, abs(embedding[4]::DOUBLE) * 100 + 1 AS h, embedding[5]::DOUBLE AS a FROM embeddings),
corners AS (SELECT vec_id, [x, x + w * cos(a), x + w * cos(a) - h * sin(a), x - h * sin(a)] AS xs, [y, y + w * sin(a), y + w * sin(a) + h * cos(a), y + h * cos(a)] AS ys FROM rects)"""


def rects(spark, d):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rect = F.struct((e(0) * 100).alias("x"), (e(1) * 100).alias("y"), (F.abs(e(3)) * 100 + 1).alias("height"), (F.abs(e(2)) * 100 + 1).alias("width"), e(4).alias("angle"))
    return table(spark, d, "embeddings").select("vec_id", rect.alias("rect"))


@query("g10_g12_corners_bounds", f"WITH {RECTS}, b AS (SELECT vec_id, xs, ys, list_min(xs) AS bx, list_min(ys) AS b_y, list_max(xs) - list_min(xs) AS bw, list_max(ys) - list_min(ys) AS bh FROM corners), i AS (SELECT *, unnest(range(4)) AS i FROM b) SELECT vec_id, i, round(xs[i + 1], 6) AS x, round(ys[i + 1], 6) AS y, round(bx + CASE WHEN i IN (1, 2) THEN bw ELSE 0 END, 6) AS ax, round(b_y + CASE WHEN i > 1 THEN bh ELSE 0 END, 6) AS ay FROM i")
def g10(spark, d):
    rows = rects(spark, d).select("vec_id", geometry.rect_corners(F.col("rect")).alias("c"))
    rows = rows.select("vec_id", "c", geometry.aabb_corners(geometry.bounds(F.col("c"))).alias("b"))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip("c", "b")).alias("i", "z"))
    return rounded(rows.select("vec_id", "i", F.col("z.c.x").alias("x"), F.col("z.c.y").alias("y"), F.col("z.b.x").alias("ax"), F.col("z.b.y").alias("ay")))


@query("g14_round_half_even", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice / 8, 0) AS INT) AS x FROM lineitem")
def g14(spark, d):
    at = geometry.rounded(F.array(F.struct((F.col("l_extendedprice") / 8).alias("x"), F.lit(0.0).alias("y"))))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", at[0]["x"].alias("x"))


@query("g16_g17_quads", f"WITH {POINTS}, q AS (SELECT vec_id, i, trunc(x / 3) AS x, trunc(y / 3) AS y FROM points WHERE i < 4), n AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY vec_id ORDER BY i), first_value(x) OVER (PARTITION BY vec_id ORDER BY i)) AS x2, coalesce(lead(y) OVER (PARTITION BY vec_id ORDER BY i), first_value(y) OVER (PARTITION BY vec_id ORDER BY i)) AS y2 FROM q) SELECT vec_id, sum((x2 - x) * (y2 + y)) AS turn, sum((x2 - x) * (y2 + y)) > 0 AS wrong FROM n GROUP BY vec_id")
def g16(spark, d):
    flat = F.flatten(F.transform(F.slice("points", 1, 4), lambda p: F.array(p["x"] / 3, p["y"] / 3)))
    rows = points(spark, d).select("vec_id", geometry.quad_from_ints(flat).cast(geometry.POINTS).alias("q"))
    return rows.select("vec_id", geometry.clockwise_sum(F.col("q")).alias("turn"), (geometry.clockwise_sum(F.col("q")) > 0).alias("wrong"))


@query("g18_in_bounds", f"WITH {POINTS} SELECT vec_id, bool_and(x + 40 BETWEEN 0 AND 75 AND y + 40 BETWEEN 0 AND 75) AS inside FROM points GROUP BY vec_id")
def g18(spark, d):
    moved = F.transform("points", lambda p: F.struct((p["x"] + 40).alias("x"), (p["y"] + 40).alias("y")))
    return points(spark, d).select("vec_id", geometry.in_bounds(moved, F.lit(75.0), F.lit(75.0)).alias("inside"))


@query("g19_g20_placement", f"WITH {RECTS} SELECT vec_id, round(list_avg(xs), 6) AS cx, round(list_avg(ys), 6) AS cy, round(degrees(atan2(ys[2] - ys[1], xs[2] - xs[1])), 6) AS angle, round(sqrt(pow(xs[4] - xs[1], 2) + pow(ys[4] - ys[1], 2)), 6) AS font, round(least(w / (0.55 * 7), h), 6) AS fit FROM corners JOIN rects USING (vec_id)")
def g19(spark, d):
    rows = rects(spark, d).select("vec_id", "rect", geometry.rect_corners(F.col("rect")).alias("c"))
    rows = rows.select("vec_id", geometry.text_placement(F.col("c")).alias("t"), geometry.font_fit(F.col("rect.width"), F.col("rect.height"), F.lit("letters")).alias("fit"))
    return rounded(rows.select("vec_id", "t.*", "fit"))


# Evaluation.


def corners(spark, d, at):
    return boxes(spark, d, at).select("image", "id", geometry.aabb_corners(F.col("rect")).alias("points"), "care")


def detected(spark, d):
    return corners(spark, d, 4).drop("care").withColumn("confidence", F.col("id") % 97 / 97.0)


IOU = f"SELECT g.image, g.id AS gt_id, d.id AS det_id, {OVERLAP} AS o, g.w * g.h + d.w * d.h AS s, g.care FROM gt g JOIN det d ON g.image = d.image"


@query("j3_g15_iou_join", f"WITH {GT}, {DET}, p AS ({IOU}) SELECT image, gt_id, det_id, round(o / (s - o), 9) AS iou FROM p WHERE o / (s - o) > 0.5")
def j3(spark, d):
    rows = evaluate.box_pairs(corners(spark, d, 0), corners(spark, d, 4))
    rows = rows.withColumn("iou", geometry.aabb_iou(geometry.bounds(F.col("gt_points")), geometry.bounds(F.col("det_points")))).where("iou > 0.5")
    return rows.select("image", "gt_id", "det_id", F.round("iou", 9).alias("iou"))


@query("g15_polygon_iou", f"WITH {GT}, {DET}, p AS ({IOU}) SELECT image, gt_id, det_id, round(o / (s - o), 6) AS iou FROM p WHERE o > 0")
def g15(spark, d):
    rows = evaluate.overlapping(corners(spark, d, 0), corners(spark, d, 4), least=0.0)
    return rows.select("image", "gt_id", "det_id", evaluate.half_up(F.col("iou"), 6).alias("iou"))


def _walk(wanted: str, source: str = "det") -> str:
    """Greedy matching of pairs in the order that `wanted` gives them, one step of the recursion for each pair of an image."""
    return f"""cand AS (SELECT g.image, g.id AS g, d.id AS d, o / (s - o) AS iou FROM (SELECT g.image, g.id, d.id AS did, {OVERLAP} AS o, g.w * g.h + d.w * d.h AS s FROM gt g JOIN {source} d ON g.image = d.image WHERE g.care) g JOIN det d ON d.id = did WHERE o / (s - o) > 0.5),
queue AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY {wanted}) AS k FROM cand),
walk(image, k, gs, ds, g, d, iou) AS (SELECT DISTINCT image, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM queue
  UNION ALL SELECT image, k, CASE WHEN free THEN list_append(gs, g) ELSE gs END, CASE WHEN free THEN list_append(ds, d) ELSE ds END, CASE WHEN free THEN g END, d, iou
  FROM (SELECT w.image, q.k, gs, ds, q.g, q.d, q.iou, NOT list_contains(gs, q.g) AND NOT list_contains(ds, q.d) AS free FROM walk w JOIN queue q ON q.image = w.image AND q.k = w.k + 1)),
pairs AS (SELECT image, g AS gt_id, d AS det_id, iou FROM walk WHERE g IS NOT NULL)"""


def _matched(spark, d, best_first):
    rows = evaluate.match(corners(spark, d, 0), corners(spark, d, 4).withColumn("care", F.lit(True)), best_first=best_first)
    return rows.select("image", "gt_id", "det_id", evaluate.half_up(F.col("iou"), 6).alias("iou"))


@query("j4_match_in_order", f"WITH RECURSIVE {GT}, {DET}, {_walk('g, d')} SELECT image, gt_id, det_id, round(iou, 6) AS iou FROM pairs")
def j4(spark, d):
    return _matched(spark, d, False)


@query("j5_match_best_first", f"WITH RECURSIVE {GT}, {DET}, {_walk('round(iou, 9) DESC, g, d')} SELECT image, gt_id, det_id, round(iou, 6) AS iou FROM pairs")
def j5(spark, d):
    return _matched(spark, d, True)


WITHIN = f"SELECT d.image, d.id FROM det d WHERE EXISTS (SELECT 1 FROM gt g WHERE g.image = d.image AND NOT g.care AND {OVERLAP} / (d.w * d.h) > 0.5)"


@query("j6_dont_care_semi", f"WITH {GT}, {DET} {WITHIN}")
def j6(spark, d):
    return evaluate.not_cared_for(corners(spark, d, 0), corners(spark, d, 4))


@query("j7_unknown_samples", "SELECT DISTINCT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def j7(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


EVALUATION = f"""WITH RECURSIVE {GT}, {DET}, own AS (SELECT * FROM det WHERE id NOT IN (SELECT id FROM ({WITHIN}))), {_walk('g, d', 'own')},
found AS (SELECT o.image, o.id, o.id % 97 / 97.0::DOUBLE AS confidence, p.det_id IS NOT NULL AS hit FROM own o LEFT JOIN pairs p ON p.det_id = o.id),
ranked AS (SELECT *, row_number() OVER i AS n, count(*) FILTER (WHERE hit) OVER (i ROWS UNBOUNDED PRECEDING) AS hits, row_number() OVER a AS all_n, count(*) FILTER (WHERE hit) OVER (a ROWS UNBOUNDED PRECEDING) AS all_hits
  FROM found WINDOW i AS (PARTITION BY image ORDER BY confidence DESC, id), a AS (ORDER BY confidence DESC, image, id)),
sums AS (SELECT image, count(*) AS care_det, count(*) FILTER (WHERE hit) AS matched, sum(CASE WHEN hit THEN hits / n ELSE 0 END) AS s FROM ranked GROUP BY image),
counts AS (SELECT image, care_gt, coalesce(care_det, 0) AS care_det, coalesce(matched, 0) AS matched, coalesce(s, 0) AS s FROM (SELECT image, count(*) FILTER (WHERE care) AS care_gt FROM gt GROUP BY image) LEFT JOIN sums USING (image)),
ratios AS (SELECT *, CASE WHEN care_gt = 0 THEN 1 ELSE matched / care_gt END AS r, CASE WHEN care_gt = 0 THEN CASE WHEN care_det > 0 THEN 0 ELSE 1 END WHEN care_det = 0 THEN 0 ELSE matched / care_det END AS p FROM counts)"""


@query("j8_a26_per_sample", f"{EVALUATION} SELECT image, care_gt, care_det, matched, round(r, 8) AS recall, round(p, 8) AS precision, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 8) AS hmean, round(CASE WHEN care_gt = 0 THEN p ELSE s / care_gt END, 8) AS ap FROM ratios")
def a26(spark, d):
    return rounded(evaluate.evaluation(corners(spark, d, 0), detected(spark, d))[0], 8)


@query("a27_method", f"{EVALUATION}, t AS (SELECT sum(matched)::BIGINT AS matched, sum(care_gt)::BIGINT AS care_gt, sum(care_det)::BIGINT AS care_det FROM counts), pr AS (SELECT *, matched / care_det AS p, matched / care_gt AS r FROM t) SELECT matched, care_gt, care_det, round(p, 8) AS precision, round(r, 8) AS recall, round(2 * p * r / (p + r), 8) AS hmean, round((SELECT sum(all_hits / all_n) FROM ranked WHERE hit) / care_gt, 8) AS ap FROM pr")
def a27(spark, d):
    return rounded(evaluate.evaluation(corners(spark, d, 0), detected(spark, d))[1], 8)


AP = """WITH rows AS (SELECT source, doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)),
ranked AS (SELECT *, row_number() OVER w AS n, sum(quality) OVER (w ROWS UNBOUNDED PRECEDING) AS correct FROM rows WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id))
SELECT source, round(sum(CASE WHEN quality = 1 THEN correct / n ELSE 0 END) / nullif(sum(quality), 0), 8) AS ap FROM ranked GROUP BY source HAVING sum(quality) > 0"""


@query("a25_w8_average_precision", AP)
def a25(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    out = evaluate.average_precision(rows, "n_chars", "quality", "doc_id", F.sum("quality"), "source")
    return rounded(out.where("ap > 0"), 8)


LINES = """lines AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_partkey || ',' || l_suppkey || ',' || (l_partkey + 9) || ',' || (l_suppkey + 9) || ',word' WHEN 1 THEN l_partkey || ',' || l_suppkey || ',1,2,"a \\"b\\""' WHEN 2 THEN 'bad,' || l_partkey ELSE '5,6,7,8,###' END AS line FROM lineitem)"""


def _lines(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", """CASE l_linenumber % 4 WHEN 0 THEN concat_ws(',', l_partkey, l_suppkey, l_partkey + 9, l_suppkey + 9, 'word') WHEN 1 THEN concat_ws(',', l_partkey, l_suppkey, '1', '2', '"a \\\\"b\\\\""') WHEN 2 THEN concat('bad,', l_partkey) ELSE '5,6,7,8,###' END AS line""")


@query("l1_l5_parse_lines", f"""WITH {LINES}, m AS (SELECT *, regexp_extract(line, '^(-?[0-9]+),(-?[0-9]+),([0-9]+),([0-9]+),(.*)$', ['a', 'b', 'c', 'd', 't']) AS g FROM lines),
e AS (SELECT *, CASE WHEN g.a = '' THEN 'Format incorrect' WHEN TRY_CAST(g.c AS BIGINT) < TRY_CAST(g.a AS BIGINT) THEN 'Xmax lower than Xmin' WHEN TRY_CAST(g.d AS BIGINT) < TRY_CAST(g.b AS BIGINT) THEN 'Ymax lower than Ymin' END AS error FROM m)
SELECT l_orderkey, l_linenumber, error, CASE WHEN error IS NULL THEN TRY_CAST(g.a AS DOUBLE) END AS x, CASE WHEN error IS NULL THEN CASE WHEN g.t LIKE '"%"' THEN replace(g.t[2:-2], '\\"', '"') ELSE g.t END END AS text, CASE WHEN error IS NULL THEN g.t = '###' END AS dont_care FROM e""")
def l1(spark, d):
    rows = evaluate.parse_lines(_lines(spark, d), ltrb=True)
    return rows.select("l_orderkey", "l_linenumber", "error", F.get("points", F.lit(0)).alias("x"), F.col("transcription").alias("text"), (F.col("transcription") == evaluate.DONT_CARE).alias("dont_care"))


# The eight forms of a line, made of the same numbers: some lines are right, others break one rule.

_X, _Y = "l_partkey % 300 - 20", "l_suppkey % 90 - 5"
_X2, _Y2 = f"({_X}) + l_linenumber * 10 - 15", f"({_Y}) + CAST(l_quantity AS BIGINT) % 40 - 4"
_LINE_CONFIDENCE = "CASE l_orderkey % 9 WHEN 0 THEN '1' WHEN 1 THEN '0.5' WHEN 2 THEN '1.' WHEN 3 THEN '.5' WHEN 4 THEN '99' WHEN 5 THEN '5' WHEN 6 THEN ' 0.25 ' WHEN 7 THEN '0x1' ELSE '1e0' END"
_LINE_TEXT = """CASE l_orderkey % 4 WHEN 0 THEN 'word, and, more' WHEN 1 THEN ' "say ''it'', twice" ' WHEN 2 THEN '###' ELSE '' END"""


def _line_sql(ltrb: bool, text: bool, confidence: bool) -> str:
    numbers = [_X, _Y, _X2, _Y2] if ltrb else [_X, _Y, _X2, _Y, _X2, _Y2, _X, _Y2]
    spaced = [f"concat(CASE WHEN l_orderkey % 5 = {i % 5} THEN ' ' ELSE '' END, {n})" for i, n in enumerate(numbers)]
    parts = spaced + [_LINE_CONFIDENCE] * confidence + [_LINE_TEXT] * text
    end = "CASE WHEN l_partkey % 13 = 0 THEN ',' WHEN l_partkey % 13 = 1 THEN 'x' ELSE '' END"
    return f"concat(concat_ws(',', {', '.join(parts)}), {end})"


def _form_oracle(ltrb: bool, text: bool, confidence: bool) -> str:
    n = 4 if ltrb else 8
    m = n + confidence
    number = lambda i: f"regexp_full_match(trim(f[{i + 1}]), '{'[0-9]+' if ltrb and i > 1 else '-?[0-9]+'}')"
    rules = [number(i) for i in range(n)]
    if confidence and not text:
        given = f"trim(array_to_string(f[{n + 1}:], ','))"
        rules.append(f"regexp_full_match({given}, '[01].?[0-9]*')")
    elif confidence:
        # a single digit may take the next comma and digits in, if another comma follows
        given = f"CASE WHEN len(f) > {m + 1} AND ltrim(f[{m}]) IN ('0', '1') AND regexp_full_match(f[{m + 1}], '[0-9]*\\s*') THEN f[{m}] || ',' || f[{m + 1}] ELSE trim(f[{m}]) END"
        rules += [f"len(f) > {m}", f"regexp_full_match(trim(f[{m}]), '[01].?[0-9]*')"]
    else:
        rules.append(f"len(f) > {m}" if text else f"(len(f) = {m} OR len(f) = {m + 1} AND trim(f[{m + 1}]) = '')" if ltrb else f"len(f) = {m}")
    v = [f"TRY_CAST(trim(f[{i + 1}]) AS DOUBLE)" for i in range(n)]
    turn = " + ".join(f"({v[(i + 2) % 8]} - {v[i]}) * ({v[(i + 3) % 8]} + {v[i + 1]})" for i in range(0, 8, 2)) if not ltrb else ""
    wrong = f"WHEN {v[2]} < {v[0]} THEN 'Xmax lower than Xmin' WHEN {v[3]} < {v[1]} THEN 'Ymax lower than Ymin'" if ltrb else f"WHEN {turn} > 0 THEN 'Points are not clockwise'"
    wrong += f" WHEN TRY_CAST({given} AS DOUBLE) IS NULL THEN 'Confidence is no number'" if confidence else ""
    rest = f"array_to_string(f[{m + 1}:], ',')"
    shown = f"CASE WHEN trim({rest}) LIKE '\"%\"' AND len(trim({rest})) > 1 THEN trim({rest})[2:-2] ELSE {rest} END" if text else "NULL::VARCHAR"
    return f"""WITH e AS (SELECT l_orderkey, l_linenumber, f, CASE WHEN NOT ({' AND '.join(rules)}) THEN 'Format incorrect' {wrong} END AS error FROM (SELECT l_orderkey, l_linenumber, string_split({_line_sql(ltrb, text, confidence)}, ',') AS f FROM lineitem))
SELECT l_orderkey, l_linenumber, error, CASE WHEN error IS NULL THEN {v[0]} END AS first, CASE WHEN error IS NULL THEN {v[n - 1]} END AS last, CASE WHEN error IS NULL THEN {f"TRY_CAST(trim(f[{n + 1}]) AS DOUBLE)" if confidence else "NULL::DOUBLE"} END AS confidence, CASE WHEN error IS NULL THEN {shown} END AS text FROM e"""


def _parsed(spark, d, ltrb, text, confidence):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_line_sql(ltrb, text, confidence).replace("''it''", "\\'it\\'")).alias("line"))
    rows = evaluate.parse_lines(rows, ltrb=ltrb, transcription=text, confidence=confidence)
    at = lambda i: F.get("points", F.lit(i))
    return rows.select("l_orderkey", "l_linenumber", "error", at(0).alias("first"), at(3 if ltrb else 7).alias("last"), "confidence", F.col("transcription").alias("text"))


for _form in [(a, b, c) for a in (True, False) for b in (False, True) for c in (False, True)]:
    _name = "l1_" + ("ltrb" if _form[0] else "quad") + "_confidence" * _form[2] + "_text" * _form[1]
    QUERIES[_name], SQL[_name] = partial(_parsed, ltrb=_form[0], text=_form[1], confidence=_form[2]), _form_oracle(*_form)


@query("l2_file_lines", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY doc_id")
def l2(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("l7_image_number", "SELECT page_id, TRY_CAST(regexp_extract('img_' || page_id || '.jpg', 'img_([0-9]+)', 1) AS INT) AS image FROM pages")
def l7(spark, d):
    return table(spark, d, "pages").select("page_id", evaluate.image_number(F.concat(F.lit("img_"), F.col("page_id").cast("string"), F.lit(".jpg"))).alias("image"))


@query("l10_cpu_list", "SELECT n_nationkey, array_to_string(range(n_nationkey + 1) || [40], ',') AS cpus FROM nation")
def l10(spark, d):
    text = F.concat(F.lit("0-"), F.col("n_nationkey").cast("string"), F.lit(",40"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(evaluate.cpu_list(text).cast("array<string>"), ",").alias("cpus"))


@query("k6_submission", f"WITH {DET} SELECT w.image, coalesce(content, '') AS content FROM (SELECT r.image FROM range(60) r(image)) w LEFT JOIN (SELECT image, string_agg(x::INT || ',' || y::INT, chr(10) ORDER BY id) AS content FROM det GROUP BY image) USING (image)")
def k6(spark, d):
    rows = boxes(spark, d, 4).select("image", "id", F.concat_ws(",", F.col("rect.x").cast("int"), F.col("rect.y").cast("int")).alias("line"))
    return evaluate.submission_lines(rows, spark.range(60).withColumnRenamed("id", "image"))


@query("k7_filtered_gt", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def k7(spark, d):
    wanted = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, d, "labels").select("doc_id", "quality").join(wanted, "doc_id", "left_semi")


# JSON and formats.


@query("s8_json_lines", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE props LIKE '{%'")
def s8(spark, d):
    rows = table(spark, d, "events").where(F.col("props").startswith("{"))
    return rows.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("s9_perf_lines", """SELECT l_orderkey * 1.0::DOUBLE AS second, CASE WHEN l_linenumber % 2 = 0 THEN 'cycles' ELSE 'instructions' END AS event, sum(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_partkey END)::DOUBLE AS n FROM lineitem WHERE l_linenumber <> 5 GROUP BY ALL""")
def s9(spark, d):
    value = "CASE WHEN l_linenumber = 3 THEN '<not counted>' WHEN l_linenumber = 5 THEN 'oops' ELSE CAST(l_partkey AS STRING) END"
    lines = table(spark, d, "lineitem").selectExpr(f"concat_ws(',', l_orderkey, {value}, '', if(l_linenumber % 2 = 0, 'cpu_core/cycles/', 'cpu_atom/instructions/')) AS value")
    return readers.perf_lines(lines)


@query("s9_perf_samples", """WITH e AS (SELECT l_orderkey AS second, l_linenumber AS k, l_partkey % 1000 AS n FROM lineitem),
s AS (SELECT second, sum(CASE WHEN k % 2 = 1 THEN n ELSE 0 END) AS i, sum(CASE WHEN k IN (2, 4) THEN n ELSE 0 END) AS c, sum(CASE WHEN k = 1 THEN n / 10 ELSE 0 END) AS l1, sum(CASE WHEN k IN (2, 3) THEN n / 10 ELSE 0 END) AS mem, coalesce(arg_max(n / 10, n) FILTER (WHERE k = 4), 0) AS bw FROM e GROUP BY second)
SELECT second * 1.0::DOUBLE AS second, round(mem, 6) AS memory_bound_pct, round(l1, 6) AS l1_bound_pct, round(bw, 6) AS bandwidth_gbps, round(CASE WHEN c > 0 THEN i / c ELSE 0 END, 6) AS ipc FROM s""")
def s9b(spark, d):
    n = "CAST(l_partkey % 1000 AS STRING)"
    event = "CASE WHEN l_linenumber % 2 = 1 THEN 'cpu_core/INSTRUCTIONS/' WHEN l_linenumber = 6 THEN 'cpu_clk_unhalted.cycles' ELSE 'cpu_atom/cycles/' END"
    tail = "CASE WHEN l_linenumber = 1 THEN concat(',1,100,', l_partkey % 1000 / 10, ',%  tma_l1_bound') WHEN l_linenumber IN (2, 3) THEN concat(',1,100,', l_partkey % 1000 / 10, ',% tma_memory_bound') WHEN l_linenumber = 4 THEN concat(',1,100,', l_partkey % 1000 / 10, ',tma_info_system_dram_bw_use') WHEN l_linenumber = 5 THEN ',1,100,x,% tma_l2_bound' ELSE '' END"
    lines = table(spark, d, "lineitem").selectExpr("l_partkey % 1000 AS line_no", f"concat_ws(',', l_orderkey, {n}, '', concat({event}, {tail})) AS value")
    rows = readers.perf_samples(lines)
    return rounded(rows.select("second", "memory_bound_pct", "l1_bound_pct", "bandwidth_gbps", "ipc"))


@query("a28_parameters", """WITH t AS (SELECT ['float32', 'int8', 'int64', 'float16'][p_partkey % 4 + 1] AS dtype, CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE p_size * (p_partkey % 7 + 1) END AS n FROM part)
SELECT dtype, sum(n)::BIGINT AS n, (sum(n) * CASE dtype WHEN 'float32' THEN 4 WHEN 'int8' THEN 1 WHEN 'int64' THEN 8 ELSE 2 END)::BIGINT AS bytes, round(100 * sum(n) / (SELECT sum(n) FROM t), 6) AS pct FROM t GROUP BY dtype""")
def a28(spark, d):
    dtype = F.element_at(F.array(*map(F.lit, ("float32", "int8", "int64", "float16"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    dims = F.when(F.col("p_partkey") % 9 == 0, F.array().cast("array<long>")).otherwise(F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 7 + 1))
    return rounded(inventory.parameters(table(spark, d, "part").select(dtype.alias("dtype"), dims.alias("dims"))))


@query("a28_operators", "SELECT p_type AS op_type, count(*) AS n FROM part GROUP BY p_type")
def a28b(spark, d):
    return inventory.operators(table(spark, d, "part").select(F.col("p_type").alias("op_type")))


@query("g21_views", f"""WITH {SIZES}, f AS (SELECT p_partkey, width, height, least(1280 / width, 720 / height, 1) * 0.95::DOUBLE AS s, p_partkey % 30 / 2.0::DOUBLE AS factor FROM sizes),
z AS (SELECT *, (1280 - width * s) / 2 AS x, (720 - height * s) / 2 AS y, greatest(0.1, least(10, s * factor)) AS t FROM f)
SELECT p_partkey, round(x, 6) AS x, round(y, 6) AS y, round(s, 9) AS scale, round(640 - (640 - x) * t / s, 6) AS zoomed_x, round(360 - (360 - y) * t / s, 6) AS zoomed_y, round(t, 9) AS zoomed_scale FROM z""")
def g21(spark, d):
    w, h = F.lit(1280.0), F.lit(720.0)
    rows = sizes(spark, d).select("p_partkey", geometry.fit_to_view(F.col("width"), F.col("height"), w, h).alias("v"))
    rows = rows.withColumn("z", geometry.zoomed(F.col("v"), F.col("p_partkey") % 30 / 2.0, w, h))
    return rows.select("p_partkey", F.round("v.x", 6).alias("x"), F.round("v.y", 6).alias("y"), F.round("v.scale", 9).alias("scale"), F.round("z.x", 6).alias("zoomed_x"), F.round("z.y", 6).alias("zoomed_y"), F.round("z.scale", 9).alias("zoomed_scale"))


@query("s11_r3_results", "SELECT page_id AS image, 0 AS pos, page_id / 2.0::DOUBLE AS x, 'w' || page_id AS text, 0.5::DOUBLE AS confidence FROM pages")
def s11(spark, d):
    box = """'{"filename":"img_', page_id, '.jpg","results":[{"boundingBox":{"rotatedRectangle":{"x":', {x}, ',"y":1,"height":2,"width":3,"angle":0}},"text":"', {t}, '","confidence":0.5},{"boundingBox":{},"text":"none","confidence":1}]}'"""
    old, new = box.replace("{x}", "0").replace("{t}", "'old'"), box.replace("{x}", "page_id / 2").replace("{t}", "concat('w', page_id)")
    pages = table(spark, d, "pages")
    lines = pages.selectExpr("page_id AS line_no", f"concat({old}) AS value").unionByName(pages.selectExpr("page_id + 1000000000 AS line_no", f"concat({new}) AS value"))
    return readers.detections(lines).select(F.col("image").cast("long").alias("image"), "pos", F.col("rect.x").alias("x"), "text", "confidence")


@query("k1_p1_wire", """SELECT vec_id, '{"filename":null,"results":[{"boundingBox":{"x":' || vec_id || ',"y":1},"text":"t' || label || '","confidence":0.5}]}' AS line FROM embeddings""")
def k1(spark, d):
    box = F.array(F.struct(F.col("vec_id").alias("x"), F.lit(1).alias("y")))
    text = F.array(F.struct(F.concat(F.lit("t"), F.col("label").cast("string")).alias("text"), F.lit(0.5).alias("confidence")))
    return table(spark, d, "embeddings").select("vec_id", sinks.wire(F.lit(None).cast("string"), sinks.zipped(box, text)).alias("line"))


@query("k2_json_array", """SELECT conv_id, '[' || string_agg('{"t":' || turn || '}', ',' ORDER BY turn) || ']' AS body FROM conversations GROUP BY conv_id""")
def k2(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.col("turn").alias("t"))).alias("line"))
    return sinks.json_array(rows, "line", "turn", "conv_id")


@query("k9_timer_record", f"""WITH {TRACE} SELECT event_id, '{{"start":' || start_us || ',"end":' || end_us || ',"tags":{{"model":"' || model || '"}}}}' AS line FROM trace""")
def k9(spark, d):
    return trace(spark, d).select("event_id", sinks.timer_record(F.col("start_us"), F.col("end_us"), F.create_map(F.lit("model"), F.col("model"))).alias("line"))


@query("l3_dict_detections", "SELECT vec_id, CASE WHEN label < 2 THEN 'Fewer than 3 points' WHEN vec_id % 7 = 0 THEN 'No transcription' END AS error, CASE WHEN label >= 2 AND vec_id % 7 <> 0 THEN 2 * (label + 1) ELSE -1 END AS n, CASE WHEN label >= 2 AND vec_id % 7 <> 0 THEN CASE WHEN label % 2 = 0 OR vec_id % 5 = 0 THEN '###' ELSE 'x' END END AS transcription FROM embeddings")
def l3(spark, d):
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.col("label")), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit(",1]"))), ",")
    named = F.when(F.col("vec_id") % 7 == 0, "").otherwise('"transcription":"x",')
    text = F.concat(F.lit('{"points":['), made, F.lit("],"), named, F.lit('"illegibility":'), (F.col("label") % 2 == 0).cast("string"), F.lit(',"dontCare":'), (F.col("vec_id") % 5 == 0).cast("string"), F.lit("}"))
    rows = evaluate.parse_dicts(table(spark, d, "embeddings").select("vec_id", text.alias("value")), transcription=True)
    return rows.select("vec_id", "error", F.coalesce(F.size("points"), F.lit(-1)).alias("n"), "transcription")


@query("l2_l4_o3_files", """WITH lines AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS line_no, o_orderkey % 50 AS x, o_orderkey % 89 / 100.0::DOUBLE AS c FROM orders)
SELECT o_custkey::VARCHAR AS name, line_no, x::DOUBLE AS x, round(c, 6) AS confidence, CASE WHEN x <= 40 THEN NULL ELSE 'Line in sample not valid. Sample: ' || o_custkey || ' Line: ' || x || ',1,40,9,' || printf('%.2f', c) || ' Error: Xmax lower than Xmin' END AS message,
  row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, line_no) - 1 AS position FROM lines""")
def l2_l4(spark, d):
    """Each customer's orders as a file of lines, read back."""
    line = F.concat_ws(",", F.col("o_orderkey") % 50, F.lit(1), F.lit(40), F.lit(9), F.format_string("%.2f", F.col("o_orderkey") % 89 / 100.0))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda r: r["line"])
    files = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.concat(F.lit("\ufeff"), F.array_join(ordered, "\r\n"), F.lit("\r\n\r\n")).cast("binary").alias("content"))
    form = {"ltrb": True, "transcription": False, "confidence": True}
    lines = evaluate.file_lines(files, crlf=True)
    bad = evaluate.invalid_lines(files, crlf=True, **form)
    number = F.split("line", ",")
    rows = lines.select("name", "line_no", F.get(number, F.lit(0)).cast("double").alias("x"), F.get(number, F.lit(4)).cast("double").alias("confidence")).join(bad, ["name", "line_no"], "left")
    return rounded(evaluate.by_confidence(rows, "name").withColumn("line_no", F.col("line_no").cast("long")))


@query("f_number_formats", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%d B', n_chars) WHEN n_chars < 1048576 THEN printf('%.2f KB', round(n_chars / 1024.0::DOUBLE + 1e-9, 2)) WHEN n_chars < 1073741824 THEN printf('%.2f MB', round(n_chars / 1048576.0::DOUBLE + 1e-9, 2)) ELSE CASE WHEN n_chars IS NOT NULL THEN printf('%.2f GB', round(n_chars / 1073741824.0::DOUBLE + 1e-9, 2)) END END AS size FROM documents")
def f_formats(spark, d):
    return table(spark, d, "documents").select("doc_id", formats.size_text(F.col("n_chars")).alias("size"))


@query("f3_i14_ocr_pipeline")
def ocr(spark, d):
    """Pages with dark bars of the nations' sizes; one is too small and keeps its error."""
    @F.pandas_udf("binary")
    def draw(w: pd.Series, h: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for a, b, n in zip(w, h, k, strict=True):
            page = np.full((b, a, 3), 255, np.uint8)
            page[30:60, 30 : min(a - 10, 80 + 6 * n)] = 0
            out.append(page.tobytes())
        return pd.Series(out)

    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.when(F.col("n_nationkey") == 3, 20).otherwise(300).alias("width"), F.lit(120).alias("height"))
    out = pipeline.run(rows.select("*", draw("width", "height", "seq").alias("data")))
    return out.select("seq", F.size("results").alias("n"), F.col("error").isNotNull().alias("failed"), F.round(F.get("results", F.lit(0))["boundingBox"]["rectangle"]["width"], 3).alias("width"))
