"""Analysis of benchmark traces: rows with start_us and end_us (microseconds) and any grouping columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def throughput(rows: DataFrame, *keys: str, batch: Column | None = None) -> DataFrame:
    """Count (times batch) over the span from first start to last end, in 1/s, and the mean latency in ms."""
    n = F.count(F.lit(1)) if batch is None else F.sum(batch)
    span = (F.max("end_us") - F.min("start_us")) / SECOND
    return rows.groupBy(*keys).agg(n.alias("n"), F.try_divide(n, span).alias("per_sec"), F.avg((F.col("end_us") - F.col("start_us")) / 1000).alias("latency_ms"))


def midpoint() -> Column:
    return F.col("start_us") + F.floor((F.col("end_us") - F.col("start_us")) / 2)


def trimmed(rows: DataFrame, trim_us: int, *keys: str) -> DataFrame:
    """Rows whose midpoint is at least trim_us within their group's span; the spans are aggregated first, one row a group."""
    span = rows.groupBy(*keys).agg((F.min("start_us") + trim_us).alias("_low"), (F.max("end_us") - trim_us).alias("_high"))
    return rows.join(span, list(keys)).where(midpoint().between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def variance_parts(rows: DataFrame, value: str, level: str, core: str) -> DataFrame:
    """Per level: total variance, mean variance within cores, what is left as heterogeneity, its share; spread of core means."""
    cores = rows.groupBy(level, core).agg(F.var_samp(value).alias("v"), F.avg(value).alias("m"))
    inner = cores.groupBy(level).agg(F.avg("v").alias("intra"), F.min("m").alias("lowest"), F.max("m").alias("highest"))
    total = rows.groupBy(level).agg(F.var_samp(value).alias("total"), F.stddev_samp(value).alias("std"))
    het = F.greatest(F.lit(0.0), F.col("total") - F.col("intra"))
    return total.join(inner, level).select(
        level, "total", "std", "intra", het.alias("heterogeneity"), F.when(F.col("total") == 0, 0.0).otherwise(100 * het / F.col("total")).alias("pct"),
        "lowest", "highest", (F.col("highest") - F.col("lowest")).alias("spread"),
    )


def fastest_slowest(rows: DataFrame, level: str, core: str, value: str) -> DataFrame:
    """Core with the smallest and the largest mean per level; ties go to the smaller core."""
    cores = rows.groupBy(level, core).agg(F.round(F.avg(value), 9).alias("m"))
    return cores.groupBy(level).agg(F.min_by(core, F.struct("m", core)).alias("fastest"), F.max_by(core, F.struct(F.col("m"), -F.col(core))).alias("slowest"))


def each_bin(rows: DataFrame, low: str, high: str, name: str, part: int = 4096) -> DataFrame:
    """Rows with every bin from low to high, none if high is lower; made in parts, so that no array grows with the span."""
    rows = rows.where(F.col(low) <= F.col(high)).withColumn("_part", F.explode(F.sequence(F.col(low), F.col(high), F.lit(part).cast("long"))))
    return rows.withColumn(name, F.explode(F.sequence(F.col("_part"), F.least(F.col("_part") + (part - 1), F.col(high))))).drop("_part")


def binned(rows: DataFrame, at: Column, key: str, width_us: int, *aggregates: Column) -> DataFrame:
    """Aggregates in bins of width_us, with a row for every bin between a group's first and last; the two outer bins go.

    The gaps are filled from generated bins; time_s counts from the group's first bin.
    """
    found = rows.withColumn("bin", F.floor(at / width_us)).groupBy(key, "bin").agg(*aggregates)
    spine = found.groupBy(key).agg(F.min("bin").alias("_b0"), (F.min("bin") + 1).alias("_low"), (F.max("bin") - 1).alias("_high"))
    spine = each_bin(spine, "_low", "_high", "bin").drop("_low", "_high")
    return spine.join(found, [key, "bin"], "left").withColumn("time_s", (F.col("bin") - F.col("_b0")) * (width_us / SECOND)).drop("_b0")


def common_range(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Rows up to the smallest of the groups' last times, a single number joined to all."""
    last = rows.groupBy(key).agg(F.max(time).alias("m")).agg(F.min("m").alias("_common"))
    return rows.crossJoin(F.broadcast(last)).where(F.col(time) <= F.col("_common")).drop("_common")


def range_join(samples: DataFrame, runs: DataFrame, ts: str, low: str, high: str, width: int) -> DataFrame:
    """Samples within closed intervals, as an equi-join on time bins of `width`: an interval gets a row for each bin it meets.

    Choose the width near the usual length of an interval; a very long interval is spread over many tasks.
    """
    left = samples.withColumn("_bin", F.floor(F.col(ts) / width))
    right = runs.withColumns({"_low": F.floor(F.col(low) / width), "_high": F.floor(F.col(high) / width)})
    return left.join(each_bin(right, "_low", "_high", "_bin").drop("_low", "_high"), "_bin").where(F.col(ts).between(F.col(low), F.col(high))).drop("_bin")


def marginal(rows: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """Difference to the row before, over the first row's value; null in the first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("marginal", (F.col(value) - F.lag(value).over(w)) / F.first(value).over(w))


def against_baseline(rows: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """Percent against the first row, and as text with a sign."""
    w = Window.partitionBy(*keys).orderBy(order)
    pct = (F.col(value) / F.first(value).over(w) - 1) * 100
    return rows.withColumn("pct", pct).withColumn("pct_text", F.format_string("%+.0f%%", F.col("pct")))


def p_core_metrics(inst: Column, clk: Column, ref: Column, l3: Column, l2: Column, l1d: Column, loads: Column) -> dict[str, Column]:
    """Rates of a performance core from counter deltas; all 0 without clock ticks."""
    made = {
        "ipc": inst / clk, "freq_ratio": F.when(ref != 0, clk / ref).otherwise(0.0), "dram_bound_pct": 100 * l3 / clk,
        "l3_bound_pct": 100 * (l2 - l3) / clk, "l2_bound_pct": 100 * (l1d - l2) / clk, "l1_bound_pct": 100 * F.greatest(loads - l1d, F.lit(0)) / clk,
    }
    return {k: F.when(clk != 0, v).otherwise(0.0) for k, v in made.items()}


def e_core_metrics(inst: Column, clk: Column, ref: Column, l1_miss: Column, l1_bound: Column, load: Column, dram: Column, llc: Column, l2: Column) -> dict[str, Column]:
    """Rates of an efficiency core; stalls are corrected by the share of load stalls that no first-level miss explains."""
    share = F.when(load != 0, F.greatest((load - l1_miss) / clk, F.lit(0.0)) / load).otherwise(0.0)
    bound = lambda hit: 100 * (hit / clk - share * hit)
    made = {
        "ipc": inst / clk, "freq_ratio": F.when(ref != 0, clk / ref).otherwise(0.0), "dram_bound_pct": bound(dram),
        "l3_bound_pct": bound(llc), "l2_bound_pct": bound(l2), "l1_bound_pct": 100 * l1_bound / clk,
    }
    return {k: F.when(clk != 0, v).otherwise(0.0) for k, v in made.items()}


def bandwidth_gbps(lines: Column, seconds: Column) -> Column:
    """64-byte lines over a time; null where there are no counters."""
    return 64 * lines / seconds / 1e9
