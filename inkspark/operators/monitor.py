"""Dashboard aggregates over metric rows (time_us, metric_name, value), in batch and, by event time, on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_average(rows: DataFrame, width_us: int, low: int | None = None, high: int | None = None, divide: float = 1.0) -> DataFrame:
    """Mean value by metric and time bucket, within [low, high)."""
    if low is not None:
        rows = rows.where(F.col("time_us") >= low)
    if high is not None:
        rows = rows.where(F.col("time_us") < high)
    return rows.groupBy("metric_name", (F.floor(F.col("time_us") / width_us) * width_us).alias("bucket_us")).agg((F.avg("value") / divide).alias("avg_value"))


def last_values(rows: DataFrame, width_us: int, tie: str) -> DataFrame:
    """A gauge's last value in each bucket."""
    return rows.groupBy("metric_name", F.floor(F.col("time_us") / width_us).alias("bucket")).agg(F.max_by("value", F.struct("time_us", tie)).alias("last_value"))


def bucket_counts(rows: DataFrame, bounds: list[float], *keys: str) -> DataFrame:
    """Cumulative histogram counts (le) of values by key; the last bound is infinity."""
    n = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(F.lit(1)).alias(f"b{len(bounds)}")]
    wide = rows.groupBy(*keys).agg(*n)
    les = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds, float("inf")])])
    return wide.select(*keys, F.inline(les))


def histogram_quantiles(counts: DataFrame, qs: list[float], *keys: str) -> DataFrame:
    """Quantiles (q, quantile) of cumulative bucket counts, linear within a bucket; the last finite bound if one lies beyond."""
    ordered = F.array_sort(F.collect_list(F.struct("le", "n")))
    rows = counts.groupBy(*keys).agg(ordered.alias("h")).withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    rows = rows.withColumn("rank", F.col("q") * F.element_at("h", -1)["n"]).withColumn("i", F.expr("cast(size(filter(h, x -> x.n < rank)) as int)"))
    low, before = F.when(F.col("i") == 0, 0.0).otherwise(F.expr("h[i - 1].le")), F.when(F.col("i") == 0, 0).otherwise(F.expr("h[i - 1].n"))
    high, n = F.expr("get(h, i).le"), F.expr("get(h, i).n")
    inside = low + (high - low) * F.try_divide(F.col("rank") - before, n - before)
    last = F.expr("h[size(h) - 2].le")
    return rows.select(*keys, "q", F.when(F.element_at("h", -1)["n"] == 0, F.lit(None)).when(F.col("i") >= F.size("h") - 1, last).otherwise(inside).alias("quantile"))


def trailing_rate(rows: DataFrame, seconds: float, *keys: str) -> DataFrame:
    """Events of the last `seconds` up to each event, over `seconds`."""
    w = Window.partitionBy(*keys).orderBy("time_us").rangeBetween(-int(seconds * 1e6) + 1, 0)
    return rows.withColumn("rate", F.count(F.lit(1)).over(w) / seconds)


def windowed_rate(events: DataFrame, time: str, window: str, slide: str, seconds: float, *keys: str) -> DataFrame:
    """The same on a stream or a table, sampled at each slide."""
    return events.groupBy(*keys, F.window(time, window, slide)).agg((F.count(F.lit(1)) / seconds).alias("rate"))


def gauge_average(value: Column) -> Column:
    """What an average gauge collects: 0 without values."""
    return F.coalesce(F.avg(value), F.lit(0.0))
