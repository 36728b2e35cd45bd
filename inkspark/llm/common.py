"""Shared folders, saved tables and parameters checked on the way in."""

from __future__ import annotations

import sys
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is known to have no more rows than this.
BROADCAST_ROWS = 20_000


#: A key with no more rows than this needs no care in a join.
FEW_ROWS = 1000


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the session has no such setting, a temporary folder is set for it in local mode (tests); on a cluster, whose
    executors wouldn't see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/inkspark/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: what follows depends on the files and no longer on the plan before them."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Let go of what a Python worker holds for the tokenizer, and of freed Arrow memory, as the next operator in it needs neither."""
    if tokens := sys.modules.get("inkspark.llm.tokens"):
        tokens.forget()
    pa.default_memory_pool().release_unused()


def column(name: str) -> Column:
    """The column of just this name, with dots or backticks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(taken: list[str], wanted: str) -> str:
    """A name for a result beside columns that stay: `wanted`, with `_` added until no column has it in any case."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def lookup(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """left (a saved table) joined with right, which has one row for each key, where a key may have any share of left's rows.

    Keys of more than `FEW_ROWS` rows, and of more than one in `BROADCAST_ROWS`, are counted first. There are fewer than
    `BROADCAST_ROWS` of them: their rows of right are broadcast. Left's rows with them have found what they look for then, and
    are spread by a hash of the whole row in the join that the others' keys take.
    """
    keys = [keys] if isinstance(keys, str) else keys
    often = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > max(FEW_ROWS, left.count() // BROADCAST_ROWS))
    often = left.sparkSession.createDataFrame(often.select(*keys).dropna().collect(), left.select(*keys).schema)  # bounded as said
    if often.isEmpty():
        return left.join(right, keys, how)
    more = [c for c in right.columns if c not in keys]
    hot = often.join(right.withColumn("_found", F.lit(True)), keys, "left")
    hot = hot.select(*keys, F.lit(True).alias("_hot"), F.col("_found").alias("_hot_found"), *[F.col(c).alias(f"_hot_{c}") for c in more])
    marked = left.join(F.broadcast(hot), keys, "left")
    apart = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.coalesce(F.col("_hot"), F.lit(False)))
    marked = marked.withColumn("_spread", F.when(apart, F.xxhash64(*left.columns)).otherwise(F.lit(0).cast("long")))
    cold = right.select(*[F.col(c).alias(f"_cold_{c}") for c in right.columns], F.lit(0).cast("long").alias("_none"), F.lit(True).alias("_found"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_cold_{k}") for k in keys], F.col("_spread") == F.col("_none"))
    out = marked.join(cold, same, "left")
    if how == "inner":
        out = out.where(F.coalesce(F.when(F.col("_hot"), F.col("_hot_found")).otherwise(F.col("_found")), F.lit(False)))
    return out.select(*left.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in more])
