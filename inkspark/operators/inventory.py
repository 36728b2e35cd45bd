"""What a model file holds: parameters by number format, operators by frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a number in each format.
BYTES = {"float64": 8, "int64": 8, "uint64": 8, "float32": 4, "int32": 4, "uint32": 4, "float16": 2, "bfloat16": 2, "int16": 2, "uint16": 2, "int8": 1, "uint8": 1, "bool": 1}


def parameters(tensors: DataFrame) -> DataFrame:
    """dtype, n, bytes and pct of all parameters of tensors (dtype, dims), most first; a tensor without dims is one number."""
    n = F.aggregate(F.transform("dims", lambda x: x.cast("long")), F.lit(1).cast("long"), lambda a, x: a * x)
    sizes = F.create_map(*[F.lit(x) for kv in BYTES.items() for x in kv])
    rows = tensors.groupBy("dtype").agg(F.sum(n).alias("n")).withColumn("bytes", F.col("n") * F.try_element_at(sizes, "dtype"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("dtype", "n", "bytes", (100 * F.col("n") / F.col("total")).alias("pct")).orderBy(F.desc("n"), "dtype")


def operators(nodes: DataFrame) -> DataFrame:
    """op_type and n of nodes, most first."""
    return nodes.groupBy("op_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "op_type")
