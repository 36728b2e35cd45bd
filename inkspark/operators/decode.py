"""Greedy CTC decoding over rows of step probabilities, with the confidence rule of the recognizer.

A sequence is an array of steps, each an array of class probabilities; class 0 is the blank. Everything happens within
the row (no shuffle): the arg-max of each step, the runs of equal classes, the characters that runs of other classes
than the blank emit. A character counts for the confidence only if another character follows its run directly, or if it
is the last; the confidence is the geometric mean of the counted characters' largest probabilities, 0 without any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def index_of_max(values: Column) -> Column:
    """Place of the first largest element from 0; -1 for an empty array."""
    return F.when(F.size(values) == 0, -1).otherwise(F.array_position(values, F.array_max(values)).cast("int") - 1)


def decode(steps: Column, all_chars: bool = False) -> Column:
    """struct<classes array<int>, n_chars int, confidence double> of an array of steps."""
    best = F.transform(steps, lambda s: F.struct(index_of_max(s).alias("c"), F.array_max(s).cast("double").alias("p")))

    def runs(found: Column) -> Column:
        """Class and largest probability of each run of equal classes, from the places where runs begin."""
        places = F.transform(found, lambda x, i: F.when((i == 0) | (x["c"] != F.get(found, i - 1)["c"]), i))

        def cut(starts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(found))
            own = lambda s, k: F.slice(found, s + 1, end(k) - s)
            return F.transform(starts, lambda s, k: F.struct(F.get(found, s)["c"].alias("c"), F.array_max(F.transform(own(s, k), lambda x: x["p"])).alias("p")))

        return bind(F.filter(places, lambda i: i.isNotNull()), cut)

    def result(run: Column) -> Column:
        marked = F.transform(run, lambda r, i: F.struct(r["c"].alias("c"), r["p"].alias("p"), (F.get(run, i + 1)["c"] != 0).alias("followed")))
        chars = F.filter(marked, lambda r: r["c"] != 0)

        def confidence(own: Column) -> Column:
            counted = own if all_chars else F.filter(F.transform(own, lambda r, i: F.when(r["followed"] | (i == F.size(own) - 1), r["p"])), lambda p: p.isNotNull())
            logs = F.transform(counted, (lambda r: F.log(r["p"])) if all_chars else (lambda p: F.log(p)))
            mean = bind(logs, lambda x: F.exp(F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)))
            return F.struct(
                F.transform(own, lambda r: r["c"]).alias("classes"), F.size(own).alias("n_chars"), F.when(F.size(own) > 0, mean).otherwise(0.0).alias("confidence")
            )

        return bind(chars, confidence)

    return bind(bind(best, runs), result)


def dictionary(lines: DataFrame, text: str = "ch", order: str = "idx") -> DataFrame:
    """(idx, ch): blank at 0, the given characters in order from 1, a space last."""
    own = lines.select(F.col(order).cast("long").alias("o"), F.col(text).alias("ch"))
    rank = own.select(F.expr("row_number() OVER (ORDER BY o)").alias("idx"), "ch")
    ends = own.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("idx"), F.lit("\0").alias("ch")), F.struct((F.col("n") + 1).alias("idx"), F.lit(" ").alias("ch")))).alias("e")).select("e.*")
    return rank.select(F.col("idx").cast("long"), "ch").unionByName(ends)


def to_chars(classes: DataFrame, chars: DataFrame, class_column: str = "class") -> DataFrame:
    """Characters of class rows; `?` where the dictionary has none. The dictionary is a fixed resource (6 625 rows at most here)."""
    return classes.join(F.broadcast(chars.select(F.col("idx").alias(class_column), "ch")), class_column, "left").withColumn("ch", F.coalesce("ch", F.lit("?")))
