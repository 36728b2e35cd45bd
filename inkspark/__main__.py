"""Command line: reads image files and prints a JSON line for each; with --viz, writes a page beside each."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from inkspark.plans import pipeline
from inkspark.sources.readers import pictures


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, **kernels) -> int:
    parser = argparse.ArgumentParser(prog="inkspark")
    parser.add_argument("inputs", nargs="*", help="image files")
    parser.add_argument("--viz", action="store_true", help="write <name>_viz.svg beside each image")
    parser.add_argument("--detector", help="an ONNX file; by default dark spots are found")
    parser.add_argument("--reader", help="an ONNX file; by default a stand-in reads one letter")
    given = parser.parse_args(arguments)
    if not given.inputs:
        print("Error: No input files specified.", file=sys.stderr)
        return 1
    for name in ("detector", "reader"):
        if path := getattr(given, name):
            kernels[name] = lambda path=path: pipeline.onnx_kernel(path)
    spark = spark or SparkSession.builder.appName("inkspark").getOrCreate()
    found = pictures(spark, [p if "://" in p else os.path.abspath(p) for p in given.inputs])
    read = pipeline.run(found, **kernels)
    read = read.persist()  # printed, and drawn from
    for row in pipeline.json_lines(read, found).orderBy("seq").toLocalIterator():
        if row["error"]:
            print(f"Error: Failed to process '{given.inputs[row['seq']]}': {row['error']}", file=sys.stderr)
            return 1
        print(row["line"])
    if given.viz:
        for row in pipeline.draw_files(found, read, kernels.get("detector", lambda: pipeline.dark_kernel)).toLocalIterator():
            with open(row["path"], "w", encoding="utf-8") as file:
                file.write(row["svg"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
