"""Readers: images, trace lines, perf output, OCR result lines, zip archives, HTTP bodies, dictionaries."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "start timestamp, end timestamp, tags map<string,string>"
RESULTS = (
    "filename string, results array<struct<boundingBox:struct<polygon:struct<points:array<struct<x:double,y:double>>>,"
    "rotatedRectangle:struct<x:double,y:double,height:double,width:double,angle:double>,"
    "rectangle:struct<x:double,y:double,height:double,width:double>>,text:string,confidence:double>>"
)


def _named(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """(seq, path, name, uri) of the paths, the last two with their scheme, and the names of the files that exist, each once."""
    rows, found = [], {}
    for i, p in enumerate(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        full = fs.makeQualified(where)
        found.setdefault(full.toString(), fs.exists(where))
        rows.append((i, p, full.toString(), full.toUri().toString()))
    return spark.createDataFrame(rows, "seq long, path string, name string, uri string"), [n for n, there in found.items() if there]


def _scheme(path: Column) -> Column:
    """file:///a and file:/a are one name."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Encoded images in the order of paths: seq, path, content. A missing file has a null content; a path may come again."""
    wanted, names = _named(spark, paths)
    if not names:
        return wanted.select("seq", "path", F.lit(None).cast("binary").alias("content"))
    files = spark.read.format("binaryFile").load(names).select(_scheme(F.col("path")).alias("name"), "content")
    return wanted.withColumn("name", _scheme(F.col("name"))).join(files, "name", "left").select("seq", "path", "content")


def pictures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Decoded images in the order of paths: seq, path, width, height and data (rows of RGB bytes); nulls for what is none."""
    wanted, names = _named(spark, paths)
    if not names:
        return wanted.select("seq", "path", *[F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("data", "binary"))])

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for raw, n in zip(data, channels, strict=True):
            pixels = np.frombuffer(raw, np.uint8).reshape(-1, int(n))
            out.append((np.repeat(pixels, 3, 1) if n == 1 else pixels[:, 2::-1]).tobytes())  # blue comes first there
        return pd.Series(out)

    files = spark.read.format("image").option("dropInvalid", "true").load(names).select("image.*")
    files = files.select(_scheme(F.col("origin")).alias("uri"), "width", "height", rgb("data", "nChannels").alias("data"))
    return wanted.withColumn("uri", _scheme(F.col("uri"))).join(files, "uri", "left").select("seq", "path", "width", "height", "data")


def submitted(spark: SparkSession, contents: Iterable[bytes]) -> DataFrame:
    """Encoded images from memory, each with a handle."""
    return spark.createDataFrame([(i, str(uuid.uuid4()), bytearray(c)) for i, c in enumerate(contents)], "seq long, handle string, content binary")


def numbered_files(names: DataFrame, name: str = "name", first: int | None = None) -> DataFrame:
    """Files by image number, the first so many at most."""
    rows = names.withColumn("image", F.regexp_extract(name, r"img_(\d+)", 1).try_cast("int")).where("image is not null").orderBy("image", name)
    return rows if first is None else rows.limit(first)


def trace_lines(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Trace events of lines that begin with `{`, and the other lines, which are a log."""
    is_event = F.ltrim(F.col(line)).startswith("{")
    return lines.where(is_event).select(F.from_json(line, TRACE).alias("e")).select("e.*"), lines.where(~is_event)


def perf_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Counter sums (second, event, n) of `perf stat -x,` output: comments and short or non-numeric lines are skipped."""
    parts = F.split(F.col(line), ",")
    rows = lines.where(~F.ltrim(F.col(line)).startswith("#") & (F.size(parts) >= 4)).select(parts.alias("p"))
    rows = rows.select(F.trim(F.element_at("p", 1)).try_cast("double").alias("second"), F.when(F.trim(F.element_at("p", 2)) == "<not counted>", 0.0).otherwise(F.trim(F.element_at("p", 2)).try_cast("double")).alias("n"), F.regexp_replace(F.trim(F.element_at("p", 4)), r"^cpu_(core|atom)/(.*)/$", "$2").alias("event"))
    return rows.where("second is not null and n is not null").groupBy("second", "event").agg(F.sum("n").alias("n"))


#: The derived metrics of perf's output and what they are called here.
TOP_DOWN = {
    "tma_memory_bound": "memory_bound_pct", "tma_l1_bound": "l1_bound_pct", "tma_l2_bound": "l2_bound_pct", "tma_l3_bound": "l3_bound_pct",
    "tma_dram_bound": "dram_bound_pct", "tma_info_system_dram_bw_use": "bandwidth_gbps",
}


def perf_samples(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """A row for each second of `perf stat -x,` output: ipc over all cores, and the metrics that lines end with, 0 where absent.

    Metrics of several lines of a second add up, but of the bandwidth the last one counts.
    """
    parts = F.transform(F.split(F.trim(line), ","), lambda x: F.trim(x))
    rows = lines.where(~F.ltrim(F.col(line)).startswith("#")).select(F.col(order).alias("_order"), parts.alias("p")).where(F.size("p") >= 4)
    rows = rows.withColumn("second", F.col("p")[0].try_cast("double")).where("second is not null")
    event, value = F.lower(F.col("p")[3]), F.coalesce(F.col("p")[1].try_cast("double"), F.lit(0.0))
    names = F.transform("p", lambda x: F.regexp_replace(x, r"^%\s*", ""))
    at = F.array_max(F.transform(names, lambda x, i: F.when(x.startswith("tma_") & (i > 3), i)))
    rows = rows.select("_order", "second", event.alias("event"), value.alias("n"), F.get(names, at).alias("metric"), F.get("p", at - 1).try_cast("double").alias("metric_value"))
    instructions = F.col("event").contains("instructions")
    cycles = ~instructions & F.col("event").contains("cycles") & ~F.col("event").contains("unhalted")
    counted = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0.0))
    of = lambda name: F.col("metric") == name
    metrics = [F.coalesce(F.sum(F.when(of(k), F.col("metric_value"))), F.lit(0.0)).alias(v) for k, v in TOP_DOWN.items() if v != "bandwidth_gbps"]
    used = of("tma_info_system_dram_bw_use") & F.col("metric_value").isNotNull()
    bandwidth = F.coalesce(F.max_by(F.when(used, F.col("metric_value")), F.when(used, F.col("_order"))), F.lit(0.0)).alias("bandwidth_gbps")
    made = rows.groupBy("second").agg(counted(instructions).alias("_i"), counted(cycles).alias("_c"), *metrics, bandwidth)
    return made.withColumn("ipc", F.when(F.col("_c") > 0, F.col("_i") / F.col("_c")).otherwise(0.0)).drop("_i", "_c")


def detections(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """(image, pos, rect, text, confidence) of result lines; of lines with the same image the last counts."""
    rows = lines.select(F.col(order), F.from_json(line, RESULTS).alias("r")).select(order, "r.*")
    rows = rows.withColumn("image", F.regexp_extract("filename", r"img_(\d+)", 1).try_cast("int")).where("image is not null")
    last = rows.groupBy("image").agg(F.max_by("results", order).alias("results"))
    return last.select("image", F.posexplode("results").alias("pos", "d")).where("d.boundingBox.rotatedRectangle is not null").select("image", "pos", F.col("d.boundingBox.rotatedRectangle").alias("rect"), "d.text", "d.confidence")


def zip_entries(archives: DataFrame, pattern: str, all_entries: bool = False) -> DataFrame:
    """(archive, key, content) of the entries whose name matches; key is the first group. Archives come as binaryFile rows."""
    return _entries(archives, pattern, all_entries, True)


def _entries(archives: DataFrame, pattern: str, all_entries: bool, contents: bool) -> DataFrame:
    matcher = re.compile(pattern)
    names = ["archive", "key", "content"][: 2 + contents]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        found = matcher.match(name)
                        if found:
                            row = (path, found.group(1) if found.groups() else name)
                            out.append((*row, z.read(name)) if contents else row)
                        elif all_entries:
                            raise ValueError(f"{name} is no valid entry")
            yield pd.DataFrame(out, columns=names)

    return archives.select("path", "content").mapInPandas(run, "archive string, key string" + ", content binary" * contents)


def zip_keys(archives: DataFrame, pattern: str, all_entries: bool = False) -> DataFrame:
    """(archive, key) of the entries whose name matches, without reading them."""
    return _entries(archives, pattern, all_entries, False)


def multipart(body: bytes, content_type: str) -> list[bytes]:
    """The contents of the parts that have a file name; a body that ends early gives the parts before its end."""
    boundary = b"--" + content_type.partition("boundary=")[2].split(";")[0].strip().strip('"').encode()
    out = []
    for part in body.split(boundary)[1:]:
        if part.startswith(b"--"):
            break
        head, mark, content = part.removeprefix(b"\r\n").partition(b"\r\n\r\n")
        if mark and re.search(rb"filename\*?=", head):
            out.append(content.removesuffix(b"\r\n"))
    return out


def request_images(body: bytes, content_type: str | None) -> list[bytes]:
    """Images of a request body; ValueError for a type that isn't accepted."""
    kind = (content_type or "").strip().lower()
    if kind.startswith("multipart/"):
        return multipart(body, content_type or "")
    if not kind or kind.startswith(("application/", "image/")):
        return [body]
    raise ValueError(f"unsupported content type {content_type}")


def json_objects(text: str) -> list[str]:
    """Top-level JSON objects of a text in which they may lie in arrays, over lines, or be cut off at the end."""
    out, depth, begin, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            begin, depth = (i if not depth else begin), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[begin : i + 1])
    return out


def text_image(width: int, height: int, dense: bool = False, font: int = 24) -> np.ndarray:
    """A white page with dark blocks for words, lines 1.2 fonts apart; for fixtures."""
    page = np.full((height, width, 3), 255, np.uint8)
    for i, y in enumerate(range(font // 2, height - font, round(font * 1.2))):
        if dense or i % 3 == 0:
            for x in range(font // 2, width - 3 * font, 4 * font):
                page[y : y + font * 3 // 4, x : x + 3 * font] = 0
    return page


def random_tensor(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Rows with an array of n floats that depend on the seed and the row."""
    return rows.withColumn("data", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), i), F.lit(1 << 24)) / (1 << 24)).cast("float")))


def epoch_us(ts: Column) -> Column:
    """Microseconds of a time stamp that has no zone or UTC."""
    return F.unix_micros(ts.cast("timestamp"))
