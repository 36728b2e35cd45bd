"""Probability maps: thresholding, 3 x 3 morphology, flood fill and boundary tracing.

Two forms with the same results. The pixel form (rows map_id, x, y, v) is all window functions, one shuffle by
map and line each way. The array form (data, width, height) keeps a map in its row and works on it with numpy, an
Arrow batch of maps at a time; it has no shuffle and is the one for large maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.2
#: Directions by which a boundary is walked: north, then clockwise.
_AROUND = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def binarize(value: Column, threshold: float = THRESHOLD) -> Column:
    """1 from the threshold on, compared as 32-bit floats."""
    return F.when(value.cast("float") >= F.lit(threshold).cast("float"), 1).otherwise(0)


def _separable(pixels: DataFrame, pick, value: str, *keys: str) -> DataFrame:
    across = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-1, 1)
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-1, 1)
    n_across, n_down = F.count(F.lit(1)).over(across), F.count(F.lit(1)).over(down)
    rows = pixels.withColumn("_v", pick(value).over(across)).withColumn("_nx", n_across)
    return rows.withColumn("_v", pick("_v").over(down)).withColumn("_nx", F.min("_nx").over(down)).withColumn("_ny", n_down)


def erode(pixels: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """Smallest of the 3 x 3 surroundings; pixels at the border become 0, as what lies outside counts as 0."""
    rows = _separable(pixels, F.min, value, *keys)
    return rows.withColumn(value, F.when((F.col("_nx") < 3) | (F.col("_ny") < 3), F.lit(0).cast("int")).otherwise(F.col("_v"))).drop("_v", "_nx", "_ny")


def dilate(pixels: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """Largest of the 3 x 3 surroundings within the map."""
    return _separable(pixels, F.max, value, *keys).withColumn(value, F.col("_v")).drop("_v", "_nx", "_ny")


def opening(pixels: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    return dilate(erode(pixels, *keys, value=value), *keys, value=value)


def boundary_pixels(pixels: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """Foreground pixels at the border or beside a background pixel."""
    rows = _separable(pixels, F.min, value, *keys)
    edge = (F.col("_nx") < 3) | (F.col("_ny") < 3) | (F.col("_v") == 0)
    return rows.withColumn("on_boundary", (F.col(value) == 1) & edge).drop("_v", "_nx", "_ny")


def neighbors(pixels: DataFrame, *keys: str) -> DataFrame:
    """The up to eight in-bounds neighbours (nx, ny) of every pixel of maps with width and height."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _AROUND])
    rows = pixels.select(*keys, "x", "y", "width", "height", F.explode(offsets).alias("o"))
    rows = rows.select(*keys, "x", "y", "width", "height", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    return rows.where("nx >= 0 and ny >= 0 and nx < width and ny < height").drop("width", "height")


def _shift_stack(a: np.ndarray, fill: float) -> np.ndarray:
    padded = np.pad(a, 1, constant_values=fill)
    h, w = a.shape
    return np.stack([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])


def open_map(a: np.ndarray) -> np.ndarray:
    """Opening of one 0/1 map."""
    return _shift_stack(_shift_stack(a, 0).min(0), 0).max(0)


def flood(a: np.ndarray, x: int, y: int, mark: float = -1) -> None:
    """Mark the 4-connected foreground around a pixel, in place; nothing if it isn't foreground."""
    if a[y, x] <= 0:
        return
    front = [(x, y)]
    a[y, x] = mark
    while front:
        x, y = front.pop()
        for nx, ny in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if 0 <= ny < a.shape[0] and 0 <= nx < a.shape[1] and a[ny, nx] > 0:
                a[ny, nx] = mark
                front.append((nx, ny))


def trace(a: np.ndarray, x: int, y: int) -> list[tuple[int, int]]:
    """Walk the boundary of the foreground from a pixel, ending when the walk is back beside its beginning."""
    ground = np.pad(a, 2, constant_values=0)

    def edge(px: int, py: int) -> bool:
        return ground[py, px] == 1 and bool((ground[py - 1 : py + 2, px - 1 : px + 2] <= 0).any())

    at = np.array([x + 2, y + 2])
    heading = next((i for i, d in enumerate(_AROUND) if ground[at[1] + d[1], at[0] + d[0]] <= 0), None)
    if heading is None:
        return [(x, y)]
    path: list[tuple[int, int]] = []
    while True:
        path.append((int(at[0]) - 2, int(at[1]) - 2))
        turn = next((t % 8 for t in range(heading + 6, heading + 14) if edge(at[0] + _AROUND[t % 8][0], at[1] + _AROUND[t % 8][1])), None)
        if turn is None:
            return path
        heading = turn
        at = at + _AROUND[turn]
        if len(path) > 2 and max(abs(at[0] - 2 - x), abs(at[1] - 2 - y)) <= 1:
            return path


def shapes(a: np.ndarray) -> np.ndarray:
    """For each foreground pixel the number of the first pixel of its 4-connected shape, -1 for the background.

    Works on runs of pixels: those of neighbouring rows that overlap belong together.
    """
    change = np.diff(np.pad(a > 0, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(change == 1)
    stops = np.nonzero(change == -1)[1]
    top = list(range(len(rows)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    begin = np.searchsorted(rows, np.arange(a.shape[0] + 1)).tolist()
    for y in range(1, a.shape[0]):
        i, j = begin[y - 1], begin[y]
        while i < begin[y] and j < begin[y + 1]:
            if starts[i] < stops[j] and starts[j] < stops[i]:
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
            i, j = (i + 1, j) if stops[i] < stops[j] else (i, j + 1)
    label = np.full(a.shape, -1)
    for i, (y, x0, x1) in enumerate(zip(rows.tolist(), starts.tolist(), stops.tolist(), strict=True)):
        first = find(i)
        label[y, x0:x1] = rows[first] * a.shape[1] + starts[first]
    return label


def trace_all(a: np.ndarray, threshold: float | None = THRESHOLD) -> list[list[tuple[int, int]]]:
    """Boundaries of all shapes of a probability map after thresholding and opening, in scan order."""
    work = a if threshold is None else open_map((a.astype(np.float32) >= np.float32(threshold)).astype(np.int8))
    work = work.astype(np.int8).copy()
    label = shapes(work)
    found = []
    for first in np.unique(label[label >= 0]).tolist():
        found.append(trace(work, first % work.shape[1], first // work.shape[1]))
        work[label == first] = -1
    return found


def trace_boundaries(maps: DataFrame, key: str = "map_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row (key, poly_idx, points) for each shape of maps (key, data, width, height)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data, w, h in zip(pdf[key], pdf["data"], pdf["width"], pdf["height"], strict=True):
                for i, points in enumerate(trace_all(np.asarray(data, np.float32).reshape(h, w), threshold)):
                    out.append((k, i, [{"x": x, "y": y} for x, y in points]))
            yield pd.DataFrame(out, columns=[key, "poly_idx", "points"])

    kind = maps.schema[key].dataType.simpleString()
    return maps.select(key, "data", "width", "height").mapInPandas(run, f"{key} {kind}, poly_idx int, points array<struct<x:int,y:int>>")


def components(pixels: DataFrame, key: str = "map_id") -> DataFrame:
    """The smallest pixel number (y * width + x) of each foreground pixel's 4-connected shape, over maps held by row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1
        a = np.zeros((h, w), np.int32)
        a[pdf["y"], pdf["x"]] = pdf["v"]
        label = shapes(a)
        pdf = pdf[pdf["v"] > 0]
        return pd.DataFrame({key: pdf[key], "x": pdf["x"], "y": pdf["y"], "shape": label[pdf["y"], pdf["x"]]})

    kind = pixels.schema[key].dataType.simpleString()
    return pixels.groupBy(key).applyInPandas(run, f"{key} {kind}, x int, y int, shape int")
