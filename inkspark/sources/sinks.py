"""Writers: JSON lines and arrays, timer records, CSV spans, submission archives, SVG pages."""

from __future__ import annotations

import base64
import html
import json
import math
import os
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def wire(filename: Column, results: Column) -> Column:
    """The compact JSON of a result; null fields stay."""
    return F.to_json(F.struct(filename.alias("filename"), results.alias("results")), _KEEP_NULLS)


def zipped(boxes: Column, texts: Column) -> Column:
    """Detections joined to recognitions by position."""
    return F.transform(F.arrays_zip(boxes.alias("b"), texts.alias("t")), lambda z: F.struct(z["b"].alias("boundingBox"), z["t"]["text"].alias("text"), z["t"]["confidence"].alias("confidence")))


def json_array(rows: DataFrame, text: str, order: str, *keys: str) -> DataFrame:
    """One JSON array of each request's result texts, in order. A request is one group, as its answer is one text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text])
    return rows.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("body"))


def timer_record(start: Column, end: Column, tags: Column) -> Column:
    return F.to_json(F.struct(start.alias("start"), end.alias("end"), tags.alias("tags")), _KEEP_NULLS)


def write_spans(rows: DataFrame, path: str) -> None:
    """CSV start,end with ISO times."""
    rows.select("start", "end").write.option("header", "true").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").csv(path)


def write_zip(entries: DataFrame, path: str, name: str = "name", content: str = "content") -> int:
    """A zip of (name, content) rows, streamed through the driver one at a time; written aside and renamed."""
    n = 0
    with zipfile.ZipFile(path + ".part", "w", zipfile.ZIP_DEFLATED) as z:
        for row in entries.select(name, content).orderBy(name).toLocalIterator():
            z.writestr(row[0], row[1])
            n += 1
    os.replace(path + ".part", path)
    return n


def write_results(method: dict, per_sample: DataFrame, path: str) -> None:
    """method.json and a JSON file for each sample."""
    files = per_sample.select(F.concat(F.col("image").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct("*")).alias("content"))
    write_zip(files, path)
    with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("method.json", json.dumps(method))


def evaluated(evaluate, *args) -> dict:
    """The evaluation's answer, or what went wrong."""
    try:
        return {"calculated": True, "Message": "", **evaluate(*args)}
    except Exception as e:  # noqa: BLE001  the answer carries the error
        return {"calculated": False, "Message": str(e)}


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of rows of RGB or RGBA bytes."""
    height, width, channels = pixels.shape

    def chunk(kind: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))

    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], 1)  # no filter
    head = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def data_uri(pixels: np.ndarray) -> str:
    return "data:image/png;base64," + base64.b64encode(png(pixels)).decode()


def overlay(intensity: np.ndarray) -> np.ndarray:
    """Yellow, half as opaque as the intensity (bytes) says."""
    out = np.full((*intensity.shape, 4), 255, np.uint8)
    out[..., 2] = 0
    out[..., 3] = intensity // 2
    return out


LAYERS = ("image", "probabilityMap", "polygons", "rotatedRectangles", "rectangles", "expected", "text")


class Page:
    """An SVG page of layers, each of which can be added once; text items can repeat."""

    def __init__(self, width: int, height: int):
        self.width, self.height, self.layers, self.texts = width, height, {}, []

    def add(self, layer: str, markup: str) -> Page:
        if layer not in LAYERS:
            raise KeyError(layer)
        if layer in self.layers:
            raise ValueError(f"{layer} was added before")
        self.layers[layer] = markup
        return self

    def polygons(self, layer: str, rings: list[list[tuple[float, float]]], color: str) -> Page:
        shapes = "".join(f'<polygon points="{" ".join(f"{x:g},{y:g}" for x, y in ring)}" fill="none" stroke="{color}"/>' for ring in rings)
        return self.add(layer, shapes)

    def text(self, cx: float, cy: float, angle: float, size: float, value: str) -> Page:
        self.texts.append(f'<text x="{cx:g}" y="{cy:g}" font-size="{size:g}" text-anchor="middle" transform="rotate({angle:g} {cx:g} {cy:g})">{html.escape(value)}</text>')
        return self

    def render(self) -> str:
        state = json.dumps({name: name in self.layers or name == "text" and bool(self.texts) for name in LAYERS})
        groups = "".join(f'<g id="{n}">{m}</g>' for n, m in self.layers.items()) + f'<g id="text">{"".join(self.texts)}</g>'
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.width}" height="{self.height}"><desc>{html.escape(state)}</desc>{groups}</svg>'

    def picture(self, layer: str, pixels: np.ndarray) -> Page:
        return self.add(layer, f'<image width="{self.width}" height="{self.height}" href="{data_uri(pixels)}"/>')


def page_of(pixels: np.ndarray, results: list[dict], probabilities: np.ndarray | None = None) -> Page:
    """The page of an image (RGB bytes) with its results' boxes and texts, and a map of probabilities (bytes) over it."""
    page = Page(pixels.shape[1], pixels.shape[0]).picture("image", pixels)
    if probabilities is not None:
        page.picture("probabilityMap", overlay(probabilities))
    boxes = [r["boundingBox"] for r in results]
    page.polygons("polygons", [[(p["x"], p["y"]) for p in b["polygon"]] for b in boxes], "blue")
    turned = [_corners(b["rotatedRectangle"]) for b in boxes]
    page.polygons("rotatedRectangles", turned, "red").polygons("rectangles", [_corners({**b["rectangle"], "angle": 0.0}) for b in boxes], "green")
    for r, ring in zip(results, turned, strict=True):
        (ax, ay), (bx, by), _, (dx, dy) = ring
        cx, cy = (sum(v) / 4 for v in zip(*ring, strict=True))
        page.text(cx, cy, math.degrees(math.atan2(by - ay, bx - ax)), math.hypot(dx - ax, dy - ay), r["text"])
    return page


def _corners(r: dict) -> list[tuple[float, float]]:
    c, s = math.cos(r["angle"]), math.sin(r["angle"])
    return [(r["x"] + a * r["width"] * c - b * r["height"] * s, r["y"] + a * r["width"] * s + b * r["height"] * c) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
