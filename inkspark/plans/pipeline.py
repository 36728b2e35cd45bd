"""Text detection and recognition of images end to end, with inference as a plug-in.

A kernel is any callable (data float32 array, shape) -> (data, shape), made once in each Python worker by a factory. The
images' order is the column seq; an image that fails has an error and no results and never stops another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from threading import Semaphore
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators.geometry import BOX, bounding_box
from inkspark.operators.relief import trace_all
from inkspark.operators.tiling import DETECT_MEANS, DETECT_STDS, OVERLAP_SHARE, READ_MEANS, READ_STDS, TILE
from inkspark.sources.readers import pictures
from inkspark.sources.sinks import page_of, wire

Kernel = Callable[[np.ndarray, tuple[int, ...]], tuple[np.ndarray, tuple[int, ...]]]
READ_WIDTH, READ_HEIGHT = 160, 48


@dataclass(frozen=True)
class Settings:
    """Options of a kernel; only the two published model and number-format pairs are served."""

    model: str
    quantization: str
    intra_threads: int = 1
    inter_threads: int = 1

    def __post_init__(self) -> None:
        if (self.model, self.quantization) not in {("dbnet", "int8"), ("svtr", "fp32")}:
            raise ValueError(f"{self.model} with {self.quantization} isn't supported")
        if min(self.intra_threads, self.inter_threads) < 1:
            raise ValueError("threads must be 1 or more")


def pool_size(detector_capacity: int = 8, reader_capacity: int = 8) -> int:
    """Images in flight at once."""
    return math.ceil(1.5 * (detector_capacity + reader_capacity))


def dark_kernel(data: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, tuple[int, ...]]:
    """Stands in for a detector: the probability is how dark a pixel is."""
    n, _, h, w = shape
    means, stds = np.array(DETECT_MEANS)[:, None, None], np.array(DETECT_STDS)[:, None, None]
    grey = (data.reshape(3, h, w) * stds + means).mean(0) / 255
    return np.clip(1 - grey, 0, 1).astype(np.float32), (n, h, w)


def blank_kernel(data: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, tuple[int, ...]]:
    """Stands in for a reader: reads class 1 once, with the crop's mean brightness as probability."""
    steps = shape[3] // 8
    out = np.zeros((steps, 2), np.float32)
    out[:, 0] = 1
    out[0] = (0, float(np.clip((data.mean() + 1) / 2, 0.01, 1)))
    return out, (shape[0], steps, 2)


def onnx_kernel(path: str, threads: int = 1) -> Kernel:
    """A model file that the user supplies, by onnxruntime."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    session = onnxruntime.InferenceSession(path, options)

    def run(data: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, tuple[int, ...]]:
        (out,) = session.run(["output"], {"input": data.reshape(shape).astype(np.float32)})
        return out, out.shape

    return run


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic resampling, one axis after the other; edges repeat."""
    for axis, size in ((0, height), (1, width)):
        old = image.shape[axis]
        spread = max(1.0, old / size)
        centre = (np.arange(size) + 0.5) * old / size - 0.5
        taps = np.arange(math.floor(-2 * spread), math.ceil(2 * spread) + 1)
        at = np.floor(centre)[:, None] + taps
        weight = _cubic((at - centre[:, None]) / spread)
        weight /= weight.sum(1, keepdims=True)
        table = np.zeros((size, old))
        np.add.at(table, (np.arange(size)[:, None], np.clip(at, 0, old - 1).astype(int)), weight)
        image = np.moveaxis(np.tensordot(table, np.moveaxis(image, axis, 0), 1), 0, axis)
    return image


def fitted(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at its own proportions in the top left of a black one."""
    by = min(width / image.shape[1], height / image.shape[0])
    w, h = max(1, round(image.shape[1] * by)), max(1, round(image.shape[0] * by))
    out = np.zeros((height, width, 3))
    out[:h, :w] = np.clip(np.rint(resized(image.astype(float), w, h)), 0, 255)
    return out


def tensor(image: np.ndarray, means, stds) -> np.ndarray:
    return ((image - np.array(means)) / np.array(stds)).transpose(2, 0, 1).astype(np.float32)


def crop(image: np.ndarray, rect: dict[str, float]) -> np.ndarray:
    """A rotated rectangle's content, bilinear between pixels, the border repeated."""
    w, h = max(1, math.ceil(rect["width"])), max(1, math.ceil(rect["height"]))
    u = np.arange(w) / (w - 1) if w > 1 else np.zeros(1)
    v = np.arange(h) / (h - 1) if h > 1 else np.zeros(1)
    c, s = math.cos(rect["angle"]), math.sin(rect["angle"])
    x = np.clip(rect["x"] + u[None, :] * rect["width"] * c - v[:, None] * rect["height"] * s, 0, image.shape[1] - 1)
    y = np.clip(rect["y"] + u[None, :] * rect["width"] * s + v[:, None] * rect["height"] * c, 0, image.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    image = image.astype(float)
    return np.rint((image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy).astype(np.uint8)


def detector_map(image: np.ndarray, kernel: Kernel, tile: int = TILE) -> tuple[np.ndarray, int, int]:
    """The largest probability of all tiles over each pixel of the page that the image is fitted to, and the page's size."""
    overlap = round(OVERLAP_SHARE * tile)
    stride = tile - overlap
    across, down = (math.ceil((side - overlap) / stride) for side in (image.shape[1], image.shape[0]))
    if across < 1 or down < 1:
        raise ValueError(f"an image side is {overlap} pixels or less")
    wide, high = (across - 1) * stride + tile, (down - 1) * stride + tile
    page = fitted(image, wide, high)
    merged = np.zeros((high, wide), np.float32)
    for y in range(0, down * stride, stride):
        for x in range(0, across * stride, stride):
            out, _ = kernel(tensor(page[y : y + tile, x : x + tile], DETECT_MEANS, DETECT_STDS), (1, 3, tile, tile))
            part = merged[y : y + tile, x : x + tile]
            np.maximum(part, np.asarray(out, np.float32).reshape(tile, tile), out=part)
    return merged, wide, high


def detect(image: np.ndarray, kernel: Kernel, tile: int = TILE) -> list[dict]:
    """Boxes of all texts of an RGB image."""
    merged, wide, high = detector_map(image, kernel, tile)
    by = min(wide / image.shape[1], high / image.shape[0])
    boxes = (bounding_box(np.array(b, float), by, image.shape[1], image.shape[0]) for b in trace_all(merged))
    return [b for b in boxes if b is not None]


def read_text(image: np.ndarray, rect: dict[str, float], kernel: Kernel, chars: list[str]) -> tuple[str, float]:
    out, shape = kernel(tensor(fitted(crop(image, rect), READ_WIDTH, READ_HEIGHT), READ_MEANS, READ_STDS), (1, 3, READ_HEIGHT, READ_WIDTH))
    steps = np.asarray(out).reshape(-1, shape[-1])
    best, top = steps.argmax(1), steps.max(1)
    cuts = np.flatnonzero(np.diff(best, prepend=-1))
    runs = [(int(best[i]), float(top[i:j].max())) for i, j in zip(cuts, [*cuts[1:], len(best)], strict=True)]
    own = [i for i, (c, _) in enumerate(runs) if c]
    counted = [runs[i][1] for i in own if i == own[-1] or runs[i + 1][0]]
    text = "".join(chars[runs[i][0]] if runs[i][0] < len(chars) else "?" for i in own)
    return text.strip(), math.exp(sum(map(math.log, counted)) / len(counted)) if counted else 0.0


RESULT = f"seq long, width int, height int, results array<struct<boundingBox:{BOX},text:string,confidence:double>>, error string"


def run(images: DataFrame, detector: Callable[[], Kernel] = lambda: dark_kernel, reader: Callable[[], Kernel] = lambda: blank_kernel, chars: list[str] | None = None) -> DataFrame:
    """seq, results and error of images (seq, width, height, data: row-major RGB bytes), one Arrow batch of images at a time."""
    chars = chars or ["\0", "a", " "]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, read = detector(), reader()
        for pdf in batches:
            rows = []
            for seq, w, h, data in zip(pdf["seq"], pdf["width"], pdf["height"], pdf["data"], strict=True):
                try:
                    if data is None:
                        raise ValueError("no image")
                    image = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)
                    found = [(b, *read_text(image, b["rotatedRectangle"], read, chars)) for b in detect(image, find)]
                    rows.append((seq, w, h, [{"boundingBox": b, "text": t, "confidence": c} for b, t, c in found], None))
                except Exception as e:  # noqa: BLE001  an image's failure is its result
                    rows.append((seq, w, h, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["seq", "width", "height", "results", "error"])

    return images.select("seq", "width", "height", "data").mapInPandas(work, RESULT)


def probabilities(image: np.ndarray, kernel: Kernel, tile: int = TILE) -> np.ndarray:
    """The detector's map in the image's size, as bytes: cut to bytes first, resampled then."""
    merged, wide, high = detector_map(image, kernel, tile)
    by = min(wide / image.shape[1], high / image.shape[0])
    own = np.floor(np.clip(merged[: round(image.shape[0] * by), : round(image.shape[1] * by)], 0, 1) * 255)
    return np.clip(np.rint(resized(own, image.shape[1], image.shape[0])), 0, 255).astype(np.uint8)


def json_lines(read: DataFrame, names: DataFrame) -> DataFrame:
    """(seq, line, error) of what `run` gives, with the file names of names (seq, path); order by seq to print them."""
    rows = read.join(names.select("seq", "path"), "seq")
    box = lambda b: F.struct(F.struct(b["polygon"].alias("points")).alias("polygon"), b["rotatedRectangle"].alias("rotatedRectangle"), b["rectangle"].alias("rectangle"))
    results = F.transform("results", lambda r: F.struct(box(r["boundingBox"]).alias("boundingBox"), r["text"].alias("text"), r["confidence"].alias("confidence")))
    return rows.select("seq", F.when(F.col("error").isNull(), wire(F.col("path"), results)).alias("line"), "error")


def read_files(spark: SparkSession, paths: list[str], **kernels) -> DataFrame:
    """(seq, line, error): the JSON line of each image file, in the order of seq, or why it has none."""
    found = pictures(spark, paths)
    return json_lines(run(found, **kernels), found)


def draw_files(found: DataFrame, read: DataFrame, detector: Callable[[], Kernel] = lambda: dark_kernel) -> DataFrame:
    """(seq, path, svg): the page `<name>_viz.svg` beside each of `pictures`' files that `run` has read."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = detector()
        for pdf in batches:
            rows = []
            for seq, path, w, h, data, results in zip(*(pdf[c] for c in ("seq", "path", "width", "height", "data", "results")), strict=True):
                image = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)
                rows.append((seq, path.rpartition(".")[0] + "_viz.svg", page_of(image, list(results), probabilities(image, find)).render()))
            yield pd.DataFrame(rows, columns=["seq", "path", "svg"])

    return found.join(read.where("error is null").select("seq", "results"), "seq").mapInPandas(work, "seq long, path string, svg string")


def text_buffer(text: str) -> tuple[bytes, int]:
    """A result's UTF-8 bytes with a zero byte after them, and their number without it."""
    raw = text.encode()
    return raw + b"\0", len(raw)


class Reader:
    """Handles for single images: submit, wait with a time limit, cancel. Admission is bounded, first come first served."""

    def __init__(self, work: Callable[[bytes], str], size: int | None = None):
        self.work, self.free = work, Semaphore(size or pool_size())
        self.pool = ThreadPoolExecutor(size or pool_size())
        self.handles: dict[str, Future] = {}

    def submit(self, content: bytes) -> str:
        self.free.acquire()
        handle, future = str(uuid.uuid4()), self.pool.submit(self.work, content)
        future.add_done_callback(lambda _: self.free.release())
        self.handles[handle] = future
        return handle

    def wait(self, handle: str, seconds: float | None = None) -> tuple[int, str]:
        """(0, result), (1, error) or (2, "") if time ran out; only then the handle stays."""
        future = self.handles.get(handle)
        if future is None:
            return 1, "unknown handle"
        if not wait([future], seconds).done:
            return 2, ""
        self.handles.pop(handle, None)
        if future.cancelled():
            return 1, "cancelled"
        error = future.exception()
        return (0, future.result()) if error is None else (1, str(error) or type(error).__name__)

    def cancel(self, handle: str) -> None:
        """Forget the handle; its work goes on."""
        self.handles.pop(handle, None)

    def close(self) -> None:
        self.handles.clear()
        self.pool.shutdown(wait=False, cancel_futures=True)
