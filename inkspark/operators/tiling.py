"""Tile plans for images, tile merging and tensor arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per channel, what is subtracted and divided by before detection and before recognition.
DETECT_MEANS, DETECT_STDS = (123.675, 116.28, 103.53), (58.395, 57.12, 57.375)
READ_MEANS, READ_STDS = (127.5, 127.5, 127.5), (127.5, 127.5, 127.5)
TILE, OVERLAP_SHARE = 640, 0.05


def tile_count(side: Column, tile: int = TILE) -> Column:
    """Tiles along a side; 0 for sides within the overlap, which the caller reports as an error."""
    overlap = round(OVERLAP_SHARE * tile)
    return F.greatest(F.lit(0), F.ceil((side - overlap) / (tile - overlap))).cast("int")


def plan_tiles(images: DataFrame, tile: int = TILE) -> DataFrame:
    """One row (tile_row, tile_col, x, y, w, h) for each tile of images (width, height), row by row."""
    stride = tile - round(OVERLAP_SHARE * tile)
    across, down = tile_count(F.col("width"), tile), tile_count(F.col("height"), tile)

    def numbers(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))

    rows = images.withColumn("tile_row", F.explode(numbers(down))).withColumn("tile_col", F.explode(numbers(across)))
    return rows.select("*", (F.col("tile_col") * stride).alias("x"), (F.col("tile_row") * stride).alias("y"), F.lit(tile).alias("w"), F.lit(tile).alias("h"))


def tiled_extent(tiles: DataFrame, *keys: str) -> DataFrame:
    return tiles.groupBy(*keys).agg(F.max(F.col("x") + F.col("w")).alias("tiled_width"), F.max(F.col("y") + F.col("h")).alias("tiled_height"))


def undo_scale(width: Column, height: Column, tiled_width: Column, tiled_height: Column) -> Column:
    return F.least(tiled_width / width, tiled_height / height)


def merge_tiles(pixels: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """Composite of overlapping tiles: the largest value of each pixel, 0 at least."""
    return pixels.groupBy(*keys).agg(F.greatest(F.max(value), F.lit(0.0)).alias(value))


def normalized(value: Column, channel: Column, means=DETECT_MEANS, stds=DETECT_STDS) -> Column:
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), channel.cast("int") + 1)
    return (value - pick(means)) / pick(stds)


def chw_index(channel: Column, y: Column, x: Column, height: Column, width: Column) -> Column:
    return (channel * height + y) * width + x


def output_shape(model: Column, shape: Column, classes: int = 6625) -> Column:
    """Shape that a model's output has for an input shape [n, c, h, w]."""
    n, h, w = shape[0], shape[2], shape[3]
    return F.when(model == "dbnet", F.array(n, h, w)).when(model == "svtr", F.array(n, (w / 8).cast("int"), F.lit(classes)))


def data_uri(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), r"\r\n", ""))
