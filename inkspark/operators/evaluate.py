"""Evaluation of text detections against ground truth: matching within images, precision, recall, H-mean, AP."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkspark.operators.geometry import area, bounds, clip_areas, clockwise, convex, intersection_udf

#: Defaults of the evaluation.
PARAMETERS = {"IOU_CONSTRAINT": 0.5, "AREA_PRECISION_CONSTRAINT": 0.5, "CONFIDENCES": False, "PER_SAMPLE_RESULTS": True, "CRLF": False, "LTRB": False}
DONT_CARE = "###"
#: Groups of boxes are dealt to no more tasks than this.
MOST_TASKS = 4096


def half_up(value: Column, digits: int) -> Column:
    """A value that isn't negative, rounded as SQL does it: as a double times a power of ten, not by its decimal digits."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


def _spread(rows: DataFrame, name: str, image: str, cell: float) -> DataFrame:
    """Boxes with their bounds, once for each cell of a grid that these meet."""
    rows = rows.select(image, F.col("id").alias(f"{name}_id"), F.col("points").alias(f"{name}_points"), bounds(F.col("points")).alias(name))
    first = lambda axis: F.floor(F.col(f"{name}.{axis}") / cell)
    last = lambda axis, size: F.floor((F.col(f"{name}.{axis}") + F.col(f"{name}.{size}")) / cell)
    rows = rows.withColumn("column", F.explode(F.sequence(first("x"), last("x", "width"))))
    return rows.withColumn("line", F.explode(F.sequence(first("y"), last("y", "height"))))


def box_pairs(gt: DataFrame, det: DataFrame, image: str = "image", cell: float = 512.0) -> DataFrame:
    """Pairs (image, gt_id, det_id, gt_points, det_points) of an image's boxes whose bounds overlap.

    Boxes are joined on the cells of a grid that their bounds meet; a pair counts in the first cell that both meet.
    """

    g, d = F.col("gt"), F.col("det")
    over = lambda axis, size: (g[axis] <= d[axis] + d[size]) & (d[axis] <= g[axis] + g[size])
    pairs = _spread(gt, "gt", image, cell).join(_spread(det, "det", image, cell), [image, "column", "line"]).where(over("x", "width") & over("y", "height"))
    here = (F.col("column") == F.floor(F.greatest(g["x"], d["x"]) / cell)) & (F.col("line") == F.floor(F.greatest(g["y"], d["y"]) / cell))
    return pairs.where(here).select(image, "gt_id", "det_id", "gt_points", "det_points")


def _pairs_above(image: str, least: float, cell: float, schema: pa.Schema):
    """Overlaps above `least` of the boxes of two tables with the same image, cell and part."""

    def rings(rows: pa.Table, name: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        flat = rows[f"{name}_flat"].combine_chunks()
        ends = flat.offsets.to_numpy() // 2
        points = flat.values.to_numpy(zero_copy_only=False)[2 * ends[0] : 2 * ends[-1]].reshape(-1, 2)
        ends = (ends - ends[0]).astype(np.int64)
        points, area = clockwise(points, ends)
        box = {c: rows[c].to_numpy() for c in ("x", "y", "width", "height")} | {"area": area, "convex": convex(points, ends)}
        return box | {"x2": box["x"] + box["width"], "y2": box["y"] + box["height"]}, points, ends

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        names = [image, "column", "line", "part"]
        keys = pa.concat_tables([left.select(names), right.select(names)]).combine_chunks()
        code = pc.dictionary_encode(keys[image]).combine_chunks()
        code = np.stack([code.indices.to_numpy(), *(keys[c].to_numpy() for c in names[1:])], 1)
        code = np.unique(code, axis=0, return_inverse=True)[1].reshape(-1)
        column, line = (left[c].to_numpy() for c in ("column", "line"))
        order = np.argsort(code[len(left) :], kind="stable")
        of_right = code[len(left) :][order]
        first = np.searchsorted(of_right, code[: len(left)])
        n = np.searchsorted(of_right, code[: len(left)], "right") - first
        (g, a, a_ends), (d, b, b_ends) = rings(left, "gt"), rings(right, "det")
        found = []
        for rows in np.split(np.arange(len(left)), np.flatnonzero(np.diff(np.cumsum(n) // (1 << 18))) + 1):
            own = n[rows]
            i = np.repeat(rows, own)
            j = order[np.arange(len(i)) + np.repeat(first[rows] - np.cumsum(own) + own, own)]
            left_at, right_at = np.maximum(g["x"][i], d["x"][j]), np.minimum(g["x2"][i], d["x2"][j])
            top, bottom = np.maximum(g["y"][i], d["y"][j]), np.minimum(g["y2"][i], d["y2"][j])
            # a pair counts in the first cell that both bounds meet
            stay = (left_at <= right_at) & (top <= bottom) & (column[i] == np.floor(left_at / cell)) & (line[i] == np.floor(top / cell))
            # convex rings share no more than their bounds do, nor than either has
            most = np.minimum((right_at - left_at) * (bottom - top), np.minimum(g["area"][i], d["area"][j])) * (1 + 1e-9)
            stay &= (most > least * (g["area"][i] + d["area"][j] - most)) | ~(g["convex"][i] & d["convex"][j])
            i, j = i[stay], j[stay]
            both = clip_areas(a, a_ends, b, b_ends, i, j)
            union = g["area"][i] + d["area"][j] - both
            iou = np.divide(both, union, out=np.zeros(len(i)), where=union > 0)
            stay = iou > least
            found.append((i[stay], j[stay], iou[stay]))
        i, j, iou = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.Table.from_arrays([left[image].take(i), left["gt_id"].take(i), right["det_id"].take(j), pa.array(iou)], schema=schema)

    return run


def overlapping(gt: DataFrame, det: DataFrame, image: str = "image", least: float = 0.5, cell: float = 512.0, part_boxes: int = 256) -> DataFrame:
    """Pairs (image, gt_id, det_id, iou) above `least`.

    A cell's ground truth is dealt into parts, so many that an image has about `part_boxes` in one, and each part meets all
    detections of the cell: a task gets boxes and makes their pairs itself, of which only those above `least` leave it.
    """

    def boxes(rows: DataFrame, name: str) -> DataFrame:
        flat = F.flatten(F.transform(f"{name}_points", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
        side = [F.col(f"{name}.{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")]
        return _spread(rows, name, image, cell).select(image, "column", "line", f"{name}_id", flat.alias(f"{name}_flat"), *side)

    held = gt.groupBy(image).agg(F.ceil(F.count(F.lit(1)) / part_boxes).cast("int").alias("parts"))
    g = boxes(gt, "gt").join(held, image).withColumn("part", F.pmod(F.xxhash64("gt_id"), F.col("parts")).cast("int")).drop("parts")
    d = boxes(det, "det").join(held, image).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    groups = max(1, math.ceil(gt.count() / part_boxes))  # many small images share a group
    group = F.pmod(F.xxhash64(image, "column", "line", "part"), F.lit(groups)).alias("group")
    # the boxes are few bytes with many pairs: Spark is not to join tasks by their size
    g, d = (rows.select(*[F.col(c).alias(c) for c in rows.columns], group).repartition(min(groups, MOST_TASKS), "group") for rows in (g, d))  # anew, as both may be one frame
    schema = T.StructType([gt.schema[image], T.StructField("gt_id", gt.schema["id"].dataType), T.StructField("det_id", det.schema["id"].dataType), T.StructField("iou", T.DoubleType())])
    run = _pairs_above(image, least, cell, to_arrow_schema(schema))
    return g.groupBy("group").cogroup(d.groupBy("group")).applyInArrow(run, schema)


def not_cared_for(gt: DataFrame, det: DataFrame, image: str = "image", least: float = PARAMETERS["AREA_PRECISION_CONSTRAINT"]) -> DataFrame:
    """(image, id) of detections of which more than the share `least` lies in one ground truth that isn't cared for."""
    pairs = box_pairs(gt.where(~F.col("care")), det, image)
    share = F.try_divide(intersection_udf("gt_points", "det_points"), area(F.col("det_points")))
    return pairs.where(share > least).select(image, F.col("det_id").alias("id")).distinct()


def match(gt: DataFrame, det: DataFrame, image: str = "image", least: float = PARAMETERS["IOU_CONSTRAINT"], best_first: bool = False) -> DataFrame:
    """One-to-one matches (image, gt_id, det_id, iou) of rows (image, id, points, care), greedy within an image.

    In ground-truth order each takes the first free detection above `least`; with best_first, the highest overlaps are taken
    first (to nine digits; equal ones by ids). An image's pairs above `least` pass one task in this order, of which it holds
    the ids that are taken; images are spread.
    """
    pairs = overlapping(gt.where("care"), det.where("care"), image, least)
    order = [half_up(F.col("iou"), 9).desc()] * best_first + ["gt_id", "det_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken_g, taken_d = None, set(), set()
        for batch in batches:
            rows = []
            for i, (of, g, d) in enumerate(zip(*(batch[c].to_pylist() for c in (image, "gt_id", "det_id")), strict=True)):
                if of != now:
                    now, taken_g, taken_d = of, set(), set()
                if g not in taken_g and d not in taken_d:
                    taken_g.add(g)
                    taken_d.add(d)
                    rows.append(i)
            yield batch.take(pa.array(rows, pa.int64()))

    return pairs.repartition(image).sortWithinPartitions(image, *order).mapInArrow(run, pairs.schema)


def evaluation(gt: DataFrame, det: DataFrame, image: str = "image", iou_above: float = PARAMETERS["IOU_CONSTRAINT"], area_above: float = PARAMETERS["AREA_PRECISION_CONSTRAINT"], best_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Results for each image of the ground truth and for all, of gt (image, id, points, care) and det (image, id, points, confidence).

    Detections within ground truth that isn't cared for are left out, the others matched. Images without detections count
    with none; detections of images without ground truth don't count. An image where nothing is cared for has its precision as ap.
    """
    images = gt.groupBy(image).agg(F.count_if("care").alias("care_gt"))
    det = det.join(images.select(image), image, "left_semi")
    det = det.join(not_cared_for(gt, det, image, area_above), [image, "id"], "left_anti").withColumn("care", F.lit(True))
    pairs = match(gt, det, image, iou_above, best_first).select(image, F.col("det_id").alias("id"), F.lit(True).alias("hit"))
    found = det.join(pairs, [image, "id"], "left").select(image, "id", "confidence", F.coalesce("hit", F.lit(False)).alias("hit"))
    found = found.withColumn("_rank_in", F.row_number().over(Window.partitionBy(image).orderBy(F.desc("confidence"), "id")))
    hits = F.count_if("hit").over(Window.partitionBy(image).orderBy(F.desc("confidence"), "id").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_at", F.when(F.col("hit"), hits / F.col("_rank_in")).otherwise(0.0))
    sums = found.groupBy(image).agg(F.count(F.lit(1)).alias("care_det"), F.count_if("hit").alias("matched"), F.sum("_at").alias("_ap"))
    counts = images.join(sums, image, "left").fillna(0, ["care_det", "matched", "_ap"])
    samples = per_sample(counts).withColumn("ap", F.when(F.col("care_gt") == 0, F.col("precision")).otherwise(F.col("_ap") / F.col("care_gt"))).drop("_ap")
    total = method_level(counts)
    ap = overall_precision(found, total.select("care_gt"), image)
    return samples, total.crossJoin(F.broadcast(ap))  # one row each


def overall_precision(found: DataFrame, care_gt: DataFrame, image: str = "image", parts: int = 4096) -> DataFrame:
    """`ap` of all detections (image, id, confidence from 0 to 1, hit) by falling confidence, ties by image and id.

    Detections are ranked within `parts` ranges of the confidence; only the ranges' counts are added up in one place.
    """
    rows = found.select(image, "id", "confidence", "hit", F.floor(F.col("confidence") * parts).alias("_part"))
    held = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.count_if("hit").alias("_h"))
    before = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_h"))
    own = Window.partitionBy("_part").orderBy(F.desc("confidence"), image, "id")
    hits = F.count_if("hit").over(own.rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.select("_part", "hit", F.row_number().over(own).alias("_rank"), hits.alias("_hits")).join(F.broadcast(held), "_part")
    summed = ranked.where("hit").agg(F.coalesce(F.sum((F.col("_hits") + F.col("_h")) / (F.col("_rank") + F.col("_n"))), F.lit(0.0)).alias("_s"))
    return summed.crossJoin(F.broadcast(care_gt)).select(F.when(F.col("care_gt") > 0, F.col("_s") / F.col("care_gt")).otherwise(F.lit(0.0)).alias("ap"))


def ratios(matched: Column, care_gt: Column, care_det: Column) -> dict[str, Column]:
    """Recall, precision and H-mean with the rules for nothing to find and nothing found."""
    recall = F.when(care_gt == 0, 1.0).otherwise(matched / care_gt)
    precision = F.when(care_gt == 0, F.when(care_det > 0, 0.0).otherwise(1.0)).otherwise(F.when(care_det == 0, 0.0).otherwise(matched / care_det))
    return {"recall": recall, "precision": precision, "hmean": F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))}


def per_sample(counts: DataFrame) -> DataFrame:
    """Rows (image, matched, care_gt, care_det) with their ratios."""
    return counts.withColumns(ratios(F.col("matched"), F.col("care_gt"), F.col("care_det")))


def method_level(counts: DataFrame) -> DataFrame:
    """The ratios over all images: 0 where nothing is to find, or nothing found."""
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched", "care_gt", "care_det")])
    part = lambda of: F.when(F.col(of) == 0, 0.0).otherwise(F.col("matched") / F.col(of))
    p, r = part("care_det"), part("care_gt")
    return total.select("matched", "care_gt", "care_det", p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("hmean"))


def average_precision(rows: DataFrame, confidence: str, matched: str, tie: str, care_gt: Column, *keys: str) -> DataFrame:
    """Mean over all ground truths of the precision at each match, by falling confidence (ties by `tie`)."""
    w = Window.partitionBy(*keys).orderBy(F.col(confidence).desc(), tie)
    hit = F.col(matched).cast("int")
    ranked = rows.withColumn("_rank", F.row_number().over(w)).withColumn("_correct", F.sum(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.groupBy(*keys).agg(F.sum(F.when(hit == 1, F.col("_correct") / F.col("_rank")).otherwise(0.0)).alias("_s"), care_gt.alias("care_gt")).select(*keys, F.when(F.col("care_gt") > 0, F.col("_s") / F.col("care_gt")).otherwise(F.col("_s")).alias("ap"))


#: The parts of a result line. A confidence may look like a number and be none, even hold the next comma.
_INT, _POSITIVE, _CONFIDENCE, _TEXT = r"\s*-?[0-9]+\s*", r"\s*[0-9]+\s*", r"\s*([0-1].?[0-9]*)\s*", r"(.*)"


def line_pattern(ltrb: bool, transcription: bool, confidence: bool) -> str:
    """What a line looks like: four numbers, the last two without a sign, or eight; then the confidence and the text."""
    parts = [_INT, _INT, _POSITIVE, _POSITIVE] if ltrb else [_INT] * 8
    parts += [_CONFIDENCE] * confidence + [_TEXT] * transcription
    end = r",?\s*" if ltrb and len(parts) == 4 else ""
    return "(?dU)^" + ",".join(parts) + end + "$"


def _clockwise_error(x: list[Column]) -> Column:
    n = len(x)
    turn = sum(((x[(i + 2) % n] - x[i]) * (x[(i + 3) % n] + x[i + 1]) for i in range(0, n, 2)), F.lit(0.0))
    return F.when(turn > 0, "Points are not clockwise")


def parse_lines(rows: DataFrame, line: str = "line", ltrb: bool = False, transcription: bool = True, confidence: bool = False, width: int = 0, height: int = 0) -> DataFrame:
    """points, confidence, transcription and error of each line; a bad line has an error and no values.

    With width and height, points outside of the image are an error too.
    """
    n = 4 if ltrb else 8
    col = F.col(line)
    fits = col.rlike(line_pattern(ltrb, transcription, confidence))
    rows = rows.withColumn("_parts", F.when(fits, F.split(col, ",", n + 1)))
    group = lambda i: F.regexp_extract(col, line_pattern(ltrb, transcription, confidence), i)
    x = [F.regexp_extract(F.get("_parts", F.lit(i)), "-?[0-9]+", 0).try_cast("double") for i in range(n)]
    rows = rows.withColumn("points", F.when(F.col("_parts").isNotNull(), F.array(*x)))
    x = [F.get("points", F.lit(i)) for i in range(n)]
    if ltrb:
        wrong = F.when(x[2] < x[0], "Xmax lower than Xmin").when(x[3] < x[1], "Ymax lower than Ymin")
    else:
        wrong = _clockwise_error(x)
    if width > 0 and height > 0:
        inside = [v.between(0, top) for v, top in zip(x, [width, height] * (n // 2), strict=True)]
        wrong = F.coalesce(wrong, F.when(~reduce(lambda a, b: a & b, inside), "Point outside of the image"))
    number = F.regexp_replace(group(1), r"(?U)^\s+|\s+$", "") if confidence else F.lit("")
    number = F.when(number.rlike(r"^[01](?:_?[0-9]+|\.[0-9]*|[eE][0-9]+)?$"), F.replace(number, F.lit("_"), F.lit("")).try_cast("double"))
    if confidence:
        wrong = F.coalesce(wrong, F.when(number.isNull(), "Confidence is no number"))
    text = group(1 + confidence) if transcription else F.lit("")
    quoted = r'(?dU)^\s*"(.*)"\s*$'
    bare = F.replace(F.replace(F.regexp_extract(text, quoted, 1), F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit('"'))
    out = rows.withColumn("error", F.when(F.col("_parts").isNull(), "Format incorrect").otherwise(wrong))
    good = F.col("error").isNull()
    return out.withColumns({
        "points": F.when(good, F.col("points")),
        "confidence": F.when(good, number) if confidence else F.lit(None).cast("double"),
        "transcription": F.when(good, F.when(text.rlike(quoted), bare).otherwise(text)) if transcription else F.lit(None).cast("string"),
    }).drop("_parts")


def file_lines(files: DataFrame, name: str = "name", content: str = "content", crlf: bool = False) -> DataFrame:
    """(name, line_no, line) of files' lines that aren't empty; bytes that are no UTF-8 are replaced, a mark at the beginning goes."""
    text = F.regexp_replace(F.make_valid_utf8(F.col(content).cast("string")), "^\ufeff", "")
    lines = files.select(name, F.posexplode(F.split(text, "\r\n" if crlf else "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.regexp_replace("line", "[\r\n]", "")).where("line <> ''")


def invalid_lines(files: DataFrame, name: str = "name", content: str = "content", crlf: bool = False, **form) -> DataFrame:
    """(name, line_no, message) of the lines of files that aren't valid in the form that `parse_lines` takes."""
    rows = parse_lines(file_lines(files, name, content, crlf), **form).where("error is not null")
    message = F.format_string("Line in sample not valid. Sample: %s Line: %s Error: %s", F.col(name), F.col("line"), F.col("error"))
    return rows.select(name, "line_no", message.alias("message"))


def by_confidence(rows: DataFrame, *keys: str, order: str = "line_no") -> DataFrame:
    """Rows with `position`, from 0 within the keys, by falling confidence, ties in order."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), order)) - 1)


_DICT = "points array<array<double>>, transcription string, confidence double, illegibility boolean, dontCare boolean"


def parse_dicts(rows: DataFrame, text: str = "value", transcription: bool = False, confidence: bool = False) -> DataFrame:
    """points (x and y in turn), confidence, transcription and error of detections written as JSON objects.

    Texts marked illegible or not cared for read `###`; a bad object has an error and no values.
    """
    rows = rows.withColumn("_d", F.from_json(F.col(text), _DICT))
    points = F.col("_d.points")
    number = F.col("_d.confidence")
    bad = (
        F.when(points.isNull(), "No points")
        .when(F.size(points) < 3, "Fewer than 3 points")
        .when(F.exists(points, lambda p: p.isNull() | (F.size(p) != 2) | F.exists(p, lambda v: v.isNull())), "A point isn't two numbers")
        .when(_turn(points) > 0, "Points are not clockwise")
    )
    if confidence:
        bad = bad.when(number.isNull(), "No confidence").when(~number.between(0, 1), "Confidence not from 0 to 1")
    if transcription:
        bad = bad.when(F.col("_d.transcription").isNull(), "No transcription")
    hidden = F.coalesce("_d.illegibility", F.lit(False)) | F.coalesce("_d.dontCare", F.lit(False))
    rows = rows.withColumn("error", bad)
    good = F.col("error").isNull()
    return rows.withColumns({
        "points": F.when(good, F.flatten(points)),
        "confidence": F.when(good, number) if confidence else F.lit(None).cast("double"),
        "transcription": F.when(good, F.when(hidden, DONT_CARE).otherwise(F.col("_d.transcription"))) if transcription else F.lit(None).cast("string"),
    }).drop("_d")


def _turn(points: Column) -> Column:
    """The sign by which whole coordinates run, positive against the clock."""
    at = lambda p, i: F.signum(F.get(p, F.lit(i))) * F.floor(F.abs(F.get(p, F.lit(i))))
    following = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, following, lambda p, q: (at(q, 0) - at(p, 0)) * (at(q, 1) + at(p, 1))), F.lit(0.0), lambda a, v: a + v)


def quad_points(points: Column, ltrb: bool = False) -> Column:
    """Corner structs of a parsed line's numbers."""
    x = lambda i: F.get(points, F.lit(i))
    pairs = [(0, 1), (2, 1), (2, 3), (0, 3)] if ltrb else [(0, 1), (2, 3), (4, 5), (6, 7)]
    return F.array(*[F.struct(x(i).alias("x"), x(j).alias("y")) for i, j in pairs])


def image_number(name: Column) -> Column:
    return F.regexp_extract(name, r"img_(\d+)", 1).try_cast("int")


def cpu_list(text: Column) -> Column:
    """`0-3,8` as the numbers it lists."""
    part = lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.flatten(F.transform(F.split(text, ","), part))


def submission_lines(dets: DataFrame, wanted: DataFrame, image: str = "image", text: str = "line", order: str = "id") -> DataFrame:
    """One row (image, content) for every wanted image, empty where nothing was found."""
    content = dets.groupBy(image).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), "\n").alias("content"))
    return wanted.select(image).join(content, image, "left").withColumn("content", F.coalesce("content", F.lit("")))
