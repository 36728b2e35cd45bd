import math
import zipfile

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkspark.operators import decode, evaluate, geometry, relief, tiling
from inkspark.plans import pipeline
from inkspark.sources import readers, sinks


def square(x, y, s):
    return np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], float)


def test_confidence_skips_characters_before_a_blank(spark):
    rows = {"skips": [[0, 0.5, 0.1], [0.9, 0, 0], [0, 0.1, 0.8]], "both": [[0, 0.8, 0], [0, 0, 0.9]], "run": [[0, 0.6, 0], [0, 0.9, 0], [0, 0.7, 0]], "none": [[1.0, 0, 0]], "empty": []}
    df = spark.createDataFrame([(k, [[float(x) for x in s] for s in v]) for k, v in rows.items()], "k string, steps array<array<double>>")
    got = {r["k"]: r["r"] for r in df.select("k", decode.decode(F.col("steps")).alias("r")).collect()}
    assert got["skips"]["confidence"] == pytest.approx(0.8)
    assert got["both"]["confidence"] == pytest.approx(math.sqrt(0.72)) and got["both"]["classes"] == [1, 2]
    assert got["run"]["confidence"] == pytest.approx(0.9) and got["run"]["n_chars"] == 1
    assert got["none"]["confidence"] == 0 and got["empty"]["n_chars"] == 0


def test_tile_counts(spark):
    sides = {32: 0, 33: 1, 640: 1, 641: 2, 1248: 2, 1249: 3}
    df = spark.createDataFrame([(k,) for k in sides], "s int").select("s", tiling.tile_count(F.col("s")).alias("n"))
    assert {r["s"]: r["n"] for r in df.collect()} == sides


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=6, max_size=6), min_size=3, max_size=8))
def test_map_form_of_opening_and_shapes(rows):
    a = np.array(rows, np.int8)
    naive = np.zeros_like(a)
    for y in range(1, a.shape[0] - 1):
        for x in range(1, a.shape[1] - 1):
            naive[y, x] = a[y - 1 : y + 2, x - 1 : x + 2].min()
    wide = np.array([[naive[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max() for x in range(a.shape[1])] for y in range(a.shape[0])])
    assert (relief.open_map(a) == wide).all()
    label, work = relief.shapes(a), a.copy()
    while (left := np.flatnonzero(work.ravel() == 1)).size:
        before = work.copy()
        relief.flood(work, int(left[0]) % 6, int(left[0]) // 6)
        assert (label[before != work] == left[0]).all()


def test_trace_follows_shapes():
    a = np.full((9, 9), 0.1)
    a[2:6, 2:6] = 0.3
    (path,) = relief.trace_all(a)
    assert len(set(path)) == len(path) and set(path) <= {(x, y) for x in range(2, 6) for y in range(2, 6) if x in (2, 5) or y in (2, 5)}
    assert relief.trace_all(np.zeros((5, 5))) == []
    assert relief.trace(np.array([[0, 0, 0], [0, 1, 0], [0, 0, 0]]), 1, 1)[0] == (1, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=30))
def test_hull_and_rectangle_hold_all_points(points):
    p = np.array(points, float)
    ring = geometry.hull(p)
    if ring is None:
        return
    for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
        assert ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) <= 1e-9).all()
    r = geometry.min_area_rectangle(ring)
    if r is not None and abs(abs(r["angle"]) - math.pi / 2) > 1e-4:
        c, s = math.cos(r["angle"]), math.sin(r["angle"])
        d = p - [r["x"], r["y"]]
        area = geometry.clip_area(ring, ring)
        assert r["width"] * r["height"] >= area - 1e-6
        if abs(r["width"] - r["height"]) > 1e-3:
            u, v = d @ [c, s], d @ [-s, c]
            assert u.min() > -1e-6 and u.max() < r["width"] + 1e-6 and v.min() > -1e-6 and v.max() < r["height"] + 1e-6


def test_overlap_and_dilation():
    assert geometry.iou(square(0, 0, 10), square(5, 0, 10)) == pytest.approx(1 / 3)
    assert geometry.clip_area(square(0, 0, 2), square(5, 5, 2)) == 0
    grown = geometry.dilated(square(0, 0, 100))
    assert np.ptp(grown[:, 0]) == pytest.approx(175, abs=10) and np.ptp(grown[:, 1]) == pytest.approx(175, abs=10)
    assert geometry.dilated(np.zeros((4, 2))) is None
    assert len(geometry.simplify(np.array([(0, 0), (5, 0.5), (10, 0), (10, 10)], float), 4)) == 3


@pytest.mark.parametrize("x", [(10, 20, 50, 30, 0.0), (3, 4, 20, 20, 0.0), (5, 5, 30, 10, math.pi / 2), (5, 5, 30, 10, -math.pi / 2), (50, 40, 8, 8, math.pi / 4), (1, 2, 30, 12, 2.5), (0, 0, 9, 3, math.pi), (7, 7, 12, 12, math.pi / 2)])
def test_rectangles_of_corners(x):
    def corners(r):
        c, s = math.cos(r["angle"]), math.sin(r["angle"])
        return [(r["x"] + a * r["width"] * c - b * r["height"] * s, r["y"] + a * r["width"] * s + b * r["height"] * c) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]

    given = np.array(corners(dict(zip(("x", "y", "width", "height", "angle"), x, strict=True))))
    for ring in (given, given[::-1]):
        for k in range(4):
            r = geometry.rectangle_of(np.roll(ring, k, 0))
            made = corners(r)
            assert all(min(math.dist(p, q) for q in made) < 1e-6 for p in given.tolist())
            assert r["width"] >= r["height"] - 1e-6 and abs(r["angle"]) <= math.pi / 2 + 1e-6
            assert all(geometry.rectangle_of(np.roll(given, j, 0)) == pytest.approx(r) for j in range(4))


@settings(max_examples=200, deadline=None)
@given(st.floats(-100, 100), st.floats(-100, 100), st.floats(0.5, 60), st.floats(0.5, 60), st.floats(-3.2, 3.2))
def test_any_rectangle_is_found_again(x, y, w, h, angle):
    c, s = math.cos(angle), math.sin(angle)
    given = np.array([(x, y), (x + w * c, y + w * s), (x + w * c - h * s, y + w * s + h * c), (x - h * s, y + h * c)])
    r = geometry.rectangle_of(given)
    c, s = math.cos(r["angle"]), math.sin(r["angle"])
    made = [(r["x"] + a * r["width"] * c - b * r["height"] * s, r["y"] + a * r["width"] * s + b * r["height"] * c) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    assert all(min(math.dist(p, q) for q in made) < 1e-5 for p in given.tolist())


def test_line_forms(spark):
    good = {
        (True, False, False): ["1,2,3,4", " -1 , 2,3,4, ", "1,2,3,4,"],
        (True, False, True): ["1,2,3,4,0.5", "1,2,3,4,1.", "1,2,3,4, 0 "],
        (True, True, False): ["1,2,3,4,", '1,2,3,4, "a, b" '],
        (True, True, True): ["1,2,3,4,1,a,b"],
        (False, False, False): ["0,0,9,0,9,9,0,9"],
        (False, False, True): ["0,0,9,0,9,9,0,9,0.25"],
        (False, True, False): ["0,0,9,0,9,9,0,9,###"],
        (False, True, True): ["0,0,9,0,9,9,0,9,1,x"],
    }
    bad = {
        (True, False, False): ["1,2,-3,4", "1,2,3", "a,2,3,4", "1,2,3,4,,", "5,2,3,4", "1,5,3,4"],
        (True, False, True): ["1,2,3,4,99", "1,2,3,4,5", "1,2,3,4,.5", "1,2,3,4", "1,2,3,4,1x", "1,2,3,4,1,"],
        (True, True, False): ["1,2,3,4"],
        (True, True, True): ["1,2,3,4,x,a", "1,2,3,4,1,,a", "1,2,3,4,1,5,a"],
        (False, False, False): ["0,0,9,0,9,9,0,9,", "0,0,0,9,9,9,9,0"],
        (False, False, True): ["0,0,9,0,9,9,0,9,2"],
        (False, True, False): ["0,0,9,0,9,9,0,9"],
        (False, True, True): ["0,0,9,0,9,9,0,9,x"],
    }
    for form, lines in good.items():
        rows = evaluate.parse_lines(spark.createDataFrame([(x,) for x in lines + bad[form]], "line string"), ltrb=form[0], transcription=form[1], confidence=form[2])
        for i, r in enumerate(rows.collect()):
            assert (r["error"] is None) == (i < len(lines)) == (r["points"] is not None), r
    quoted = spark.createDataFrame([('1,2,3,4,"a \\\\ \\" b"',)], "line string")
    assert evaluate.parse_lines(quoted, ltrb=True).first()["transcription"] == 'a \\ " b'
    outside = spark.createDataFrame([("1,2,30,4,x",)], "line string")
    assert evaluate.parse_lines(outside, ltrb=True, width=20, height=20).first()["error"] == "Point outside of the image"


def test_files_name_their_bad_lines(spark):
    files = spark.createDataFrame([("a", bytearray(b"\xef\xbb\xbf1,2,3,4\n\nbad\xff\n")), ("b", bytearray(b"1,2,3,4\r\n")), ("c", bytearray(b""))], "name string, content binary")
    got = [tuple(r) for r in evaluate.invalid_lines(files, ltrb=True, transcription=False).collect()]
    assert got == [("a", 2, "Line in sample not valid. Sample: a Line: bad\ufffd Error: Format incorrect")]


def test_dict_detections(spark):
    box = '"points":[[0,0],[9,0],[9,9],[0,9]]'
    texts = {
        "{" + box + ',"transcription":"a","confidence":0.5}': None, "{" + box + ',"transcription":"a","confidence":1.5}': "Confidence not from 0 to 1",
        "{" + box + ',"confidence":0.5}': "No transcription", "{" + box + ',"transcription":"a"}': "No confidence", '{"transcription":"a"}': "No points", "[]": "No points",
        '{"points":[[0,0],[9,0]],"transcription":"a","confidence":1}': "Fewer than 3 points", '{"points":[[0,0],[9],[9,9]],"transcription":"a","confidence":1}': "A point isn't two numbers",
        '{"points":[[0,0],[0,9],[9,9],[9,0]],"transcription":"a","confidence":1}': "Points are not clockwise",
    }
    rows = evaluate.parse_dicts(spark.createDataFrame([(t,) for t in texts], "value string"), transcription=True, confidence=True)
    assert {r["value"]: r["error"] for r in rows.collect()} == texts


def test_evaluation_of_an_image_without_detections_or_care(spark):
    pts = lambda q: [{"x": float(x), "y": float(y)} for x, y in q]
    gt = spark.createDataFrame([(1, 0, pts(square(0, 0, 10)), True), (2, 0, pts(square(0, 0, 10)), True), (3, 0, pts(square(0, 0, 600)), False), (4, 0, pts(square(0, 0, 9)), False)], f"image int, id int, points {geometry.POINTS}, care boolean")
    det = [(1, 0, pts(square(1, 0, 10)), 0.5), (1, 1, pts(square(500, 500, 30)), 0.9), (3, 0, pts(square(520, 500, 30)), 0.7), (4, 0, pts(square(50, 50, 30)), 0.6), (9, 0, pts(square(0, 0, 30)), 0.6)]
    samples, total = evaluate.evaluation(gt, spark.createDataFrame(det, f"image int, id int, points {geometry.POINTS}, confidence double"))
    got = {r["image"]: (r["matched"], r["care_gt"], r["care_det"], r["precision"], r["recall"], r["ap"]) for r in samples.collect()}
    assert got == {1: (1, 1, 2, 0.5, 1.0, 0.5), 2: (0, 1, 0, 0.0, 0.0, 0.0), 3: (0, 0, 0, 1.0, 1.0, 1.0), 4: (0, 0, 1, 0.0, 1.0, 0.0)}
    (all_,) = total.collect()
    assert (all_["matched"], all_["care_gt"], all_["care_det"]) == (1, 2, 3) and all_["ap"] == pytest.approx(1 / 3 / 2)


def test_rings_of_any_length(spark):
    n = 1_200_000
    ring = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.cos(i * (2 * math.pi / n)).alias("x"), F.sin(i * (2 * math.pi / n)).alias("y"))).alias("p"))
    r = ring.select(geometry.area(F.col("p")).alias("a"), geometry.perimeter(F.col("p")).alias("l")).first()
    assert r["a"] == pytest.approx(math.pi) and r["l"] == pytest.approx(2 * math.pi)


def test_match_orders(spark):
    pts = lambda q: [{"x": float(x), "y": float(y)} for x, y in q]
    kind = f"image int, id int, points {geometry.POINTS}, care boolean"
    gt = spark.createDataFrame([(1, 0, pts(square(0, 0, 10)), True), (1, 1, pts(square(1, 0, 10)), True)], kind)
    det = spark.createDataFrame([(1, 0, pts(square(1, 0, 10)), True), (1, 1, pts(square(40, 0, 9)), True)], kind)
    assert [(r["gt_id"], r["det_id"]) for r in evaluate.match(gt, det).collect()] == [(0, 0)]
    assert [(r["gt_id"], r["det_id"]) for r in evaluate.match(gt, det, best_first=True).collect()] == [(1, 0)]


def test_pipeline_keeps_order_and_errors(spark):
    page = np.full((120, 300, 3), 255, np.uint8)
    page[40:70, 40:200] = 0
    rows = [(0, 300, 120, bytearray(page.tobytes())), (1, 20, 20, bytearray(1200)), (2, 300, 120, bytearray(b"short"))]
    got = {r["seq"]: r for r in pipeline.run(spark.createDataFrame(rows, "seq long, width int, height int, data binary")).collect()}
    assert got[0]["error"] is None and len(got[0]["results"]) >= 1
    assert "pixels or less" in got[1]["error"] and got[2]["results"] is None


def test_requests_and_files(tmp_path, spark):
    body = b'--b\r\nContent-Disposition: form-data; name="f"; filename="a"\r\n\r\nIMG\r\n--b\r\nContent-Disposition: form-data; name="x"\r\n\r\nno\r\n--b--\r\n'
    assert readers.request_images(body, "multipart/form-data; boundary=b") == [b"IMG"]
    assert readers.request_images(b"x", None) == [b"x"]
    with pytest.raises(ValueError):
        readers.request_images(b"x", "text/plain")
    assert readers.json_objects('[{"a": "}"},\n{"b": {"c": 1}}, {"cut": ') == ['{"a": "}"}', '{"b": {"c": 1}}']
    path = str(tmp_path / "a.zip")
    assert sinks.write_zip(spark.createDataFrame([("res_img_1.txt", "1,2"), ("res_img_2.txt", "")], "name string, content string"), path) == 2
    entries = readers.zip_entries(spark.read.format("binaryFile").load(path), r"res_img_(\d+)\.txt")
    assert {r["key"]: bytes(r["content"]) for r in entries.collect()} == {"1": b"1,2", "2": b""}
    assert zipfile.ZipFile(path).testzip() is None
    with pytest.raises(ValueError):
        sinks.Page(1, 1).add("image", "").add("image", "")


def test_handles():
    reader = pipeline.Reader(lambda b: b.decode(), 2)
    assert reader.wait(reader.submit(b"ok")) == (0, "ok")
    assert reader.wait(reader.submit(b"\xff"))[0] == 1
    reader.close()
    assert pipeline.pool_size() == 24


def _rings(rnd, n):
    """Rectangles, convex rings in both directions, and rings that cross themselves or have no area."""
    for k in range(n):
        x, y, w, h = (float(v) for v in rnd.integers(0, 40, 4))
        angles = np.sort(rnd.uniform(0, 2 * math.pi, int(rnd.integers(3, 9))))[:: 1 if k % 2 else -1]
        kinds = [np.array([(x, y), (x + w + 1, y), (x + w + 1, y + h + 1), (x, y + h + 1)]), np.stack([x + 15 * np.cos(angles), y + 15 * np.sin(angles)], 1), rnd.integers(0, 40, (int(rnd.integers(1, 7)), 2)).astype(float)]
        yield kinds[min(k % 5, 2)] if k % 5 > 1 else kinds[k % 5]


def test_pairs_clipped_at_once_are_as_one_by_one():
    rings = list(_rings(np.random.default_rng(5), 90))
    points, area = geometry.clockwise(np.concatenate(rings), np.cumsum([0, *map(len, rings)]))
    ends = np.cumsum([0, *map(len, rings)])
    some = [k for k, r in enumerate(rings) if len(r) > 2]
    i, j = (v.ravel() for v in np.meshgrid(some, some))
    got = geometry.clip_areas(points, ends, points, ends, i, j)
    assert got == pytest.approx([geometry.clip_area(rings[a], rings[b]) for a, b in zip(i, j, strict=True)], abs=1e-9)
    assert area[some] == pytest.approx([abs(geometry._signed(rings[k])) for k in some])


def _greedy(gt, det, best_first):
    pairs = [(geometry.iou(p, q), image, i, j) for image, i, p in gt for at, j, q in det if at == image]
    pairs = [p for p in pairs if p[0] > 0.5]
    free, out = set(), set()
    for _, image, i, j in sorted(pairs, key=lambda p: (-math.floor(p[0] * 1e9 + 0.5) if best_first else 0, *p[1:])):
        if not {("g", image, i), ("d", image, j)} & free:
            free |= {("g", image, i), ("d", image, j)}
            out.add((image, i, j))
    return out


def _matched(spark, best_first):
    rnd = np.random.default_rng(6)
    gt, det = ([(k % 3, k, r + [480.0, 0]) for k, r in enumerate(_rings(rnd, 240)) if len(r) > 2] for _ in range(2))  # across two cells
    frame = lambda rows: spark.createDataFrame([(f"img_{a}", k, [{"x": float(x), "y": float(y)} for x, y in r], True) for a, k, r in rows], f"image string, id long, points {geometry.POINTS}, care boolean")
    found = evaluate.match(frame(gt), frame(det), best_first=best_first)
    rows = [(int(r["image"][4:]), r["gt_id"], r["det_id"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _greedy(gt, det, best_first)
    return found


def test_match_in_order_streams_pairs_and_sends_only_boxes(spark):
    plan = _matched(spark, False)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "EvalPython" not in plan  # no group of pairs in a task's memory, no pair sent to be measured


def test_pairs_of_one_image_are_made_in_many_tasks(spark):
    box = lambda k: [{"x": float(x), "y": float(y)} for x, y in square(k % 20, k % 30, 30)]
    rows = spark.createDataFrame([(1, k, box(k)) for k in range(600)], f"image int, id int, points {geometry.POINTS}")
    found = evaluate.overlapping(rows, rows, least=0.0, part_boxes=20)
    assert found.count() == 360_000
    assert found.select(F.spark_partition_id()).distinct().count() > 4


def test_best_first_rounds_as_sql(spark):
    # 0.6171875005 times 1e9 is half a unit: both overlaps are one to nine digits, so that the smaller ids go first
    half, above = 0.6171875005, 0.617187501
    got = spark.createDataFrame([(half,), (above,), (0.0629375,)], "v double").select(evaluate.half_up(F.col("v"), 9).alias("nine"), evaluate.half_up(F.col("v"), 6).alias("six")).collect()
    want = duckdb.connect().execute("SELECT round(v, 9), round(v, 6) FROM (VALUES (0.6171875005::DOUBLE), (0.617187501), (0.0629375)) t(v)").fetchall()
    assert [tuple(r) for r in got] == want
