"""Image files to JSON lines and pages, handles, streams and the small functions around them."""

import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.__main__ import main
from inkspark.functions import flags, formats
from inkspark.operators import geometry, monitor
from inkspark.plans import pipeline
from inkspark.sources import readers, sinks
from inkspark.streaming import monitor as streams


@pytest.fixture
def files(tmp_path):
    page = np.full((120, 300, 3), 255, np.uint8)
    page[40:70, 40:200] = (10, 20, 30)
    a, b = str(tmp_path / "a 1.png"), str(tmp_path / "b.png")
    for path in (a, b):
        with open(path, "wb") as file:
            file.write(sinks.png(page))
    with open(tmp_path / "none.png", "wb") as file:
        file.write(b"no image")
    return page, a, b, str(tmp_path / "none.png"), str(tmp_path / "missing.png")


def test_images_by_path(spark, files):
    page, a, b, none, missing = files
    paths = [b, a, missing, b, "file://" + b, none]
    rows = readers.images(spark, paths).orderBy("seq").collect()
    assert [r["path"] for r in rows] == paths and [r["content"] is None for r in rows] == [False, False, True, False, False, False]
    rows = readers.pictures(spark, paths).orderBy("seq").collect()
    assert [r["width"] for r in rows] == [300, 300, None, 300, 300, None]
    assert all((np.frombuffer(r["data"], np.uint8).reshape(120, 300, 3) == page).all() for r in rows if r["data"] is not None)
    assert readers.pictures(spark, [missing]).first()["data"] is None


def test_files_to_lines(spark, files):
    _, a, b, none, missing = files
    rows = pipeline.read_files(spark, [b, none, a, missing]).orderBy("seq").collect()
    assert [r["error"] is None for r in rows] == [True, False, True, False]
    got = json.loads(rows[0]["line"])
    assert got["filename"] == b and list(got) == ["filename", "results"] and got["results"]
    # the stand-in detector takes the black below a fitted image for text too
    box = min((r["boundingBox"] for r in got["results"]), key=lambda b: b["rectangle"]["y"])
    assert [r["x"] for r in spark.createDataFrame([(0, rows[0]["line"].replace("b.png", "img_5.png"))], "line_no long, value string").transform(readers.detections).select("rect.x").collect()] == [r["boundingBox"]["rotatedRectangle"]["x"] for r in got["results"]]
    assert list(box["polygon"]) == ["points"] and list(box) == ["polygon", "rotatedRectangle", "rectangle"] and got["results"][0]["text"] == "a"
    assert box["rectangle"]["x"] < 45 and box["rectangle"]["x"] + box["rectangle"]["width"] > 195


def test_command_line(spark, files, capsys):
    _, a, b, none, _ = files
    assert main([], spark) == 1 and "No input files" in capsys.readouterr().err
    assert main([b, a, "--viz"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["filename"] for x in lines] == [b, a]
    svg = open(a.replace(".png", "_viz.svg"), encoding="utf-8").read()
    assert svg.startswith("<svg") and svg.count("data:image/png;base64,") == 2 and "<text" in svg and 'id="rotatedRectangles"' in svg
    assert main([a, none], spark) == 1 and "Failed to process" in capsys.readouterr().err


def test_overlay_and_page():
    over = sinks.overlay(np.array([[0, 255, 100]], np.uint8))
    assert over.tolist() == [[[255, 255, 0, 0], [255, 255, 0, 127], [255, 255, 0, 50]]]
    page = sinks.Page(10, 10).text(1, 2, 0, 3, "<&>").polygons("polygons", [[(0, 0), (1, 0), (1, 1)]], "red")
    assert "&lt;&amp;&gt;" in page.render() and "&quot;polygons&quot;: true" in page.render()
    with pytest.raises(KeyError):
        page.add("other", "")
    image = readers.text_image(200, 100, dense=True)
    assert image.shape == (100, 200, 3) and (image == 0).any() and pipeline.probabilities(image, pipeline.dark_kernel).shape == (100, 200)


def test_handles_keep_what_went_wrong():
    def work(content):
        if content == b"slow":
            time.sleep(0.4)
        if content == b"time":
            raise TimeoutError("by the work")
        if content == b"key":
            raise KeyError("own")
        return content.decode()

    reader = pipeline.Reader(work, 2)
    handle = reader.submit(b"slow")
    assert reader.wait(handle, 0.01) == (2, "") and reader.wait(handle) == (0, "slow")
    assert reader.wait(handle) == (1, "unknown handle")
    for content, text in ((b"time", "by the work"), (b"key", "'own'")):
        handle = reader.submit(content)
        assert reader.wait(handle) == (1, text) and reader.wait(handle) == (1, "unknown handle")
    handle = reader.submit(b"a")
    reader.cancel(handle)
    assert reader.wait(handle) == (1, "unknown handle")
    reader.close()


def test_admission_is_bounded():
    gate, reader = threading.Event(), None
    reader = pipeline.Reader(lambda b: str(gate.wait(5)), 2)
    reader.submit(b""), reader.submit(b"")
    third = threading.Thread(target=lambda: reader.submit(b""))
    third.start()
    time.sleep(0.2)
    assert third.is_alive() and len(reader.handles) == 2
    gate.set()
    third.join(5)
    assert len(reader.handles) == 3
    reader.close()


def test_gauges_and_messages_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(f"m{i % 2}", i, float(i)) for i in range(100)]
    made = spark.createDataFrame(rows, "name string, second int, value double").withColumn("at", F.timestamp_seconds(F.col("second")))
    made.repartitionByRange(3, "second").write.parquet(path)
    events = streams.metric_stream(spark, path, made.schema)
    query = streams.gauges(events, "at", "10 seconds", "1 hour", "name").writeStream.format("memory").queryName("gauges").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(r["name"], r["start"].timestamp()): (r["average"], r["per_sec"]) for r in spark.table("gauges").collect()}
    assert len(got) == 20 and got["m0", 10.0] == (14.0, 0.5)
    rate = monitor.windowed_rate(made, "at", "20 seconds", "10 seconds", 20.0, "name").where("name = 'm0'").collect()
    assert {r["rate"] for r in rate} == {0.25, 0.5}

    sent = []
    results = spark.createDataFrame([(2, None, "bad"), (0, "x", None), (1, None, None)], "seq long, text string, error string")
    results.write.parquet(str(tmp_path / "results"))
    stream = streams.metric_stream(spark, str(tmp_path / "results"), results.schema, 100)
    streams.each_message(stream, lambda rows: sent.extend((r["seq"], r["message"]) for r in rows), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert sorted(sent) == [(0, '{"text":"x"}'), (1, '{"text":null}'), (2, '{"error":"bad"}')]


def test_small_readers_and_writers(spark, tmp_path):
    lines = spark.createDataFrame([('{"start":"2024-01-01T00:00:00Z","end":"2024-01-01T00:00:01Z","tags":{"core":"1"}}',), ("log",)], "value string")
    events, log = readers.trace_lines(lines)
    assert events.select(formats.tag(F.col("tags"), "core"), formats.tag(F.col("tags"), "model")).first()[:] == ("1", "unknown") and log.first()["value"] == "log"
    names = spark.createDataFrame([("img_10.jpg",), ("img_9.jpg",), ("x.jpg",)], "name string")
    assert [r["image"] for r in readers.numbered_files(names).collect()] == [9, 10] and readers.numbered_files(names, first=1).count() == 1
    some = readers.submitted(spark, [b"a", b"b"]).collect()
    assert [bytes(r["content"]) for r in some] == [b"a", b"b"] and some[0]["handle"] != some[1]["handle"]
    one, two = (readers.random_tensor(spark.createDataFrame([(5, ), (6, )], "id int"), 8, seed=3).collect() for _ in range(2))
    assert one == two and one[0]["data"] != one[1]["data"] and all(0 <= x < 1 for x in one[0]["data"])
    sinks.write_spans(events, str(tmp_path / "spans"))
    assert spark.read.text(str(tmp_path / "spans")).where("value like '2024-01-01T00:00:00.000000Z,%'").count() == 1
    sinks.write_results({"ap": 1}, spark.createDataFrame([(7, 0.5)], "image int, recall double"), str(tmp_path / "r.zip"))
    entries = {r["key"]: json.loads(bytes(r["content"])) for r in readers.zip_entries(spark.read.format("binaryFile").load(str(tmp_path / "r.zip")), r".*").collect()}
    assert entries == {"7.json": {"image": 7, "recall": 0.5}, "method.json": {"ap": 1}}
    assert sinks.evaluated(lambda x: {"a": x}, 1) == {"calculated": True, "Message": "", "a": 1} and sinks.evaluated(lambda: 1 / 0)["calculated"] is False
    rows = spark.createDataFrame([(0.125, 3.0), (0.5, -1.0)], "x double, y double")
    assert [r[0] for r in rows.select(formats.percent_text(F.col("x"))).collect()] == ["12.5%", "50.0%"]
    assert rows.select(formats.require(F.col("x"), F.col("y") > -5, "no")).count() == 2
    with pytest.raises(Exception, match="too small"):
        rows.select(formats.require(F.col("y"), F.col("y") > 0, "too small").alias("y")).collect()
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (5, 0.5), (10, 0), (10, 10))])
    assert spark.range(1).select(F.size(geometry.simplify_udf(ring, F.lit(4.0)))).first()[0] == 3


def test_settings():
    assert pipeline.Settings("dbnet", "int8").intra_threads == 1
    for wrong in (("dbnet", "fp32"), ("other", "int8")):
        with pytest.raises(ValueError):
            pipeline.Settings(*wrong)
    with pytest.raises(ValueError):
        pipeline.Settings("svtr", "fp32", intra_threads=0)


@pytest.mark.parametrize("angle", [0.0, 0.3, -0.7, np.pi / 2])
def test_crops_have_the_rectangle_s_size_and_colours(angle):
    image = np.zeros((300, 400, 3), np.uint8)
    c, s = np.cos(angle), np.sin(angle)
    rect = {"x": 180.0, "y": 120.0, "width": 90.0, "height": 40.0, "angle": float(angle)}
    yy, xx = np.mgrid[0:300, 0:400]
    u, v = (xx - 180) * c + (yy - 120) * s, -(xx - 180) * s + (yy - 120) * c
    inside = (u >= 0) & (u <= 90) & (v >= 0) & (v <= 40)
    image[inside] = np.stack([255 * u / 90, 255 * v / 40, np.full_like(u, 200.0)], -1)[inside].clip(0, 255)
    out = pipeline.crop(image, rect)
    assert abs(out.shape[1] - 90) <= 2 and abs(out.shape[0] - 40) <= 2
    assert abs(int(out[20, 45, 0]) - 127) < 8 and abs(int(out[20, 45, 1]) - 127) < 8 and out[20, 10, 0] < out[20, 80, 0] and out[5, 45, 1] < out[35, 45, 1]


def test_flags():
    given = flags.Flags("x --model DbNet --cores 0 2 4 --warm --duration 1.5 -v 9 --cores 1 3".split())
    assert given.get("cores", [int]) == [1, 3] and given.get("duration", float) == 1.5 and given.get("warm", bool) and given.get("warm") == ""
    assert given.get("model") == "DbNet" and given.get("absent", int, 7) == 7 and given.get("cores", int) == 1
    with pytest.raises(flags.UnrecognizedFlag):
        given.get("absent")


def test_text_buffer():
    assert pipeline.text_buffer("é") == (b"\xc3\xa9\0", 2)


def test_keys_of_archives(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    sinks.write_zip(spark.createDataFrame([("res_img_1.txt", "1"), ("other", "")], "name string, content string"), path)
    archives = spark.read.format("binaryFile").load(path)
    assert [r["key"] for r in readers.zip_keys(archives, r"res_img_(\d+)\.txt").collect()] == ["1"]
    with pytest.raises(Exception, match="no valid entry"):
        readers.zip_keys(archives, r"res_img_(\d+)\.txt", all_entries=True).collect()


def test_perf_samples(spark):
    lines = ["# started", "", "1.0,<not counted>,,cpu_core/cycles/", "1.0,200,,cpu_core/instructions/,5,100.0,12.5,%  tma_l1_bound", "1.0,100,,cpu_atom/cycles/,5,1,2.5,% tma_l1_bound",
             "1.0,5,,x,5,1,30,tma_info_system_dram_bw_use", "1.0,5,,x,5,1,20,tma_info_system_dram_bw_use", "bad,1,2,3", "2.0,1,x", " 3.0,7,,cpu_clk_unhalted.cycles"]
    rows = {r["second"]: r for r in readers.perf_samples(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")).collect()}
    assert set(rows) == {1.0, 3.0} and rows[1.0]["ipc"] == 2.0 and rows[1.0]["l1_bound_pct"] == 15.0 and rows[1.0]["bandwidth_gbps"] == 20.0 and rows[3.0]["ipc"] == 0.0
