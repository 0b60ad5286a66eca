import json
import sys

import pytest
from pyspark.sql import functions as F

from platewright import config
from platewright.operators import engines, evaluate, tracking
from platewright.sources import media, payloads, reports
from platewright.streaming import plates


def test_config(tmp_path):
    s = config.settings({"ocr": {"engine": "other", "max_variants": 0}, "video": {"vehicle_mode": "STATIONARY", "skip_frames": None}, "forensic": {"jpeg_quality": 300}})
    assert (s["ocr"]["engine"], s["ocr"]["max_variants"], s["ocr"]["paddle"]["lang"]) == ("paddle", 1, "pt")
    assert (s["video"]["skip_frames"], s["temporal_voting"]["min_observations"], s["forensic"]["jpeg_quality"]) == (5, 3, 100)
    (tmp_path / "c.json").write_text(json.dumps({"pipeline": {"crop_margin": 0.2}}))
    loaded = config.load(tmp_path / "c.json")
    assert loaded["pipeline"] == {**config.DEFAULTS["pipeline"], "crop_margin": 0.2}
    assert config.load(tmp_path / "none.json") == config.settings({})
    assert config.signature(loaded) != config.signature(config.settings({})) and hash(config.signature(loaded))


def test_settings_in_yaml_need_a_reader(tmp_path, monkeypatch):
    monkeypatch.setitem(sys.modules, "yaml", None)
    (tmp_path / "c.yaml").write_text("pipeline: {crop_margin: 0.2}")
    with pytest.raises(ImportError):
        config.load(tmp_path / "c.yaml")


def test_payloads(spark):
    bodies = [
        '{"results":[{"plate":"abc 1d23","score":0.4},{"plate":"abc1d23","score":0.9,"region":{"code":"br"},"candidates":[{"plate":"a","score":0.1},{"plate":"b"},{"plate":"c"},{"plate":"d"},{"plate":"e"},{"plate":"f"}]}]}',
        '{"results":[]}', "nonsense", None, '{"results":[{"plate":"abc1234","score":0.3}]}',
    ]
    got = payloads.plate_response(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string"), "body").orderBy("i").collect()
    assert [(r["plate"], r["score"], r["accepted"], r["format"]) for r in got] == [("ABC1D23", 0.9, True, "mercosul"), ("", 0.0, False, "unknown"), ("", 0.0, False, "unknown"), ("", 0.0, False, "unknown"), ("ABC1234", 0.3, False, "old")]
    assert (got[0]["region"], len(got[0]["alternates"])) == ("br", 5)
    said = spark.createDataFrame([('```json\n{"selected_plate":"A","decision_confidence":0.8}\n```',), ("none",)], "b string")
    assert sorted(str(r["selected_plate"]) for r in payloads.decision(said, "b").collect()) == ["A", "None"]
    pick = spark.createDataFrame([("A", ["A", "B"]), ("C", ["A"])], "p string, c array<string>")
    assert [r["choice"] for r in payloads.accepted_pick(pick, "p", "c").collect()] == ["A", "ABSTAIN"]


def test_media_and_engines(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\x02\x03xyzxyz")
    (tmp_path / "b.png").write_bytes(b"")
    (tmp_path / "c.bmp").write_bytes(b"bad")
    (tmp_path / "v.MP4").write_bytes(b"12345")
    (tmp_path / "m.pt").write_bytes(b"..")

    def decoder():
        def one(data):
            if data == b"bad":
                raise ValueError("no image")
            return data[0], data[1], 1, data[2:]

        return one

    got = {r["path"].rsplit("/", 1)[1]: r for r in media.read_images(spark, str(tmp_path), decoder).collect()}
    assert (got["a.jpg"]["h"], got["a.jpg"]["w"], got["c.bmp"]["error"], "b.png" in got) == (2, 3, "no image", False)
    frames = media.read_videos(spark, str(tmp_path), lambda: lambda data: ((n + 1, n * 40.0, 1, 1, 1, data[n : n + 1]) for n in range(5)), skip=2).collect()
    assert [r["frame_number"] for r in frames] == [1, 3, 5]
    assert [r["path"].rsplit("/", 1)[1] for r in media.list_models(spark, str(tmp_path)).collect()] == ["m.pt"]

    class Reader:
        name = "fake"

        def __init__(self, known):
            self.known = known

        def __call__(self, h, w, c, data):
            return self.known.get(bytes(data), [])

    variants = spark.createDataFrame([(1, 0, 1, 1, 1, b"a"), (1, 1, 1, 1, 1, b"b"), (2, 0, 1, 1, 1, b"x")], "crop_id long, variant_idx int, h int, w int, c int, data binary")
    original = variants.where("variant_idx = 0")
    found = engines.read_with_fallback(variants, original, lambda: Reader({b"a": [("ABC1234", 0.5)], b"b": [("ABC1235", 1.5)]}), lambda: Reader({b"x": [("XYZ9876", 0.4)]}))
    assert {(r["crop_id"], r["text"], r["confidence"]) for r in found.collect()} == {(1, "ABC1235", 1.0), (2, "XYZ9876", 0.4)}
    images = spark.createDataFrame([(1, 4, 4, 1, b"ok"), (2, 4, 4, 1, b"no")], "image_id long, h int, w int, c int, data binary")

    def detector():
        def run(h, w, c, data, confidence):
            if data == b"no":
                raise RuntimeError("broken")
            return [(0.9, 1.2, 3.7, 3.1, 0.8, "plate")]

        return run

    boxes = {r["image_id"]: r for r in engines.detect(images, detector).collect()}
    assert (boxes[1]["x1"], boxes[1]["x2"], boxes[2]["error"]) == (0, 3, "broken")


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("ABC-1234", 0.9, True, b"x", ["clear"]), (None, 0.7, False, b"y", [])], "plate_text string, confidence double, is_valid boolean, content binary, scenario_tags array<string>")
    reports.write_reports(rows, str(tmp_path / "r"))
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted(x["recognition"]["confidence_band"] for x in got) == ["high", "medium"] and all(len(x["source"]["sha256"]) == 64 for x in got)
    records = spark.createDataFrame([(1, "A", "A", 0.9, 0.8, 10.0, ["x", "y"]), (2, "", "B", 0.5, 0.8, 30.0, ["x"])], "fixture_id long, expected string, predicted string, confidence double, det_conf double, ms double, tags array<string>")
    reports.write_evaluation(evaluate.evaluate(records), evaluate.scored(records), str(tmp_path / "e"))
    summary = spark.read.json(str(tmp_path / "e/summary")).first()
    assert (summary["n"], summary["exact_rate"], summary["false_positive_rate"], summary["avg_ms"]) == (2, 0.5, 0.5, 20.0)
    assert {r["scenario_tags"] for r in spark.read.option("header", True).csv(str(tmp_path / "e/rows")).collect()} == {"x,y", "x"}
    empty = evaluate.evaluate(records.limit(0)).first()
    assert empty["n"] == 0 and empty["exact_rate"] == 0.0


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_gives_the_batch_tracks(spark, tmp_path, batches):
    rows = [(v, f, 0, ["ABC1234", "ABC1284", "XYZ9K87"][(v + f * f) % 3], 0.5 + f % 5 / 10, x := [0, 10, 500][(f // 2) % 3], 0, x + 100, 50) for v in range(3) for f in range(30)]
    schema = "video_id long, frame_number long, seq long, plate string, confidence double, x1 long, y1 long, x2 long, y2 long"
    whole = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "in")
    query = plates.track_stream(spark.readStream.schema(schema).parquet(src)) if (tmp_path / "in").mkdir() is None else None
    running = query.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        step = 30 // batches
        for b in range(batches):
            whole.where((F.col("frame_number") >= b * step) & (F.col("frame_number") < (b + 1) * step)).coalesce(1).write.mode("append").parquet(src)
            running.processAllAvailable()
    finally:
        running.stop()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, tracking.assign_tracks(whole).collect())) and len(got) == 90


def test_windows_and_sessions(spark, tmp_path):
    rows = [(1, "A", 0.5, f"2024-01-01 00:00:{s:02d}") for s in (1, 2, 40)] + [(1, "B", 0.7, "2024-01-01 00:06:00"), (1, "Z", 0.1, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "video_id long, plate string, confidence double, t string").withColumn("ts", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for n, make in enumerate((plates.plate_windows, plates.plate_sessions, plates.distinct_plates)):
        out = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        q = out.writeStream.format("memory").queryName(f"seen{n}").outputMode("append").option("checkpointLocation", str(tmp_path / f"cp{n}")).start()
        q.processAllAvailable()
        q.processAllAvailable()
        q.stop()
    windows = spark.table("seen0").collect()
    assert {(r["plate"], r["detections"]) for r in windows} == {("A", 3), ("B", 1)}
    assert sorted(r["detections"] for r in spark.table("seen1").where("plate = 'A'").collect()) == [1, 2]
    assert spark.table("seen2").count() == 3
