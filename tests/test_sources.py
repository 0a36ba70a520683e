import json

import pytest
from pyspark.sql import functions as F

from loomcast.functions import columns as C
from loomcast.sources import readers, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_coco(spark, tmp_path):
    path = write(
        tmp_path / "train.json",
        {
            "images": [{"id": 1, "file_name": "v_frame_001.jpg", "width": 100, "height": 50, "group": "g"}, {"id": 2, "file_name": "b\\c.jpg", "width": 10, "height": 10}],
            "annotations": [{"id": 5, "image_id": 1, "category_id": 7, "bbox": [10, 5, 20, 10], "iscrowd": 0}, {"id": 6, "image_id": 1, "category_id": 8, "bbox": [0, 0, 200, 10]}, {"id": 7, "image_id": 1, "category_id": 7, "bbox": [1, 1, 1, 1], "iscrowd": 1}, {"id": 8, "image_id": 2, "category_id": 8}],
            "categories": [{"id": 7, "name": "fish"}, {"id": 8, "name": "rock"}],
        },
    )
    rows = {r.image_id: r for r in readers.read_coco(spark, path, "s", "CC BY 4.0", ["fish"], split="train").collect()}
    one, two = rows["s:v_frame_001.jpg"], rows["s:b\\c.jpg"]
    assert one.boxes == [[0.1, 0.1, 0.3, 0.3], [0.0, 0.0, 1.0, 0.2]] and one.box_is_animal == [True, False] and one.box_labels == ["fish", "rock"]
    assert (one.frame_label, one.group_id, one.video_id, one.license, one.train_commercial_ok, one.labeled) == (1, "s:g", "v", "CC-BY-4.0", True, True)
    assert (two.frame_label, two.boxes, two.path, two.group_id, two.split_hint) == (0, [], "b/c.jpg", "s:c", "train")
    loose = readers.read_coco(spark, path, "s", "x", ["fish"], exhaustive=False).where("path = 'b/c.jpg'").first()
    assert loose.frame_label == -1 and not loose.labeled and loose.license == "unknown"


def test_camera_traps(spark, tmp_path):
    names = {0: "empty", 1: "herring"}
    images = [{"id": i, "file_name": f"{i}.jpg", "location": f"river{i % 2}", "datetime": "2020-05-01 10:00", "width": 4, "height": 4} for i in range(12)]
    notes = [{"id": i, "image_id": i, "category_id": int(i >= 6)} for i in range(11)] + [{"id": 50, "image_id": 0, "category_id": 1}]
    path = write(tmp_path / "c.json", {"images": images, "annotations": notes, "categories": [{"id": k, "name": v} for k, v in names.items()]})
    rows = readers.read_camera_traps(spark, path, "s", "own", most_empty=3).collect()
    assert sum(r.frame_label == 0 for r in rows) == 3 and sum(r.frame_label == 1 for r in rows) == 6
    assert {r.group_id for r in rows} == {"s:river0:2020-05-01", "s:river1:2020-05-01"} and not any(r.boxes_exhaustive for r in rows)


def test_yolo(spark, tmp_path):
    write(tmp_path / "labels/train/a.txt", "0 0.5 0.5 0.2 0.4\n7 0.0 0.0 0.5 0.5\nbroken 1 2\n")
    write(tmp_path / "labels/train/b.txt", "\n")
    rows = {r.image_id: r for r in readers.read_yolo(spark, str(tmp_path / "labels"), "y", "CC0", {0: "fish"}, ["fish"], exhaustive=True).collect()}
    assert rows["y:train/a"].boxes == [[0.4, 0.3, 0.6, 0.7], [0.0, 0.0, 0.25, 0.25]] and rows["y:train/a"].box_labels == ["fish", "7"]
    assert (rows["y:train/a"].frame_label, rows["y:train/b"].frame_label, rows["y:train/a"].split_hint) == (1, 0, "train")


def test_manifest_and_listing(spark, tmp_path):
    path = write(tmp_path / "m.csv", "url,dive,notes\n# comment\n\nhttp://h/EX2107_DIVE03_20210711T1.mp4,,x\nhttp://h/other.mp4,,\n,,no url\n")
    assert [(r.cruise, r.dive, r.date, r.notes) for r in readers.read_manifest(spark, path).collect()] == [("EX2107", "DIVE03", "20210711", "x")]
    path = write(tmp_path / "z.json", {"files": [{"key": "a", "size": 3, "checksum": "md5:ff", "links": {"self": "u1"}}, {"filename": "b", "filesize": 4, "checksum": "ee", "links": {"download": "u2", "self": "u3"}}]})
    assert [tuple(r) for r in readers.read_listing(spark, path).collect()] == [("a", 3, "ff", "u1"), ("b", 4, "ee", "u2")]


def test_habitats(spark, tmp_path):
    path = write(tmp_path / "c.csv", "ID,labels\n7117/valid/x_1,1\n7117/empty/x_2,0\n7117/empty/gone,0\n")
    files = spark.createDataFrame([("img/x_1.jpg",), ("img/x_2.jpg",)], "file string")
    rows = {r.image_id: (r.frame_label, r.group_id) for r in readers.read_habitat_csv(spark, path, files, "h", "own").collect()}
    assert rows == {"h:7117/valid/x_1": (1, "h:7117"), "h:7117/empty/x_2": (0, "h:7117")}


def test_logs(spark, tmp_path):
    frame = {"kind": "guidance", "t": 1.0, "state": "SEARCH", "events": ["a"], "nav": {"depth_m": 3.0}}
    encounter = {"id": 1, "t_start": 1.0, "t_end": 2.0, "reason": "lost"}
    lines = [frame, {"kind": "stats", "t": 2.0}, {"kind": "encounter"} | encounter, {**frame, "t": 0.5, "encounter_summary": encounter}, {"t": 3.0, "state": "SAFE"}]
    a = write(tmp_path / "a.jsonl", "\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    b = write(tmp_path / "b.jsonl", json.dumps({"kind": "encounter"} | encounter))
    frames, encounters = readers.read_logs(spark, [a, b])
    assert sorted(r.t for r in frames.collect()) == [0.5, 1.0, 3.0]
    assert [(r.id, r.reason) for r in encounters.collect()] == [(1, "lost")]


def test_union(spark, tmp_path):
    rows = readers.make_record(spark.createDataFrame([("a",), ("b",)], "i string"), "s", image_id=F.col("i"), license=F.lit("own"))
    writers.write_table(rows, str(tmp_path / "s"))
    said = []
    out = readers.concat_records(spark, [str(tmp_path / "s"), str(tmp_path / "gone")], said.append)
    assert out.count() == 2 and len(said) == 1 and out.schema.names == readers.RECORD.names
    with pytest.raises(readers.DuplicateIds):
        readers.concat_records(spark, [str(tmp_path / "s")] * 2)
    with pytest.raises(ValueError):
        readers.concat_records(spark, [str(tmp_path / "gone")], said.append)


def test_packs(spark):
    kind = "key string, content binary, mtime double"
    first = spark.createDataFrame([(f"f{i}", bytearray(b"x" * i), 1.0) for i in range(6)], kind)
    part = writers.pack(first, None).cache()
    assert part.count() == 6 and writers.verify(part).count() == 0
    more = writers.pack(first.union(spark.createDataFrame([("f9", bytearray(b"new"), 2.0), ("f1", bytearray(b"changed"), 2.0)], kind)), part).cache()
    assert sorted((r.key, r.part) for r in more.collect()) == [("f1", 1), ("f9", 1)]
    both = part.unionByName(more)
    keys = spark.createDataFrame([("f1",), ("f2",), ("nope",)], "key string")
    loose = spark.createDataFrame([("f2", bytearray(b"loose"))], "key string, content binary")
    got = {r.key: r.content and bytes(r.content) for r in readers.lookup_packed(both, keys, loose).collect()}
    assert got == {"f1": b"changed", "f2": b"loose", "nope": None}
    assert writers.verify(both.withColumn("content", F.lit(b"?"))).count() == 8
    assert writers.pack(first, part).count() == 0


def test_cache_and_resume(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, size int").withColumn("key", C.normalize_license(F.lit("own")))
    rows = rows.withColumn("key", readers.cache_key(F.col("path"), F.col("size"), F.lit(1.5)))
    cache = spark.createDataFrame([("a|1|1.5", 0.1, None, 1), ("a|1|1.5", 0.2, None, 2), ("b|2|1.5", None, "broken", 1), ("c|9|1.5", 0.5, None, 1)], "key string, lum double, metric_error string, written int")
    have, need = readers.cached(rows, cache, "key")
    assert {r.path: (r.lum, r.metric_error) for r in have.collect()} == {"a": (0.2, None), "b": (None, "broken")}
    assert [r.path for r in need.collect()] == ["c"]
    assert [r.path for r in readers.todo(rows, have, "path").collect()] == ["c"]


def test_terms(spark):
    with pytest.raises(readers.LicenseNotAccepted):
        readers.read_source(spark, "coco", "/nowhere", "x", "own", {"x": True})
    with pytest.raises(KeyError):
        readers.read_source(spark, "nothing", "/nowhere", "x", "own")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0), ("a", float("nan")), ("c", None)], "name string, value double")
    assert writers.markdown(df, order=["name"]).splitlines()[2:] == ["| a | – |", "| b | 2 |", "| c | – |"]
    seen = []
    writers.fan_out([lambda b: seen.append(b.count()), lambda b: writers.append_log(b, str(tmp_path / "log"))])(df, 0)
    assert seen == [3] and spark.read.json(str(tmp_path / "log")).count() == 3
    assert json.loads(writers.curation_log({"a": 1}, {}, [{"step": "x"}]))["steps"] == [{"step": "x"}]


def png(path, rows):
    """A small colour PNG file."""
    import struct
    import zlib

    path.parent.mkdir(parents=True, exist_ok=True)
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_named_sources(spark, tmp_path):
    from loomcast.sources import dispatch

    assert len(dispatch.SOURCES) == 11
    with pytest.raises(readers.LicenseNotAccepted):
        dispatch.fetch(spark, "kakadu", "/nowhere")
    with pytest.raises(KeyError):
        dispatch.fetch(spark, "nothing")
    rows = dispatch.fetch(spark, "synthetic", n=9).collect()
    assert len(rows) == 9 and {r.frame_label for r in rows} == {0, 1} and all(r.labeled for r in rows)
    for split in ("train", "val"):  # two files with the same numbers, one image missing, one without a size
        png(tmp_path / f"k/{split}_0001.png", [[(1, 2, 3)] * 4] * 2)
        write(tmp_path / f"k/{split}.json", {"images": [{"id": 1, "file_name": f"{split}_0001.png", "split": "test" if split == "val" else None}, {"id": 2, "file_name": "gone.png", "width": 4, "height": 2}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 0, 2, 1]}], "categories": [{"id": 1, "name": "fish"}]})
    out = dispatch.fetch(spark, "kakadu", str(tmp_path / "k"), "CC-BY-3.0-AU")
    got = {r.image_id: (r.width, r.height, r.boxes, r.split_hint, r.frame_label) for r in readers.union_sources([out], "image_id").collect()}
    assert got == {"kakadu:train/train_0001.png": (4, 2, [[0.25, 0.0, 0.75, 0.5]], "train", 1), "kakadu:val/val_0001.png": (4, 2, [[0.25, 0.0, 0.75, 0.5]], "test", 1)}
    pages = spark.createDataFrame([(json.dumps(x),) for x in ({"uuid": "u1", "url": "http://h/EX1_frame_3.png", "width": 100, "height": 50, "boundingBoxes": [{"x": 10, "y": 5, "width": 20, "height": 10, "concept": "squid"}, {"x": 0, "y": 0, "width": 1, "height": 1, "concept": "kelp", "rejected": True}]}, {"uuid": "u1", "url": "http://h/again.png"}, {"uuid": "u2"}, {"uuid": "u3", "url": "http://h/a/1234.png", "latitude": 36.74, "longitude": -122.01, "timestamp": "2020-05-01T10:00", "contributorsEmail": "a@b", "license": "CC0"})], "value string")
    found = {r.image_id: r for r in dispatch.site_images(pages, "fathomnet", dispatch.SOURCES["fathomnet"]).collect()}
    assert set(found) == {"fathomnet:u1", "fathomnet:u3"} and found["fathomnet:u3"].license == "CC0-1.0" and found["fathomnet:u3"].train_commercial_ok
    manifest = write(tmp_path / "m.csv", "url,dive,notes\nhttp://h/EX2107_DIVE03_20210711T1.mp4,,x\n")
    one = dispatch.fetch(spark, "noaa_oer", manifest, "public-domain-us-gov").first()
    assert one.group_id == "noaa_oer:EX2107:DIVE03" and one.url.endswith(".mp4")


def test_yolo_images_without_labels(spark, tmp_path):
    for name in ("train/1", "val/1", "val/2"):
        png(tmp_path / f"images/{name}.png", [[(1, 2, 3)] * 2])
    write(tmp_path / "labels/train/1.txt", "0 0.5 0.5 0.2 0.4\n")
    write(tmp_path / "labels/val/1.txt", "\n")
    read = lambda **o: {r.image_id: r.frame_label for r in readers.read_yolo(spark, str(tmp_path / "labels"), "y", "CC0", {0: "fish"}, images_dir=str(tmp_path / "images"), **o).collect()}
    assert read() == {"y:train/1.png": 1, "y:val/1.png": -1, "y:val/2.png": -1}
    assert read(exhaustive=True) == {"y:train/1.png": 1, "y:val/1.png": 0, "y:val/2.png": -1}
