import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.sources import annotations as A
from gleanery.sources import files, labels
from gleanery.streaming import replay


def put(path: Path, data) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))


def test_label_parser_every_counter(spark):
    lines = ["0 0.5 0.5 0.2 0.2", "0 .5 .5 .2 .2", "0 0.5  0.5 0.2 0.2", "x 1 1 1 1", "1.5 .1 .1 .1 .1", "1.0 .1 .1 .1 .1", "1 nan .1 .1 .1", "1 .1 .1 .1", "1 .1 .1 .1 .1 .1", "2 .1 .1 .3 .1 .3 .4",
             "9 .1 .1 .1 .1", "1 1.2 .1 .1 .1", "1 .1 .1 0 .1", "0 .1 .1 1.5 .1 .1 .1", "", "   ", "2\t.2\t.2\t.1\t.1"]
    df = spark.createDataFrame([("s", "u", i, x) for i, x in enumerate(lines)] + [("s", "u", 99, None)], "source string, uid string, line_no int, line string")
    got = labels.issues(df, 3).first().asDict()
    assert got == {"source": "s", "duplicate_lines": 1, "malformed_lines": 5, "polygon_lines": 2, "bad_class_id": 1, "out_of_range_coords": 2, "zero_size_boxes": 2}
    kept = {r.line_no for r in labels.boxes(df, 3).collect()}
    assert kept == {0, 1, 5, 9, 11, 16}
    poly = labels.boxes(df, 3).where("line_no = 9").first()
    assert (round(poly.cx, 9), round(poly.cy, 9), round(poly.w, 9), round(poly.h, 9)) == (0.2, 0.25, 0.2, 0.3)


def test_label_folder(spark, tmp_path):
    put(tmp_path / "train/images/a.jpg", "x")
    put(tmp_path / "train/labels/a.txt", "0 .5 .5 .1 .1\n1 .5 .5 .1 .1\n")
    put(tmp_path / "train/images/b.PNG", "x")
    put(tmp_path / "valid/labels/c.txt", "0 .5 .5 .1 .1")
    images, lines = A.label_files(spark, str(tmp_path))
    got = {(r.uid, r.label_path, r.has_label) for r in A.labelled_images(images, lines).collect()}
    assert got == {("train/images/a.jpg", "train/labels/a.txt", True), ("train/images/b.PNG", "train/labels/b.txt", False), (None, "valid/labels/c.txt", True)}
    assert [(r.line_no, r.line) for r in lines.where("label_path = 'train/labels/a.txt' and line <> ''").orderBy("line_no").collect()] == [(1, "0 .5 .5 .1 .1"), (2, "1 .5 .5 .1 .1")]
    assert A.listing(spark, str(tmp_path)).count() == 4 and A.newest(spark, str(tmp_path)).first().newest is not None
    assert {r.rel for r in A.tree(spark, str(tmp_path), ["valid"]).collect()} == {"train/images/a.jpg", "train/labels/a.txt", "train/images/b.PNG"}


def test_coco(spark, tmp_path):
    put(tmp_path / "c.json", {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 80, "height": 60}, {"id": 2, "file_name": "b.jpg", "width": 80, "height": 60}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [10, 10, 20, 30], "iscrowd": 0}, {"id": 2, "image_id": 1, "category_id": 9, "bbox": [1, 1, 1, 1]}, {"id": 3, "image_id": 7, "category_id": 1, "bbox": [0, 0, 1, 1]}],
        "categories": [{"id": 1, "name": "can", "supercategory": "metal"}, {"id": 2, "name": "jar", "supercategory": ""}],
    })
    images, ann = A.coco(spark, str(tmp_path / "c.json"))
    assert {(r.file_name, r.n) for r in images.collect()} == {("a.jpg", 2), ("b.jpg", 0)}
    assert {(r.id, r["class"], r.x, r.w) for r in ann.collect()} == {(1, "can", 10.0, 20.0), (2, None, 1.0, 1.0)}
    _, by_super = A.coco(spark, str(tmp_path / "c.json"), "supercategory")
    assert by_super.where("id = 1").first()["class"] == "metal"


def test_supervisely(spark, tmp_path):
    box = {"exterior": [[10, 20], [30, 60]]}
    put(tmp_path / "ds/ann/a.jpg.json", {"size": {"width": 100, "height": 80}, "objects": [
        {"classTitle": "trash", "geometryType": "rectangle", "points": box, "tags": [{"name": "material", "value": "glass"}]},
        {"classTitle": "trash", "geometryType": "polygon", "points": box, "tags": [{"name": "material", "value": "glass"}, {"name": "state", "value": "wet"}]},
        {"classTitle": "trash", "geometryType": "bitmap", "points": box, "tags": []}, {"classTitle": "trash", "geometryType": "polygon", "points": {"exterior": [[1, 1]]}}]})
    put(tmp_path / "meta.json", {"classes": []})
    got = sorted(A.supervisely(spark, str(tmp_path), "material", [("state", "wet", "OTHER")]).collect(), key=lambda r: r.obj_no)
    assert [(r.uid, r["class"], r.override, r.problem) for r in got] == [
        ("ds/a.jpg", "glass", False, None), ("ds/a.jpg", "OTHER", True, None), ("ds/a.jpg", "untagged", False, "unsupported_geometry:bitmap"), ("ds/a.jpg", "untagged", False, "invalid_bbox"),
    ]
    assert (got[0].x, got[0].y, got[0].w, got[0].h) == (10.0, 20.0, 20.0, 40.0)


def test_labelme(spark, tmp_path):
    put(tmp_path / "a/1.json", {"version": "5", "imagePath": "..\\img\\p.jpg", "imageWidth": 10, "imageHeight": 10, "shapes": [
        {"label": "Plastic Bottle 2", "points": [[1, 1], [4, 5], [2, 2]], "shape_type": "polygon"}, {"label": "glass 2", "points": [[5, 5], [8, 9]], "shape_type": "circle"},
        {"label": "x", "points": [[1, 1]], "shape_type": "rectangle"}, {"label": "y", "points": [[1, 1], [2, 2]], "shape_type": "line"}]})
    put(tmp_path / "a/2.json", {"imagePath": "p.jpg", "shapes": []})
    put(tmp_path / "a/3.json", {"other": 1})
    put(tmp_path / "a/4.json", "{broken")
    objects, problems = A.labelme(spark, str(tmp_path))
    got = sorted(objects.collect(), key=lambda r: r.shape_no)
    assert [(r.uid, r["class"], r.problem) for r in got] == [("a/p.jpg", "plastic bottle", None), ("a/p.jpg", "glass", None), ("a/p.jpg", "x", "invalid_bbox"), ("a/p.jpg", "y", "unsupported_shape:line")]
    assert (got[1].x, got[1].w) == (0.0, 10.0)
    assert {(r.json, r.problem) for r in problems.collect()} == {("a/2.json", "second_json_for_same_image_skipped"), ("a/3.json", "non_labelme_json_skipped"), ("a/4.json", "unreadable_json_skipped")}


def test_mask_regions(spark):
    m = np.zeros((100, 200), int)
    m[10:30, 20:60], m[50:56, 100:106], m[40:65, 150:190] = 1, 1, 2
    m[70:72, 10:60], m[72:90, 58:60] = 1, 1
    m[0:5, 0:5] = 9
    found, small = A.regions(m, [1, 2], 50, True)
    assert found == [(1, 10, 70, 50, 20), (1, 20, 10, 40, 20), (2, 150, 40, 40, 25)] and small == 1
    diag = np.eye(12, dtype=int)
    assert A.regions(diag, [1], 1, True)[0] == [(1, 0, 0, 12, 12)] and len(A.regions(diag, [1], 1, False)[0]) == 12
    y, x = np.nonzero(m >= 0)
    px = spark.createDataFrame([("p", int(a), int(b), int(m[a, b])) for a, b in zip(y, x)], "image string, y int, x int, value int")
    rows = A.mask_regions(px, [1, 2]).collect()
    assert sorted((r.value, r.x, r.y, r.w, r.h) for r in rows) == found and rows[0].dropped == 1


def test_mask_pairs_and_pictures(spark, tmp_path):
    import struct
    import zlib

    def png(path, px):
        h, w = px.shape
        raw = b"".join(b"\0" + bytes(r) for r in px.astype(np.uint8))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (40, 60))
    png(tmp_path / "a.png", a)
    png(tmp_path / "mask_a.png", np.clip(a + 5, 0, 255))
    png(tmp_path / "flat.png", np.full((20, 20), 7))
    got = {(r.image, r.mask, r.state) for r in A.mask_pairs(spark, str(tmp_path)).collect()}
    assert got == {("a.png", "mask_a.png", "paired"), ("flat.png", None, "image_without_mask")}
    f = {Path(r.path).name: r for r in A.picture_fingerprints(spark.read.format("image").load(str(tmp_path))).collect()}
    assert f["flat.png"].h0 is None and f["flat.png"].thumb is None and f["a.png"].width == 60 and len(f["a.png"].thumb) == 64
    bits = sum(bin((f["a.png"][h] ^ f["mask_a.png"][h]) & (2**64 - 1)).count("1") for h in ("h0", "h1", "h2", "h3"))
    assert bits <= 40


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("valid", "b.jpg", "s"), ("train", "c.jpg", "s"), ("train", "a.jpg", "t")], "split string, file string, source string")
    files.write_split(df, str(tmp_path / "split"))
    back = files.read_split(spark, str(tmp_path / "split"))
    assert [tuple(r) for r in back.collect()] == [("train", "a.jpg", "t"), ("train", "c.jpg", "s"), ("valid", "b.jpg", "s")]
    with pytest.raises(files.InvalidFile):
        files.read_split(spark, str(tmp_path / "split"), ("split", "nothing"))
    bad = spark.createDataFrame([("train", "a"), ("tr", "b"), ("train", "a"), ("valid", " ")], "split string, file string")
    known = spark.createDataFrame([("a",), ("z",)], "file string")
    assert {(r.fault, r.file) for r in files.split_faults(bad, known).collect()} == {("blank", " "), ("bad_split", "b"), ("repeated", "a"), ("not_in_dataset", "b"), ("not_assigned", "z")}
    assert files.write_lists(df, str(tmp_path / "lists")) == ["no files for test"]
    assert {r.file for r in files.read_list(spark, str(tmp_path / "lists")).collect()} == {"a.jpg", "b.jpg", "c.jpg"}
    files.write_labels(spark.createDataFrame([("a", "0 .1"), ("a", "1 .1"), ("b", "2 .1")], "image string, line string"), str(tmp_path / "labels"))
    assert files.read_list(spark, str(tmp_path / "labels")).count() == 3
    put(tmp_path / "e.csv", " epoch,  metrics/mAP50(B)\n 1, 0.5\n 2, 0.6\n")
    assert [tuple(r) for r in files.read_epochs(spark, str(tmp_path / "e.csv")).select("epoch", "`metrics/mAP50(B)`").collect()] == [(1, 0.5), (2, 0.6)]
    assert files.read_report(spark, str(tmp_path / "none.json"), "a int") is None
    files.write_report(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "r"))
    assert files.read_report(spark, str(tmp_path / "r"), "a int").first().a == 1
    moved = files.relocated(spark.createDataFrame([("/x/a.jpg",), ("c:\\y\\q.jpg",)], "p string"), "p", "/new/")
    assert {r.p for r in moved.collect()} == {"/new/a.jpg", "/new/q.jpg"}
    assert [r.p for r in files.missing_files(moved, "p", spark.createDataFrame([("/d/a.jpg",)], "path string")).collect()] == ["/new/q.jpg"]
    kept, gone, images = files.class_prefix(spark.createDataFrame([("i", "0 1"), ("i", "5 1"), ("j", "6 1"), ("k", "")], "image string, line string"), 5)
    assert {(r.image, r.lines) for r in images.collect()} == {("i", 1), ("j", 0), ("k", 0)}
    assert kept.count() == 1 and {(r.cls, r.removed) for r in gone.collect()} == {(5, 1), (6, 1)}
    with pytest.raises(files.InvalidFile):
        files.guarded_output(spark, str(tmp_path / "split"), ("lists",))
    with pytest.raises(files.InvalidFile):
        files.guarded_output(spark, str(tmp_path / "in/out"), (), (str(tmp_path / "in"),))


def test_pins(spark, tmp_path):
    put(tmp_path / "p.csv", "split,file\ntrain,a.jpg\ntest,b.jpg\nvalid,z.jpg\n")
    items = spark.createDataFrame([("d/a.jpg",), ("e/b.jpg",), ("c.jpg",)], "uid string")
    rows, counts = files.read_pins(spark, str(tmp_path / "p.csv"), items)
    assert {(r.uid, r.pinned) for r in rows.collect()} == {("d/a.jpg", "train"), ("e/b.jpg", "test"), ("c.jpg", None)}
    assert tuple(counts.first()) == (3, 2, 1, 1)
    with pytest.raises(files.InvalidFile):
        files.read_pins(spark, str(tmp_path / "p.csv"), items.union(spark.createDataFrame([("x/a.jpg",)], "uid string")))
    put(tmp_path / "q.csv", "split,file\ntrian,a.jpg\n")
    with pytest.raises(files.InvalidFile):
        files.read_pins(spark, str(tmp_path / "q.csv"), items)


def test_located(spark):
    f = spark.createDataFrame([(p,) for p in ("x/My-Data", "x/My-Data/sub/my_data", "y/mydata2", "a/b/c/d/e/f/g/mydata", "z")], "path string")
    assert [r.path for r in files.located(f, ["MY DATA"]).collect()] == ["x/My-Data"]
    assert {r.path for r in files.located(f, ["my_data"], contains=True).collect()} == {"x/My-Data", "y/mydata2"}
    assert files.located(f, ["none"]).count() == 0


def test_lists_masks_and_meta(spark, tmp_path):
    put(tmp_path / "l/a.txt", "x/a.jpg\n\n b.jpg \nb.jpg\n")
    there = spark.createDataFrame([("/d/a.jpg",)], "path string")
    assert {(r.fault, r.file) for r in files.list_faults(files.read_list(spark, str(tmp_path / "l")), there).collect()} == {("repeated", "b.jpg"), ("missing", "b.jpg")}
    px = spark.createDataFrame([("p", 0, 0, 1), ("p", 0, 1, 7), ("q", 0, 0, 255)], "image string, y int, x int, value int")
    assert [(r.image, r.unknown) for r in A.mask_faults(px, [1, 2], [255]).collect()] == [("p", [7])]
    put(tmp_path / "meta.json", {"classes": [], "tags": [{"name": "material", "values": ["glass", "metal"]}, {"name": "state", "values": ["wet"]}]})
    assert {r.value for r in A.supervisely_tags(spark, str(tmp_path / "meta.json"), "material").collect()} == {"glass", "metal", "untagged"}
    put(tmp_path / "e/1.json", {"shapes": [], "imageData": "AAEC"})
    put(tmp_path / "e/2.json", {"shapes": [], "imageData": "AAEC"})
    put(tmp_path / "e/2.jpg", "x")
    assert [(r.json, bytes(r.image_bytes)) for r in A.embedded_pictures(spark, str(tmp_path / "e")).collect()] == [("1.json", b"\0\1\2")]
    assert [(r.path, r.length, r.error) for r in A.picture_files(spark, str(tmp_path / "e")).collect()] == [("2.jpg", 1, "unreadable")]


def test_replay(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 0)], "s int, i int")
    assert [tuple(r) for r in replay.missing(replay.plan(rows, "s", "i"), rows, ["s", "i"]).collect()] == [(1, 2)]
    assert [r.s for r in replay.gaps(rows, "s", "i").collect()] == [1]
    path = str(tmp_path / "log")
    assert replay.append_new(spark, path, rows, ["s", "i"]).count() == 4
    more = rows.unionByName(spark.createDataFrame([(9, 9)], "s int, i int"))
    assert [tuple(r) for r in replay.append_new(spark, path, more, ["s", "i"]).collect()] == [(9, 9)]
    assert spark.read.parquet(path).agg(F.count("*")).first()[0] == 5
