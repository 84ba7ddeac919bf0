"""Queries of sources and sinks: tables written to the shared folder and read back, and small folders of every format."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.names import file_key, source_key, split_key
from gleanery.functions.text import base_name
from gleanery.operators import classmap
from gleanery.session import new_folder
from gleanery.sources import annotations as A
from gleanery.sources import files
from gleanery.streaming import replay
from gleanery.tables import load


def _folder(spark: SparkSession, name: str, content: dict[str, object]) -> str:
    """A small folder in the shared store, written through the cluster's file system."""
    folder, path = new_folder(spark, name), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for file, data in content.items():
        at = path(f"{folder}/{file}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(data if isinstance(data, bytes) else (data if isinstance(data, str) else json.dumps(data)).encode()))
        out.close()
    return folder


def _split(spark: SparkSession, d: str) -> DataFrame:
    """One row per file and split of the split table, in normal form."""
    s = load(spark, d, "split").where("file is not null")
    return s.select(split_key(F.col("split")).alias("split"), file_key(F.col("file")).alias("file"), source_key(F.col("source")).alias("source")).where(F.col("split").isin(*files.SPLITS)).distinct()


def src1_label_folder(spark, d):
    f = _folder(spark, "src1", {"t/images/a.jpg": "x", "t/labels/a.txt": "0 .5 .5 .1 .1\n1 .5 .5 .1 .1", "t/images/b.PNG": "x", "v/labels/c.txt": "0 .5 .5 .1 .1", "images/images/q.webp": "x"})
    images, lines = A.label_files(spark, f)
    n = lines.groupBy("label_path").agg(F.count("*").alias("n"))
    return A.labelled_images(images, lines).join(n, "label_path", "left").select("uid", "label_path", "has_label", F.coalesce("n", F.lit(0)).alias("n"))


def src3_coco(spark, d):
    f = _folder(spark, "src3", {"c.json": {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 80, "height": 60}, {"id": 2, "file_name": "b.jpg", "width": 80, "height": 60}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [10, 10, 20, 30]}, {"id": 2, "image_id": 1, "category_id": 9, "bbox": [1, 1, 1, 1], "iscrowd": 1}, {"id": 3, "image_id": 7, "category_id": 1, "bbox": [0, 0, 1, 1]}, {"id": 4, "image_id": 1, "category_id": 2, "bbox": [3, 4, 5, 6]}],
        "categories": [{"id": 1, "name": "can", "supercategory": "metal"}, {"id": 2, "name": "jar", "supercategory": ""}],
    }})
    images, ann = A.coco(spark, f"{f}/c.json", "supercategory")
    return images.join(ann.withColumnRenamed("id", "ann"), images["id"] == ann["image_id"], "left").select("file_name", "n", "ann", F.col("class").alias("cls"), "crowd", "x", "y", "w", "h")


def src4_supervisely(spark, d):
    box = {"exterior": [[10, 20], [30, 60]]}
    f = _folder(spark, "src4", {"ds/ann/a.jpg.json": {"size": {"width": 100, "height": 80}, "objects": [
        {"classTitle": "trash", "geometryType": "rectangle", "points": box, "tags": [{"name": "material", "value": "glass"}]},
        {"classTitle": "trash", "geometryType": "polygon", "points": box, "tags": [{"name": "material", "value": "glass"}, {"name": "state", "value": "wet"}]},
        {"classTitle": "trash", "geometryType": "bitmap", "points": box, "tags": []}]}, "meta.json": {"tags": [{"name": "material", "values": ["glass"]}]}})
    allowed = A.supervisely_tags(spark, f"{f}/meta.json", "material")
    out = A.supervisely(spark, f, "material", [("state", "wet", "OTHER")])
    return out.join(F.broadcast(allowed.withColumn("known", F.lit(True))), out["class"] == F.col("value"), "left").select(
        "uid", "obj_no", F.col("class").alias("cls"), "override", "x", "y", "w", "h", "problem", F.coalesce("known", F.lit(False)).alias("known")
    )


def src5_labelme(spark, d):
    f = _folder(spark, "src5", {
        "a/1.json": {"imagePath": "..\\img\\p.jpg", "imageWidth": 10, "imageHeight": 10, "shapes": [{"label": "Plastic Bottle 2", "points": [[1, 1], [4, 5], [2, 2]], "shape_type": "polygon"}, {"label": "glass 2", "points": [[5, 5], [8, 9]], "shape_type": "circle"}]},
        "a/2.json": {"imagePath": "p.jpg", "shapes": []}, "a/3.json": {"other": 1}, "a/4.json": "{broken"})
    objects, problems = A.labelme(spark, f)
    a = objects.select("json", F.col("class").alias("what"), "x", "w")
    return a.unionByName(problems.select("json", F.col("problem").alias("what")), allowMissingColumns=True)


def src6_mask_pairs(spark, d):
    return A.mask_pairs(spark, _folder(spark, "src6", {"a.png": "x", "mask_a.png": "x", "b/c.jpg": "x", "mask_q.png": "x", "note.txt": "x"}))


def src7_mask_regions(spark, d):
    """Regions of at least three pixels of a small mask; diagonal neighbours do not touch."""
    px = []
    for y, row in enumerate(["1100222", "1100202", "0000222", "3003000", "0330000"]):
        px += [("m", y, x, int(v)) for x, v in enumerate(row)]
    return A.mask_regions(spark.createDataFrame(px, "image string, y int, x int, value int"), [1, 2, 3], 3, False)


def src9_pins(spark, d):
    """Files of the images table against the split table as pins, written and read back."""
    s = _split(spark, d).groupBy("file").agg(F.max("split").alias("split"))
    folder = new_folder(spark, "src9")
    files.write_split(s, folder)
    items = load(spark, d, "fingerprints").where("file is not null").select(file_key(F.col("file")).alias("uid")).distinct()
    return files.read_pins(spark, folder, items)[1]


def src11_list_faults(spark, d):
    """The lists of all splits, read back: names in several lists, and names without a fingerprint."""
    folder = new_folder(spark, "src11")
    files.write_lists(_split(spark, d), folder)
    there = load(spark, d, "fingerprints").where("file is not null").select(file_key(F.col("file")).alias("path"))
    return files.list_faults(files.read_list(spark, folder), there)


def src13_report(spark, d):
    """Counts per source as JSON documents, read back; a report that is not there is None."""
    n = load(spark, d, "split").groupBy("source").agg(F.count("*").alias("n"))
    folder = new_folder(spark, "src13")
    files.write_report(n, folder)
    assert files.read_report(spark, folder + "-none", "n long") is None
    return files.read_report(spark, folder, "source string, n long", True)


def src14_epochs(spark, d):
    f = _folder(spark, "src14", {"e.csv": " epoch,  metrics/mAP50(B) , lr \n 1, 0.5,0.1\n 2, 0.625 ,0.01\n"})
    return files.read_epochs(spark, f"{f}/e.csv").select("epoch", F.col("`metrics/mAP50(B)`").alias("map50"), "lr")


def src15_picture_files(spark, d):
    return A.picture_files(spark, _folder(spark, "src15", {"a.png": b"not a picture", "b/c.JPG": b"x", "note.txt": "x"}))


def src16_location(spark, d):
    """Folders of the images table whose name holds ``a``, the outermost ones."""
    up = F.regexp_extract("uid", "^(.*)/", 1)
    folders = load(spark, d, "images").where("uid is not null").select(up.alias("path")).where("path <> ''").distinct()
    return files.located(folders, ["a"], contains=True)


def src17_tree(spark, d):
    f = _folder(spark, "src17", {"a/x.txt": "12345", "a/b/y.txt": "1", "skip/z.txt": "123", "w.bin": "1"})
    return A.tree(spark, f, ["skip"])


def snk1_split_file(spark, d):
    """The split file, written and read back."""
    folder = new_folder(spark, "snk1")
    files.write_split(_split(spark, d), folder)
    return files.read_split(spark, folder).select("split", "file", "source")


def snk2_lists(spark, d):
    """Names per list, with how often each stands there."""
    folder = new_folder(spark, "snk2")
    files.write_lists(_split(spark, d), folder, ("split", "source"))
    return spark.read.text(folder).groupBy("split", "source").agg(F.count("*").alias("files"), F.min("value").alias("first"), F.max("value").alias("last"))


def snk7_relocated(spark, d):
    """Files of the split table moved to another folder, and whether the fingerprints hold them there."""
    moved = files.relocated(_split(spark, d).select(F.concat(F.lit("/old/"), "file").alias("p")).distinct(), "p", "/new/")
    there = load(spark, d, "fingerprints").where("file is not null").select(file_key(F.col("file")).alias("path"))
    lost = files.missing_files(moved, "p", there).withColumn("lost", F.lit(True))
    return moved.join(lost, "p", "left").select("p", F.coalesce("lost", F.lit(False)).alias("lost"))


def snk8_class_prefix(spark, d):
    """Label lines of the first four classes: lines that every image keeps."""
    return files.class_prefix(load(spark, d, "label_lines").where("line is not null"), 4, ["source", "uid"])[2]


def snk8_removed(spark, d):
    return files.class_prefix(load(spark, d, "label_lines").where("line is not null"), 4, ["source", "uid"])[1]


def snk10_log(spark, d):
    """A log of all events by type, appended in two steps that overlap: nothing is written twice."""
    e = load(spark, d, "events").select("event_id", "event_type")
    path = new_folder(spark, "snk10")
    replay.append_new(spark, path, e.where("event_type <> 'view'"), ["event_id"])
    replay.append_new(spark, path, e, ["event_id"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


def prj2_categories(spark, d):
    """Outcomes of the split table's classes under a map: unknown, dropped images, crowds, drops and classes, in this order."""
    r = load(spark, d, "split").select(F.lower(F.trim("dominant_class")).alias("c"), F.when(F.col("row_id") % 7 == 0, 1).otherwise(0).alias("crowd"))
    rules = {"glass": "GLASS", "metal": "METAL", "paper": "drop_annotation", "other": "drop_image", "bio": "BIO"}
    return r.groupBy(classmap.mapped_category(F.col("c"), F.col("crowd"), rules).alias("outcome")).agg(F.count("*").alias("n"))


def prj3_objects(spark, d):
    """Outcomes of objects with tags: an override, a dropped image, a bad box, a drop or the class."""
    r = load(spark, d, "split").select(
        F.create_map(F.lit("material"), F.lower(F.trim("dominant_class")), F.lit("state"), F.when(F.col("row_id") % 5 == 0, "wet").otherwise("dry")).alias("tags"),
        (F.col("row_id") % 11 != 0).alias("has_box"),
    )
    out = classmap.object_outcome(F.col("tags"), F.col("has_box"), [("state", "wet", "drop_and_mask")], "material", {"glass": "GLASS", "paper": "drop_annotation", "other": "drop_image"}, "OTHER")
    return r.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


def set7_outermost_folders(spark, d):
    f = load(spark, d, "images").where("uid is not null").select(F.regexp_extract("uid", "^(.*)/", 1).alias("path")).where("path <> ''").distinct()
    return files.outermost(f)


def sclr_base_names(spark, d):
    f = load(spark, d, "fingerprints").where("file is not null").select("file").distinct()
    return f.select("file", base_name(F.concat(F.lit("a\\b/"), "file")).alias("name"))


QUERIES = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_K = "nullif(regexp_replace(lower({0}), '[\\s_-]+', '', 'g'), '')"
_C = "nullif(regexp_replace(lower({0}), '[\\s[:punct:]]+', '', 'g'), '')"
_S = f"""s as (
    select distinct * from (select case when {_C.format('split')} in ('val', 'validation') then 'valid' else {_C.format('split')} end split, lower(file) file, {_K.format('source')} source from split where file is not null) where split in ('train', 'valid', 'test')
), p as (
    select distinct lower(file) f from fingerprints where file is not null
)"""
_F = "f as (select distinct regexp_extract(uid, '^(.*)/', 1) path from images where uid is not null and contains(uid, '/'))"
SQL = {
    "src1_label_folder": "select * from (values ('t/images/a.jpg', 't/labels/a.txt', true, 2::bigint), ('t/images/b.PNG', 't/labels/b.txt', false, 0), (null, 'v/labels/c.txt', true, 1), ('images/images/q.webp', 'images/labels/q.txt', false, 0)) t(uid, label_path, has_label, n)",
    "src3_coco": "select * from (values ('a.jpg', 3::bigint, 1::bigint, 'metal', 0, 10.0::double, 10.0::double, 20.0::double, 30.0::double), ('a.jpg', 3, 2, null, 1, 1, 1, 1, 1), ('a.jpg', 3, 4, 'jar', 0, 3, 4, 5, 6), ('b.jpg', 0, null, null, null, null, null, null, null)) t(file_name, n, ann, cls, crowd, x, y, w, h)",
    "src4_supervisely": "select * from (values ('ds/a.jpg', 0, 'glass', false, 10::double, 20::double, 20::double, 40::double, null, true), ('ds/a.jpg', 1, 'OTHER', true, 10, 20, 20, 40, null, false), ('ds/a.jpg', 2, 'untagged', false, null, null, null, null, 'unsupported_geometry:bitmap', true)) t(uid, obj_no, cls, override, x, y, w, h, problem, known)",
    "src5_labelme": "select * from (values ('a/1.json', 'plastic bottle', 1::double, 3::double), ('a/1.json', 'glass', 0, 10), ('a/2.json', 'second_json_for_same_image_skipped', null, null), ('a/3.json', 'non_labelme_json_skipped', null, null), ('a/4.json', 'unreadable_json_skipped', null, null)) t(json, what, x, w)",
    "src6_mask_pairs": "select * from (values ('a.png', 'mask_a.png', 'paired'), ('b/c.jpg', null, 'image_without_mask'), (null, 'mask_q.png', 'mask_without_image')) t(image, mask, state)",
    "src7_mask_regions": "select * from (values ('m', 1::bigint, 0::bigint, 0::bigint, 2::bigint, 2::bigint, 3::bigint), ('m', 2, 4, 0, 3, 3, 3)) t(image, value, x, y, w, h, dropped)",
    "src9_pins": f"with {_S}, a as (select distinct file from s) select (select count(*) from a) as csv_rows, (select count(*) from a where file in (select f from p)) as pinned_images, (select count(*) from p where f not in (select file from a)) as images_not_in_csv, (select count(*) from a where file not in (select f from p)) as csv_rows_not_in_source",
    "src11_list_faults": f"with {_S}, l as (select file, count(*) n from (select file, split, source from s) group by file) select 'repeated' as fault, file from l where n > 1 union all select 'missing', file from l where file not in (select f from p)",
    "src13_report": "select source, count(*) as n from split group by source",
    "src14_epochs": "select * from (values (1, 0.5::double, 0.1::double), (2, 0.625, 0.01)) t(epoch, map50, lr)",
    "src15_picture_files": "select * from (values ('a.png', md5('not a picture'), 13::bigint, 'unreadable'), ('b/c.JPG', md5('x'), 1, 'unreadable')) t(path, md5, length, error)",
    "src16_location": f"with {_F}, h as (select path from f where contains(regexp_replace(lower(regexp_extract(path, '([^/]*)$', 1)), '[^a-z0-9]', '', 'g'), 'a') and len(string_split(path, '/')) <= 7) select path from h where not exists (select 1 from h g where starts_with(h.path, g.path || '/'))",
    "src17_tree": "select * from (values ('a/x.txt', 5::bigint), ('a/b/y.txt', 1), ('w.bin', 1)) t(rel, length)",
    "snk1_split_file": f"with {_S} select split, file, source from s",
    "snk2_lists": f"with {_S} select split, source, count(*) as files, min(file) as first, max(file) as last from s group by all",
    "snk7_relocated": f"with {_S} select distinct '/new/' || file as p, file not in (select f from p) as lost from s",
    "snk8_class_prefix": "select source, uid, count(*) filter (where try_cast(split_part(trim(line), ' ', 1) as double) < 4 and trunc(try_cast(split_part(trim(line), ' ', 1) as double)) < 4) as lines from label_lines where line is not null group by all",
    "snk8_removed": "select trunc(c)::int as cls, count(*) as removed from (select try_cast(split_part(trim(line), ' ', 1) as double) c from label_lines where line is not null) where trunc(c) >= 4 and not isnan(c) and not isinf(c) group by 1",
    "snk10_log": "select event_type, count(*) as n from events group by 1",
    "prj2_categories": "select case when c is null or c not in ('glass', 'metal', 'paper', 'other', 'bio') then 'unknown_category_id' when c = 'other' then 'drop_image' when row_id % 7 = 0 then 'crowd' when c = 'paper' then 'drop_annotation' else upper(c) end as outcome, count(*) as n from (select row_id, lower(trim(dominant_class)) c from split) group by 1",
    "prj3_objects": "select case when row_id % 5 <> 0 and c = 'other' then 'drop_image' when row_id % 11 = 0 then 'invalid_bbox' when row_id % 5 = 0 then 'drop_and_mask' when c is null then 'OTHER' when c = 'paper' then 'drop_annotation' when c = 'glass' then 'GLASS' else 'unmapped' end as outcome, count(*) as n from (select row_id, lower(trim(dominant_class)) c from split) group by 1",
    "set7_outermost_folders": f"with {_F} select path from f where path <> '' and not exists (select 1 from f g where starts_with(f.path, g.path || '/') and g.path <> '')",
    "sclr_base_names": "select distinct file, regexp_extract(file, '([^/\\\\]*)$', 1) as name from fingerprints where file is not null",
}
