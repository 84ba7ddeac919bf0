"""Readers of annotation folders: label text files, COCO, Supervisely, Labelme and mask folders.

Every reader is a lazy scan over the file system of the cluster; files are listed and read by Spark, and nothing but counts
of problems is meant for the driver. Unreadable files become rows of ``problems`` instead of errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.boxes import circle_box, points_box
from gleanery.functions.text import base_name, file_stem, without_number

#: File name endings of images (fixed list).
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "webp")
_IMAGE = r"(?i)\.(" + "|".join(IMAGE_ENDINGS) + r")$"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, length, modificationTime)`` of all files below a folder; contents are not read. Empty files have no row, since the
    engine's file index leaves them out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return df.select("path", "length", "modificationTime")


def newest(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder).agg(F.max("modificationTime").alias("newest"))


def tree(spark: SparkSession, folder: str, exclude: list[str] | None = None) -> DataFrame:
    """Relative paths and sizes, without those below excluded folders."""
    out = listing(spark, folder).select(F.regexp_replace("path", "^.*?" + _quoted(folder.rstrip("/")) + "/", "").alias("rel"), "length")
    for e in exclude or []:
        out = out.where(~F.col("rel").startswith(e.rstrip("/") + "/"))
    return out


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def relative(path: Column, folder: str) -> Column:
    return F.regexp_replace(path, "^.*?" + _quoted(folder.rstrip("/")) + "/", "")


def label_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``images(uid, label_path)`` of every image below an ``images`` folder, and ``lines(label_path, line_no, line)``.

    An image's label stands at its path with the last ``images`` turned into ``labels`` and the ending into ``txt``.
    """
    files = listing(spark, folder).select(relative(F.col("path"), folder).alias("uid"))
    images = files.where(F.col("uid").rlike(_IMAGE) & F.col("uid").rlike(r"(^|/)images/"))
    label = F.regexp_replace(F.regexp_replace("uid", r"^(.*/)?images/((?!.*/?images/).*)$", "$1labels/$2"), r"\.[^.]*$", ".txt")
    images = images.select("uid", label.alias("label_path"))
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    text = text.select(relative(F.col("_metadata.file_path"), folder).alias("label_path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return images, text.select("label_path", (F.col("line_no") + 1).alias("line_no"), "line")


def labelled_images(images: DataFrame, lines: DataFrame) -> DataFrame:
    """Images with whether they have a label file; label files without an image come with a null uid."""
    has = lines.select("label_path").distinct().withColumn("has_label", F.lit(True))
    return images.join(has, "label_path", "full_outer").select("uid", "label_path", F.coalesce("has_label", F.lit(False)).alias("has_label"))


COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,iscrowd:int,area:double>>, "
    "categories array<struct<id:bigint,name:string,supercategory:string>>"
)


def coco(spark: SparkSession, path: str, class_from: str = "name") -> tuple[DataFrame, DataFrame]:
    """``images(id, file_name, width, height, n)`` and ``annotations(image_id, id, class, crowd, x, y, w, h)``.

    The class is the category's name or supercategory (its name where that is empty), null for unknown ids. Annotations of
    images that are not listed vanish; images without annotations stay with n = 0.
    """
    doc = spark.read.schema(COCO).option("multiLine", "true").json(path)
    images = doc.select(F.inline("images"))
    cats = doc.select(F.inline("categories")).select(
        F.col("id").alias("category_id"), (F.coalesce(F.nullif("supercategory", F.lit("")), "name") if class_from == "supercategory" else F.col("name")).alias("class")
    )
    ann = doc.select(F.inline("annotations"))
    ann = ann.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi").join(cats, "category_id", "left")
    box = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "w", "h"))]
    ann = ann.select("image_id", "id", "class", F.coalesce("iscrowd", F.lit(0)).alias("crowd"), *box)
    n = ann.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("n"))
    return images.join(n, "id", "left").na.fill(0, ["n"]), ann


SUPERVISELY = (
    "description string, size struct<width:int,height:int>, objects array<struct<classTitle:string,geometryType:string,points:struct<exterior:array<array<double>>>,tags:array<struct<name:string,value:string>>>>"
)


def supervisely(spark: SparkSession, folder: str, tag: str | None, overrides: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``(uid, width, height, obj_no, class, override, x, y, w, h, problem)``, one row per object of every ``ann/*.json``.

    The class is the target of the first override whose tag has that value, else the value of ``tag`` (``untagged`` without
    one), else, where no tag is named, the object's title.
    """
    doc = spark.read.schema(SUPERVISELY).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    doc = doc.select(relative(F.col("_metadata.file_path"), folder).alias("p"), "size", "objects").where(F.col("p").rlike("(^|/)ann/"))
    uid = F.regexp_replace(F.regexp_replace("p", r"(^|/)ann/", "$1"), r"\.json$", "")
    o = doc.select(uid.alias("uid"), "size", F.posexplode_outer("objects").alias("obj_no", "o"))
    tags = F.map_from_entries(F.array_distinct(F.filter(F.coalesce("o.tags", F.array().cast("array<struct<name:string,value:string>>")), lambda t: t["name"].isNotNull())))
    o = o.withColumn("t", F.when(F.col("o").isNotNull(), tags))
    hits = [F.when(F.try_element_at("t", F.lit(n)) == v, F.lit(c)) for n, v, c in overrides or []]
    over = F.coalesce(*hits, F.lit(None).cast("string"))
    plain = F.coalesce(F.try_element_at("t", F.lit(tag)), F.lit("untagged")) if tag else F.col("o.classTitle")
    ok = F.col("o.geometryType").isin("rectangle", "polygon")
    box = F.when(ok, points_box(F.col("o.points.exterior")))
    problem = F.when(F.col("o").isNull(), None).when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("unsupported_geometry:"), F.coalesce("o.geometryType", F.lit("")))).when(box.isNull(), "invalid_bbox")
    return o.select("uid", F.col("size.width").alias("width"), F.col("size.height").alias("height"), "obj_no", F.coalesce(over, plain).alias("class"), over.isNotNull().alias("override"), box.alias("b"), problem.alias("problem")).select(
        "uid", "width", "height", "obj_no", "class", "override", "b.*", "problem"
    )


def supervisely_tags(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """``(value)``: the values that a project's ``meta.json`` allows for a tag, besides ``untagged``."""
    doc = spark.read.schema("tags array<struct<name:string,values:array<string>>>").option("multiLine", "true").json(path)
    return doc.select(F.inline("tags")).where(F.col("name") == tag).select(F.explode("values").alias("value")).union(spark.createDataFrame([("untagged",)], "value string")).distinct()


LABELME = "version string, shapes array<struct<label:string,points:array<array<double>>,shape_type:string>>, imagePath string, imageData string, imageHeight int, imageWidth int"


def labelme(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``objects(uid, json, width, height, shape_no, class, x, y, w, h, problem)`` and ``problems(json, problem)``.

    Labels lose a trailing number; polygons, rectangles and circles become boxes. The image is the record's path, else the
    file's own stem; of several files for one image the first path wins. Embedded pictures are marked, not decoded.
    """
    raw = spark.read.schema(LABELME + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    raw = raw.select("*", relative(F.col("_metadata.file_path"), folder).alias("json"))
    problem = F.when(F.col("_bad").isNotNull(), "unreadable_json_skipped").when(F.col("shapes").isNull(), "non_labelme_json_skipped")
    good = raw.where(problem.isNull())
    image = F.concat_ws("/", F.nullif(F.regexp_extract("json", "^(.*)/[^/]*$", 1), F.lit("")), F.coalesce(F.nullif(base_name(F.col("imagePath")), F.lit("")), F.concat(file_stem(F.col("json")), F.lit(".jpg"))))
    good = good.withColumn("uid", image).withColumn("k", F.row_number().over(Window.partitionBy("uid").orderBy("json")))
    problems = raw.select("json", problem.alias("problem")).where("problem is not null").unionByName(good.where("k > 1").select("json", F.lit("second_json_for_same_image_skipped").alias("problem")))
    s = good.where("k = 1").select("uid", "json", F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.posexplode_outer("shapes").alias("shape_no", "s"))
    kind = F.coalesce("s.shape_type", F.lit("polygon"))
    p = F.col("s.points")
    at = lambda i, j: F.get(F.get(p, F.lit(i)), F.lit(j))
    circle = F.when(at(1, 1).isNotNull() & at(0, 1).isNotNull(), circle_box(at(0, 0), at(0, 1), at(1, 0), at(1, 1)))
    box = F.when(kind == "circle", circle).when(kind.isin("polygon", "rectangle"), points_box(p))
    fault = F.when(F.col("s").isNull(), None).when(~kind.isin("polygon", "rectangle", "circle"), F.concat(F.lit("unsupported_shape:"), kind)).when(box.isNull(), "invalid_bbox")
    out = s.select("uid", "json", "width", "height", "shape_no", without_number(F.col("s.label")).alias("class"), box.alias("b"), fault.alias("problem"))
    return out.select("uid", "json", "width", "height", "shape_no", "class", "b.*", "problem"), problems


def embedded_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """``(json, image_bytes)`` of Labelme files that hold their picture and have no image of their stem beside them."""
    raw = spark.read.schema(LABELME).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    raw = raw.where("shapes is not null and imageData is not null").select(relative(F.col("_metadata.file_path"), folder).alias("json"), F.try_to_binary("imageData", F.lit("base64")).alias("image_bytes"))
    there = listing(spark, folder).select(relative(F.col("path"), folder).alias("p")).where(F.col("p").rlike(_IMAGE))
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    return raw.withColumn("_s", stem("json")).join(there.select(stem("p").alias("_s")).distinct(), "_s", "left_anti").drop("_s").where("image_bytes is not null")


def mask_pairs(spark: SparkSession, folder: str, prefix: str = "mask_") -> DataFrame:
    """Images and masks of a folder paired by stem, with what lacks a partner."""
    f = listing(spark, folder).select(relative(F.col("path"), folder).alias("uid")).where(F.col("uid").rlike(_IMAGE)).withColumn("s", file_stem(F.col("uid")))
    m = f.where(F.col("s").startswith(prefix)).select(F.substring("s", F.lit(len(prefix) + 1), F.length("s")).alias("k"), F.col("uid").alias("mask"))
    i = f.where(~F.col("s").startswith(prefix)).select(F.col("s").alias("k"), F.col("uid").alias("image"))
    return i.join(m, "k", "full_outer").select("image", "mask", F.when(F.col("mask").isNull(), "image_without_mask").when(F.col("image").isNull(), "mask_without_image").otherwise("paired").alias("state"))


def regions(mask: np.ndarray, values: list[int], least: int, diagonal: bool) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Boxes (value, x, y, w, h) of the connected regions of each value, and how many were smaller than ``least`` pixels.

    Labels spread by minimum over neighbours until nothing changes, with whole-array operations.
    """
    out, small = [], 0
    for v in values:
        on = mask == v
        if not on.any():
            continue
        lab = np.where(on, np.arange(mask.size).reshape(mask.shape), mask.size)
        steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
        while True:
            new = lab.copy()
            for dy, dx in steps:
                a = (slice(0, mask.shape[0] - dy), slice(max(0, -dx), mask.shape[1] - max(0, dx)))
                b = (slice(dy, mask.shape[0]), slice(max(0, dx), mask.shape[1] - max(0, -dx)))
                both = on[a] & on[b]
                low = np.minimum(new[a], new[b])
                new[a] = np.where(both, low, new[a])
                new[b] = np.where(both, low, new[b])
            flat = np.append(new.ravel(), mask.size)
            new = np.where(on, flat[new], mask.size)
            if (new == lab).all():
                break
            lab = new
        for k in np.unique(lab[on]):
            y, x = np.nonzero(lab == k)
            if len(x) < least:
                small += 1
            else:
                out.append((v, int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
    return sorted(out), small


def mask_regions(pixels: DataFrame, values: list[int], least: int = 50, diagonal: bool = True, image: str = "image") -> DataFrame:
    """``(image, value, x, y, w, h, dropped)`` of a pixel table (image, y, x, value); one picture is one group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = np.full((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), -1)
        m[rows["y"], rows["x"]] = rows["value"]
        found, small = regions(m, values, least, diagonal)
        return pd.DataFrame([(key[0], *r, small) for r in found] or [(key[0], None, None, None, None, None, small)], columns=[image, "value", "x", "y", "w", "h", "dropped"]).astype({c: "Int64" for c in ("value", "x", "y", "w", "h", "dropped")})

    return pixels.groupBy(image).applyInPandas(run, f"{image} {dict(pixels.dtypes)[image]}, value long, x long, y long, w long, h long, dropped long")


def mask_faults(pixels: DataFrame, values: list[int], ignored: list[int], image: str = "image") -> DataFrame:
    """``(image, unknown)``: masks with values that are neither mapped nor ignored, and those values."""
    seen = pixels.groupBy(image).agg(F.collect_set("value").alias("v"))  # at most as many as a pixel has values
    return seen.select(image, F.array_sort(F.array_except("v", F.array(*[F.lit(x) for x in [*values, *ignored]]))).alias("unknown")).where(F.size("unknown") > 0)


def picture_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, md5, length, error)`` of every image file; ``error`` where it cannot be decoded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    raw = raw.select(relative(F.col("path"), folder).alias("path"), F.md5("content").alias("md5"), "length").where(F.col("path").rlike(_IMAGE))
    good = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)
    good = good.select(relative(F.col("image.origin"), folder).alias("path"), F.lit(1).alias("_g"))
    return raw.join(good, "path", "left").select("path", "md5", "length", F.when(F.col("_g").isNull(), "unreadable").alias("error"))


def picture_fingerprints(images: DataFrame, grid: int = 16, thumb: int = 8) -> DataFrame:
    """``(path, width, height, h0..h3, thumb)`` of decoded pictures (the ``image`` source): difference hash and grey thumbnail.

    Pictures are reduced by averaging over cells; flat ones (a single grey) have null hash and thumbnail.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cells(g: np.ndarray, h: int, w: int) -> np.ndarray:
            ys, xs = (np.arange(h) * g.shape[0]) // h, (np.arange(w) * g.shape[1]) // w
            total = np.add.reduceat(np.add.reduceat(g, ys, axis=0), xs, axis=1)
            n = np.maximum(1, np.diff(np.append(ys, g.shape[0])))[:, None] * np.maximum(1, np.diff(np.append(xs, g.shape[1])))[None, :]
            return total / n

        for part in parts:
            out = []
            for p, w, h, c, data in zip(part["path"], part["width"], part["height"], part["channels"], part["data"], strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h, w, c)[..., :3].astype(float)
                grey = px.mean(2) if c == 1 else px @ np.array([0.114, 0.587, 0.299])  # the source's channels are blue, green, red
                if np.ptp(grey) == 0:
                    out.append((p, w, h, None, None, None, None, None))
                    continue
                d = cells(grey, grid, grid + 1)
                words = np.packbits((d[:, 1:] > d[:, :-1]).ravel()).view(">u8").astype(np.uint64).view(np.int64)
                out.append((p, w, h, *[int(x) for x in words], [float(x) for x in cells(grey, thumb, thumb).ravel()]))
            yield pd.DataFrame(out, columns=["path", "width", "height", "h0", "h1", "h2", "h3", "thumb"]).astype({f"h{i}": "Int64" for i in range(4)})

    flat = images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, "path string, width int, height int, h0 long, h1 long, h2 long, h3 long, thumb array<double>")
