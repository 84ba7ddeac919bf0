"""Class maps with drop targets, and output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import file_stem, safe_name

#: Targets that are not classes (fixed names).
DROPS = ("drop_annotation", "drop_image", "drop_and_mask")


def _map(spark, class_map: dict[int, str], targets: list[str]) -> DataFrame:
    """A dimension of a few rows, made from the configuration."""
    rows = [(k, v if v in DROPS else None, targets.index(v) if v not in DROPS else None) for k, v in class_map.items()]
    return F.broadcast(spark.createDataFrame(rows, "cls int, drop string, target int"))


def mapped_boxes(boxes: DataFrame, class_map: dict[int, str], targets: list[str], key: tuple[str, ...] = ("source", "uid")) -> DataFrame:
    """Boxes with ``target`` class numbers; boxes of dropped classes go, and whole images where a class asks for it.

    Whether an image goes is a window over the image's own boxes, so one shuffle by image does.
    """
    m = boxes.join(_map(boxes.sparkSession, class_map, targets), "cls")
    gone = F.max((F.col("drop") == "drop_image").cast("int")).over(Window.partitionBy(*key))
    return m.withColumn("_gone", F.coalesce(gone, F.lit(0))).where("_gone = 0 and target is not null").drop("_gone", "drop")


def drop_reasons(boxes: DataFrame, class_map: dict[int, str], by: str = "source") -> DataFrame:
    m = boxes.join(_map(boxes.sparkSession, class_map, [v for v in class_map.values() if v not in DROPS]), "cls").where("drop is not null")
    return m.groupBy(by, F.col("drop").alias("reason")).agg(F.count("*").alias("n"))


def mapped_category(category: Column, crowd: Column, class_map: dict[str, str], unknown: str = "unknown_category_id") -> Column:
    """The outcome for an annotation: unknown category, drop_image, crowd, a drop, or the class kept, in this order."""
    target = F.try_element_at(F.create_map(*[F.lit(x) for kv in class_map.items() for x in kv]), category)
    return (
        F.when(category.isNull() | target.isNull(), F.lit(unknown)).when(target == "drop_image", "drop_image").when(F.coalesce(crowd, F.lit(0)) == 1, "crowd").otherwise(target)
    )


def mapped_object(tags: Column, overrides: list[tuple[str, str, str]], tag: str, class_map: dict[str, str]) -> Column:
    """The class of a tagged object: the first override that holds, else the tag's value, else ``untagged``."""
    hit = F.coalesce(*[F.when(F.try_element_at(tags, F.lit(name)) == value, F.lit(target)) for name, value, target in overrides], F.lit(None).cast("string"))
    value = F.coalesce(F.try_element_at(tags, F.lit(tag)), F.lit("untagged"))
    known = F.create_map(*[F.lit(x) for kv in class_map.items() for x in kv])
    return F.coalesce(hit, F.try_element_at(known, value), F.lit("unmapped"))


def object_outcome(tags: Column, has_box: Column, overrides: list[tuple[str, str, str]], tag: str, class_map: dict[str, str], untagged: str, problem: str = "invalid_bbox") -> Column:
    """The outcome for a tagged object: its target is that of the first override that holds, that of no tag, or that of the tag's
    value; ``drop_image`` goes before a bad box, and a bad box before everything else."""
    hit = F.coalesce(*[F.when(F.try_element_at(tags, F.lit(name)) == value, F.lit(target)) for name, value, target in overrides], F.lit(None).cast("string"))
    known = F.create_map(*[F.lit(x) for kv in class_map.items() for x in kv])
    value = F.try_element_at(tags, F.lit(tag))
    target = F.coalesce(hit, F.when(value.isNull(), untagged), F.try_element_at(known, value), F.lit("unmapped"))
    return F.when(target == "drop_image", target).when(~F.coalesce(has_box, F.lit(False)), problem).otherwise(target)


def file_names(images: DataFrame, source: str = "source", uid: str = "uid") -> DataFrame:
    """``file``: source, two underscores and a safe name; names equal but for case get a piece of the uid's md5."""
    name = F.concat(F.col(source), F.lit("__"), safe_name(file_stem(F.col(uid))))
    same = F.count("*").over(Window.partitionBy(F.lower("_f")))
    out = images.withColumn("_f", name).withColumn("_n", same)
    full = F.when(F.col("_n") > 1, F.concat("_f", F.lit("_"), F.substring(F.md5(F.col(uid).cast("binary")), 1, 8))).otherwise(F.col("_f"))
    return out.withColumn("file", F.concat(full, F.lit(".jpg"))).drop("_f", "_n")
