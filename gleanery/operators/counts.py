"""Counts, histograms, quality gates and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds of the quality gates (fixed values).
MOST_MISSING, MOST_DEGENERATE, DEGENERATE_AREA, TINY_AREA, LEAST_BOXES = 0.01, 0.30, 0.90, 0.01, 400
IMAGE = ["source", "uid"]


def _numbers(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("cls"))


def count_block(images: DataFrame, boxes: DataFrame, classes: int, by: list[str]) -> DataFrame:
    """Per group and class, zero-filled: images, boxes, images without boxes, images and boxes of the class.

    Boxes are counted per image and class first (small rows), and everything above is made of these counts.
    """
    per = boxes.join(images.select(*IMAGE), IMAGE, "left_semi").groupBy(*IMAGE, "cls").agg(F.count("*").alias("n"))
    per_image = per.groupBy(*IMAGE).agg(F.sum("n").alias("n"))
    whole = images.join(per_image, IMAGE, "left").groupBy(*by).agg(
        F.count("*").alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"), F.count(F.when(F.col("n").isNull(), 1)).alias("background")
    )
    of_class = per.groupBy(*by, "cls").agg(F.count("*").alias("class_images"), F.sum("n").alias("class_boxes"))
    grid = whole.crossJoin(F.broadcast(_numbers(images.sparkSession, classes)))  # a few class numbers
    return grid.join(of_class, [*by, "cls"], "left").na.fill(0, ["class_images", "class_boxes"]).select(
        *by, "cls", "images", "boxes", "background", "class_images", "class_boxes"
    )


def size_histogram(images: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent sizes (a top-k report; ties by size)."""
    return images.groupBy("width", "height").agg(F.count("*").alias("images")).orderBy(F.desc("images"), "width", "height").limit(most)


def grouping_sets(rows: DataFrame) -> DataFrame:
    """Counts by split, by domain and split, and by source and split."""
    sets = [["split"], ["domain", "split"], ["source", "split"]]
    level = F.grouping("domain") * 2 + F.grouping("source")
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], "domain", "source", "split").agg(level.cast("int").alias("level"), F.count("*").alias("n"))
    return out.select("level", "domain", "source", "split", "n")


def split_statistics(images: DataFrame, parsed: DataFrame, classes: list[str]) -> DataFrame:
    """Statistics of each split: ``images`` (source, uid, split, name_class), ``parsed`` label lines with their counters."""
    from gleanery.sources.labels import ISSUES

    own = F.array(*[F.when(F.col(f"_c{i}") > 0, F.lit(c.lower())) for i, c in enumerate(classes)])
    per = parsed.groupBy(*IMAGE).agg(
        F.count("*").alias("lines"), F.count_if("kept").alias("boxes"), *[F.count_if(F.col("kept") & (F.col("cls") == i)).alias(f"_c{i}") for i in range(len(classes))], *[F.sum(i).alias(i) for i in ISSUES]
    )
    j = images.join(per, IMAGE, "left")
    none = F.coalesce("boxes", F.lit(0)) == 0
    wrong = F.col("name_class").isin(*[c.lower() for c in classes]) & ~none & ~F.array_contains(F.array_compact(own), F.col("name_class"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.groupBy("split").agg(
        F.count("*").alias("images"), F.count_if(F.col("lines").isNull()).alias("missing_labels"), F.count_if(none).alias("background"), count("boxes").alias("boxes"),
        *[count(f"_c{i}").alias(f"boxes_{c.lower()}") for i, c in enumerate(classes)], *[F.count_if(F.col(f"_c{i}") > 0).alias(f"images_{c.lower()}") for i, c in enumerate(classes)],
        *[count(i).alias(i) for i in ISSUES], F.count_if(wrong).alias("name_class_mismatch"),
    )


def reasons(wide: DataFrame, names: list[str], by: str = "source") -> DataFrame:
    """Counters in columns as rows of reason and count, without zeros."""
    return wide.unpivot([by], names, "reason", "n").where("n > 0")


def area_stats(boxes: DataFrame) -> DataFrame:
    area = F.col("w") * F.col("h")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    ps = (5, 25, 50, 75, 95)
    return boxes.agg(
        share(area > DEGENERATE_AREA).alias("large"), share(area < TINY_AREA).alias("tiny"), F.percentile(area, F.array(*[F.lit(p / 100) for p in ps])).alias("p")
    ).select("large", "tiny", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{p}") for i, p in enumerate(ps)])


def dominant_class(boxes: DataFrame) -> DataFrame:
    """The most frequent class of an image; of equally frequent ones the lowest."""
    per = boxes.groupBy(*IMAGE, "cls").agg(F.count("*").alias("n"))
    return per.groupBy(*IMAGE).agg(F.max_by("cls", F.struct("n", -F.col("cls"))).alias("dominant"))


def class_counts(boxes: DataFrame, classes: int) -> DataFrame:
    per = boxes.groupBy("cls").agg(F.count("*").alias("n"))
    return _numbers(boxes.sparkSession, classes).join(per, "cls", "left").na.fill(0, ["n"])


def thin_classes(boxes: DataFrame, classes: int, least: int) -> DataFrame:
    thin = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") < least, F.col("cls")))), lambda c: c.cast("string")), ",")
    return class_counts(boxes, classes).agg(F.min("n").alias("least"), F.nullif(thin, F.lit("")).alias("thin"))


def empty_reasons(images: DataFrame, lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per image whether it is kept, lost its boxes, or never had any."""
    had = lines.where(F.length(F.trim(F.regexp_replace("line", r"\s+", " "))) > 0).select(*IMAGE).distinct().withColumn("_had", F.lit(1))
    has = boxes.select(*IMAGE).distinct().withColumn("_has", F.lit(1))
    j = images.select(*IMAGE).join(had, IMAGE, "left").join(has, IMAGE, "left")
    return j.select(*IMAGE, F.when(F.col("_has") == 1, "kept").when(F.col("_had") == 1, "no_boxes_left").otherwise("no_annotations").alias("reason"))


def quality_gates(images: DataFrame, lines: DataFrame, boxes: DataFrame, classes: int) -> DataFrame:
    """One row per automatic check: its value and whether it passes."""
    from gleanery.sources.labels import issues

    labelled = lines.select(*IMAGE).distinct().withColumn("_l", F.lit(1))
    missing = images.join(labelled, IMAGE, "left").agg(F.avg(F.col("_l").isNull().cast("int")).alias("v"))
    large = boxes.agg(F.avg((F.col("w") * F.col("h") > DEGENERATE_AREA).cast("int")).alias("v"))
    least = class_counts(boxes, classes).agg(F.min("n").cast("double").alias("v"))
    bad = issues(lines, classes, by=())

    def row(df: DataFrame, name: str, passed) -> DataFrame:
        return df.select(F.lit(name).alias("check_name"), F.round("v", 6).alias("value"), passed(F.col("v")).alias("passed"))

    out = row(missing, "missing_labels", lambda v: v < MOST_MISSING)
    out = out.unionByName(row(large, "degenerate_boxes", lambda v: v < MOST_DEGENERATE))
    out = out.unionByName(row(least, "least_boxes_of_a_class", lambda v: v >= LEAST_BOXES))
    out = out.unionByName(row(bad.select(F.col("bad_class_id").cast("double").alias("v")), "bad_class_ids", lambda v: v == 0))
    return out.unionByName(row(bad.select(F.col("malformed_lines").cast("double").alias("v")), "malformed_lines", lambda v: v == 0))


def same_boxes(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per image whether two sets of boxes agree in any order within a tolerance (both sorted, joined by rank)."""
    from pyspark.sql import Window

    cols = ["cls", "cx", "cy", "w", "h"]
    rank = lambda df, p: df.select(*IMAGE, F.row_number().over(Window.partitionBy(*IMAGE).orderBy(*cols)).alias("_k"), *[F.col(c).alias(p + c) for c in cols])
    j = rank(a, "a_").join(rank(b, "b_"), [*IMAGE, "_k"], "full_outer")
    near = F.col("a_cls") == F.col("b_cls")
    for c in cols[1:]:
        near = near & (F.abs(F.col("a_" + c) - F.col("b_" + c)) <= tolerance)
    return j.groupBy(*IMAGE).agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("same"))
