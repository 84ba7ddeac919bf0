"""Label lines: ``class cx cy w h``, or a class and a polygon, with every irregularity counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counters in the order of their rules (fixed names).
ISSUES = ("duplicate_lines", "malformed_lines", "polygon_lines", "bad_class_id", "out_of_range_coords", "zero_size_boxes")


def parsed_lines(lines: DataFrame, classes: int, key: tuple[str, ...] = ("source", "uid"), order: str = "line_no", text: str = "line") -> DataFrame:
    """Every non-blank line with its box (null where it is dropped) and one flag per issue.

    The rules in order: a line whose tokens were seen before in its image is a duplicate; lines that are not numbers, have a
    class that is not whole, any value that is not finite, or another number of values than 4 (box) or an even number from 6
    (polygon, which becomes its bounding box) are malformed; classes outside the list drop the box, values outside 0..1 are
    only counted, and boxes without an area are dropped.
    """
    tokens = F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ")
    out = lines.where(F.coalesce(F.length(F.trim(F.regexp_replace(F.col(text), r"\s+", " "))), F.lit(0)) > 0)
    out = out.select(*key, order, F.array_join(tokens, " ").alias("_t"), tokens.alias("_tok"))
    first = F.row_number().over(Window.partitionBy(*key, "_t").orderBy(order))
    out = out.withColumn("_dup", first > 1)
    number = F.transform("_tok", lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double")))  # no 1d or 1f
    out = out.withColumn("_v", number)
    fine = F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    cls = F.get("_v", F.lit(0))
    n = F.size("_v") - 1
    shape = F.when(n == 4, "box").when((n >= 6) & (n % 2 == 0), "polygon")
    out = out.withColumn("_good", F.coalesce(~F.col("_dup") & fine & (cls == F.floor(cls)) & shape.isNotNull(), F.lit(False)))
    out = out.withColumn("_shape", F.when(F.col("_good"), shape))
    rest = F.slice("_v", 2, F.greatest(n, F.lit(0)))
    xs = F.filter(rest, lambda v, i: i % 2 == 0)
    ys = F.filter(rest, lambda v, i: i % 2 == 1)
    out = out.withColumn("_r", F.when(F.col("_good"), rest)).withColumn("_xs", F.when(F.col("_shape") == "polygon", xs)).withColumn("_ys", F.when(F.col("_shape") == "polygon", ys))
    x0, x1, y0, y1 = F.array_min("_xs"), F.array_max("_xs"), F.array_min("_ys"), F.array_max("_ys")
    poly = F.col("_shape") == "polygon"
    pick = lambda i, p: F.when(poly, p).otherwise(F.get("_r", F.lit(i)))
    known = F.col("_good") & (cls >= 0) & (cls < classes)
    out = out.select(
        *key, order, "_dup", "_good", "_shape", "_r", known.alias("_known"), cls.try_cast("int").alias("cls"),
        pick(0, (x0 + x1) / 2).alias("cx"), pick(1, (y0 + y1) / 2).alias("cy"), pick(2, x1 - x0).alias("w"), pick(3, y1 - y0).alias("h"),
    )
    flat = (F.col("w") <= 0) | (F.col("h") <= 0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    outside = F.exists("_r", lambda v: (v < 0) | (v > 1))
    return out.select(
        *key, order, "cls", "cx", "cy", "w", "h",
        flag(F.col("_known") & ~flat).cast("boolean").alias("kept"),
        flag(F.col("_dup")).alias("duplicate_lines"),
        flag(~F.col("_dup") & ~F.col("_good")).alias("malformed_lines"),
        flag(F.col("_shape") == "polygon").alias("polygon_lines"),
        flag(F.col("_good") & ~F.col("_known")).alias("bad_class_id"),
        flag(F.col("_known") & outside).alias("out_of_range_coords"),
        flag(F.col("_known") & flat).alias("zero_size_boxes"),
    )


def boxes(lines: DataFrame, classes: int, **names) -> DataFrame:
    return parsed_lines(lines, classes, **names).where("kept").drop("kept", *ISSUES)


def issues(lines: DataFrame, classes: int, by: tuple[str, ...] = ("source",), **names) -> DataFrame:
    """Sums of the issue counters."""
    return parsed_lines(lines, classes, **names).groupBy(*by).agg(*[F.sum(i).alias(i) for i in ISSUES])


def label_text(cls: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """A label line with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, cx, cy, w, h)
