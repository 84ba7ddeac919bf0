"""Queries over label lines, images and boxes: parsing, class mapping, geometry, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import boxes as B
from gleanery.functions import text as T
from gleanery.functions.names import class_key, source_key, split_key
from gleanery.operators import classmap, counts
from gleanery.sources import labels
from gleanery.tables import load

CLASSES = ("BIO", "CARDBOARD", "GLASS", "METAL", "PAPER", "PLASTIC", "OTHER")
#: An example of a class map with its three drop targets.
CLASS_MAP = {0: "BIO", 1: "PAPER", 2: "GLASS", 3: "drop_annotation", 4: "PAPER", 5: "PLASTIC", 6: "drop_image"}


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "label_lines")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return labels.boxes(_lines(spark, d), len(CLASSES))


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Images with usable sizes, one row each (repeated rows agree or are ordered by their values)."""
    w = Window.partitionBy("source", "uid").orderBy("width", "height", "split_hint")
    good = load(spark, d, "images").where("width > 0 and height > 0 and source is not null and uid is not null")
    return good.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(F.col(n), digits).alias(n) for n in names]


def src2_boxes(spark, d):
    return _boxes(spark, d).select("source", "uid", "line_no", "cls", *_r("cx", "cy", "w", "h"))


def src2_issues(spark, d):
    return labels.issues(_lines(spark, d), len(CLASSES))


def snk4_label_text(spark, d):
    b = _boxes(spark, d)
    return b.select("source", "uid", "line_no", labels.label_text(*[F.col(c) for c in ("cls", "cx", "cy", "w", "h")]).alias("line"))


def prj1_class_map(spark, d):
    return classmap.mapped_boxes(_boxes(spark, d), CLASS_MAP, list(CLASSES)).select("source", "uid", "line_no", "target", *_r("cx", "cy", "w", "h"))


def prj1_dropped(spark, d):
    return classmap.drop_reasons(_boxes(spark, d), CLASS_MAP)


def prj4_clip(spark, d):
    c = B.clipped(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    out = _boxes(spark, d).select("source", "uid", "line_no", c.alias("b")).where("b is not null")
    return out.select("source", "uid", "line_no", *[F.round(F.col(f"b.{n}"), 6).alias(n) for n in ("cx", "cy", "w", "h")])


def prj4_clipped_counts(spark, d):
    c = B.clipped(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    out = _boxes(spark, d).select("source", c.alias("b"))
    return out.groupBy("source").agg(F.count(F.when(F.col("b").isNull(), 1)).alias("empty"), F.count(F.when(F.col("b.moved"), 1)).alias("clipped_boxes"))


def _orientation() -> F.Column:
    """An orientation tag derived from the image's name."""
    return (F.conv(F.substring(F.md5(F.col("uid").cast("binary")), 1, 4), 16, 10).cast("int") % 8 + 1).alias("o")


def prj5_pixel_boxes(spark, d):
    """Pixel boxes as unit boxes; those of tags 2, 3 and 6 stand in the raw frame and are turned."""
    b, i = _boxes(spark, d), _images(spark, d).select("source", "uid", "width", "height", _orientation())
    px = b.join(i, ["source", "uid"]).select(
        "source", "uid", "line_no", "width", "height", "o", ((F.col("cx") - F.col("w") / 2) * F.col("width")).alias("x"),
        ((F.col("cy") - F.col("h") / 2) * F.col("height")).alias("y"), (F.col("w") * F.col("width")).alias("pw"), (F.col("h") * F.col("height")).alias("ph"),
    )
    frame = F.when(F.col("o").isin(2, 3, 6), "raw").otherwise("display")
    u = B.unit_box(*[F.col(c) for c in ("x", "y", "pw", "ph", "width", "height")], frame, F.col("o"))
    out = px.select("source", "uid", "line_no", u.alias("b")).where("b is not null")
    return out.select("source", "uid", "line_no", *[F.round(F.col(f"b.{n}"), 7).alias(n) for n in ("cx", "cy", "w", "h")])


def prj6_frames(spark, d):
    """Recorded sizes, as they are and halved, against the raw size of a picture with that tag: frames and warnings."""
    i = load(spark, d, "images").where("width is not null and height is not null and source is not null and uid is not null")
    f = i.select("source", "width", "height", _orientation(), F.explode(F.array(F.lit(1), F.lit(2))).alias("scale"))
    swap = F.col("o").isin(5, 7)
    raw = F.when(swap, F.col("height")).otherwise(F.col("width")), F.when(swap, F.col("width")).otherwise(F.col("height"))
    fr = B.frame(F.col("width"), F.col("height"), raw[0] * F.col("scale"), raw[1] * F.col("scale"), F.col("o"))
    out = f.select("source", "scale", fr.alias("fr")).groupBy("source", "scale", F.col("fr.frame").alias("frame"))
    return out.agg(F.count("*").alias("n"), F.count_if("fr.assumed").alias("assumed"), F.count_if("fr.rescaled").alias("rescaled"))


def prj7_oriented(spark, d):
    p = B.oriented(F.col("cx"), F.col("cy"), F.pmod(F.col("line_no"), F.lit(8)) + 1)
    return _boxes(spark, d).select("source", "uid", "line_no", p.alias("p")).select("source", "uid", "line_no", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def prj8_points_box(spark, d):
    """Boxes around the centres of each image."""
    g = _boxes(spark, d).groupBy("source", "uid").agg(F.collect_list(F.array("cx", "cy")).alias("p")).select("source", "uid", B.points_box(F.col("p")).alias("b"))
    return g.where("b is not null").select("source", "uid", *[F.round(F.col(f"b.{n}"), 6).alias(n) for n in ("x", "y", "w", "h")])


def prj9_circle_box(spark, d):
    b = B.circle_box(F.col("cx"), F.col("cy"), F.col("cx") + F.col("w"), F.col("cy") + F.col("h"))
    return _boxes(spark, d).select("source", "uid", "line_no", b.alias("b")).select("source", "uid", "line_no", *[F.round(F.col(f"b.{n}"), 6).alias(n) for n in ("x", "y", "w", "h")])


def prj10_corners(spark, d):
    x0, y0, x1, y1 = B.corners(*[F.col(c) for c in ("cx", "cy", "w", "h")])
    return _boxes(spark, d).select("source", "uid", "line_no", *[F.round(v, 6).alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def prj11_overlaps(spark, d):
    """Overlap of successive boxes of an image."""
    w = Window.partitionBy("source", "uid").orderBy("line_no", "cls", "cx", "cy", "w", "h")
    prev = _boxes(spark, d).select("*", *[F.lag(c).over(w).alias(f"p{c}") for c in ("cx", "cy", "w", "h")]).where("pcx is not null")
    a = B.corners(*[F.col(c) for c in ("cx", "cy", "w", "h")])
    b = B.corners(*[F.col(f"p{c}") for c in ("cx", "cy", "w", "h")])
    return prev.select("source", "uid", "line_no", F.round(B.overlap(a, b), 6).alias("iou"))


def prj13_file_names(spark, d):
    return classmap.file_names(_images(spark, d).select("source", "uid")).select("source", "uid", "file")


def fil1_class_prefix(spark, d):
    b = _boxes(spark, d)
    return b.where("cls >= 4").groupBy("cls").agg(F.count("*").alias("removed"))


def fil2_keep_empty(spark, d):
    return counts.empty_reasons(_images(spark, d), _lines(spark, d), _boxes(spark, d).where("cls < 3")).groupBy("reason").agg(F.count("*").alias("images"))


def fil6_min_boxes(spark, d):
    return _boxes(spark, d).groupBy("source", "uid").agg(F.count("*").alias("boxes")).where("boxes >= 5")


def fil6_single_objects(spark, d):
    """Images with exactly one box, and its class."""
    per = _boxes(spark, d).groupBy("source", "uid").agg(F.count("*").alias("n"), F.min("cls").alias("cls"))
    return per.where("n = 1").select("source", "uid", "cls")


def hlp19_summary(spark, d):
    """A line of text on each source: images, boxes, and boxes per image."""
    b = _boxes(spark, d).groupBy("source").agg(F.count("*").alias("boxes"), F.countDistinct("uid").alias("images"))
    return b.select("source", F.format_string("%s: %d images, %d boxes (%.2f per image)", "source", "images", "boxes", F.col("boxes") / F.col("images") + 1e-9).alias("line"))


def join1_images_with_boxes(spark, d):
    n = _boxes(spark, d).groupBy("source", "uid").agg(F.count("*").alias("n"))
    return _images(spark, d).join(n, ["source", "uid"], "left").select("source", "uid", F.coalesce("n", F.lit(0)).alias("boxes"))


def join2_category(spark, d):
    names = spark.createDataFrame([(i, c) for i, c in enumerate(CLASSES) if i != 6], "cls int, name string")
    return _boxes(spark, d).join(F.broadcast(names), "cls", "left").groupBy(F.coalesce("name", F.lit("unknown_category_id")).alias("category")).agg(F.count("*").alias("n"))


def join3_missing_labels(spark, d):
    i, l = _images(spark, d).select("source", "uid"), _lines(spark, d).select("source", "uid").distinct()
    a = i.join(l, ["source", "uid"], "left_anti").agg(F.count("*").alias("n")).select(F.lit("images_without_labels").alias("what"), "n")
    return a.unionByName(l.join(i, ["source", "uid"], "left_anti").agg(F.count("*").alias("n")).select(F.lit("labels_without_image").alias("what"), "n"))


def join4_full_outer(spark, d):
    i = _images(spark, d).select("source").distinct().withColumn("a", F.lit(1))
    l = load(spark, d, "sources").select(F.col("source_name").alias("source")).distinct().withColumn("b", F.lit(1))
    j = i.join(l, "source", "full_outer")
    return j.select("source", F.when(F.col("a").isNull(), "no_images").when(F.col("b").isNull(), "not_listed").otherwise("both").alias("state"))


def agg1_count_block(spark, d):
    return counts.count_block(_images(spark, d), _boxes(spark, d), len(CLASSES), ["source"])


def agg2_split_stats(spark, d):
    """Per split: images, images without a label line or without boxes, boxes, each class's boxes and images, images whose
    source's class has no box, and the counters of the label rules."""
    rows = load(spark, d, "split").where("source is not null and source_file is not null")
    cls = class_key(F.col("source_class"))
    im = rows.groupBy("source", F.col("source_file").alias("uid")).agg(F.min(split_key(F.col("split"))).alias("split"), F.min(cls).alias("name_class"))
    return counts.split_statistics(im.where("split is not null"), labels.parsed_lines(_lines(spark, d), len(CLASSES)), list(CLASSES))


def agg2_image_sizes(spark, d):
    return counts.size_histogram(_images(spark, d))


def agg3_grouping_sets(spark, d):
    s = load(spark, d, "split").select(source_key(F.col("source")).alias("source"), source_key(F.col("domain")).alias("domain"), class_key(F.col("split")).alias("split"))
    return counts.grouping_sets(s)


def agg4_reasons(spark, d):
    return counts.reasons(labels.issues(_lines(spark, d), len(CLASSES)), list(labels.ISSUES))


def agg5_box_areas(spark, d):
    return counts.area_stats(_boxes(spark, d))


def agg6_dominant_class(spark, d):
    return counts.dominant_class(_boxes(spark, d))


def agg29_thin_classes(spark, d):
    return counts.thin_classes(_boxes(spark, d), len(CLASSES), 400)


def win14_first_occurrence(spark, d):
    w = Window.partitionBy("source", "uid", "line").orderBy("line_no")
    return _lines(spark, d).withColumn("k", F.row_number().over(w)).where("k > 1").groupBy("source").agg(F.count("*").alias("repeats"))


def fil9_quality_gates(spark, d):
    return counts.quality_gates(_images(spark, d), _lines(spark, d), _boxes(spark, d), len(CLASSES))


def hlp6_box_tolerance(spark, d):
    """Images whose boxes, sorted, agree with the same boxes shifted by half a hundredth."""
    b = _boxes(spark, d).select("source", "uid", "cls", "cx", "cy", "w", "h")
    return counts.same_boxes(b, b.withColumn("cx", F.col("cx") + 0.005)).groupBy("same").agg(F.count("*").alias("images"))


def sclr_text(spark, d):
    s = load(spark, d, "split").where("file is not null and source_file is not null")
    f, u = F.col("file"), F.col("source_file")
    return s.select(
        "row_id", T.bare(f).alias("bare"), T.without_number(T.file_stem(f)).alias("no_number"), T.safe_name(u).alias("safe"), T.leading_letters(f).alias("letters"),
        T.base_name(u).alias("base"), T.file_stem(u).alias("stem"), F.substring(F.sha2(f.cast("binary"), 256), 1, 12).alias("sha"),
    )


def sclr_math(spark, d):
    l = load(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount").distinct()
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return l.select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", T.six_digits(F.sqrt(p)).alias("six"), F.round(F.hypot(q, F.lit(3.0)), 6).alias("hyp"), F.round(F.log10(p), 6).alias("lg"),
        F.round(T.luminance(q * 5, q, q * 2), 6).alias("lum"), T.close(p, p * (1 + F.col("l_discount") * 1e-5), 5e-7).alias("near"), T.finite(p).alias("ok"),
    )


def sclr_lists(spark, d):
    g = load(spark, d, "sources").groupBy("annot_format").agg(F.sort_array(F.collect_set("domain")).alias("x"))
    return g.select("annot_format", T.spoken_list(F.col("x")).alias("domains"), F.array_join(T.class_range(F.lit("0-5")), "|").alias("a"), F.array_join(T.class_range(F.lit("0, 1")), "|").alias("b"), T.domain_of(F.concat(F.lit("data_test_"), F.col("annot_format"), F.lit(".yaml"))).alias("dom"))


_NAMES = [n for n in dir() if n.split("_")[0].rstrip("0123456789") in ("src", "snk", "prj", "fil", "join", "agg", "win", "hlp", "sclr")]
QUERIES = {n: globals()[n] for n in _NAMES}

_LINES = r"""
lt as (
    select source, uid, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) t from label_lines where length(trim(regexp_replace(line, '\s+', ' ', 'g'))) > 0
), ld as (
    select *, row_number() over (partition by source, uid, t order by line_no) > 1 dup, string_split(t, ' ') tok from lt
), lv as (
    select *, list_transform(tok, lambda x: try_cast(x as double)) v from ld
), lg as (
    select *, len(v) - 1 n, coalesce(not dup and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and v[1] = floor(v[1])
        and (len(v) = 5 or (len(v) >= 7 and len(v) % 2 = 1)), false) good from lv
), lr as (
    select *, good and v[1] >= 0 and v[1] < 7 known, good and n > 4 poly, v[2:] r,
        list_filter(v[2:], lambda x, i: i % 2 = 1) xs, list_filter(v[2:], lambda x, i: i % 2 = 0) ys from lg
), lb as (
    select source, uid, line_no, dup, good, known, poly, r, case when good then v[1]::int end cls,
        case when poly then (list_min(xs) + list_max(xs)) / 2 else r[1] end cx, case when poly then (list_min(ys) + list_max(ys)) / 2 else r[2] end cy,
        case when poly then list_max(xs) - list_min(xs) else r[3] end w, case when poly then list_max(ys) - list_min(ys) else r[4] end h from lr
), b as (
    select source, uid, line_no, cls, cx, cy, w, h from lb where known and w > 0 and h > 0
), i as (
    select source, uid, width, height, split_hint from images where width > 0 and height > 0 and source is not null and uid is not null
    qualify row_number() over (partition by source, uid order by width, height nulls first, split_hint nulls first) = 1
), iss as (
    select source, sum(dup::int)::bigint duplicate_lines, sum((not dup and not good)::int)::bigint malformed_lines, sum(poly::int)::bigint polygon_lines,
        sum((good and not known)::int)::bigint bad_class_id, sum((known and len(list_filter(r, lambda x: x < 0 or x > 1)) > 0)::int)::bigint out_of_range_coords,
        sum((known and (w <= 0 or h <= 0))::int)::bigint zero_size_boxes from lb group by source
)"""
_CLIP = """, c as (
    select *, greatest(cx - w / 2, 0) a0, greatest(cy - h / 2, 0) b0, least(cx + w / 2, 1) a1, least(cy + h / 2, 1) b1 from b
)"""
_KEY = "nullif(regexp_replace(lower({0}), '[\\s_-]+', '', 'g'), '')"
_CKEY = "nullif(regexp_replace(lower({0}), '[\\s[:punct:]]+', '', 'g'), '')"


def _q(body: str, more: str = "") -> str:
    return f"with {_LINES.strip()}{more}\n{body}"


SQL = {
    "src2_boxes": _q("select source, uid, line_no, cls, round(cx, 6) as cx, round(cy, 6) as cy, round(w, 6) as w, round(h, 6) as h from b"),
    "src2_issues": _q("select * from iss"),
    "snk4_label_text": _q("select source, uid, line_no, format('{:d} {:.6f} {:.6f} {:.6f} {:.6f}', cls, cx, cy, w, h) as line from b"),
    "prj1_class_map": _q(
        "select source, uid, line_no, case cls when 0 then 0 when 1 then 4 when 2 then 2 when 4 then 4 when 5 then 5 end as target, round(cx, 6) as cx, round(cy, 6) as cy, round(w, 6) as w, round(h, 6) as h from b "
        "where cls <> 3 and (source, uid) not in (select source, uid from b where cls = 6)"
    ),
    "prj1_dropped": _q(
        "select source, case cls when 3 then 'drop_annotation' else 'drop_image' end as reason, count(*) as n from b where cls in (3, 6) group by all"
    ),
    "prj4_clip": _q("select source, uid, line_no, round((a0 + a1) / 2, 6) as cx, round((b0 + b1) / 2, 6) as cy, round(a1 - a0, 6) as w, round(b1 - b0, 6) as h from c where a1 > a0 and b1 > b0", _CLIP),
    "prj4_clipped_counts": _q(
        "select source, count(*) filter (where not (a1 > a0 and b1 > b0)) as empty, count(*) filter (where a1 > a0 and b1 > b0 and greatest(abs(a0 - (cx - w / 2)), abs(b0 - (cy - h / 2)), abs(a1 - (cx + w / 2)), abs(b1 - (cy + h / 2))) > 1e-6) as clipped_boxes from c group by source", _CLIP
    ),
    "prj5_pixel_boxes": _q(
        """select source, uid, line_no, round((a0 + a1) / 2, 7) as cx, round((b0 + b1) / 2, 7) as cy, round(a1 - a0, 7) as w, round(b1 - b0, 7) as h from u where a1 > a0 and b1 > b0""",
        """, px as (
    select b.source, b.uid, line_no, width, height, ('0x' || substr(md5(b.uid), 1, 4))::int % 8 + 1 o, (cx - w / 2) * width x, (cy - h / 2) * height y, w * width pw, h * height ph
    from b join i on i.source = b.source and i.uid = b.uid
), xy as (
    select *, x / width x0, y / height y0, (x + pw) / width x1, (y + ph) / height y1 from px where pw > 0 and ph > 0
), t as (
    select source, uid, line_no, case o when 2 then [1 - x1, y0, 1 - x0, y1] when 3 then [1 - x1, 1 - y1, 1 - x0, 1 - y0] when 6 then [1 - y1, x0, 1 - y0, x1] else [x0, y0, x1, y1] end q from xy
), u as (
    select source, uid, line_no, greatest(q[1], 0) a0, greatest(q[2], 0) b0, least(q[3], 1) a1, least(q[4], 1) b1 from t
)""",
    ),
    "prj6_frames": """
with f as (
    select source, width w, height h, ('0x' || substr(md5(uid), 1, 4))::int % 8 + 1 o, s::int as scale from images, unnest([1, 2]) x(s) where width is not null and height is not null and source is not null and uid is not null
), g as (
    select *, case when o in (5, 7) then h else w end * scale rw, case when o in (5, 7) then w else h end * scale rh from f
), e as (
    select *, case when o >= 5 then rh else rw end dw, case when o >= 5 then rw else rh end dh from g
), m as (
    select *, abs(w * dh - h * dw) <= 0.02 * greatest(w * dh, h * dw) md, abs(w * rh - h * rw) <= 0.02 * greatest(w * rh, h * rw) mr from e
), c as (
    select *, o > 1 and mr and not md as is_raw, o > 1 and mr = md as assumed from m
)
select source, scale, case when w > 0 and h > 0 and (case when is_raw then mr else md end) then (case when is_raw then 'raw' else 'display' end) else 'mismatch' end as frame,
    count(*) as n, count(*) filter (where assumed) as assumed,
    count(*) filter (where w > 0 and h > 0 and (case when is_raw then mr else md end) and (w <> (case when is_raw then rw else dw end) or h <> (case when is_raw then rh else dh end))) as rescaled
from c group by all
""",
    "prj7_oriented": _q("""select source, uid, line_no,
    round(case (line_no % 8 + 8) % 8 + 1 when 2 then 1 - cx when 3 then 1 - cx when 5 then cy when 6 then 1 - cy when 7 then 1 - cy when 8 then cy else cx end, 6) as x,
    round(case (line_no % 8 + 8) % 8 + 1 when 3 then 1 - cy when 4 then 1 - cy when 5 then cx when 6 then cx when 7 then 1 - cx when 8 then 1 - cx else cy end, 6) as y from b"""),
    "prj8_points_box": _q("select source, uid, round(min(cx), 6) as x, round(min(cy), 6) as y, round(max(cx) - min(cx), 6) as w, round(max(cy) - min(cy), 6) as h from b group by source, uid having count(*) >= 2"),
    "prj9_circle_box": _q("select source, uid, line_no, round(cx - sqrt(w * w + h * h), 6) as x, round(cy - sqrt(w * w + h * h), 6) as y, round(2 * sqrt(w * w + h * h), 6) as w, round(2 * sqrt(w * w + h * h), 6) as h from b"),
    "prj10_corners": _q("select source, uid, line_no, round(cx - w / 2, 6) as x0, round(cy - h / 2, 6) as y0, round(cx + w / 2, 6) as x1, round(cy + h / 2, 6) as y1 from b"),
    "prj11_overlaps": _q(
        "select source, uid, line_no, round(case when iw > 0 and ih > 0 then iw * ih / (w * h + pw * ph - iw * ih) else 0 end, 6) as iou from p2",
        """, p as (
    select *, lag(cx) over o pcx, lag(cy) over o pcy, lag(w) over o pw, lag(h) over o ph from b window o as (partition by source, uid order by line_no, cls, cx, cy, w, h)
), p2 as (
    select *, least(cx + w / 2, pcx + pw / 2) - greatest(cx - w / 2, pcx - pw / 2) iw, least(cy + h / 2, pcy + ph / 2) - greatest(cy - h / 2, pcy - ph / 2) ih from p where pcx is not null
)""",
    ),
    "prj13_file_names": _q(
        "select source, uid, case when count(*) over (partition by lower(f)) > 1 then f || '_' || substr(md5(uid), 1, 8) else f end || '.jpg' as file from n",
        """, n as (
    select source, uid, source || '__' || coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(string_split(replace(uid, '\\', '/'), '/')[-1], '\\.[^.]*$', ''), '[^A-Za-z0-9.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'img') f from i
)""",
    ),
    "fil1_class_prefix": _q("select cls, count(*) as removed from b where cls >= 4 group by cls"),
    "fil2_keep_empty": _q(
        """select case when k.n > 0 then 'kept' when l.n > 0 then 'no_boxes_left' else 'no_annotations' end as reason, count(*) as images
from i left join (select source, uid, count(*) n from label_lines where length(trim(regexp_replace(line, '\\s+', ' ', 'g'))) > 0 group by all) l using (source, uid)
left join (select source, uid, count(*) n from b where cls < 3 group by all) k using (source, uid) group by 1"""
    ),
    "fil6_min_boxes": _q("select source, uid, count(*) as boxes from b group by source, uid having count(*) >= 5"),
    "fil6_single_objects": _q("select source, uid, min(cls) as cls from b group by all having count(*) = 1"),
    "hlp19_summary": _q("select source, format('{}: {} images, {} boxes ({:.2f} per image)', source, count(distinct uid), count(*), count(*) / count(distinct uid) + 1e-9) as line from b group by source"),
    "join1_images_with_boxes": _q("select source, uid, coalesce(n, 0) as boxes from i left join (select source, uid, count(*) n from b group by all) using (source, uid)"),
    "join2_category": _q("select coalesce(['BIO', 'CARDBOARD', 'GLASS', 'METAL', 'PAPER', 'PLASTIC'][cls + 1], 'unknown_category_id') as category, count(*) as n from b group by 1"),
    "join3_missing_labels": _q(
        "select 'images_without_labels' as what, count(*) as n from i where not exists (select 1 from label_lines l where l.source = i.source and l.uid = i.uid) union all "
        "select 'labels_without_image', count(*) from (select distinct source, uid from label_lines) l where not exists (select 1 from i where l.source = i.source and l.uid = i.uid)"
    ),
    "join4_full_outer": _q(
        "select coalesce(a.source, s.source_name) as source, case when a.source is null then 'no_images' when s.source_name is null then 'not_listed' else 'both' end as state "
        "from (select distinct source from i) a full join (select distinct source_name from sources) s on a.source = s.source_name"
    ),
    "agg1_count_block": _q(
        """select s.source, s.cls, images, boxes, background, coalesce(class_images, 0) as class_images, coalesce(class_boxes, 0) as class_boxes
from (select source, count(*) images, count(*) filter (where n is null) background, coalesce(sum(n), 0)::bigint boxes from i left join (select source, uid, count(*) n from b group by all) using (source, uid) group by source) t
join (select distinct source, unnest(range(7))::int cls from i) s on s.source = t.source
left join (select source, cls, count(*) class_boxes, count(distinct uid) class_images from b where (source, uid) in (select source, uid from i) group by all) x on x.source = s.source and x.cls = s.cls"""
    ),
    "agg2_split_stats": _q(
        "select split, count(*) as images, count(*) filter (where lines is null) as missing_labels, count(*) filter (where coalesce(boxes, 0) = 0) as background, coalesce(sum(boxes), 0)::bigint as boxes, "
        + ", ".join(f"coalesce(sum(c{i}), 0)::bigint as boxes_{c.lower()}, count(*) filter (where c{i} > 0) as images_{c.lower()}" for i, c in enumerate(CLASSES))
        + ", " + ", ".join(f"coalesce(sum({n}), 0)::bigint as {n}" for n in labels.ISSUES)
        + ", count(*) filter (where coalesce(boxes, 0) > 0 and (" + " or ".join(f"nc = '{c.lower()}' and c{i} = 0" for i, c in enumerate(CLASSES)) + ")) as name_class_mismatch from im left join per using (source, uid) where split is not null group by split",
        f""", im as (
    select source, source_file uid, min(case when {_CKEY.format('split')} in ('val', 'validation') then 'valid' else {_CKEY.format('split')} end) split, min({_CKEY.format('source_class')}) nc
    from split where source is not null and source_file is not null group by all
), per as (
    select source, uid, count(*) as lines, count(*) filter (where known and w > 0 and h > 0) boxes, {', '.join(f"count(*) filter (where known and w > 0 and h > 0 and cls = {i}) c{i}" for i in range(len(CLASSES)))},
        sum(dup::int) duplicate_lines, sum((not dup and not good)::int) malformed_lines, sum(poly::int) polygon_lines, sum((good and not known)::int) bad_class_id,
        sum((known and len(list_filter(r, lambda x: x < 0 or x > 1)) > 0)::int) out_of_range_coords, sum((known and (w <= 0 or h <= 0))::int) zero_size_boxes from lb group by all
)""",
    ),
    "agg2_image_sizes": _q("select width, height, count(*) as images from i group by all order by images desc, width, height limit 5"),
    "agg3_grouping_sets": f"""
with s as (select {_KEY.format('source')} source, {_KEY.format('domain')} as domain, {_CKEY.format('split')} split from split)
select grouping(domain, source)::int as level, domain, source, split, count(*) as n from s group by grouping sets ((split), (domain, split), (source, split))
""",
    "agg4_reasons": _q("select source, reason, n from iss unpivot (n for reason in (duplicate_lines, malformed_lines, polygon_lines, bad_class_id, out_of_range_coords, zero_size_boxes)) where n > 0"),
    "agg5_box_areas": _q("select round(avg((w * h > 0.9)::int), 6) as large, round(avg((w * h < 0.01)::int), 6) as tiny, " + ", ".join(f"round(quantile_cont(w * h, {p / 100}), 6) as p{p}" for p in (5, 25, 50, 75, 95)) + " from b"),
    "agg6_dominant_class": _q("select source, uid, arg_max(cls, n * 100 - cls) as dominant from (select source, uid, cls, count(*) n from b group by all) group by source, uid"),
    "agg29_thin_classes": _q("select min(n) as least, string_agg(cls::varchar, ',' order by cls) filter (where n < 400) as thin from (select k.cls, count(b.cls) n from (select unnest(range(7))::int cls) k left join b on b.cls = k.cls group by k.cls)"),
    "win14_first_occurrence": "select source, count(*) as repeats from (select source, row_number() over (partition by source, uid, line order by line_no) k from label_lines) where k > 1 group by source",
    "fil9_quality_gates": _q(
        """select 'missing_labels' as check_name, round(avg((l.uid is null)::int), 6) as value, avg((l.uid is null)::int) < 0.01 as passed from i left join (select distinct source, uid from label_lines) l on l.source = i.source and l.uid = i.uid
union all select 'degenerate_boxes', round(avg((w * h > 0.9)::int), 6), avg((w * h > 0.9)::int) < 0.3 from b
union all select 'least_boxes_of_a_class', min(n), min(n) >= 400 from (select k.cls, count(b.cls) n from (select unnest(range(7))::int cls) k left join b on b.cls = k.cls group by k.cls)
union all select 'bad_class_ids', sum(bad_class_id), sum(bad_class_id) = 0 from iss
union all select 'malformed_lines', sum(malformed_lines), sum(malformed_lines) = 0 from iss"""
    ),
    "hlp6_box_tolerance": _q("select true as same, count(*) as images from (select distinct source, uid from b)"),
    "sclr_text": r"""
select row_id, regexp_replace(lower(file), '[^a-z0-9]', '', 'g') as bare, regexp_replace(lower(trim(regexp_replace(string_split(replace(file, '\', '/'), '/')[-1], '\.[^.]*$', ''))), '[\s_-]*\d+$', '') as no_number,
    coalesce(nullif(regexp_replace(regexp_replace(source_file, '[^A-Za-z0-9.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'img') as safe, regexp_extract(file, '^[A-Za-z]+') as letters,
    string_split(replace(source_file, '\', '/'), '/')[-1] as base, regexp_replace(string_split(replace(source_file, '\', '/'), '/')[-1], '\.[^.]*$', '') as stem, substr(sha256(file), 1, 12) as sha
from split where file is not null and source_file is not null
""",
    "sclr_math": """
select distinct l_orderkey, l_quantity, l_extendedprice, l_discount, format('{:.5e}', sqrt(l_extendedprice))::double as six, round(sqrt(l_quantity * l_quantity + 9), 6) as hyp, round(log10(l_extendedprice), 6) as lg,
    round(0.2126 * case when l_quantity * 5 / 255 <= 0.03928 then l_quantity * 5 / 255 / 12.92 else pow((l_quantity * 5 / 255 + 0.055) / 1.055, 2.4) end
    + 0.7152 * case when l_quantity / 255 <= 0.03928 then l_quantity / 255 / 12.92 else pow((l_quantity / 255 + 0.055) / 1.055, 2.4) end
    + 0.0722 * case when l_quantity * 2 / 255 <= 0.03928 then l_quantity * 2 / 255 / 12.92 else pow((l_quantity * 2 / 255 + 0.055) / 1.055, 2.4) end, 6) as lum,
    abs(l_extendedprice - l_extendedprice * (1 + l_discount * 1e-5)) <= 5e-7 * greatest(abs(l_extendedprice), abs(l_extendedprice * (1 + l_discount * 1e-5))) as near, true as ok
from lineitem
""",
    "sclr_lists": """
with g as (select annot_format, list_sort(list(distinct domain) filter (where domain is not null)) x from sources group by annot_format)
select annot_format, case when len(x) <= 1 then coalesce(x[1], '') else array_to_string(x[:-2], ', ') || ' and ' || x[-1] end as domains, '0|1|2|3|4|5' as a, '0|1' as b, annot_format as dom from g
""",
}
