"""Deeply nested annotation records as related flat tables.

One higher-order projection per record: nested ``transform`` calls attach the ancestor's key and the position, ``flatten``
joins the levels, and one ``inline`` per target table emits the rows. No join and no shuffle are needed, since every child
row carries the key of its parent.

Defined results: a null body, a body that is not one complete JSON value, or one without a ``shapes`` array gives no row. A
byte order mark and blanks around the body are ignored. A record may be the body itself or stand in any field or element, at
any depth, and what holds it may be JSON text inside a JSON string. A body may hold several records: they are numbered by level,
then by position (fields in the order of their names). Inside a record no further one is sought. Shapes that are not objects keep
their number and give no row; so do points without two finite numbers (numbers may be written as text; booleans are no
numbers). Points may be pairs, objects with ``x`` and ``y``, or one flat list of coordinates. Repeated bodies are separate
records, and so are bodies with a repeated key, as far as they are readable (a field given twice makes a body unreadable).
Columns of the input other than the key and the body are ignored, whatever their names.

Levels: one projection unrolls ``WRAPS`` levels of what holds a record and ``LEVELS`` levels of children. Deeper ones go through
further rounds, over those bodies alone whose text allows for more (``_may_be_deeper``), so that no other body is parsed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of ``children`` unrolled in one projection.
LEVELS = 6
#: Levels of objects or arrays around a record that are searched in one projection.
WRAPS = 2

_ITEMS = "array<variant>"


def _variant(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is_object(v: Column) -> Column:
    return _variant(v, "$", "map<string,variant>").isNotNull()


def _is_array(v: Column) -> Column:
    return _variant(v, "$", _ITEMS).isNotNull()


def _unquoted(v: Column) -> Column:
    """JSON text inside a JSON string, opened; anything else as it is."""
    text = F.when(~_is_object(v) & ~_is_array(v), _variant(v, "$", "string"))
    return F.coalesce(F.when(text.rlike(r"^\s*[\[{]"), F.try_parse_json(text)), v)


def parsed(body: Column) -> Column:
    """The body as a variant, null unless it is exactly one complete JSON value."""
    text = F.regexp_replace(body, r"^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    whole = _variant(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", _ITEMS)
    return F.when(F.size(whole) == 1, F.get(whole, F.lit(0)))


def _inner(v: Column) -> Column:
    """The values one level down, opened; an empty array for scalars."""
    fields = F.map_values(_variant(v, "$", "map<string,variant>"))
    return F.transform(F.coalesce(fields, _variant(v, "$", _ITEMS), F.array().cast(_ITEMS)), _unquoted)


def _is_record(v: Column) -> Column:
    return _variant(v, "$.shapes", _ITEMS).isNotNull()


def _is_held(v: Column) -> Column:
    return _variant(v, "$.shapes", _ITEMS).isNull()


def _may_be_deeper(body: Column) -> Column:
    """Whether the text allows for a record below ``WRAPS`` levels, or for children below ``LEVELS``.

    A record at level n has more than n brackets before its ``shapes``; children at level n need the word n times. Letters that
    are written as escapes, and a second ``shapes``, allow for anything.
    """
    opened = F.length(F.regexp_replace(F.substring_index(body, "shapes", 1), r"[^\[{]", ""))
    times = lambda word: (F.length(body) - F.length(F.replace(body, F.lit(word), F.lit("")))) / len(word)
    held_deep = body.contains("shapes") & ((times("shapes") > 1) | (opened > WRAPS + 1))
    return body.contains("\\u006") | body.contains("\\u007") | held_deep | (times("children") > LEVELS)


def held(df: DataFrame, key: str, body: str, levels: int = WRAPS) -> DataFrame:
    """``(_k, _records, _rest)``: all records of each body down to that level, and what is still to be searched.

    Every step is a projection of its own, and no filter stands on a computed column (it would be pushed down and
    evaluate the chain again): bodies without a record come back with an empty array.
    """
    out = df.select(F.col(key).alias("_k"), parsed(F.col(body)).alias("_v"))
    out = out.select("_k", F.array().cast(_ITEMS).alias("_records"), F.array(_unquoted(F.col("_v"))).alias("_rest"))
    for _ in range(levels + 1):
        inside = F.flatten(F.transform(F.filter("_rest", _is_held), _inner))
        out = out.select("_k", F.concat("_records", F.filter("_rest", _is_record)).alias("_records"), inside.alias("_rest"))
    return out


def _unrolled(df: DataFrame, key: str, body: str, wraps: int, levels: int) -> DataFrame:
    """``(_k, _records, _rest, _l0, ..)``: the records of each body, and its shapes by level."""
    top = held(df, key, body, wraps)
    top = top.select("*", F.flatten(F.transform("_records", lambda r, i: _children(i, F.lit(None).cast("string"), r, "shapes"))).alias("_l0"))
    for k in range(levels):
        below = F.flatten(F.transform(f"_l{k}", lambda s: _children(s["rec"], s["path"], s["v"], "children")))
        top = top.select("*", below.alias(f"_l{k + 1}"))
    return top


def _parts(df: DataFrame, key: str, body: str) -> list[tuple[DataFrame, int, int]]:
    """Bodies with the levels to unroll for them: all at once, unless some are deeper than that."""
    deeper = F.coalesce(_may_be_deeper(F.col(body)), F.lit(False))
    rest, wraps, levels = df.where(deeper), WRAPS, LEVELS
    while True:
        most = _unrolled(rest, key, body, wraps, levels).agg(F.max(F.size("_rest")), F.max(F.size(f"_l{levels}"))).first()
        if not any(most):
            break
        wraps, levels = wraps * 2 if most[0] else wraps, levels * 2 if most[1] else levels
    if (wraps, levels) == (WRAPS, LEVELS):
        return [(df, wraps, levels)]
    return [(df.where(~deeper), WRAPS, LEVELS), (rest, wraps, levels)]


def _children(number: Column, prefix: Column, holder: Column, field: str) -> Column:
    """The shapes in ``holder.field`` as structs of the record's number, path, parent's path and value."""
    none = F.array().cast("array<struct<rec:int,path:string,parent:string,v:variant>>")
    items = F.transform(
        _variant(holder, f"$.{field}", _ITEMS),
        lambda s, i: F.struct(
            number.alias("rec"), F.concat_ws(".", prefix, i.cast("string")).alias("path"), prefix.alias("parent"), s.alias("v")
        ),
    )
    return F.coalesce(items, none)


def records(df: DataFrame, key: str = "json_id", body: str = "body") -> DataFrame:
    """One row per record: ``(key, record_no, image_path, version, image_width, image_height, n_shapes)``."""
    r = F.col("_r")
    out = None
    for part, wraps, _ in _parts(df, key, body):
        one = held(part, key, body, wraps).select("_k", F.inline_outer(F.transform("_records", lambda v, i: F.struct(i.alias("record_no"), v.alias("_r")))))
        rows = one.where("record_no is not null").select(
            F.col("_k").alias(key),
            "record_no",
            _variant(r, "$.imagePath", "string").alias("image_path"),
            _variant(r, "$.version", "string").alias("version"),
            _variant(r, "$.imageWidth", "int").alias("image_width"),
            _variant(r, "$.imageHeight", "int").alias("image_height"),
            F.size(_variant(r, "$.shapes", _ITEMS)).alias("n_shapes"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _shape_values(df: DataFrame, key: str, body: str) -> DataFrame:
    """(_k, rec, path, parent, v) of every shape, at any depth."""
    out = None
    for part, wraps, levels in _parts(df, key, body):
        top = _unrolled(part, key, body, wraps, levels)
        rows = top.select("_k", F.inline_outer(F.concat(*[F.col(f"_l{k}") for k in range(levels)]))).where("path is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def shapes(df: DataFrame, key: str = "json_id", body: str = "body") -> DataFrame:
    """One row per shape object, with its record, its path and its parent's path (null for shapes of the record itself)."""
    v = F.col("v")
    return (
        _shape_values(df, key, body)
        .where(_is_object(v))
        .select(
            F.col("_k").alias(key),
            F.col("rec").alias("record_no"),
            F.col("path").alias("shape_path"),
            F.col("parent").alias("parent_path"),
            _variant(v, "$.label", "string").alias("label"),
            _variant(v, "$.shape_type", "string").alias("shape_type"),
            F.coalesce(F.size(_variant(v, "$.points", _ITEMS)), F.lit(0)).alias("n_points"),
        )
    )


def _number(text: Column) -> Column:
    """A finite number from the text of a JSON value; null for booleans, words and empty text."""
    good = F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(good, F.trim(text).try_cast("double"))


def points(df: DataFrame, key: str = "json_id", body: str = "body") -> DataFrame:
    """One row per point with two finite coordinates: ``(key, record_no, shape_path, point_no, x, y)``."""
    rows = _shape_values(df, key, body).select("_k", "rec", "path", _variant(F.col("v"), "$.points", _ITEMS).alias("_p"))
    rows = rows.select("*", F.exists("_p", lambda p: _is_array(p) | _is_object(p)).alias("_nested"))
    pair = F.transform(
        F.col("_p"),
        lambda p, i: F.struct(
            i.alias("point_no"),
            F.coalesce(_variant(p, "$[0]", "string"), _variant(p, "$.x", "string")).alias("x"),
            F.coalesce(_variant(p, "$[1]", "string"), _variant(p, "$.y", "string")).alias("y"),
        ),
    )
    flat = F.transform(
        F.filter(F.transform("_p", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda s: s["i"] % 2 == 0),
        lambda s, k: F.struct(
            k.alias("point_no"),
            _variant(s["p"], "$", "string").alias("x"),
            _variant(F.get("_p", s["i"] + 1), "$", "string").alias("y"),
        ),
    )
    made = rows.select("_k", "rec", "path", F.inline_outer(F.when(F.col("_nested"), pair).otherwise(flat)))
    out = made.select(
        F.col("_k").alias(key), F.col("rec").alias("record_no"), F.col("path").alias("shape_path"), "point_no", _number(F.col("x")).alias("x"), _number(F.col("y")).alias("y")
    )
    return out.where("point_no is not null").where(F.abs("x").between(0, 1.7976931348623157e308) & F.abs("y").between(0, 1.7976931348623157e308))
