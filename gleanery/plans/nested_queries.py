"""Queries of the nested-record operator (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.operators import nested
from gleanery.tables import load


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.points(load(spark, d, "labelme_raw")).select("json_id", "shape_path", "point_no")


def p3_points(spark: SparkSession, d: str) -> DataFrame:
    return nested.points(load(spark, d, "labelme_raw"))


def p3_shapes(spark: SparkSession, d: str) -> DataFrame:
    return nested.shapes(load(spark, d, "labelme_raw"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.records(load(spark, d, "labelme_raw"))


QUERIES = {f.__name__: f for f in (p3_found, p3_points, p3_shapes, p3_records)}
_SHAPES = r"""
with recursive b as (
    select json_id, regexp_replace(body, '^[\s\x{FEFF}]+', '') t from labelme_raw where body is not null
), v as (
    select json_id, t::json j from b where json_valid(t)
), w(json_id, j, level, ord) as (
    select json_id, case when json_type(j) = 'VARCHAR' then coalesce(try_cast(json_extract_string(j, '$') as json), j) else j end, 0, []::varchar[] from v
    union all
    select json_id, case when json_type(c) = 'VARCHAR' and regexp_matches(json_extract_string(c, '$'), '^\s*[\[{]') then coalesce(try_cast(json_extract_string(c, '$') as json), c) else c end, level + 1, list_append(ord, k) from (
        select json_id, level, ord, k, json_extract(j, '$."' || k || '"') c from (select *, unnest(json_keys(j)) k from w where json_type(j) = 'OBJECT' and coalesce(json_type(j, '$.shapes'), '') <> 'ARRAY')
        union all
        select json_id, level, ord, lpad(i::varchar, 12, '0'), json_extract(j, '$[' || i || ']') from (select *, unnest(range(json_array_length(j)::bigint)) i from w where json_type(j) = 'ARRAY'))
    where c is not null
), rec as (
    select json_id, (row_number() over (partition by json_id order by level, ord) - 1)::int rn, j from w where json_type(j, '$.shapes') = 'ARRAY'
), sh(json_id, rn, path, s) as (
    select json_id, rn, i::varchar, json_extract(j, '$.shapes[' || i || ']') from (select json_id, rn, j, unnest(range(json_array_length(j, '$.shapes')::bigint)) i from rec)
    union all
    select json_id, rn, path || '.' || i, json_extract(s, '$.children[' || i || ']') from (select json_id, rn, path, s, unnest(range(json_array_length(s, '$.children')::bigint)) i from sh where json_type(s, '$.children') = 'ARRAY')
)"""
_POINTS = r"""
, p as (
    select json_id, rn, path, i, json_extract(s, '$.points[' || i || ']') e, json_type(s, '$.points[0]') in ('ARRAY', 'OBJECT') nested0,
        len(list_filter(json_transform(json_extract(s, '$.points'), '["JSON"]'), lambda x: json_type(x) in ('ARRAY', 'OBJECT'))) > 0 nested, s
    from (select json_id, rn, path, s, unnest(range(json_array_length(s, '$.points')::bigint)) i from sh where json_type(s, '$.points') = 'ARRAY')
), c as (
    select json_id, rn, path, i, coalesce(json_extract_string(e, '$[0]'), json_extract_string(e, '$.x')) x, coalesce(json_extract_string(e, '$[1]'), json_extract_string(e, '$.y')) y from p where nested
    union all
    select json_id, rn, path, i // 2, json_extract_string(s, '$.points[' || i || ']'), json_extract_string(s, '$.points[' || (i + 1) || ']') from p where not nested and i % 2 = 0
)"""
_FINITE = """try_cast(x as double) is not null and try_cast(y as double) is not null and not isnan(try_cast(x as double)) and not isnan(try_cast(y as double))"""
SQL = {
    "p3_found": f"{_SHAPES}{_POINTS} select json_id, path as shape_path, i::int as point_no from c where {_FINITE}",
    "p3_points": f"{_SHAPES}{_POINTS} select json_id, rn as record_no, path as shape_path, i::int as point_no, x::double as x, y::double as y from c where {_FINITE}",
    "p3_shapes": f"""{_SHAPES}
select json_id, rn as record_no, path as shape_path, case when contains(path, '.') then regexp_replace(path, '[.][0-9]+$', '') end as parent_path, json_extract_string(s, '$.label') as label,
    json_extract_string(s, '$.shape_type') as shape_type, case when json_type(s, '$.points') = 'ARRAY' then json_array_length(s, '$.points') else 0 end::int as n_points
from sh where json_type(s) = 'OBJECT'
""",
    "p3_records": f"""{_SHAPES}
select json_id, rn as record_no, json_extract_string(j, '$.imagePath') as image_path, json_extract_string(j, '$.version') as version, json_extract_string(j, '$.imageWidth')::int as image_width,
    json_extract_string(j, '$.imageHeight')::int as image_height, json_array_length(j, '$.shapes')::int as n_shapes from rec
""",
}
