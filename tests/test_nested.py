import json

import pytest

from gleanery.operators import nested


def frame(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "json_id long, body string")


def points(spark, bodies):
    return {tuple(r) for r in nested.points(frame(spark, bodies)).collect()}


def rec(shapes, **more):
    return json.dumps({"version": "5", "shapes": shapes, "imagePath": "a.jpg"} | more)


def test_point_forms_and_numbers(spark):
    got = points(spark, [rec([
        {"points": [[1, 2.5], ["3", " 4e1 "], [None, 1], [1], [True, 2], ["x", 1], {"x": 5, "y": "6"}, {"x": 1}, [7, 8, 9], "no"]},
        {"points": [1, 2, None, 4, "5", "6", 7]},
        {"points": None}, {"label": "none"}, None, 7, {"points": []}, {"points": ["nan", "inf", 1, 2]},
    ])])
    assert got == {
        (0, 0, "0", 0, 1.0, 2.5), (0, 0, "0", 1, 3.0, 40.0), (0, 0, "0", 6, 5.0, 6.0), (0, 0, "0", 8, 7.0, 8.0),
        (0, 0, "1", 0, 1.0, 2.0), (0, 0, "1", 2, 5.0, 6.0), (0, 0, "7", 1, 1.0, 2.0),
    }


def test_deep_children_keep_their_paths(spark):
    shape = {"points": [[0, 0]]}
    for _ in range(14):
        shape = {"points": [[1, 1]], "children": [None, shape]}
    rows = nested.shapes(frame(spark, [rec([shape])])).collect()
    assert len(rows) == 15
    paths = {r.shape_path: r.parent_path for r in rows}
    assert paths["0"] is None and paths["0.1"] == "0" and paths["0" + ".1" * 14] == "0" + ".1" * 13


def test_where_the_record_stands(spark):
    r = {"shapes": [{"points": [[1, 2]]}]}
    bodies = [
        json.dumps(r), json.dumps(json.dumps(r)), "\ufeff" + json.dumps(r), "\n " + json.dumps(r) + " \n", json.dumps({"data": r}), json.dumps({"x": 1, "y": {"annotation": r}}),
        json.dumps([r]), json.dumps({"data": json.dumps(r)}), json.dumps(r)[:-1], json.dumps(r) + "}", json.dumps(r) + "," + json.dumps(r), json.dumps({"shapes": None}), json.dumps({"annotations": []}),
        "", None, "null", "[]", "3", json.dumps({"shapes": {"a": 1}}), json.dumps({"shapes": []}),
    ]
    assert {p[0] for p in points(spark, bodies)} == set(range(8))
    assert {p[1] for p in points(spark, bodies)} == {0}
    assert {r.json_id for r in nested.records(frame(spark, bodies)).collect()} == {*range(8), 19}


def wrapped(r, depth):
    for i in range(depth):
        r = {f"w{i}": r, "note": "}]"} if i % 3 else [None, r] if i % 2 else {"z": json.dumps(r)}
    return json.dumps(r)


def test_records_at_any_depth(spark):
    r = {"flags": {}, "shapes": [{"points": [[1, 2]]}]}
    bodies = [wrapped(r, d) for d in range(12)]
    assert {p[0] for p in points(spark, bodies)} == set(range(12))
    assert nested.records(frame(spark, bodies)).count() == 12


def test_all_records_of_a_body(spark):
    r = lambda x: {"shapes": [{"points": [[x, 2], [x, 3]], "children": [{"points": [[x, 4]]}]}]}
    bodies = [json.dumps([r(1), r(2)]), json.dumps({"b": r(3), "a": [{"deep": {"er": {"still": {"more": r(5)}}}}, r(4)]}), json.dumps({"shapes": [{"label": "shapes", "extra": r(9)}]})]
    got = points(spark, bodies)
    assert {(k, n, x) for k, n, _, _, x, _ in got} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0), (1, 2, 5.0)}
    assert len(got) == 15
    assert {(x.json_id, x.record_no) for x in nested.shapes(frame(spark, bodies)).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0)}


def test_escaped_keys_and_words_in_text(spark):
    deep = {"points": [[0, 0]]}
    for _ in range(9):
        deep = {"points": [[1, 1]], "children": [deep]}
    body = json.dumps({"shapes": [deep]}).replace("children", "\\u0063hildren").replace("shapes", "\\u0073hapes")
    plain = json.dumps({"imagePath": "children children children children children children children shapes shapes", "shapes": [{"points": [[1, 2]]}]})
    got = points(spark, [body, plain])
    assert len([p for p in got if p[0] == 0]) == 10 and len([p for p in got if p[0] == 1]) == 1


def test_empty_table_repeats_and_clashing_columns(spark):
    assert points(spark, []) == set()
    df = spark.createDataFrame([(1, rec([{"points": [[1, 2]]}]), 9, 8), (1, rec([{"points": [[1, 2]]}]), 9, 8)], "json_id long, body string, _k int, path int")
    assert len(nested.points(df).collect()) == 2
    assert nested.records(df).count() == 2


def test_long_body(spark):
    big = rec([{"points": [[i, i + 1] for i in range(20_000)]}])
    assert len(points(spark, [big])) == 20_000


@pytest.mark.parametrize("name", ["records", "shapes", "points"])
def test_round_trip_against_python(name, spark, folder):
    """The driver's table against a plain recursion."""
    df = spark.read.parquet(f"{folder}/labelme_raw.parquet")
    got = getattr(nested, name)(df)
    want = set()

    def number(x):
        try:
            return not isinstance(x, bool) and x is not None and abs(float(x)) < float("inf")
        except (TypeError, ValueError):
            return False

    def walk(j, path, s):
        if not isinstance(s, dict):
            return
        if name == "shapes":
            want.add((j, path))
        p = s.get("points")
        if name == "points" and isinstance(p, list):
            flat = not any(isinstance(q, (list, dict)) for q in p)
            pairs = list(zip(p[::2], p[1::2])) if flat else [(q.get("x"), q.get("y")) if isinstance(q, dict) else tuple(q[:2]) if isinstance(q, list) and len(q) > 1 else (None, None) for q in p]
            want.update((j, path, i) for i, (a, b) in enumerate(pairs) if number(a) and number(b))
        for i, c in enumerate(s.get("children") or []):
            walk(j, f"{path}.{i}", c)

    for r in df.collect():
        try:
            o = json.loads((r.body or "").lstrip("\ufeff"))
            o = json.loads(o) if isinstance(o, str) else o
        except ValueError:
            continue
        o = next((x for x in [o, *(o.values() if isinstance(o, dict) else [])] if isinstance(x, dict) and isinstance(x.get("shapes"), list)), None)
        if o:
            if name == "records":
                want.add((r.json_id,))
            for i, s in enumerate(o["shapes"]):
                walk(r.json_id, str(i), s)
    keys = {"records": ["json_id"], "shapes": ["json_id", "shape_path"], "points": ["json_id", "shape_path", "point_no"]}[name]
    assert {tuple(r) for r in got.select(*keys).collect()} == want
