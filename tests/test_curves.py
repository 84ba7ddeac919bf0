"""Streamed average precision under many weights against plain Python; nothing that grows with the rows reaches the driver."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import curves
from gleanery.plans import average_precision as AP
from gleanery.plans.registry import QUERIES, SQL
from tests.compare import same


def _rows(spark, n=700, images=37):
    """Equal confidences, a class without targets, one without predictions, images on one side only."""
    rng = random.Random(4)
    p = [(m, rng.randrange(images), i, rng.choice("xyyyq"), round(rng.random(), 1), [int(rng.random() < 0.9 - 0.08 * j) for j in range(10)]) for m in "mn" for i in range(n)]
    t = [(rng.randrange(images + 5), c) for c in "xyz" for _ in range(n // 3)]
    return p, t, spark.createDataFrame(p, "model string, image int, id int, cls string, conf double, tp array<int>"), spark.createDataFrame(t, "image int, cls string")


def _area(hits, n):
    """Precision made falling, read at 101 recalls: the best one of all points whose recall is above."""
    points, t = [], 0
    for i, h in enumerate(hits):
        t += h
        points.append((t / (n + 1e-16), t / (i + 1)))
    y = [max((p for r, p in points if r > k * 0.01), default=0) for k in range(101)]
    return (sum(y) - (y[0] + y[100]) / 2) * 0.01


def _plain(p, t, w):
    """(model, map50, map50_95): every row as often as its image was drawn."""
    out = {}
    for m in sorted({r[0] for r in p}):
        per = []
        for c in sorted({x[1] for x in t}):
            if n := sum(w[x[0]] for x in t if x[1] == c):
                own = [r for r in sorted((r for r in p if r[0] == m and r[3] == c), key=lambda r: (-r[4], r[2])) for _ in range(w[r[1]])]
                per.append([_area([r[5][j] for r in own], n) for j in range(10)])
        out[m] = (np.mean([x[0] for x in per]), np.mean(per)) if per else (0.0, 0.0)
    return out


def _draw(p, t, b, seed):
    images = sorted({r[1] for r in p} | {x[0] for x in t})
    taken = [images[int(hashlib.md5(f"{seed}:{b}:{i}".encode()).hexdigest()[:8], 16) % len(images)] for i in range(len(images))]
    return {x: taken.count(x) for x in images}


@pytest.fixture
def watched(spark, monkeypatch):
    """Numbers of rows that were collected; tables and broadcasts of the driver are refused."""
    seen, kind = [], type(spark.range(1))
    collect = kind.collect

    def counted(df):
        rows = collect(df)
        seen.append(len(rows))
        return rows

    def refused(*_):
        raise AssertionError("rows reach the driver")

    monkeypatch.setattr(kind, "collect", counted)
    monkeypatch.setattr(kind, "toPandas", refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    return seen


@pytest.mark.parametrize("rows", [48, 2048])
def test_bootstrap_streams_its_rows(spark, watched, monkeypatch, rows):
    monkeypatch.setattr(curves, "ROWS", rows)
    p, t, pred, targets = _rows(spark)
    got = AP.bootstrap(pred, targets, 6, 5)
    assert max(watched) <= 3  # classes and models
    got = {(r.replicate, r.model): (r.map50, r.map50_95) for r in got.collect()}
    want = {(b, m): v for b in range(6) for m, v in _plain(p, t, _draw(p, t, b, 5)).items()}
    assert set(got) == set(want) and all(math.isclose(x, y, abs_tol=1e-12) for k in want for x, y in zip(got[k], want[k]))


def test_draws_are_those_of_md5():
    for n, b, seed in ((1, 0, 0), (9, 3, 0), (10, 12, 7), (1234, 999, 0), (40, 1, "s" * 60)):
        taken = [int(hashlib.md5(f"{seed}:{b}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        assert curves.draws(n, [b], seed)[:, 0].tolist() == [*np.bincount(taken, minlength=n), 0]


def test_sums_of_weights_that_fill_their_type():
    w = np.array([[250, 1], [255, 0], [0, 0]], np.uint8)
    img = np.array([0, 1] * 300)
    c = curves.Curve(np.array([600 * 255, 600]), [0])
    c.add(img, np.ones(600, int), w, 255)
    c.add(img[:7], np.zeros(7, int), w, 255)
    assert c.seen.tolist() == [300 * 505 + 4 * 250 + 3 * 255, 304] and c.hits.tolist() == [[300 * 505, 300]]


def test_bootstrap_query_reads_only_its_mean(spark, folder, watched, monkeypatch):
    asked, areas = [], curves.curve_areas
    monkeypatch.setattr(curves, "curve_areas", lambda *a: asked.append(a[-1]) or areas(*a))
    rows = QUERIES["bst1_bootstrap_1000"](spark, folder).collect()
    assert len(rows) == 3 and max(watched) <= 5 and asked == [[0]]
    _, _, pred, targets = _rows(spark, 200)
    both, one = (AP.bootstrap(pred, targets, 3, 1, means=m).orderBy("replicate", "model").collect() for m in (("map50", "map50_95"), ("map50",)))
    assert [(r.replicate, r.model, r.map50) for r in both] == [tuple(r) for r in one]


def test_consistency_keeps_rows_off_the_driver(spark, folder, watched):
    rows = QUERIES["det4_consistency"](spark, folder).collect()
    assert len(rows) == 3 and all(r.consistent for r in rows) and max(watched) <= 5


def test_both_forms_of_the_mean_are_the_plain_one(spark, watched):
    p, t, pred, targets = _rows(spark)
    want = _plain(p, t, dict.fromkeys(range(100), 1))
    labels = targets.groupBy("cls").count().withColumnRenamed("count", "n")
    for got in (AP.whole_score(pred, targets), AP.whole_score(pred, targets, 10), AP.mean_ap(AP.average_precision(pred, labels, ["model"]), ["model"])):
        got = {r.model: (r.map50, r.map50_95) for r in got.collect()}
        assert set(got) == set(want) and all(math.isclose(x, y, abs_tol=1e-12) for m in want for x, y in zip(got[m], want[m]))


def _refused(*_, **__):
    raise AssertionError("not made here")


def test_whole_score_is_the_vectorised_form_at_any_size(spark, monkeypatch):
    """However few images a worker may hold, none is numbered, and the form it is compared with makes none of its values."""
    for owner, name in ((AP, "average_precision"), (AP, "resampled"), (curves, "image_numbers")):
        monkeypatch.setattr(owner, name, _refused)
    p, t, pred, targets = _rows(spark)
    want = _plain(p, t, dict.fromkeys(range(100), 1))
    for size in ((), (7,), (10,), (100_000,)):
        got = {r.model: (r.map50, r.map50_95) for r in AP.whole_score(pred, targets, *size).collect()}
        assert set(got) == set(want) and all(math.isclose(x, y, abs_tol=1e-12) for m in want for x, y in zip(got[m], want[m]))


def test_consistency_sees_a_fault_of_the_curves(spark, folder, monkeypatch):
    right = AP.average_precision
    monkeypatch.setattr(curves, "image_numbers", _refused)
    assert all(r.consistent for r in QUERIES["det4_consistency"](spark, folder).collect())
    monkeypatch.setattr(AP, "average_precision", lambda *a, **k: right(*a, **k).withColumn("ap", F.col("ap") + 2e-4))
    rows = QUERIES["det4_consistency"](spark, folder).collect()
    assert len(rows) == 3 and not any(r.consistent for r in rows)


@pytest.mark.parametrize("column", ["user_id", "event_type", "value", "props"])
def test_consistency_of_rows_without_a_value(spark, folder, tmp_path, column):
    """Rows without an image are left out, those without a class are a class of its own, as in the SQL."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    e = e.withColumn(column, F.when(F.col("event_id") % 7 != 1, F.col(column)))
    e.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = QUERIES["det4_consistency"](spark, str(tmp_path))
    assert all(r.consistent for r in df.collect())
    same(df, con, SQL["det4_consistency"])
