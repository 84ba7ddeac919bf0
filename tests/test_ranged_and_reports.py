"""Running values over ranges, quotas, samples, notes and settings against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions.statistics import incomplete_beta, t_two_sided
from gleanery.operators import allocate, duplicates, ranged, reports, search_log
from gleanery.plans import average_precision as AP


@pytest.fixture
def many_parts(spark):
    """Range shuffles that keep their parts, so that offsets between parts are met on small tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_values_cross_parts(many_parts):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 30), i, rng.randint(-5, 9)) for i in range(400)]
    df = ranged.ranged(many_parts.createDataFrame(rows, "g string, o int, i int, v int"), ["g"], [F.desc("o"), F.asc("i")])
    assert df.select("part").distinct().count() > 2
    got = {r.i: (r.s, r.m) for r in ranged.maximum_from_here(ranged.running_sums(df, ["g"], [F.desc("o"), F.asc("i")], {"s": F.col("v")}), ["g"], [F.asc("o"), F.desc("i")], "v", "m").collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        for k, r in enumerate(own):
            assert got[r[2]] == (sum(x[3] for x in own[: k + 1]), max(x[3] for x in own[k:]))
    numbers = {r.i: r.number for r in ranged.numbered(many_parts.createDataFrame(rows, "g string, o int, i int, v int"), [], ["o", "i"]).collect()}
    assert [numbers[r[2]] for r in sorted(rows, key=lambda r: (r[1], r[2]))] == list(range(400))
    assert ranged.numbered(many_parts.createDataFrame([], "i int"), [], ["i"]).count() == 0


def test_curves_cross_parts(many_parts):
    """Average precision over many parts against the same in one."""
    rng = random.Random(2)
    p = [(i, i % 40, rng.choice("xyz"), round(rng.random(), 1), [int(rng.random() < 0.6) for _ in range(10)]) for i in range(900)]
    pred = many_parts.createDataFrame(p, "id int, image int, cls string, conf double, tp array<int>")
    labels = many_parts.createDataFrame([("x", 250), ("y", 300), ("z", 0), ("w", 4)], "cls string, n long")
    a = {(r.cls, r.j): r.ap for r in AP.average_precision(pred, labels).collect()}
    many_parts.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    b = {(r.cls, r.j): r.ap for r in AP.average_precision(pred.coalesce(1), labels).collect()}
    assert set(a) == set(b) == {(c, j) for c in "xyw" for j in range(10)} and all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)
    assert all(a["w", j] == 0 for j in range(10))


def test_bootstrap_beyond_what_a_worker_holds(spark):
    rng = random.Random(3)
    p = spark.createDataFrame([(m, i % 12, i, rng.choice("xy"), rng.random(), [int(rng.random() < 0.5) for _ in range(10)]) for m in "mn" for i in range(60)], "model string, image int, id int, cls string, conf double, tp array<int>")
    t = spark.createDataFrame([(i % 12, "xy"[i % 2]) for i in range(50)], "image int, cls string")
    held = {(r.replicate, r.model): (r.map50, r.map50_95) for r in AP.bootstrap(p, t, 3, 5).collect()}
    spread = {(r.replicate, r.model): (r.map50, r.map50_95) for r in AP.bootstrap(p, t, 3, 5, most_held=10).collect()}
    assert set(held) == set(spread) and all(math.isclose(x, y, abs_tol=1e-9) for k in held for x, y in zip(held[k], spread[k]))
    a, b = (AP.whole_score(p, t, n).orderBy("model").collect() for n in (1_000, 10))
    assert all(math.isclose(x.map50_95, y.map50_95, abs_tol=1e-9) for x, y in zip(a, b))


def test_mean_ranks(many_parts):
    v = [3, 1, 2, 2, 2, 9, 1]
    got = {r.v: r.r for r in ranged.mean_ranks(many_parts.createDataFrame([("g", x) for x in v], "g string, v int"), ["g"], "v", "r").collect()}
    assert got == {1: 1.5, 2: 4.0, 3: 6.0, 9: 7.0}


def test_quotas_and_samples(spark):
    rows = [(i, ["train", "valid", "test", None][i % 4], "ab"[i % 3 == 0]) for i in range(1200)]
    df = spark.createDataFrame(rows, "i int, s string, c string")
    q = spark.createDataFrame([("a", 7), ("b", 5000)], "c string, quota int")
    got = allocate.first_by_quota(df, ["c"], "i", q, 3).collect()
    want = sorted((i for i, _, c in rows if c == "a"), key=lambda i: (__import__("hashlib").md5(f"3:{i}".encode()).hexdigest(), i))[:7]
    assert sorted(r.i for r in got if r.c == "a") == sorted(want) and sum(r.c == "b" for r in got) == sum(r[2] == "b" for r in rows)
    out = allocate.subsample(df, "i", "s", "c", {"train": 100, "valid": 1000}, 3).collect()
    n = {s: sum(r.s == s for r in out) for s in ("train", "valid", "test", None)}
    assert n == {"train": 100, "valid": 300, "test": 300, None: 300}
    part = allocate.fraction_sample(df, "i", "c", 0.4, 3).collect()
    assert len(part) == 480 and [r.i for r in part] == sorted(r.i for r in part) and sum(r.c == "b" for r in part) == 160
    one = allocate.one_per_class(spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "b")], "f string, c string"), "f", "c", ["a", "b", "z"]).collect()
    assert {(r.c, r.f) for r in one} == {("a", "f"), ("b", "g")}
    assert allocate.subsample(df.limit(0), "i", "s", "c", {"train": 1}).count() == 0


def test_pins_stay(spark):
    rows = [(1, "g", "s", "test"), (2, "g", "s", "train"), (3, "g", "s", None), (4, "h", "s", None)]
    out = {r.i: (r.split, r.excluded) for r in allocate.split_with_pins(spark.createDataFrame(rows, "i int, g string, s string, pin string"), "i", "g", "s", "pin").collect()}
    assert out[1] == ("test", False) and out[2] == ("train", True) and out[3] == ("test", False) and out[4][0] == "train" and not out[4][1]


def test_streaming_fold_is_the_plain_fold(spark):
    """One stratum whose rows come in several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = spark.createDataFrame([("s" if i % 5 else "t", f"g{i}", 1 + i % 4) for i in range(60)], "s string, g string, n int")
    got = {r.g: r.split for r in allocate.greedy_split(df, "s", "g", "n", 7).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r.g: r.split for r in allocate.greedy_split(df, "s", "g", "n", 7).collect()} and len(got) == 60


def test_bit_pairs_between_classes(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (30, 2))
    rows = []
    for i in range(120):
        w = base[i % 30].copy()
        for b in rng.choice(63, rng.integers(0, 7), replace=False):
            w[b % 2] ^= np.int64(1) << np.int64(b)
        rows.append((f"k{i:03}", int(w[0]), int(w[1])))
    rows += [("dup", rows[0][1], rows[0][2]), ("null", None, 1)]
    got = {(r.a, r.b, r.bits) for r in duplicates.bit_pairs(spark.createDataFrame(rows, "k string, a long, b long"), "k", ["a", "b"], 5).collect()}
    classes = {}
    for k, a, b in rows:
        if a is not None:
            classes[a, b] = min(k, classes.get((a, b), k))
    d = lambda x, y: bin((x[0] ^ y[0]) & (2**64 - 1)).count("1") + bin((x[1] ^ y[1]) & (2**64 - 1)).count("1")
    items = list(classes.items())
    assert got == {(min(p, q), max(p, q), d(x, y)) for i, (x, p) in enumerate(items) for y, q in items[:i] if d(x, y) <= 5}


def test_t_distribution():
    assert math.isclose(incomplete_beta(2, 3, 0.4), 0.5248, abs_tol=1e-4)
    # rho 0.5 of 10 pairs: t = 1.633 with 8 degrees of freedom; 0.9 of 5: t = 3.576 with 3
    assert math.isclose(t_two_sided(0.5, 10), 0.1411, abs_tol=1e-4) and math.isclose(t_two_sided(0.9, 5), 0.0374, abs_tol=1e-4)
    assert t_two_sided(None, 5) is None and t_two_sided(0.3, 2) is None and t_two_sided(1.0, 9) == 0.0


def test_notes_and_verdicts(spark):
    p = spark.createDataFrame([("A", "B", 0.1, True), ("A", "C", 0.2, True), ("B", "C", 0.01, False)], "a string, b string, diff double, significant boolean")
    assert reports.comparison_note(p).first().note == "B and C significantly beat A; C vs B is a tie"
    assert reports.comparison_note(p.where("not significant")).first().note == "no arm is significantly better than another"
    s = spark.createDataFrame([("x", 0.95, 9), ("y", 0.2, 9), ("z", None, 9)], "g string, rho double, n long")
    assert {r.g: r.verdict for r in search_log.correlation_verdict(s, "rho", "n", 0.8).collect()} == {"x": "pass", "y": "fail", "z": "fail (rho undefined)"}
    b = spark.createDataFrame([("d", "B", 1.0), ("d", "A", 1.0), ("e", "A", None)], "d string, arm string, v double")
    assert {(r.d, r.arm, r.tied) for r in reports.best_and_tied(b, ["d"], "arm", "v", "A0").collect()} == {("d", "A", True), ("e", "A0", False)}
    t = spark.createDataFrame([("m", "d1", 0.5, 0.4, 0.6), ("n", "d2", 0.5, None, 0.6)], "model string, domain string, value double, low double, high double")
    assert {tuple(r) for r in reports.domain_table(t, ["d1", "d2"]).collect()} == {("m", "0.500 [0.400, 0.600]", "n/a"), ("n", "n/a", "n/a")}


def test_build_report(spark):
    import json

    rows = spark.createDataFrame([(1, "train", "d", "s"), (2, "test", None, "t"), (3, "train", "d", "t")], "row_id long, split string, domain string, source string")
    groups = spark.createDataFrame([(1, 1), (3, 1), (2, 2)], "node long, label long")
    doc = json.loads(reports.build_report(rows, groups, spark.createDataFrame([(3,)], "row_id long")).first().report)
    assert doc["totals"] == [{"split": "test", "kept": 1, "excluded": 0}, {"split": "train", "kept": 1, "excluded": 1}]
    assert doc["duplicates"] == {"groups": 1, "images_in_groups": 2, "cross_source_groups": 1} and len(doc["sources"]) == 3
