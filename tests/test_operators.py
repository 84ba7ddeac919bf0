"""Operators on small fixtures: matching, curves, bootstrap, allocation, components, search."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import boxes as B
from gleanery.functions import text as T
from gleanery.operators import allocate, classmap, duplicates, matching, search_log
from gleanery.operators.components import connected_components
from gleanery.plans import average_precision as AP


def test_greedy_matching_cases(spark):
    schema = "image string, ord int, cls int, conf double, x0 double, y0 double, x1 double, y1 double"
    p = [("a", 0, 1, 0.9, 0, 0, 10, 10), ("a", 1, 1, 0.8, 0, 0, 10, 9), ("b", 0, 1, 0.5, 0, 0, 10, 10), ("b", 1, 2, 0.5, 0, 0, 10, 10), ("c", 0, 1, 0.5, 0, 0, 10, 20), ("d", 0, 1, 0.5, 50, 50, 60, 60), ("f", 0, 3, 0.1, 0, 0, 1, 1)]
    t = [("a", 0, 1, 0, 0, 10, 10), ("b", 0, 2, 0, 0, 10, 10), ("c", 0, 1, 0, 0, 10, 10), ("d", 0, 1, 0, 0, 10, 10), ("e", 0, 1, 0, 0, 1, 1)]
    pred = spark.createDataFrame([tuple(float(v) if i > 2 else v for i, v in enumerate(r)) for r in p], schema)
    targ = spark.createDataFrame([tuple(float(v) if i > 2 else v for i, v in enumerate(r)) for r in t], schema.replace("conf double, ", ""))
    got = {r.image: r for r in matching.image_verdicts(pred, targ).collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].fn) == (1, 1, 0) and not got["a"].fully_correct
    assert (got["b"].tp, got["b"].tp_any_class, got["b"].fp) == (1, 1, 1)
    assert got["c"].tp == 1 and got["c"].fully_correct and got["c"].f1 == 1.0  # an overlap of exactly one half counts
    assert (got["d"].tp, got["d"].fn, got["e"].fn, got["e"].n_pred, got["f"].n_gt, got["f"].fp) == (0, 1, 1, 0, 0, 1)
    assert got["e"].f1 == 0.0 and set(got) == set("abcdef")


def _slow_ap(conf, tp, n):
    order = np.argsort(-conf, kind="stable")
    tp = tp[order]
    tpc, fpc = np.cumsum(tp), np.cumsum(1 - tp)
    r = np.concatenate([[0.0], tpc / (n + 1e-16), [tpc[-1] / (n + 1e-16) if len(tpc) else 0.0, 1.0]])
    p = np.concatenate([[1.0], tpc / (tpc + fpc), [0.0, 0.0]])
    p = np.maximum.accumulate(p[::-1])[::-1]
    y = np.interp(np.arange(101) * 0.01, r, p)
    return ((y[1:] + y[:-1]) / 2).sum() * 0.01


@pytest.fixture(scope="module")
def stats():
    """Awkward predictions: ties, images with only labels or only predictions, classes on one side only, all hits, all misses."""
    rng = random.Random(4)
    pred, targ, k = [], [], 0
    for img in range(50):
        for _ in range(rng.randint(0, 4)):
            targ.append((img, rng.choice(["a", "b", "c", "only_labels"])))
        for _ in range(rng.randint(0, 9)):
            k += 1
            c = rng.choice(["a", "b", "c", "only_predictions"])
            q = rng.random() if c != "c" else 1.0
            pred.append((img, k, c, rng.choice([0.25, 0.5, rng.random()]), [int(q > 0.3 + 0.06 * j) for j in range(10)]))
            if q > 0.3 and c != "only_predictions":
                targ.append((img, c))  # every hit has its own target
    targ.append((3, "once"))
    pred.append((3, 9999, "once", 0.9, [1] * 10))
    return pred, targ


def _frames(spark, stats, models=("m",)):
    pred, targ = stats
    p = spark.createDataFrame([(m, *r) for m in models for r in pred], "model string, image int, id long, cls string, conf double, tp array<int>")
    return p, spark.createDataFrame(targ, "image int, cls string")


def test_average_precision_against_numpy(spark, stats):
    p, t = _frames(spark, stats)
    labels = t.groupBy("cls").agg(F.count("*").alias("n"))
    got = {(r.cls, r.j): r.ap for r in AP.average_precision(p, labels).collect()}
    n = {}
    for _, c in stats[1]:
        n[c] = n.get(c, 0) + 1
    assert {c for c, _ in got} == set(n)
    for c in n:
        own = sorted([r for r in stats[0] if r[2] == c], key=lambda r: r[1])
        for j in range(10):
            want = _slow_ap(np.array([r[3] for r in own]), np.array([r[4][j] for r in own]), n[c]) if own else 0.0
            assert math.isclose(got[c, j], want, abs_tol=1e-9), (c, j)
    assert got["only_labels", 0] == 0.0 and math.isclose(got["once", 9], 0.995, abs_tol=1e-9)


def test_bootstrap_equals_expanded_rows(spark, stats):
    p, t = _frames(spark, stats, ("m", "n"))
    fast = {(r.replicate, r.model): (r.map50, r.map50_95) for r in AP.bootstrap(p, t, 6, 1).collect()}
    nodes = p.select("image").union(t.select("image")).distinct()
    w = allocate.resample(nodes, "image", 6, 1)
    hits = p.join(w, "image")
    labels = t.join(w, "image").groupBy("replicate", "cls").agg(F.sum("w").alias("n"))
    slow = {(r.replicate, r.model): (r.map50, r.map50_95) for r in AP.mean_ap(AP.average_precision(hits, labels, ["replicate", "model"], weight="w"), ["replicate", "model"]).collect()}
    assert fast.keys() == slow.keys() and all(math.isclose(a, b, abs_tol=1e-9) for k in fast for a, b in zip(fast[k], slow[k]))
    assert all(fast[b, "m"] == fast[b, "n"] for b in range(6))  # equal models differ by nothing
    diff = AP.pairwise_differences(AP.bootstrap(p, t, 6, 1), ["m", "n"], "map50").first()
    assert diff.mean_diff == 0 and not diff.significant and diff.p_above == 0


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None:
            par[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in par}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_allocation_fold_against_a_loop(spark):
    rng = random.Random(2)
    groups = [(f"g{i}", rng.choice(["x", "y", "z"]), rng.randint(1, 9)) for i in range(300)] + [("solo", "alone", 4)]
    df = spark.createDataFrame(groups, "g string, s string, n long")
    start = spark.createDataFrame([("x", 50, 0, 3)], "s string, train long, valid long, test long")
    import hashlib

    got = {r.g: r.split for r in allocate.greedy_split(df, "s", "g", "n", 7, start).collect()}
    for s in "xyz":
        own = sorted([r for r in groups if r[1] == s], key=lambda r: (hashlib.md5(f"7:{r[0]}".encode()).hexdigest(), r[0]))
        have = {"train": 50, "valid": 0, "test": 3} if s == "x" else dict.fromkeys(("train", "valid", "test"), 0)
        total = sum(r[2] for r in own) + sum(have.values())
        for g, _, n in own:
            best = max(allocate.SPLITS, key=lambda sf: (sf[1] * total - have[sf[0]], -[x for x, _ in allocate.SPLITS].index(sf[0])))[0]
            assert got[g] == best
            have[best] += n
    assert got["solo"] == "train"


def test_largest_remainder_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1)], "k string, n long")
    assert {r.k: r.quota for r in allocate.largest_remainder(df, "k", "n", 2).collect()} == {"a": 1, "b": 1, "c": 0}
    assert {r.k: r.quota for r in allocate.largest_remainder(df, "k", "n", 0).collect()} == {"a": 0, "b": 0, "c": 0}
    assert {r.k: r.quota for r in allocate.largest_remainder(df, "k", "n", 3).collect()} == {"a": 1, "b": 1, "c": 1}


def test_leaks_through_two_keys_and_three_splits(spark):
    rows = [(1, "train", "m", "s"), (2, "valid", "m", None), (3, "test", None, "s"), (4, "train", None, None), (5, "train", "q", "w"), (6, "train", "q", "w")]
    df = spark.createDataFrame(rows, "id long, split string, md5 string, stem string")
    assert {r.node for r in duplicates.leaks(df, "id", "split", [F.col("md5"), F.col("stem")]).collect()} == {1}
    assert {(r.key_name, r.split_a, r.split_b, r.rows) for r in duplicates.leak_matrix(df, "id", "split", {"md5": F.col("md5")}).collect()} == {("md5", "train", "valid", 1), ("md5", "valid", "train", 1)}
    assert duplicates.shared_key_pairs(df, F.col("md5")).first().pairs == 2
    assert {tuple(r) for r in duplicates.groups(df, "id", [F.col("md5"), F.col("stem")]).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)}


def test_difference_bits(spark):
    df = spark.createDataFrame([([1, 2, 1, 5, 5, 9],)], "p array<int>")
    assert df.select(duplicates.difference_bits(F.col("p"), 2)).first()[0] == "1001"


def test_frames_and_geometry(spark):
    df = spark.createDataFrame([(100, 50, 100, 50, 1), (50, 100, 100, 50, 6), (101, 50, 100, 50, 1), (100, 50, 100, 50, 6), (0, 5, 1, 1, 1), (70, 70, 100, 50, 1)], "a int, b int, c int, d int, o int")
    assert [r[0] for r in df.select(B.frame(*[F.col(c) for c in "abcdo"]).frame).collect()] == ["display", "display", "display", "raw", "mismatch", "mismatch"]
    pts = spark.createDataFrame([([[1.0, 2.0], [3.0, None], [5.0, 7.0]],), ([[1.0, 1.0]],), (None,)], "p array<array<double>>")
    got = [r.b for r in pts.select(B.points_box(F.col("p")).alias("b")).collect()]
    assert (got[0].x, got[0].y, got[0].w, got[0].h) == (1, 2, 4, 5) and got[1] is None and got[2] is None
    one = spark.range(1)
    for tag in range(1, 9):
        p = one.select(B.oriented(F.lit(0.25), F.lit(0.1), F.lit(tag)).alias("p")).first().p
        assert (round(p.x, 6), round(p.y, 6)) == {1: (0.25, 0.1), 2: (0.75, 0.1), 3: (0.75, 0.9), 4: (0.25, 0.9), 5: (0.1, 0.25), 6: (0.9, 0.25), 7: (0.9, 0.75), 8: (0.1, 0.75)}[tag]


def test_class_outcomes(spark):
    df = spark.createDataFrame([("can", 0), ("can", 1), ("person", 1), ("zzz", 1), (None, 0)], "c string, crowd int")
    got = [r[0] for r in df.select(classmap.mapped_category(F.col("c"), F.col("crowd"), {"can": "METAL", "person": "drop_image"})).collect()]
    assert got == ["METAL", "crowd", "drop_image", "unknown_category_id", "unknown_category_id"]
    tags = spark.createDataFrame([({"material": "glass", "state": "wet"},), ({"material": "glass"},), ({},), ({"material": "rock"},)], "t map<string,string>")
    got = [r[0] for r in tags.select(classmap.mapped_object(F.col("t"), [("state", "wet", "OTHER")], "material", {"glass": "GLASS", "untagged": "OTHER"})).collect()]
    assert got == ["OTHER", "GLASS", "OTHER", "unmapped"]


def test_spoken_lists(spark):
    df = spark.createDataFrame([([],), (["A"],), (["A", "B"],), (["A", "B", "C"],)], "x array<string>")
    assert [r[0] for r in df.select(T.spoken_list(F.col("x"))).collect()] == ["", "A", "A and B", "A, B and C"]


def test_spearman_ties_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 2.0, 2.0), ("b", 1.0, 5.0), ("b", 1.0, 6.0)], "g string, x double, y double")
    got = {r.g: r.rho for r in search_log.spearman(df, ["g"], "x", "y").collect()}
    assert math.isclose(got["a"], np.corrcoef([1, 2.5, 2.5], [1, 3, 2])[0, 1]) and got["b"] is None


SPACE = [search_log.Dimension(f"x{i}", -5.12, 5.12) for i in range(6)]


def test_swarm_follows_the_formula(spark):
    """A swarm whose numbers are computed anew, one by one, from the log."""
    w = search_log.Swarm(SPACE, 5, 6, 1)
    assert [round(w.weight(m), 9) for m in range(5)] == [0.9, 0.775, 0.65, 0.525, 0.4] and search_log.Swarm(SPACE, 5, 2).weight(0) == 0.9
    bad = lambda f: f.select("round", "particle", F.when((F.col("round") == 1) & (F.col("particle") == 2), float("nan")).otherwise(-search_log.sphere(F.col("vector"))).alias("score"))
    log = {(r["round"], r.particle): r for r in search_log.run_search(spark, w, bad).collect()}

    def unit(*parts):
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32

    for p in range(5):
        for k in range(6):
            x, v = -5.12 + unit(1, "x", p, k) * 10.24, (2 * unit(1, "v", p, k) - 1) * 1.024
            for r in range(6):
                assert math.isclose(log[r, p].vector[k], x, abs_tol=1e-9)
                value = lambda q: -math.inf if math.isnan(q.score) else q.score
                own = max((log[i, p] for i in range(r + 1)), key=value).vector[k]
                best = max((log[i, q] for i in range(r + 1) for q in range(5)), key=value).vector[k]
                v = (0.9 - 0.5 * r / 4) * v + 1.5 * unit(1, "own", r, p, k) * (own - x) + 1.5 * unit(1, "best", r, p, k) * (best - x)
                v = max(-2.048, min(2.048, v))
                v, x = (v if -5.12 <= x + v <= 5.12 else 0.0), max(-5.12, min(5.12, x + v))
    again = search_log.run_search(spark, search_log.Swarm(SPACE, 5, 6, 2), bad).where("round = 0").collect()
    assert [r.vector for r in again] != [log[0, r.particle].vector for r in again]


def test_swarm_reaches_a_corner(spark):
    rise = lambda f: f.select("round", "particle", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("score"))
    log = search_log.run_search(spark, search_log.Swarm(SPACE[:2], 6, 14, 3), rise)
    assert log.agg(F.max("score")).first()[0] > 2 * 5.12 * 0.95


def test_search_resumes_and_refuses(spark):
    calls = []

    def fit(df):
        calls.append(df.count())
        return df.select("round", "particle", (-search_log.sphere(F.col("vector"))).alias("score"))

    whole = search_log.run_search(spark, search_log.Swarm(SPACE, 4, 3, 5), fit)
    assert sum(calls) == 12
    log = whole.where("round < 1 or (round = 1 and particle < 2)").drop("replayed")
    calls.clear()
    again = search_log.run_search(spark, search_log.Swarm(SPACE, 4, 3, 5), fit, log)
    assert sum(calls) == 6 and sorted(r.score for r in again.collect()) == sorted(r.score for r in whole.collect())
    with pytest.raises(ValueError):
        search_log.run_search(spark, search_log.Swarm(SPACE, 4, 3, 6), fit, log)
    with pytest.raises(ValueError):
        search_log.run_search(spark, search_log.Swarm(SPACE, 4, 3, 5), fit, whole.where("round = 1").drop("replayed"))


def test_latin_hypercube_has_one_point_per_stratum(spark):
    rows = search_log.latin_hypercube(spark, 20, [search_log.Dimension("u", 0.0, 1.0), search_log.Dimension("v", 0.0, 1.0)], 3).collect()
    for d in "uv":
        assert sorted(int(r.x * 20) for r in rows if r.dim == d) == list(range(20))


def test_session_seconds(spark):
    df = spark.createDataFrame([(1, 50.0), (2, 100.0), (3, 150.0), (4, 40.0), (5, 90.0)], "e int, t double").withColumn("r", F.lit(1))
    assert search_log.session_seconds(df, ["r"], "e", "t").first().seconds == 240.0


def test_non_maximum(spark):
    rows = [("i", 1, 0, 0.9, 0.0, 0.0, 1.0, 1.0), ("i", 2, 0, 0.8, 0.05, 0.0, 1.0, 1.0), ("i", 3, 1, 0.7, 0.0, 0.0, 1.0, 1.0), ("i", 4, 0, 0.1, 5.0, 5.0, 6.0, 6.0), ("j", 1, 0, 0.5, 0.0, 0.0, 1.0, 1.0), (None, 9, 0, 0.9, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image string, ord int, cls int, conf double, x0 double, y0 double, x1 double, y1 double")
    kept = lambda **k: {tuple(r) for r in matching.non_maximum(df, **k).collect()}
    assert kept() == {("i", 1), ("i", 3), ("j", 1)} and kept(agnostic=True) == {("i", 1), ("j", 1)}
    assert kept(iou=0.99) == {("i", 1), ("i", 2), ("i", 3), ("j", 1)} and kept(iou=0.99, most=2) == {("i", 1), ("i", 2), ("j", 1)}
    assert kept(classes=[1]) == {("i", 3)} and kept(least=0.05, classes=[0]) == {("i", 1), ("i", 4), ("j", 1)} and matching.non_maximum(df.limit(0)).count() == 0
