import random

import pytest
from pyspark.sql import functions as F

from gleanery.llm.stable_sample import sample_report, stable_sample
from gleanery.llm.target_sample import TargetSample

ROWS = "row_id long, split string, file string, source string, dominant_class string"
TARGETS = "split string, source string, dominant_class string, share_bp int, min_rows int"


def test_target_sample_quotas_and_report(spark):
    rng = random.Random(3)
    rows, k = [], 0
    have = {("a", "X"): 400, ("a", "Y"): 300, ("b", "X"): 290, ("b", "Y"): 10}
    for (s, c), n in have.items():
        for i in range(n):
            k += 1
            rows.append((k, rng.choice(["train", " Train", "TRAIN."]), f"{s}{c}{i}.jpg", rng.choice([s, s.upper(), f" {s}-"]), rng.choice([c, c.lower(), c + "."])))
            if i % 10 == 0:
                rows.append((k + 100_000, "train", f"{s}{c}{i}.JPG", s, c))
    rows += [(9001, None, "n.jpg", "a", "X"), (9002, "train", None, "a", "X"), (9003, "train", "z.jpg", None, "X"), (9004, "train", "q.jpg", "other", "X"), (9005, "train", "w.jpg", "a", None)]
    targets = [("train", "a", "X", 2500, 1), ("train", "a", "Y", 2500, 1), ("train", "b", "X", 2500, 1), ("train", "b", "Y", 2500, 2), ("valid", "a", "X", 10000, 3)]
    t = TargetSample(spark.createDataFrame(rows, ROWS), spark.createDataFrame(targets, TARGETS))
    rep = {(r.split, r.source, r.dominant_class): r for r in t.report().collect()}
    assert rep["train", "b", "Y"].available == 10 and rep["train", "b", "Y"].required == 25 and not rep["train", "b", "Y"].met
    assert rep["train", "a", "X"].available == 400 and rep["train", "a", "X"].met
    assert {tuple(r) for r in t.unmet().collect()} == {("train", "b", "Y"), ("valid", "a", "X")}
    assert rep["train", "b", "Y"].drawn == 10 and not rep["train", "b", "Y"].can_be_met
    assert rep["train", "a", "X"].source_gap == rep["train", "a", "Y"].source_gap == -rep["train", "b", "X"].source_gap
    drawn = t.sample().collect()
    assert len(drawn) == 100 == sum(r.drawn for r in rep.values())
    assert len({(r.dominant_class, r.file) for r in drawn}) == 100
    per = {k: sum((r.split, r.source, r.dominant_class) == k for r in drawn) for k in rep}
    assert all(per[k] == rep[k].drawn for k in rep) and per["train", "b", "Y"] == 10
    again = TargetSample(spark.createDataFrame(rows[::-1], ROWS).repartition(7), spark.createDataFrame(targets, TARGETS)).sample().collect()
    assert sorted(drawn) == sorted(again)


def test_what_is_drawn_below_the_requirement_is_reported(spark):
    """Requirements are rounded up and add up to more than the sample."""
    rows = [(k, "train", f"{k}.jpg", "abc"[k % 3], "XYZ"[k // 3 % 3]) for k in range(1000)]
    targets = [("train", s, c, 1111 if (s, c) != ("a", "X") else 1112, 0) for s in "abc" for c in "XYZ"]
    rep = TargetSample(spark.createDataFrame(rows, ROWS), spark.createDataFrame(targets, TARGETS)).report().collect()
    assert sum(r.drawn for r in rep) == 100 < sum(r.required for r in rep) and all(r.can_be_met for r in rep)
    assert all(r.met == (r.drawn >= r.required) for r in rep) and not all(r.met for r in rep)
    assert all(abs(r.source_gap) < 1 and abs(r.class_gap) < 1 for r in rep)


def test_target_sample_empty(spark):
    t = TargetSample(spark.createDataFrame([], ROWS), spark.createDataFrame([("train", "a", "X", 100, 1), ("train", "a", "Y", 0, 0)], TARGETS))
    assert [tuple(r) for r in t.unmet().collect()] == [("train", "a", "X")]
    assert t.sample().count() == 0


def test_target_sample_extra_columns(spark):
    df = spark.createDataFrame([(1, "train", "f", "a", "X", 5, 6)], ROWS + ", cell int, _f int")
    t = TargetSample(df, spark.createDataFrame([("train", "a", "X", 10000, 1)], TARGETS))
    assert t.report().first().available == 1


def test_target_table_must_be_small(spark):
    import gleanery.llm.target_sample as m

    old, m.MOST_CELLS = m.MOST_CELLS, 1
    try:
        with pytest.raises(ValueError):
            TargetSample(spark.createDataFrame([], ROWS), spark.createDataFrame([("train", "a", "X", 1, 1), ("train", "a", "Y", 1, 1)], TARGETS))
    finally:
        m.MOST_CELLS = old


def _files(spark, n, start=0):
    return spark.range(start, n).select(F.col("id").alias("row_id"), F.concat(F.lit("F"), F.col("id").cast("string"), F.lit(".jpg")).alias("file"), F.when(F.col("id") % 3 == 0, "studio").otherwise("Coastal ").alias("domain"))


def test_stable_sample_grows_and_keeps(spark):
    small, big = _files(spark, 2000), _files(spark, 6000)
    a = {r.file for r in stable_sample(small, 0.1).collect()}
    b = {r.file for r in stable_sample(big.repartition(13), 0.1).collect()}
    assert a <= b and b & {r.file for r in small.collect()} == a
    assert 500 < len(b) < 700
    assert {r.file for r in stable_sample(big, 0.05).collect()} <= b
    assert {r.file for r in stable_sample(big, 0.1, salt="x").collect()} != b


def test_stable_sample_rates_nulls_and_case(spark):
    rows = _files(spark, 3000).unionByName(_files(spark, 3000).select("row_id", F.lower("file").alias("file"), F.lit(None).cast("string").alias("domain")))
    out = stable_sample(rows, 0.05, {"STUDIO": 0.5})
    per = out.groupBy(F.lower("file").alias("f")).agg(F.count("*").alias("n"))
    assert per.where("n <> 2").count() == 0
    share = out.where("domain = 'studio'").count() / 1000
    assert 0.42 < share < 0.58
    assert stable_sample(spark.createDataFrame([(None, "a")], "file string, domain string"), 1.0).count() == 0
    assert stable_sample(_files(spark, 0), 0.1).count() == 0
    rep = {r.domain: (r.files, r.sampled) for r in sample_report(_files(spark, 3000), 0.1).collect()}
    assert rep["studio"][0] == 1000 and rep["coastal"][0] == 2000
    assert stable_sample(spark.createDataFrame([("a", "b", 1)], "file string, domain string, _stable_key int"), 1.0, {"b": 1.0}).columns == ["file", "domain", "_stable_key"]
