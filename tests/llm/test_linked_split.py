import random

from gleanery.llm.linked_split import LinkedSplit, split_report

ROWS = "row_id long, source string, uploader string, domain string, dominant_class string"
TARGETS = "domain string, split string, share double"
SHARES = [("studio", "train", 0.7), ("studio", "valid", 0.2), ("studio", "test", 0.1), ("coastal", "train", 0.5), ("coastal", "valid", 0.3), ("coastal", "test", 0.2)]


def test_pairs_chain_and_stand_ins(spark):
    rows = [(i, f"s_{i}", f"u{i}") for i in range(40)] + [(100 + i, f"S-{i + 1}", f" U{i} ") for i in range(39)]
    rows += [(300, "lone", "Unknown"), (301, "other", "unknown "), (302, "x", None), (303, "y", ""), (304, None, "u1"), (305, "z", "n/a")]
    df = spark.createDataFrame(rows, "row_id long, source string, uploader string")
    names = spark.createDataFrame([(f"s_{i}",) for i in range(41)] + [("lone",), ("other",), ("z",)], "source_name string")
    got = {tuple(r) for r in LinkedSplit(df).pairs(names).collect()}
    want = {tuple(sorted((f"s_{i}", f"s_{j}"))) for i in range(40) for j in range(i)}
    assert got == want


def test_assignment_keeps_groups_and_shares(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(400):
        dom = rng.choice(["studio", "Studio ", "coastal", None])
        for _ in range(rng.randint(1, 30) if g else 900):
            n += 1
            rows.append((n, f"src{g}", f"up{g // 2}" if g > 20 else rng.choice(["n/a", None]), dom, rng.choice(["A", "b", None])))
    df = spark.createDataFrame(rows, ROWS)
    out = LinkedSplit(df).assign(spark.createDataFrame(SHARES, TARGETS)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        for k in (("s", r.source), ("u", r.uploader if r.uploader != "n/a" else None)):
            if k[1]:
                by.setdefault(k, set()).add(r.assigned_split)
    assert all(len(v) == 1 for v in by.values())
    rep = split_report(LinkedSplit(df).assign(spark.createDataFrame(SHARES, TARGETS)), spark.createDataFrame(SHARES, TARGETS)).collect()
    assert all(abs(r.share - r.target) < 0.02 for r in rep if r.domain) and max(r.class_gap for r in rep) < 0.03, rep
    assert sum(r.rows for r in rep) == len(rows)
    again = LinkedSplit(df.repartition(9)).assign(spark.createDataFrame(SHARES, TARGETS)).collect()
    assert {r.row_id: r.assigned_split for r in out} == {r.row_id: r.assigned_split for r in again}


def test_rows_without_source_and_uploader_follow_their_domain(spark):
    rows = [(i, None, [None, "n/a"][i % 2], ["studio", "coastal"][i % 3 % 2], "ab"[i % 2]) for i in range(6000)]
    t = spark.createDataFrame(SHARES, TARGETS)
    out = LinkedSplit(spark.createDataFrame(rows, ROWS)).assign(t)
    rep = split_report(out, t).collect()
    assert out.where("assigned_split is null or group_label is not null").count() == 0
    assert len(rep) == 6 and all(abs(r.share - r.target) < 0.01 and r.class_gap < 0.02 for r in rep)


def test_empty_nulls_and_extra_columns(spark):
    t = spark.createDataFrame(SHARES, TARGETS)
    assert LinkedSplit(spark.createDataFrame([], ROWS)).assign(t).count() == 0
    df = spark.createDataFrame([(1, None, None, None, None, 4), (2, "a", None, "studio", "x", 5), (2, "a", None, "studio", "x", 5)], ROWS + ", label int").withColumn("_node", __import__("pyspark").sql.functions.lit("keep"))
    out = LinkedSplit(df).assign(t).collect()
    assert len(out) == 3 and all(r.assigned_split in ("train", "valid", "test") for r in out)
    assert len({r.assigned_split for r in out if r.row_id == 2}) == 1 and {r.label for r in out} == {4, 5} and {r["_node"] for r in out} == {"keep"}
