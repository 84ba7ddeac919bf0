import math

import pytest

from gleanery.llm import mixing as M

D, T = "doc_id long, text string, source string", "source string, weight double, max_repeats int"


@pytest.mark.parametrize("rate,cap", [(0.1, 1), (0.7, 1), (1.5, 3), (2.9, 3), (0.01, 8), (7.5, 8), (3.0, 3), (0.0, 4), (800.0, 1000), (999.5, 1000), (3.0, 1000)])
def test_cut_poisson_has_the_mean(rate, cap):
    t = M.thresholds(M.inverted(rate * 70, 70, cap), cap)
    assert len(t) == cap and t == sorted(t)
    assert math.isclose(sum(1 - x for x in t), rate, abs_tol=1e-6)


def test_no_parameter_reaches_more_than_the_cap():
    assert M.inverted(301, 100, 3) is None and M.inverted(1, 0, 3) is None and M.inverted(300, 100, 3) == math.inf
    assert M.thresholds(None, 2) == M.thresholds(math.inf, 2) == [0.0, 0.0]


def test_water_fill():
    assert M.water_fill([0.5, 0.3, 0.2], [100, 100, 100], 60) == [30, 18, 12]
    got = M.water_fill([0.5, 0.3, 0.2], [100, 10, 30], 100)
    assert [round(x, 9) for x in got] == [round(450 / 7, 9), 10, round(180 / 7, 9)]
    assert M.water_fill([1, 1], [3, 4], 100) == [3, 4] and M.water_fill([0, 0], [3, 4], 5) == [0, 0] and M.water_fill([], [], 5) == []


def test_mix_shares_and_limits(spark):
    docs = [(i, "word " * (20 + i % 7), ["big", "Big ", "small", "tiny-x", "unlisted", None][0 if i % 10 < 6 else 2 if i % 10 < 8 else 3 if i % 100 == 8 else 4 if i % 10 == 8 else 5]) for i in range(6000)]
    docs += [(7000, None, "big"), (7001, "", "big")]
    targets = [("big", 0.5, 1), ("SMALL", 0.3, 2), ("tiny_x", 0.15, 3), ("absent", 0.05, 4)]
    m = M.Mix(spark.createDataFrame(docs, D), spark.createDataFrame(targets, T))
    rep = {r.source: r for r in m.report().collect()}
    assert {r.source for r in m.short().collect()} == {"tiny_x", "absent"} == {k for k, r in rep.items() if r.short}
    assert all(r.most_repeats <= r.max_repeats for r in rep.values())
    assert rep["tiny_x"].copies == 3 * rep["tiny_x"].docs and rep["absent"].copies == 0
    total = sum(len(t.split()) for _, t, _ in docs if t)
    assert abs(rep["SMALL"].drawn_tokens / rep["SMALL"].tokens - rep["SMALL"].rate) < 0.1 and total > 0
    assert abs(rep["big"].drawn_tokens / rep["big"].tokens - rep["big"].rate) < 0.06
    assert all(abs(r.actual_share - r.target_share) <= r.tolerance + 1e-12 for r in rep.values())
    assert math.isclose(sum(r.target_share for r in rep.values()), 1) and rep["big"].target_share > 0.5
    rows = m.mixed().collect()
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows) == sum(r.copies for r in rep.values())
    assert [r.position_key for r in rows] == sorted(r.position_key for r in rows)
    again = M.Mix(spark.createDataFrame(docs[::-1], D).repartition(7), spark.createDataFrame(targets, T)).mixed().collect()
    assert [(r.doc_id, r.copy_no) for r in rows] == [(r.doc_id, r.copy_no) for r in again]
    assert 7000 not in {r.doc_id for r in rows}


def test_tokens_and_empty(spark):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> wörld", "a"), (2, None, "a"), (3, "", "a")], D)
    n = {r.doc_id: r.n for r in df.select("doc_id", M.token_count(df.text, M.tokenizer_file()).alias("n")).collect()}
    assert n[1] > 5 and n[2] == n[3] == 0
    m = M.Mix(spark.createDataFrame([], D), spark.createDataFrame([("a", 1.0, 2)], T))
    assert m.mixed().count() == 0 and m.short().count() == 0 and m.report().first().actual_share is None
    extra = spark.createDataFrame([(1, "some text", "a", 1, 2)], D + ", tokens int, source_key int")
    assert M.Mix(extra, spark.createDataFrame([("a", 1.0, 1)], T)).mixed().count() == 1
