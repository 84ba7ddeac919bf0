"""Every core query: against its SQL where it has one, else against what must hold of its rows."""

import json

import pytest

from gleanery.plans.registry import QUERIES, SQL
from tests.compare import same


def _intervals(rows, spark, folder):
    assert {r.model for r in rows} == {"A", "B", "C"} and all(0 <= r.low <= r.mean <= r.high <= 1 for r in rows)


def _pairwise(rows, spark, folder):
    assert {(r.a, r.b) for r in rows} == {("A", "B"), ("A", "C"), ("B", "C")}
    assert all(r.low <= r.mean_diff <= r.high and r.significant == (r.low > 0 or r.high < 0) and ("beats" in r.verdict) == r.significant for r in rows)


def _verdicts(rows, spark, folder):
    assert len(rows) > 3 and all(0 <= r.p_value <= 1 and r.verdict == ("pass" if r.rho >= 0.9 else "fail") for r in rows)


def _report(rows, spark, folder):
    doc = json.loads(rows[0].report)
    n = spark.read.parquet(f"{folder}/split.parquet").count()
    assert all(sum(x["kept"] + x["excluded"] for x in doc[part]) == n for part in ("totals", "domains", "sources")) and doc["duplicates"]["groups"] > 0


CHECKS = {
    "bst1_bootstrap_1000": _intervals, "agg16_pairwise_1000": _pairwise, "agg21_verdict": _verdicts, "rpt3_build_report": _report,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        CHECKS[name](df.collect(), spark, folder)


def test_names_match():
    assert set(SQL) | set(CHECKS) == set(QUERIES)
