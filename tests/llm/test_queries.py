"""Every training-data query: against its SQL where it has one, else against what must hold of its rows."""

import math

import pytest

from gleanery.llm.queries import QUERIES, SQL
from tests.compare import same


def _sample(rows, spark, folder):
    rep = {(r.split, r.source, r.dominant_class): r for r in QUERIES["p1_report"](spark, folder).collect()}
    got = {}
    for r in rows:
        k = (r.split, r.source, r.dominant_class)
        got[k] = got.get(k, 0) + 1
    assert rows and all(rep[k].drawn == got.get(k, 0) for k in rep) and len({(r.split, r.source, r.dominant_class, r.file) for r in rows}) == len(rows)


def _target_report(rows, spark, folder):
    assert len(rows) == 126
    for r in rows:
        assert 0 <= r.drawn <= r.available and r.reachable == min(r.required, r.available)
        assert r.met == (r.drawn >= r.required) and r.can_be_met == (r.available >= r.required) and r.drawn >= min(r.min_rows, r.available)
    for split in {r.split for r in rows}:
        own = [r for r in rows if r.split == split]
        assert sum(r.drawn for r in own) == min(max(own[0].sample_size, sum(min(r.min_rows, r.available) for r in own)), sum(r.available for r in own))


def _assignment(rows, spark, folder):
    own = {}
    for r in rows:
        own.setdefault(r.group_label, set()).add(r.assigned_split)
    assert len(rows) == spark.read.parquet(f"{folder}/split.parquet").count()
    assert all(len(v) == 1 for k, v in own.items() if k is not None) and {r.assigned_split for r in rows} <= {"train", "valid", "test"}


def _shares(rows, spark, folder):
    assert sum(r.rows for r in rows) == spark.read.parquet(f"{folder}/split.parquet").count()
    per = {}
    for r in rows:
        per[r.domain] = per.get(r.domain, 0) + r.share
    assert all(abs(x - 1) < 1e-3 for x in per.values()) and all(0 <= r.class_gap <= 1 for r in rows)


def _overlap(rows, spark, folder):
    assert all(0 <= r.overlapping <= r.rows and (r.coverage is None) == (r.overlapping == 0) and 0 < (r.coverage or 1) <= 1 for r in rows)


def _mix_report(rows, spark, folder):
    assert len(rows) == 13 and math.isclose(sum(r.actual_share for r in rows), 1) and math.isclose(sum(r.target_share for r in rows), 1)
    assert all(r.most_repeats <= r.max_repeats and abs(r.actual_share - r.target_share) <= r.tolerance + 1e-12 for r in rows)


def _mix(rows, spark, folder):
    assert rows and len({(r.doc_id, r.copy_no) for r in rows}) == len(rows) and [r.position_key for r in rows] == sorted(r.position_key for r in rows)


def _languages(rows, spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()
    whole = {r.doc_id: r.lang for r in rows if r.par_no == -1}
    assert set(whole) == {d.doc_id for d in docs} and {"en", "de", "fr"} <= set(whole.values()) and all(0 <= r.confidence <= 1 for r in rows)
    # most labels that are plain codes are right
    plain = [d for d in docs if d.lang in ("en", "de", "fr", "es", "pt", "it")]
    assert sum(whole[d.doc_id] == d.lang for d in plain) > 0.8 * len(plain)


def _wrong_labels(rows, spark, folder):
    docs = {d.doc_id: d.lang for d in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    assert rows and all(docs[r.doc_id] != r.lang for r in rows if r.par_no == -1) and len({tuple(r) for r in rows}) == len(rows)


CHECKS = {
    "p1_sample": _sample, "p1_report": _target_report, "p2_assignment": _assignment, "p2_report": _shares, "p4_report": _overlap, "p8_report": _mix_report, "p8_mix": _mix,
    "p9_languages": _languages, "p9_found": _wrong_labels,
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
