"""Joins of search logs over all users."""

from gleanery.plans.registry import QUERIES


def test_join14_pairs_every_search_with_the_next(spark, folder):
    scores = {}
    for e in sorted(spark.read.parquet(f"{folder}/events.parquet").collect(), key=lambda e: (e.user_id, e.ts, e.event_id)):
        scores.setdefault(e.user_id, []).append(e.value)
    users = sorted(scores)
    want = {(u, v, i): (x, y) for u, v in zip(users, users[1:], strict=False) for i, (x, y) in enumerate(zip(scores[u], scores[v], strict=False))}
    got = QUERIES["join14_tolerance"](spark, folder).collect()
    assert len(got) == len(want) and {(r.user_id, r.next_id, r.i): (r.a, r.b) for r in got} == want
    assert all(r.near == (abs(r.a - r.b) <= 1e-9 * max(abs(r.a), abs(r.b))) for r in got)
    assert len({r.user_id for r in got}) == len(users) - 1 > 2
