import math
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm.rounding import bounded_shares, controlled_round


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.fractions(0, 9, max_denominator=50), min_size=3, max_size=3), min_size=1, max_size=6))
def test_margins_become_floor_or_ceiling(rows):
    table = {(r, c): v for r, row in enumerate(rows) for c, v in enumerate(row)}
    got = controlled_round(table)
    near = lambda x, v: x in (math.floor(v), math.ceil(v))
    assert all(near(got[k], v) for k, v in table.items())
    for axis in (0, 1):
        for key in {k[axis] for k in table}:
            assert near(sum(got[k] for k in table if k[axis] == key), sum(v for k, v in table.items() if k[axis] == key))
    assert near(sum(got.values()), sum(table.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9), st.integers(0, 40)), min_size=1, max_size=12), st.integers(0, 200))
def test_shares_keep_to_their_bounds(cells, total):
    w, low, high = ({i: c[k] for i, c in enumerate(cells)} for k in range(3))
    got = bounded_shares(w, low, high, total)
    assert all(min(low[k], high[k]) <= got[k] <= high[k] for k in w)
    most, least = sum(high.values()), sum(min(low[k], high[k]) for k in w)
    room = sum(high[k] for k in w if w[k]) + sum(min(low[k], high[k]) for k in w if not w[k])
    if least <= total <= room:
        assert sum(got.values()) == total
    assert sum(got.values()) <= max(most, total)


def test_plain_shares():
    assert bounded_shares({1: 1, 2: 3}, {1: 0, 2: 0}, {1: 9, 2: 9}, 8) == {1: Fraction(2), 2: Fraction(6)}
    assert controlled_round({}) == {}
