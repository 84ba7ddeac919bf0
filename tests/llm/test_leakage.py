import random

import numpy as np
import pytest

from gleanery.llm import leakage as L

D, I = "doc_id long, text string", "item_id long, item_text string"


def brute(docs, items, run=60):
    norm = lambda t: "".join(map(chr, L.normal(t)))
    out = set()
    for i, t in items:
        s = norm(t) if t else ""
        grams = {s[k : k + run] for k in range(len(s) - run + 1)}
        for d, u in docs:
            v = norm(u) if u else ""
            if any(v[k : k + run] in grams for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


def world(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzäéñßœ") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(40)) for i in range(25)] + [(50, None), (51, ""), (52, "short one"), (53, "x" * 500)]
    docs = [(i, text(r.randint(0, 200))) for i in range(120)]
    for d in range(40):
        s = items[d % 25][1]
        a = r.randint(0, 60)
        piece = s[a : a + r.randint(55, 110)]
        piece = r.choice([piece, piece.upper(), piece.replace(" ", "​ - "), piece.replace("é", "é")])
        docs.append((1000 + d, text(r.randint(0, 50)) + " " + piece + " " + text(20)))
    docs += [(2000, None), (2001, ""), (2002, items[0][1]), (2002, items[0][1]), (2003, "x" * 59), (2004, "x" * 60), (2005, "y " * 50_000 + items[1][1] + " z" * 50_000)]
    return docs, items


@pytest.mark.parametrize("most_held", [L.MOST_HELD, 0])
def test_against_brute_force(spark, most_held):
    docs, items = world()
    found = L.leaks(spark.createDataFrame(docs, D), spark.createDataFrame(items, I), most_held=most_held)
    got = {tuple(r) for r in found.collect()}
    assert got == brute(docs, items) and (2004, 53) in got and (2003, 53) not in got and (2005, 1) in got


def test_winnowing_guarantee():
    """Two texts that share k + w - 1 characters share a fingerprint there."""
    r = np.random.default_rng(2)
    for _ in range(50):
        shared = r.integers(97, 123, 60).astype(np.uint32)
        a, b = (np.concatenate([r.integers(97, 123, r.integers(0, 90)).astype(np.uint32), shared, r.integers(97, 123, r.integers(0, 90)).astype(np.uint32)]) for _ in range(2))
        ha, hb = L.gram_hashes(a), L.gram_hashes(b)
        assert set(ha[L.winnow(ha, 29)]) & set(hb[L.winnow(hb, 29)])


def test_empty_and_extra_columns(spark):
    d, i = spark.createDataFrame([], D), spark.createDataFrame([], I)
    assert L.leaks(d, i).count() == 0 and L.leaks(d, i, most_held=-1).count() == 0
    docs = spark.createDataFrame([(1, "q" * 80, 5, 6)], D + ", item_id long, t int")
    items = spark.createDataFrame([(9, "q" * 80, 5)], I + ", d int")
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == [(1, 9)]
    assert [tuple(r) for r in L.leaks(docs, items, most_held=1).collect()] == [(1, 9)]
    with pytest.raises(ValueError):
        L.leaks(docs, items, run=20)
