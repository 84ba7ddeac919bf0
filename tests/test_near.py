"""Both rules of near-duplicates against exhaustive search."""

from collections import Counter

import numpy as np

from gleanery.operators import pictures
from gleanery.plans import record_queries
from gleanery.plans.registry import QUERIES

HASHED = """select lower(file) f, any_value(h0) h0, any_value(h1) h1, any_value(h2) h2, any_value(h3) h3, any_value(thumb) thumb
    from fingerprints where file is not null and h0 is not null and h1 is not null and h2 is not null and h3 is not null group by 1"""


def exhaustive(duck):
    """{(file, file): (bits, rule)} over all pairs of hashed files."""
    t = duck.execute(HASHED).df().sort_values("f", ignore_index=True)
    h = t[["h0", "h1", "h2", "h3"]].to_numpy(np.int64).view(np.uint64)
    out = {}
    for i in range(len(t)):
        bits = np.bitwise_count(h[i] ^ h[i + 1 :]).sum(1)
        for j in np.flatnonzero(bits <= 40):
            n, x, y = int(bits[j]), t.thumb[i], t.thumb[i + 1 + j]
            if n <= 10:
                out[t.f[i], t.f[i + 1 + j]] = n, "dhash"
            elif x is not None and y is not None and np.corrcoef(x, y)[0, 1] >= 0.9:
                out[t.f[i], t.f[i + 1 + j]] = n, "thumb_corr"
    return out


def test_near_pairs_by_both_rules(spark, folder, duck):
    got = QUERIES["dup2_near_pairs_full"](spark, folder).collect()
    want = exhaustive(duck)
    assert {"dhash", "thumb_corr"} == {rule for _, rule in want.values()}
    assert len(got) == len(want) and {(r.a, r.b): (r.bits, r.rule) for r in got} == want


def test_near_pairs_met_through_a_third(spark, monkeypatch):
    """The outer two of a chain share neither a piece of the hash nor a suffix, and are found through the middle one."""
    rng = np.random.default_rng(5)
    mid = rng.integers(0, 256, 64).astype(float)
    bits = lambda at: np.packbits(np.isin(np.arange(256), at)).view(">u8").astype(np.uint64).view(np.int64).tolist()
    # ten bits in pieces 0 to 4, ten in pieces 5 to 10: each leaves the other's pieces whole, both leave none
    rows = [("a", bits([2, 3, 26, 27, 50, 51, 74, 75, 97, 98]), mid), ("b", bits([]), mid), ("c", bits([118, 141, 142, 164, 165, 188, 189, 211, 212, 236]), mid * 0.5 + 3)]
    monkeypatch.setattr(pictures, "symbols", lambda t: rng.integers(0, 128, (len(t), pictures.SYMBOLS)))
    monkeypatch.setattr(pictures, "SKETCH_MOST", pictures.SKETCH)
    df = spark.createDataFrame([(f, *h, [float(v) for v in t]) for f, h, t in rows], "file string, h0 long, h1 long, h2 long, h3 long, thumb array<double>")
    got = {(r.a, r.b): (r.bits, r.rule) for r in pictures.near_files(df).collect()}
    assert got == {("a", "b"): (10, "dhash"), ("b", "c"): (10, "dhash"), ("a", "c"): (20, "thumb_corr")}


def components(nodes, links):
    """{node: smallest node of its component}, by union-find."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in up}


def expected_rows(spark, folder, duck):
    """({file: near group}, [(row, split, source, {key: value})], {row: whole group})"""
    near = components([r[0] for r in duck.execute(HASHED).fetchall()], exhaustive(duck))
    rows = [(r.row_id, r.split, r.source, {"file": r.f, "md5": r.md5, "stem": r.stem, "near_dup": near.get(r.f)}) for r in record_queries._keyed(spark, folder).collect()]
    first, links = {}, []
    for row, _, _, keys in rows:
        links += [(row, first.setdefault(k, row)) for k in keys.items() if k[1] is not None]
    return near, rows, components([r[0] for r in rows], links)


def test_groups_and_leaks_by_all_keys(spark, folder, duck):
    near, rows, whole = expected_rows(spark, folder, duck)
    run = lambda name: QUERIES[name](spark, folder).collect()
    assert {r.f: r.near_dup for r in run("dup3_near_groups")} == near
    assert {r.node: r.label for r in run("dup4_groups_full")} == whole
    assert len(set(whole.values())) < len({r.label for r in run("dup4_groups")})  # look-alikes link more
    size = Counter(whole.values())
    assert {(r.node, r.group_id, r.n) for r in run("win11_group_numbers_full")} == {(n, g, size[g]) for n, g in whole.items() if size[g] > 1}
    sources = {g: {s for r, _, s, _ in rows if whole[r] == g} - {None} for g in size if size[g] > 1}
    assert [tuple(r) for r in run("agg8_duplicate_summary_full")] == [(len(sources), sum(size[g] for g in sources), sum(len(s) > 1 for s in sources.values()))]
    rank = {"train": 1, "valid": 2, "test": 3}
    top, held = {}, Counter()
    for _, split, _, keys in rows:
        for k in keys.items():
            if k[1] is not None and split in rank:
                top[k] = max(top.get(k, 0), rank[split])
                held[k, split] += 1
    leaked = {r for r, split, _, keys in rows if split in rank and any(rank[split] < top[k] for k in keys.items() if k[1] is not None)}
    assert {r.row_id for r in run("spl3_leaks_full")} == leaked
    assert len(leaked) > len(run("spl3_leaks"))
    matrix = Counter()
    for (k, a), n in held.items():
        for b in rank:
            if b != a and (k, b) in held:
                matrix[k[0], a, b] += n
    assert {(r.key_name, r.split_a, r.split_b): r.rows for r in run("agg9_leak_matrix_full")} == dict(matrix)


def test_splits_keep_groups_whole(spark, folder, duck):
    _, rows, whole = expected_rows(spark, folder, duck)
    files = {r for r, _, _, keys in rows if keys["file"] is not None}
    got = {r.row_id: (r.label, r.split) for r in QUERIES["spl1_greedy_split_full"](spark, folder).collect()}
    assert {r: g for r, (g, _) in got.items()} == {r: whole[r] for r in files}
    assert len(set(got.values())) == len({g for g, _ in got.values()})
    batch = dict(duck.execute("select row_id, batch_no from split").fetchall())
    rank = {"train": 1, "valid": 2, "test": 3}
    pins = {}
    for r, split, _, _ in rows:
        if r in files and batch[r] == 1 and split in rank:
            pins[whole[r]] = max(pins.get(whole[r], split), split, key=rank.get)
    own = {r: split for r, split, _, _ in rows}
    pinned = QUERIES["spl2_pinned_split_full"](spark, folder).collect()
    assert {r.row_id for r in pinned} == files
    # pinned rows keep their own split; what is not excluded of a group lies in one split
    stay = {(whole[r.row_id], r.split) for r in pinned if not r.excluded}
    assert len(stay) == len({g for g, _ in stay}) == len({whole[r.row_id] for r in pinned})
    assert all(r.split == (own[r.row_id] if r.excluded else pins.get(whole[r.row_id], r.split)) for r in pinned)
    assert {r.row_id for r in pinned if r.excluded} == {r for r in files if batch[r] == 1 and own[r] in rank and own[r] != pins[whole[r]]}
