"""Evaluation passages inside training text (problem 7).

Method: winnowing. Texts are reduced to their letters and digits without case and accents; of every window of ``w`` hashes of
``k`` successive characters the smallest is kept (each of equal ones). Two texts that share a run of ``k + w - 1``
characters keep the same hash in it, so with k + w - 1 = ``run`` no shared run of that length is missed. Fingerprints of corpus
and items are joined, and every hit is extended to both sides and kept if the whole shared run is long enough.

Fingerprints of the items are held by every worker if their texts are at most ``MOST_HELD`` characters, which is checked; the
corpus is then read once and not shuffled. More items go through a shuffle join of both sides' fingerprints.

Defined results: null texts and texts with fewer than ``run`` letters and digits share nothing. Repeated documents are each
reported, and so are items with equal texts. A pair is reported once. Empty tables give an empty result. Columns beside key and
text are ignored. Texts are processed whole, in pieces of a batch only where that bounds memory.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import stage

RUN = 60
#: 2**5 characters per hash, so that five doublings make them.
GRAM_STEPS = 5
MOST_HELD = 20_000_000
_PIECE = 4_000_000
_MUL = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _fold_table() -> np.ndarray:
    """For each code point whether it is kept: letters and digits are, marks and everything else are not."""
    keep = np.zeros(0x110000, bool)
    for c in range(0x110000):
        keep[c] = chr(c).isalnum()
    return keep


_TABLE: list[np.ndarray] = []


def normal(text: str) -> np.ndarray:
    """The text's letters and digits as code points, without case and accents."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFC", text).casefold())
    else:
        text = text.lower()
    if not _TABLE:
        _TABLE.append(_fold_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes[_TABLE[0][codes]]


def gram_hashes(codes: np.ndarray, steps: int = GRAM_STEPS) -> np.ndarray:
    """A hash of the 2**steps characters from each position on (fewer positions than characters)."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _MUL[0]
    h ^= h >> np.uint64(29)
    for i in range(steps):
        n = 1 << i
        if len(h) <= n:
            return np.zeros(0, np.uint64)
        h = h[:-n] * _MUL[1 + i] + h[n:]
        h ^= h >> np.uint64(31)
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the kept hashes: the smallest of every ``window`` successive ones."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    low, size = h, 1
    while size * 2 <= window:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < window:
        d = window - size
        low = np.minimum(low[:-d], low[d:])
    # a position is kept if it is smallest in some window: the largest of the minima of the windows it is in
    n, m = len(h), len(low)
    best = np.zeros(n, np.uint64)
    pad = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
    top, size = pad, 1
    while size * 2 <= window:
        top, size = np.maximum(top[:-size], top[size:]), size * 2
    if size < window:
        d = window - size
        top = np.maximum(top[:-d], top[d:])
    best[:] = top[:n]
    assert len(top) == m + window - 1
    return np.flatnonzero(h == best)


def shared_run(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """Length of the equal run around positions i of a and j of b, and where in a it ends."""
    n = min(len(a) - i, len(b) - j)
    x = np.flatnonzero(a[i : i + n] != b[j : j + n])
    right = int(x[0]) if len(x) else n
    n = min(i, j)
    y = np.flatnonzero(a[i - n : i] != b[j - n : j])
    return right + (n - 1 - int(y[-1]) if len(y) else n), i + right


class _Items:
    """The items' texts and sorted fingerprints: made once on the driver, and held by the workers as plain arrays."""

    def __init__(self, rows: list[tuple[int, str]], run: int) -> None:
        window = run - (1 << GRAM_STEPS) + 1
        codes, hashes, where, at = [], [], [], []
        for n, (_, text) in enumerate(rows):
            codes.append(normal(text))
            h = gram_hashes(codes[-1])
            kept = winnow(h, window)
            hashes.append(h[kept])
            where.append(np.full(len(kept), n))
            at.append(kept)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        h, item, at = cat(hashes, np.uint64), cat(where, np.int64), cat(at, np.int64)
        order = np.argsort(h, kind="stable")
        self.hold([k for k, _ in rows], cat(codes, np.uint32), np.cumsum([0, *map(len, codes)]), h[order], item[order], at[order])

    def hold(self, *arrays) -> "_Items":
        self.arrays = arrays
        self.ids, self.flat, self.ends, self.h, self.item, self.at = arrays
        return self

    def codes(self, n: int) -> np.ndarray:
        return self.flat[self.ends[n] : self.ends[n + 1]]


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > _PIECE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fingerprints(texts: list[str], run: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: number of its first text, normal forms, and (text number in the piece, position, hash) of every kept fingerprint.

    The texts of a piece are hashed as one string; grams and windows that cross a border are dropped, and what a text's own
    windows keep is kept whatever its neighbours are, since grams over a border get the largest hash.
    """
    window = run - (1 << GRAM_STEPS) + 1
    gram = 1 << GRAM_STEPS
    for a, b in _pieces(texts):
        codes = [normal(t) for t in texts[a:b]]
        lens = np.array([len(c) for c in codes])
        if not lens.sum():
            continue
        flat = np.concatenate(codes)
        ends = np.cumsum(lens)
        starts = ends - lens
        h = gram_hashes(flat)
        if not len(h):
            continue
        owner = np.repeat(np.arange(len(codes)), lens)[: len(h)]
        crosses = np.arange(len(h)) + gram > ends[owner]
        h[crosses] = np.uint64(0xFFFFFFFFFFFFFFFF)
        kept = winnow(h, window)
        kept = kept[~crosses[kept]]
        own = owner[kept]
        yield a, codes, own, kept - starts[own], h[kept]


def _found(texts: list[str], items: _Items, run: int) -> Iterator[tuple[int, int, int]]:
    """(text number, item number, longest run) of the pairs that share a long enough run."""
    for first, codes, own, at, h in fingerprints(texts, run):
        left = np.searchsorted(items.h, h, "left")
        right = np.searchsorted(items.h, h, "right")
        hit = np.flatnonzero(right > left)
        best: dict[tuple[int, int], int] = {}
        for a in range(0, len(hit), 50_000):
            i = hit[a : a + 50_000]
            n = right[i] - left[i]
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left[i], n)
            i = np.repeat(i, n)
            shift = at[i] - items.at[j]
            by = np.lexsort((at[i], shift, items.item[j], own[i]))
            last, end = None, 0
            for t, item, s, x, y in zip(*(v[by].tolist() for v in (own[i], items.item[j], shift, at[i], items.at[j])), strict=True):
                if (t, item, s) == last and x < end or best.get((t, item), 0) >= run:  # inside the run before, or known
                    continue
                length, end = shared_run(codes[t], x, items.codes(item), y)
                last, best[t, item] = (t, item, s), max(length, best.get((t, item), 0))
        for (t, item), n in best.items():
            if n >= run:
                yield first + t, item, n


def leaks(
    docs: DataFrame, items: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text",
    most_held: int = MOST_HELD,
) -> DataFrame:
    """``(key, item_key)`` of every document and item that share an unbroken run of at least ``run`` letters and digits."""
    if run <= 1 << GRAM_STEPS:
        raise ValueError(f"run must be more than {1 << GRAM_STEPS}")
    spark = docs.sparkSession
    items = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    held_docs = docs.select(F.col(key).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    kinds = f"{key} {docs.schema[key].dataType.simpleString()}, {item_key} {items.schema['i'].dataType.simpleString()}"
    if size > most_held:
        return _shuffled(held_docs, items, run, key, item_key)
    # at most most_held characters, and about one fingerprint for 15 of them
    held = spark.sparkContext.broadcast(_Items([(r["i"], r["t"]) for r in items.collect()], run).arrays)

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = _Items.__new__(_Items).hold(*held.value)
        for part in parts:
            texts = part["t"].tolist()
            pairs = sorted({(t, mine.ids[i]) for t, i, _ in _found(texts, mine, run)})
            ids = part["d"].to_numpy()
            yield pd.DataFrame({key: [ids[t] for t, _ in pairs], item_key: [i for _, i in pairs]})

    return held_docs.mapInPandas(search, kinds)


def _shuffled(docs: DataFrame, items: DataFrame, run: int, key: str, item_key: str) -> DataFrame:
    """The same by a shuffle join of fingerprints; candidates get their texts back and are checked whole."""

    def prints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part.iloc[:, 0].to_numpy()
            for first, _, own, _, h in fingerprints(part["t"].tolist(), run):
                yield pd.DataFrame({"k": ids[own + first], "h": h.view(np.int64)}).drop_duplicates()

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ok = [bool([1 for _ in _found([d], _Items([(0, i)], run), run)]) for d, i in zip(part["dt"], part["it"], strict=True)]
            yield part.loc[ok, ["d", "i"]].rename(columns={"d": key, "i": item_key})

    dk, ik = docs.schema["d"].dataType.simpleString(), items.schema["i"].dataType.simpleString()
    a = docs.mapInPandas(prints, f"k {dk}, h long").withColumnRenamed("k", "d")
    b = items.mapInPandas(prints, f"k {ik}, h long").withColumnRenamed("k", "i")
    # a hot fingerprint is split by the adaptive skew join; only pairs of different texts go on
    pairs = stage(a.join(b, "h").select("d", "i").distinct(), "leak-candidates")
    full = pairs.join(docs.withColumnRenamed("t", "dt"), "d").join(items.withColumnRenamed("t", "it"), "i")
    return full.mapInPandas(check, f"{key} {dk}, {item_key} {ik}").distinct()


def leak_report(found: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per suite: items that leaked and the documents that hold them."""
    return found.join(items.select("item_id", "suite"), "item_id").groupBy("suite").agg(
        F.countDistinct("item_id").alias("items_leaked"), F.countDistinct("doc_id").alias("documents")
    )
