"""Same pictures: rows and their equality keys, picture classes, their symbol strings, the exact test, near pairs and their groups.

Two rows show the same picture when their files are equal (ignoring case), or have the same export stem (what stands before
``.rf.``), or their fingerprints have equal md5, or the 256-bit difference hashes differ in at most ``NEAR`` bits, or in at most
``FAR`` bits with a Pearson correlation of the thumbnails of at least ``ALIKE``.

Rows that share a hash and a thumbnail are one *class*; near pairs are sought between classes, so that copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.names import file_key, stem_key
from gleanery.operators.components import connected_components
from gleanery.session import stage

NEAR, FAR, ALIKE = 10, 40, 0.90
HASH = ("h0", "h1", "h2", "h3")
#: Symbols of a thumbnail's string; suffixes start at each of them, in a ring.
SYMBOLS = 31
#: A suffix's prefix: three symbols at these steps, so that two suffixes of one string share one symbol at most.
STEPS = (0, 1, 3)
#: NEAR differing bits leave one of NEAR + 1 pieces untouched.
PIECES = NEAR + 1
#: Bits of the hash, spread over all of it, that travel with every suffix, and how many of them may differ in a candidate: a pair
#: at FAR bits exceeds that with a probability of 1e-8, a pair within 24 bits never does.
SKETCH, SKETCH_MOST = 61, 24
#: How many places apart suffixes with one symbol less in common are compared, and how many bits may differ then.
NEXT, NEXT_MOST = 6, 18
#: Rows of a block of equal prefixes that one task compares; larger blocks are cut in a grid of cells of that size.
BLOCK = 8_192
SIDE = 8


def _directions() -> np.ndarray:
    """Orthonormal directions per symbol, at right angles to the plane of brightness and its slopes."""
    rng = np.random.default_rng(20260101)
    n = SIDE * SIDE
    y, x = np.divmod(np.arange(n), SIDE)
    plane = np.linalg.qr(np.c_[np.ones(n), x - x.mean(), y - y.mean()])[0]
    free = np.eye(n) - plane @ plane.T
    return np.concatenate([free @ np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(SYMBOLS)], axis=1).astype(np.float32)


def symbols(thumbs: np.ndarray) -> np.ndarray:
    """(n, SYMBOLS) strings: for each symbol the direction, with its sign, that the thumbnail points to most.

    Brightness and contrast do not matter, and neither does a slope of light over the picture.
    """
    n = SIDE * SIDE
    out = np.empty((len(thumbs), SYMBOLS), np.int64)
    d = _directions()
    for a in range(0, len(thumbs), 2048):
        t = thumbs[a : a + 2048].astype(np.float32)
        t -= t.mean(1, keepdims=True)
        y = t @ d
        for s in range(SYMBOLS):
            part = y[:, s * n : (s + 1) * n]
            hi, lo = part.argmax(1), part.argmin(1)
            rows = np.arange(len(part))
            up = part[rows, hi] >= -part[rows, lo]
            out[a : a + len(t), s] = np.where(up, hi * 2, lo * 2 + 1)
    return out


def prefixes(strings: np.ndarray) -> np.ndarray:
    """(n, SYMBOLS) keys: the prefix of the suffix from each position, as one number without the position."""
    key = np.zeros_like(strings)
    for step in STEPS:
        key = key * (2 * SIDE * SIDE) + np.roll(strings, -step, axis=1)
    return key


def pieces(hashes: np.ndarray) -> np.ndarray:
    """(n, PIECES) pieces of the 256 bits of (n, 4) unsigned words."""
    bits = np.unpackbits(np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8), axis=1)
    cuts = np.linspace(0, 256, PIECES + 1).astype(int)
    out = np.zeros((len(hashes), PIECES), np.int64)
    for i in range(PIECES):
        part = bits[:, cuts[i] : cuts[i + 1]].astype(np.int64)
        out[:, i] = part @ (1 << np.arange(part.shape[1]))
    return out


def usable(thumbs: pd.Series) -> np.ndarray:
    """Whether a thumbnail has SIDE x SIDE finite values that are not all equal (else no correlation is defined)."""
    n = SIDE * SIDE
    ok = np.array([t is not None and len(t) == n for t in thumbs], bool)
    if ok.any():
        held = np.stack(thumbs[ok].to_list()).astype(np.float64)
        with np.errstate(invalid="ignore"):
            ok[ok] = np.isfinite(held).all(1) & (np.ptp(held, axis=1) > 0)
    return ok


def code(h0: Column, h1: Column, h2: Column, h3: Column, thumb: Column) -> Column:
    """A class as bytes: hash, symbol string, and thumbnail (one byte a value where that is exact); no string without one."""

    @F.pandas_udf("binary")
    def pack(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, t: pd.Series) -> pd.Series:
        h = np.stack([x.to_numpy(np.int64) for x in (a, b, c, d)], axis=1)
        ok = usable(t)
        out = [row.tobytes() for row in h]
        if ok.any():
            at = np.flatnonzero(ok)
            thumbs = np.stack(t[ok].to_list()).astype(np.float64)
            strings = symbols(thumbs).astype(np.uint8)
            tiny = ((thumbs >= 0) & (thumbs <= 255) & (thumbs == np.floor(thumbs))).all(1)
            rows = np.concatenate([h[at].view(np.uint8), strings, np.where(tiny[:, None], thumbs, 0).astype(np.uint8)], axis=1)
            for k, i in enumerate(at.tolist()):
                out[i] = rows[k].tobytes() if tiny[k] else rows[k, : 32 + SYMBOLS].tobytes() + thumbs[k].tobytes()
        return pd.Series(out)

    return pack(h0, h1, h2, h3, thumb)


class Coded:
    """Arrays of many packed classes; made from their codes, or from the joined codes and their lengths."""

    def __init__(self, codes: list[bytes] | bytes, lengths: np.ndarray | None = None) -> None:
        if lengths is None:
            lengths = np.fromiter(map(len, codes), np.int64, len(codes))
            codes = b"".join(codes)
        n, side = len(lengths), SIDE * SIDE
        self.joined, self.lengths = codes, lengths
        self.hash, self.strings = np.zeros((n, 4), np.uint64), np.zeros((n, SYMBOLS), np.uint8)
        self.has = lengths > 32
        self.tiny, self.wide = np.zeros((n, side), np.uint8), {}
        flat = np.frombuffer(codes, np.uint8)
        starts = np.cumsum(lengths) - lengths
        for size in np.unique(lengths):  # with no thumbnail, one of bytes, or one of doubles
            at = np.flatnonzero(lengths == size)
            for a in range(0, len(at), 65_536):
                i = at[a : a + 65_536]
                if len(at) == n:
                    part = flat.reshape(n, size)[a : a + len(i)]
                else:
                    part = flat[starts[i][:, None] + np.arange(size)]
                self.hash[i] = np.ascontiguousarray(part[:, :32]).view(np.uint64)
                if size > 32:
                    self.strings[i] = part[:, 32 : 32 + SYMBOLS]
                    rest = part[:, 32 + SYMBOLS :]
                    if rest.shape[1] == side:
                        self.tiny[i] = rest
                    else:
                        self.wide.update(zip(i.tolist(), np.ascontiguousarray(rest).view(np.float64), strict=True))

    def _units(self, rows: np.ndarray) -> np.ndarray:
        """Thumbnails with mean 0 and length 1."""
        thumbs = self.tiny[rows].astype(np.float64)
        if self.wide:
            for k, r in enumerate(rows.tolist()):
                if r in self.wide:
                    thumbs[k] = self.wide[r]
        thumbs -= thumbs.mean(1, keepdims=True)
        return thumbs / np.maximum(np.linalg.norm(thumbs, axis=1, keepdims=True), 1e-300)

    def alike(self, mine: np.ndarray, other: "Coded", theirs: np.ndarray) -> np.ndarray:
        """Whether thumbnails correlate by at least ALIKE."""
        out = np.zeros(len(mine), bool)
        for a in range(0, len(mine), 16_384):
            i, j = mine[a : a + 16_384], theirs[a : a + 16_384]
            c = np.einsum("ij,ij->i", self._units(i), other._units(j))
            out[a : a + len(i)] = self.has[i] & other.has[j] & (c >= ALIKE)
        return out

    def rings(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """(PIECES + SYMBOLS, n) keys of a slice; classes without a string keep to a place of their own on the string rings."""
        out = np.empty((PIECES + SYMBOLS, len(self.hash[start:stop])), np.int32)
        for a in range(0, out.shape[1], 16_384):
            i = slice(start + a, start + min(a + 16_384, out.shape[1]))
            p = prefixes(self.strings[i].astype(np.int64))
            p[~self.has[i]] = -1
            out[:PIECES, a : a + 16_384] = pieces(self.hash[i]).T
            out[PIECES:, a : a + 16_384] = p.T
        return out


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH of the 256 bits of (n, 4) words, with two free bits below."""
    chosen = np.sort(np.random.default_rng(20260102).choice(256, SKETCH, replace=False))
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), axis=1)[:, chosen].astype(np.int64)
    return (bits << np.arange(2, SKETCH + 2)).sum(1)


def suffix_keys(code: Column) -> Column:
    """All suffixes of a class as numbers, position (6 bits) and prefix (24 bits), after the sketch of its hash."""

    @F.pandas_udf("array<long>")
    def keys(codes: pd.Series) -> pd.Series:
        c = Coded(codes.tolist())
        sketch = _sketch(c.hash)[:, None]
        bits = (np.arange(PIECES, dtype=np.int64) << 24) | pieces(c.hash)
        text = ((np.arange(SYMBOLS, dtype=np.int64) + PIECES) << 24) | prefixes(c.strings.astype(np.int64))
        return pd.Series([np.concatenate([s, x, y]) if has else np.concatenate([s, x]) for s, x, y, has in zip(sketch, bits, text, c.has, strict=True)])

    return keys(code)


def _span(k: np.ndarray, symbols_met: int) -> np.ndarray:
    """The symbols of the text (pieces, then the string's) that a common prefix covers, as bits."""
    at = k >> 24
    out = np.int64(1) << np.minimum(at, PIECES - 1)
    for step in STEPS[:symbols_met]:
        out = np.where(at >= PIECES, np.where(step, out, 0) | np.int64(1) << (PIECES + (at - PIECES + step) % SYMBOLS), out)
    return out


def _meeting(k: np.ndarray, x: np.ndarray, first: np.ndarray, crossing: bool, salt: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows i, j of the same block (``first``: number of the block's first row) whose sketches allow for a pair.

    With ``crossing`` the lowest bits of x say on which sides a row stands (1 and 2), and i must stand on side 2, j on side 1.
    With ``salt`` only rows of different salts meet, unless all of the block have the same.
    """
    n = len(k)
    size = np.bincount(first, minlength=n)[first] if n else first
    place = np.arange(n) - first
    out = []
    live, d = np.arange(n), 1
    while True:
        live = live[place[live] + d < size[live]]
        if not len(live):
            return out
        other = live + d
        ok = np.bitwise_count((x[live] ^ x[other]) >> 2) <= SKETCH_MOST
        i, j = live[ok], other[ok]
        if salt is not None:
            apart = (salt[i] != salt[j]) | (salt[first[i]] == salt[np.minimum(first[i] + size[i] - 1, n - 1)])
            i, j = i[apart], j[apart]
        out += _oriented(i, j, x, crossing)
        d += 1


def _oriented(i: np.ndarray, j: np.ndarray, x: np.ndarray, crossing: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    if not crossing:
        return [(i, j)]
    there, back = (x[i] & 2 > 0) & (x[j] & 1 > 0), (x[j] & 2 > 0) & (x[i] & 1 > 0)
    return [(i[there], j[there]), (j[back], i[back])]


_MET = "a long, b long, spans long, hot boolean"


def _neighbours(crossing: bool, block: int):
    """The pass over one sorted partition: pairs of suffixes with a common prefix, and the rows of blocks above that size."""
    import pyarrow as pa

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("spans", pa.int64()), ("hot", pa.bool_())])

    def table(a: np.ndarray, b: np.ndarray, spans: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(spans), pa.array(np.full(len(a), hot))], schema=schema)

    def work(k: np.ndarray, c: np.ndarray, x: np.ndarray, upto: int):
        """Blocks that end before ``upto``, and the next rows of each row before it."""
        cut = np.concatenate([[True], k[1:upto] != k[: upto - 1]])
        first = np.maximum.accumulate(np.where(cut, np.arange(upto), 0))
        big = np.bincount(first, minlength=upto)[first] > block
        if big.any():
            yield table(c[:upto][big], x[:upto][big], k[:upto][big].astype(np.int64), True)
        rows = np.flatnonzero(~big)
        start = np.searchsorted(rows, first[rows])
        met = [(rows[i], rows[j], 3) for i, j in _meeting(k[rows], x[rows], start, crossing)]
        for d in range(1, NEXT + 1):
            i = np.arange(min(upto, len(k) - d))
            i = i[(k[i] >> 7 == k[i + d] >> 7) & (k[i] != k[i + d]) & (k[i] >> 24 >= PIECES)]
            i = i[np.bitwise_count((x[i] ^ x[i + d]) >> 2) <= NEXT_MOST]
            met += [(i, j, 2) for i, j in _oriented(i, i + d, x, crossing)]
        for i, j, n in met:
            if len(i):
                a, b = (c[i], c[j]) if crossing else (np.minimum(c[i], c[j]), np.maximum(c[i], c[j]))
                other = a != b
                yield table(a[other], b[other], _span(k[i].astype(np.int64), n)[other], False)

    def run(parts):
        held: list[tuple[np.ndarray, ...]] = []
        rows, hot = 0, -1
        for part in parts:
            k, c, x = (part.column(n).to_numpy() for n in ("k", "class_k", "x"))
            if hot >= 0:
                same = int(np.searchsorted(k, hot, "right"))
                if same:
                    yield table(c[:same], x[:same], k[:same].astype(np.int64), True)
                    k, c, x = k[same:], c[same:], x[same:]
                if not len(k):
                    continue
                hot = -1
            held.append((k, c, x))
            rows += len(k)
            if rows < 16 * block:
                continue
            k, c, x = (np.concatenate(p) for p in zip(*held, strict=True))
            last = int(np.searchsorted(k, k[-1], "left"))
            if last:
                yield from work(k, c, x, last)
            k, c, x = k[last:], c[last:], x[last:]
            if len(k) > block:
                hot = int(k[0])
                yield table(c, x, k.astype(np.int64), True)
                k, c, x = k[:0], c[:0], x[:0]
            held, rows = [(k, c, x)], len(k)
        if rows:
            k, c, x = (np.concatenate(p) for p in zip(*held, strict=True))
            yield from work(k, c, x, len(k))

    return run


def _cells(crossing: bool):
    """The cells of the grids of large blocks: rows of two salts of one block each."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        k, c, x, salt = (part[n].to_numpy() for n in ("k", "class_k", "x", "salt"))
        by = np.argsort(salt, kind="stable")
        k, c, x, salt = k[by], c[by], x[by], salt[by]
        out = []
        for i, j in _meeting(k, x, np.zeros(len(k), np.int64), crossing, salt):
            a, b = (c[i], c[j]) if crossing else (np.minimum(c[i], c[j]), np.maximum(c[i], c[j]))
            out.append(pd.DataFrame({"a": a, "b": b, "spans": _span(k[i], 3)})[a != b])
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "spans": []}).astype("int64")

    return run


def meeting(classes: DataFrame, sides: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``(a, b, spans)``: pairs of classes whose strings share a prefix somewhere, with the symbols that the shared spans cover.

    A suffix array in partitions: the suffixes of all texts, hashed by position and the start of their prefix, and sorted within
    the partition. One pass over each finds the runs of suffixes with a common prefix, and those within ``NEXT`` places of each
    other that share one symbol less. Runs longer than ``block`` are set aside and compared in a grid: each of its g salts meets each, so that
    no pair is lost and no task gets more than two salts. With ``sides`` (bits 1 and 2) only pairs of a on 2 and b on 1.
    """
    crossing = sides is not None
    keyed = classes.select("class_k", (sides if crossing else F.lit(0)).cast("long").alias("s"), suffix_keys(F.col("code")).alias("v"))
    rows = keyed.select("class_k", F.get("v", F.lit(0)).bitwiseOR(F.col("s")).alias("x"), F.explode(F.slice("v", 2, PIECES + SYMBOLS)).alias("k"))
    rows = rows.select(F.col("k").cast("int").alias("k"), "class_k", "x").repartition(F.shiftright("k", 7))
    # one number that decides alone is sorted by its digits
    rows = rows.sortWithinPartitions(F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("class_k").bitwiseAND(F.lit(0xFFFFFFFF))))
    met = stage(rows.mapInArrow(_neighbours(crossing, block), _MET), "suffix-spans")
    pairs = met.where("not hot").select("a", "b", "spans")
    hot = met.where("hot").select(F.col("a").alias("class_k"), F.col("b").alias("x"), F.col("spans").alias("k"))
    if not hot.isEmpty():
        grid = hot.groupBy("k").agg(F.ceil(F.count("*") / block).cast("int").alias("g"))  # at most one row for ``block`` rows
        salted = hot.join(grid, "k").withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "class_k"), F.col("g")).cast("int"))
        cells = salted.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("_o"))
        cells = cells.select("k", "class_k", "x", "salt", F.least("salt", "_o").alias("i"), F.greatest("salt", "_o").alias("j"))
        pairs = pairs.unionByName(cells.groupBy("k", "i", "j").applyInPandas(_cells(crossing), "a long, b long, spans long"))
    return pairs.groupBy("a", "b").agg(F.bit_or("spans").alias("spans"))


def same_picture(a: Column, b: Column) -> Column:
    """The exact test on two packed classes: the differing bits where they show the same picture, else null."""

    @F.pandas_udf("int")
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = Coded(x.tolist()), Coded(y.tolist())
        d = np.bitwise_count(p.hash ^ q.hash).sum(1).astype(int)
        near = np.flatnonzero((d > NEAR) & (d <= FAR))
        same = d <= NEAR
        same[near] = p.alike(near, q, near)
        return pd.Series(np.where(same, d, -1)).replace(-1, None).astype("Int32")

    return test(a, b)


def rows_and_classes(split: DataFrame, prints: DataFrame, *keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows ``(row_id, keep..., file_k, stem_k, md5_k, class_k)`` and classes ``(class_k, code)``.

    A file may have several different fingerprints: then its rows come once for each. Keys are 64-bit hashes (two different
    ones among a billion agree with a probability of a few per cent); null names, hashes and md5 have none.
    """
    blank = F.greatest(*[F.col(h).isNull() for h in HASH])
    prints = prints.where("file is not null").select(
        F.xxhash64(F.lit("f"), file_key(F.col("file"))).alias("file_k"),
        F.when(F.col("md5").isNotNull(), F.xxhash64(F.lit("m"), F.col("md5"))).alias("md5_k"),
        F.when(~blank, F.xxhash64(F.lit("c"), *HASH, "thumb")).alias("class_k"),
        *HASH,
        "thumb",
    )
    packed = prints.where("class_k is not null").select("class_k", code(*[F.col(h) for h in HASH], F.col("thumb")).alias("code"))
    classes = packed.groupBy("class_k").agg(F.min("code").alias("code"))
    rows = split.where("row_id is not null").select(
        "row_id",
        *keep,
        F.when(F.col("file").isNotNull(), F.xxhash64(F.lit("f"), file_key(F.col("file")))).alias("file_k"),
        F.when(stem_key(F.col("file")).isNotNull(), F.xxhash64(F.lit("s"), stem_key(F.col("file")))).alias("stem_k"),
    )
    of_file = prints.select("file_k", "md5_k", "class_k").distinct()
    return rows.join(of_file, "file_k", "left"), classes


def equality_keys(rows: DataFrame, *keep: str) -> DataFrame:
    """``(k, row_id, keep...)``, one row for each thing by which a row may equal another."""
    keys = F.array_distinct(F.array_compact(F.array("file_k", "stem_k", "md5_k", "class_k")))
    return rows.select(F.explode(keys).alias("k"), "row_id", *keep).distinct()


def verified(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs of classes ``(a, b)`` that show the same picture, with ``bits`` that differ."""
    one = classes.select("class_k", "code").repartition("class_k")  # the same exchange for both sides
    a = one.select(F.col("class_k").alias("a"), F.col("code").alias("_ca"))
    b = one.select(F.col("class_k").alias("b"), F.col("code").alias("_cb"))
    more = [c for c in candidates.columns if c not in ("a", "b")]
    tested = candidates.join(a, "a").join(b, "b").select("a", "b", *more, same_picture(F.col("_ca"), F.col("_cb")).alias("bits"))
    return tested.where("bits is not null")


def files_and_classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(f, class_k)`` of all files with a hash, and classes ``(class_k, code)``, both staged."""
    whole = prints.where("file is not null").dropna("any", subset=list(HASH))
    held = whole.select(file_key(F.col("file")).alias("f"), F.xxhash64(F.lit("c"), *HASH, "thumb").alias("class_k"), *HASH, "thumb")
    packed = held.select("class_k", code(*[F.col(h) for h in HASH], F.col("thumb")).alias("code"))
    classes = packed.groupBy("class_k").agg(F.min("code").alias("code"))
    return stage(held.select("f", "class_k").distinct(), "picture-files"), stage(classes, "picture-classes")


def near_classes(classes: DataFrame) -> DataFrame:
    """``(a, b, bits)``, a < b: all pairs of different classes that show the same picture.

    Candidates share a piece of the hash or a part of the string (``meeting``). Pairs within NEAR bits always do; others that do not are
    met through a picture near to both: two neighbours of one class are tested until nothing new is found.
    """
    found = stage(verified(stage(meeting(classes).select("a", "b"), "near-candidates"), classes), "near-pairs")
    linked = found.select(F.col("a").alias("class_k")).union(found.select("b")).distinct()
    linked = stage(classes.join(linked, "class_k", "left_semi"), "near-linked")
    while True:
        both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        x, y = both.select(F.col("a").alias("via"), F.col("b").alias("a")), both.select(F.col("a").alias("via"), "b")
        hops = x.join(y, "via").where("a < b").select("a", "b").distinct().join(found.select("a", "b"), ["a", "b"], "left_anti")
        more = stage(verified(hops, linked), "near-more")
        if more.isEmpty():
            return found
        found = stage(found.unionByName(more), "near-pairs")


def near_files(prints: DataFrame) -> DataFrame:
    """``(a, b, bits, rule)``, a < b: all pairs of files that look the same, by ``dhash`` within NEAR bits, else by ``thumb_corr``."""
    files, classes = files_and_classes(prints)
    x, y = files.select(F.col("class_k").alias("a"), F.col("f").alias("fa")), files.select(F.col("class_k").alias("b"), F.col("f").alias("fb"))
    copies = x.join(y, F.expr("a = b and fa < fb")).select("fa", "fb", F.lit(0).alias("bits"))
    near = near_classes(classes).join(x, "a").join(y, "b").where("fa <> fb").select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb"), "bits")
    pairs = copies.unionByName(near).groupBy(F.col("fa").alias("a"), F.col("fb").alias("b")).agg(F.min("bits").alias("bits"))
    return pairs.select("a", "b", "bits", F.when(F.col("bits") <= NEAR, "dhash").otherwise("thumb_corr").alias("rule"))


def near_groups(prints: DataFrame) -> DataFrame:
    """``(f, near_dup)`` of all files with a hash: the smallest file of its component of near pairs, its own name if it has none."""
    files, classes = files_and_classes(prints)
    first = files.groupBy("f").agg(F.min("class_k").alias("a"))  # classes of one file belong together
    own = files.join(first, "f").select("a", F.col("class_k").alias("b")).where("a <> b")
    labels = connected_components(near_classes(classes).select("a", "b").unionByName(own))
    member = files.join(labels, files["class_k"] == labels["node"], "left").select("f", F.coalesce("label", "class_k").alias("g"))
    return member.join(member.groupBy("g").agg(F.min("f").alias("near_dup")), "g").select("f", "near_dup").distinct()
