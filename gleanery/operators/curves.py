"""Average precision of many weightings of the same rows, which are streamed in order and held nowhere.

With weights w, a row has t, the weight of all hits up to it, and a, that of all rows up to it. Drawing a hit again never lowers
t / a, and a miss never raises it, so the falling precision at recall x is the largest t / a of those rows whose t / n is above x.
It needs one number for each of the 101 recalls, whatever the rows' order within them: a worker keeps t, a and those numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ranged import numbered
from gleanery.session import stage
from gleanery.tables import small

EPS = 1e-16
GRID = np.arange(101) * 0.01
#: Weights (images times replicates) that a worker holds, classes and models at most, images that are numbered by a broadcast.
WEIGHTS, CURVES, BROADCAST = 1 << 24, 10_000, 500_000
#: Rows that are summed at once, which stay in a core's cache, and how many of them follow each other in a block.
ROWS, STRETCH = 2048, 16
_SHIFT = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, 0).ravel().tolist()
_SINE = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]


def md5_heads(prefix: bytes, digits: np.ndarray) -> np.ndarray:
    """The first 8 hexadecimal digits, as numbers, of md5(prefix + row) for rows of equally many characters."""
    length = len(prefix) + digits.shape[1]
    if length > 55:  # more than one block
        return np.array([int(hashlib.md5(prefix + bytes(d)).hexdigest()[:8], 16) for d in digits], np.uint32)
    text = np.zeros((len(digits), (length + 4) // 4 * 4), np.uint8)
    text[:, : len(prefix)], text[:, len(prefix) : length], text[:, length] = np.frombuffer(prefix, np.uint8), digits, 0x80
    words = [*np.ascontiguousarray(text.view("<u4").T), *[np.uint32(0)] * (16 - text.shape[1] // 4)]
    words[14] = np.uint32(8 * length)
    start = np.uint32(0x67452301)
    a, b, c, d = (np.full(len(digits), x, np.uint32) for x in (start, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(61):  # the first word of the sum is made in step 60
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += words[_WORD[i]]
        f += np.uint32(_SINE[i])
        turned = f << np.uint32(_SHIFT[i])
        f >>= np.uint32(32 - _SHIFT[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return (b + start).byteswap()


def draws(n: int, replicates: list[int], seed: int | None) -> np.ndarray:
    """(images + 1, replicates) how often each image is drawn: draw i of replicate b takes md5(seed:b:i) mod n; without a seed each
    once. The last row is 0."""
    out = np.zeros((len(replicates), n + 1), np.uint8)
    if seed is None:
        out[:, :n] = 1
        return np.ascontiguousarray(out.T)
    texts = []
    for width in range(1, len(str(n - 1)) + 1):
        i = np.arange(10 ** (width - 1) if width > 1 else 0, min(n, 10**width))
        texts.append(np.stack([i // 10 ** (width - 1 - k) % 10 + 48 for k in range(width)], 1).astype(np.uint8))
    for r, b in enumerate(replicates):
        prefix = f"{seed}:{b}:".encode()
        taken = np.concatenate([md5_heads(prefix, t[k : k + 8192]) for t in texts for k in range(0, len(t), 8192)]) % np.uint32(n)
        times = np.bincount(taken, minlength=n + 1)
        out = out.astype(np.promote_types(out.dtype, np.min_scalar_type(times.max())), copy=False)
        out[r] = times
    return np.ascontiguousarray(out.T)


def summed(weights: np.ndarray, rows: np.ndarray, kind: type) -> tuple[np.ndarray, int]:
    """Sums of the weights of the first, first two, ... of ``rows`` (numbers of rows of ``weights``, whose last row is 0), by blocks:
    that of row i is in place i % STRETCH * blocks + i // STRETCH. The other value is the number of blocks."""
    blocks = -(-len(rows) // STRETCH)
    at = np.full(blocks * STRETCH, len(weights) - 1, rows.dtype)
    at[: len(rows)] = rows
    at = np.ascontiguousarray(at.reshape(blocks, STRETCH).T)
    out = np.empty((STRETCH, blocks, weights.shape[1]), kind)
    for i in range(STRETCH):
        out[i] = weights.take(at[i], 0)
        if i:
            out[i] += out[i - 1]
    before = np.cumsum(out[-1], 0, dtype=kind)
    out[:, 1:] += before[:-1]
    return out.reshape(-1, weights.shape[1]), blocks


class Curve:
    """One curve under all weightings: what was seen, and for each threshold the hits and the best precision from each recall on."""

    def __init__(self, n: np.ndarray, steps: list[int]) -> None:
        self.n, self.steps = n, steps
        m = np.maximum(n, 1).astype(float)
        self.from_t = np.floor(GRID[:, None] * m) - 1  # the least t above each recall
        for _ in range(3):
            self.from_t += self.from_t / (m + EPS) <= GRID[:, None]
        self.seen = np.zeros(len(n))
        self.hits = np.zeros((len(steps), len(n)))
        self.best = np.zeros((len(steps), len(GRID) + 1, len(n)))

    def add(self, img: np.ndarray, bits: np.ndarray, weights: np.ndarray, most: int) -> None:
        """The next rows in order; bit j of ``bits`` is a hit at threshold j."""
        kind = np.uint16 if len(img) * most < 1 << 16 else np.uint32 if len(img) * most < 1 << 32 else np.uint64
        place = lambda rows, blocks: rows % STRETCH * blocks + rows // STRETCH
        seen, wide = summed(weights, img, kind)
        for s, j in enumerate(self.steps):
            at = np.flatnonzero(bits >> j & 1)
            if not len(at):
                continue
            top, narrow = summed(weights, img[at], kind)
            # of hits that follow each other the last is the best
            last = np.flatnonzero(np.append(np.diff(at) > 1, True))
            t = top.take(place(last, narrow), 0) + self.hits[s]
            a = seen.take(place(at[last], wide), 0) + self.seen
            p = t / np.maximum(a, 1)
            low, high = ((self.from_t <= x).sum(0) for x in (t[0], t[-1]))
            cols = np.arange(len(self.n))
            self.best[s][low, cols] = np.maximum(self.best[s][low, cols], np.where(low == high, p.max(0), 0))
            if len(cols := np.flatnonzero(low < high)):
                t, p, low, high = t[:, cols], p[:, cols], low[cols], high[cols]
                for k in range(max(1, int(low.min())), int(high.max()) + 1):
                    v = np.where((t >= self.from_t[k - 1, cols]) & (low <= k) & (k <= high), p, 0).max(0)
                    self.best[s][k, cols] = np.maximum(self.best[s][k, cols], v)
            self.hits[s] += top[-1]  # with the padding, which weighs nothing
        self.seen += seen[-1]

    def areas(self) -> np.ndarray:
        """(thresholds, weightings): trapezoids over the recalls, of which the first and the last count half."""
        y = np.maximum.accumulate(self.best[:, :0:-1], 1)[:, ::-1]
        return (y.sum(1) - (y[:, 0] + y[:, -1]) / 2) * 0.01


def _read(uris: list[str], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of the staged files, in the order of their parts."""
    import pyarrow.fs
    import pyarrow.parquet

    for uri in uris:
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as held:
            for part in pyarrow.parquet.ParquetFile(held).iter_batches(16 * ROWS, columns=columns, use_threads=False):
                yield [part.column(c).to_numpy(zero_copy_only=False) for c in columns]


def image_numbers(predictions: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """``(image, img)``: all images numbered in their order, and how many there are."""
    known = numbered(predictions.select("image").union(targets.select("image")).distinct(), [], ["image"], "img")
    return known, known.count()


def curve_areas(predictions: DataFrame, targets: DataFrame, known: DataFrame | None, n: int, replicates: int, seed: int | None, steps: list[int], at_once: int | None = None) -> DataFrame:
    """``(replicate, model, cls, areas)``: the area at each threshold of ``steps`` of every class with targets, null where a replicate
    drew none of them. Without ``known`` every image counts once (no seed, n of 1): they share one weight, and none is numbered.
    Targets without a class are a class that no prediction has; rows without an image are left out.

    Rows are staged in order, without what they were ordered by; each task makes the weights of its replicates and streams them.
    Fewer replicates than tasks share the curves. ``at_once`` rows are summed together (ROWS).
    """
    at_once = at_once or ROWS
    spark = predictions.sparkSession
    classes = [r[0] for r in small(targets.select("cls").distinct().orderBy("cls"), CURVES, "the list of classes")]
    models = [r[0] for r in small(predictions.select("model").where("model is not null").distinct().orderBy("model"), CURVES, "the list of models")]
    kinds, kind = dict(predictions.dtypes), dict(targets.dtypes)["cls"]
    schema = f"replicate long, model {kinds['model']}, cls {kind}, areas array<double>"
    if not classes or not models or not n:
        return spark.createDataFrame([], schema)
    c = F.broadcast(spark.createDataFrame(list(zip(classes, range(len(classes)))), f"cls {kind}, _c int"))
    m = F.broadcast(spark.createDataFrame(list(zip(models, range(len(models)))), f"model {kinds['model']}, _m int"))
    if known is None:
        placed = lambda df: df.where("image is not null").withColumn("img", F.lit(0))
    else:
        img = known.select("image", F.col("img").cast("int").alias("img"))
        img = F.broadcast(img) if n <= BROADCAST else img
        placed = lambda df: df.join(img, "image")

    bits = sum((F.when(F.get("tp", F.lit(j)) == 1, 1 << j).otherwise(0) for j in steps), F.lit(0))
    rows = placed(predictions.join(m, "model").join(c, "cls"))
    rows = rows.select((F.col("_m") * len(classes) + F.col("_c")).alias("curve"), "conf", "id", "img", bits.cast("int").alias("bits"))
    order = [F.asc("curve"), F.desc("conf"), F.asc("id")]
    rows = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("curve", "img", "bits"), "rows")
    per = stage(placed(targets.join(c, targets["cls"].eqNullSafe(c["cls"]))).groupBy("_c", "img").agg(F.count("*").alias("n")), "targets")
    row_files, target_files = sorted(rows.inputFiles()), sorted(per.inputFiles())

    tasks = spark.sparkContext.defaultParallelism
    block = max(1, min(-(-replicates // tasks), WEIGHTS // n))
    blocks = -(-replicates // block)
    shares = min(max(1, tasks // blocks), len(models) * len(classes))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for unit in part["id"].tolist():
                yield work(unit // shares, unit % shares)

    def work(b: int, share: int) -> pd.DataFrame:
        own = list(range(b * block, min(replicates, (b + 1) * block)))
        weights = draws(n, own, seed)
        most = int(weights.max())
        labels = np.zeros((len(classes), len(own)))
        for cls, at, times in _read(target_files, ["_c", "img", "n"]):
            for k in range(0, len(cls), ROWS):
                drawn = weights.take(at[k : k + ROWS], 0) * times[k : k + ROWS, None].astype(float)
                for x in np.unique(cls[k : k + ROWS]):
                    labels[x] += drawn[cls[k : k + ROWS] == x].sum(0)
        out, now, curve = {}, -1, None
        for which, at, flags in _read(row_files, ["curve", "img", "bits"]):
            cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y or which[x] % shares != share:
                    continue
                if which[x] != now:
                    if curve is not None:
                        out[now] = curve.areas()
                    now = int(which[x])
                    curve = Curve(labels[now % len(classes)], steps)
                for k in range(x, y, at_once):
                    curve.add(at[k : min(y, k + at_once)], flags[k : min(y, k + at_once)], weights, most)
        if curve is not None:
            out[now] = curve.areas()
        none = np.zeros((len(steps), len(own)))
        found = []
        for x in range(share, len(models) * len(classes), shares):
            areas, drawn = out.get(x, none), labels[x % len(classes)]
            found += [(r, models[x // len(classes)], classes[x % len(classes)], areas[:, i].tolist() if drawn[i] else None) for i, r in enumerate(own)]
        return pd.DataFrame(found, columns=["replicate", "model", "cls", "areas"])

    return spark.range(0, blocks * shares, 1, blocks * shares).mapInPandas(run, schema)
