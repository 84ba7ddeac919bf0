"""New batches against all history (problem 6).

Method: graph index shards. History is kept in a folder as segments, whose shards are navigable small worlds: every picture is
linked with its nearest neighbours and stands on rings (the pieces of its hash and the parts of its thumbnail's string, sorted),
which are the long-range contacts. A search enters every ring at its own place, walks the run of equal keys and the neighbours on
both sides, and follows the links of all pictures within ``BEAM`` bits and of the ``BEST`` closest ones until nothing new is met.
Hits are reranked exactly (bits, correlation).

Every batch becomes a new segment once it has been searched (``Shards.append``). Compaction is scheduled like a binary counter:
a new segment is made together with those of its own size before it, so that a batch meets about log2(n) segments and a picture
is indexed about log2(n) times in all. Segments above ``SHARD_ROWS`` have several shards. A manifest names the live segments; it is
written after the segment, so that a run that breaks off leaves the last whole state. ``Shards.compact`` makes one segment of all.

``History.add`` takes one new batch: it reads the kept shards and rows, and writes the batch's own; ``BatchDedup`` replays all
batches of one table, one after another, through the same calls. A shard is read in place, never shuffled; the queries of a batch
are read by every shard's task from the shared folder (a batch of n pictures is read once for each shard).

The beam was tuned against exhaustive search (README); pairs within NEAR bits share a piece of the hash and cannot be missed.

Defined results: rows with a null batch or row_id take no part; null fingerprints match nothing, while files without a
fingerprint still match by name. Rows of one batch are not compared. Repeated rows are separate rows. Empty tables give an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.pictures import FAR, NEAR, PIECES, Coded, equality_keys, rows_and_classes
from gleanery.session import new_folder, remove, stage

SHARD_ROWS = 100_000
QUERY_ROWS = 100_000
BEAM = 56
BEST = 2
LINKS = 8
_PART = 8_000
#: Pictures that one step of a search meets; queries whose rings have long runs of equal keys are taken in smaller parts.
_MET = 8_000_000


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted without repetitions (by sorting, which is faster here than the library's hashing)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Graph:
    """The shard: rings and links over its classes."""

    def __init__(self, data: Coded, links: np.ndarray | None = None) -> None:
        """With ``links`` as a kept shard has them, else they are made."""
        self.data, n = data, len(data.hash)
        keys = data.rings()
        self.order = [np.argsort(k, kind="stable").astype(np.int32) for k in keys]
        self.keys = [k[o] for k, o in zip(keys, self.order, strict=True)]
        self.links = np.zeros((n, min(LINKS, max(n - 1, 0))), np.int32) if links is None else links
        if links is not None:
            return
        places = np.empty((len(keys), n), np.int32)
        for r, o in enumerate(self.order):
            places[r, o] = np.arange(n, dtype=np.int32)
        for a in range(0, n, _PART):
            ids = np.arange(a, min(n, a + _PART))
            near = np.concatenate([self.order[r][np.clip(places[r, ids] + s, 0, n - 1)][:, None] for r in range(len(keys)) for s in (-1, 1)], axis=1)
            d = self._bits(data.hash[ids][:, None], near)
            d[near == ids[:, None]] = 999
            # a neighbour met on several rings counts once
            by = np.argsort(near, axis=1, kind="stable")
            s = np.take_along_axis(near, by, 1)
            again = np.zeros_like(s, bool)
            again[:, 1:] = s[:, 1:] == s[:, :-1]
            np.put_along_axis(d, by, np.where(again, 999, np.take_along_axis(d, by, 1)), 1)
            if self.links.shape[1]:
                best = np.argpartition(d, self.links.shape[1] - 1, axis=1)[:, : self.links.shape[1]]
                self.links[ids] = np.take_along_axis(near, best, 1)

    def _bits(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        h = self.data.hash
        d = np.bitwise_count(q[..., 0] ^ h[nodes, 0]).astype(np.int16)
        for w in range(1, 4):
            d += np.bitwise_count(q[..., w] ^ h[nodes, w])
        return d

    def search(self, query: Coded, beam: int = BEAM, best: int = BEST) -> tuple[np.ndarray, np.ndarray]:
        """(query number, node) of all pairs found that show the same picture."""
        n, out = len(self.data.hash), []
        if n and len(query.hash):
            for a in range(0, len(query.hash), _PART):
                out.append(self._part(query, query.rings(a, a + _PART), a, beam, best))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in out]), np.concatenate([v for _, v in out])

    def _part(self, query: Coded, keys: np.ndarray, base: int, beam: int, best: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(self.data.hash), keys.shape[1]
        runs, total = [], 0
        for r in range(len(self.keys)):
            by = np.argsort(keys[r], kind="stable")  # sorted queries are looked up several times as fast
            left = np.empty(m, np.int64)
            left[by] = np.searchsorted(self.keys[r], keys[r][by], "left")
            right = left.copy()
            equal = by[self.keys[r][np.minimum(left[by], n - 1)] == keys[r][by]]
            right[equal] = np.searchsorted(self.keys[r], keys[r][equal], "right")
            blank = ~query.has[base : base + m] if r >= PIECES else np.zeros(m, bool)
            lo, hi = np.maximum(left - 1, 0), np.minimum(right + 1, n)
            hi = np.where(blank, lo + 1, hi)
            runs.append((lo, hi - lo))
            total += int((hi - lo).sum())
        if total > _MET and m > 1:
            half = m // 2
            one, two = self._part(query, keys[:, :half], base, beam, best), self._part(query, keys[:, half:], base + half, beam, best)
            return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
        met = []
        for r, (lo, size) in enumerate(runs):
            q = np.repeat(np.arange(m), size)
            at = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            met.append(q * n + self.order[r][at])
        seen = _distinct(np.concatenate(met))
        fresh, hits_q, hits_v = seen, [], []
        while len(fresh):
            q, v = np.divmod(fresh, n)
            d = self._bits(query.hash[base + q], v)
            near = d <= FAR
            hits_q.append(q[near])
            hits_v.append(v[near])
            go = d <= beam
            if best and len(seen) == len(fresh):  # the closest ones of the entry, however far
                by = np.lexsort((d, q))
                rank = np.arange(len(by)) - np.searchsorted(q[by], q[by], "left")
                go[by[rank < best]] = True
            step = _distinct((q[go][:, None] * n + self.links[v[go]]).ravel())
            place = np.minimum(np.searchsorted(seen, step), len(seen) - 1)
            fresh = step[seen[place] != step]
            seen = np.sort(np.concatenate([seen, fresh]), kind="stable")
        q, v = np.concatenate(hits_q) + base, np.concatenate(hits_v)
        d = self._bits(query.hash[q], v)
        same = d <= NEAR
        rest = np.flatnonzero(~same)
        same[rest] = query.alike(q[rest], self.data, v[rest])
        return q[same], v[same]


SHARD = "shard int, class_k binary, codes binary, lengths binary, links binary"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: its graph, with everything a search needs, in one row."""
    keys, first = np.unique(rows["class_k"].to_numpy(np.int64), return_index=True)
    codes = rows["code"].to_numpy()[first].tolist()
    data = Coded(codes)
    links = Graph(data).links
    return pd.DataFrame([(int(rows["shard"].iloc[0]), keys.tobytes(), data.joined, data.lengths.astype(np.int16).tobytes(), links.tobytes())], columns=[c.split()[0] for c in SHARD.split(", ")])


def _loaded(row: pd.Series) -> tuple[np.ndarray, Coded, np.ndarray]:
    keys = np.frombuffer(row["class_k"], np.int64)
    data = Coded(bytes(row["codes"]), np.frombuffer(row["lengths"], np.int16).astype(np.int64))
    return keys, data, np.frombuffer(row["links"], np.int32).reshape(len(keys), -1) if len(keys) else np.zeros((0, 0), np.int32)


def _unpacked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The classes of shards, as rows."""
    for part in parts:
        for _, row in part.iterrows():
            keys = np.frombuffer(row["class_k"], np.int64)
            ends = np.cumsum(np.frombuffer(row["lengths"], np.int16).astype(np.int64))
            codes = bytes(row["codes"])
            starts = np.concatenate([[0], ends[:-1]]).tolist()
            for a in range(0, len(keys), 20_000):
                cuts = zip(starts[a : a + 20_000], ends[a : a + 20_000].tolist(), strict=True)
                yield pd.DataFrame({"class_k": keys[a : a + 20_000], "code": [codes[i:j] for i, j in cuts]})


def _asked(files: list[str]) -> Iterator[tuple[np.ndarray, Coded]]:
    """The queries of a batch, from the shared folder, part by part."""
    import pyarrow.fs
    import pyarrow.parquet

    for uri in files:
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as held:
            for part in pyarrow.parquet.ParquetFile(held).iter_batches(_PART, columns=["class_k", "code"]):
                yield part.column("class_k").to_numpy(), Coded(part.column("code").to_pylist())


def _searcher(files: list[str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                keys, data, links = _loaded(row)
                graph = Graph(data, links)
                for asked, codes in _asked(files):
                    q, v = graph.search(codes)
                    other = keys[v] != asked[q]
                    yield pd.DataFrame({"a": keys[v[other]], "b": asked[q[other]]})

    return run


class Shards:
    """The index of picture classes in one folder: live segments, search, append, compaction."""

    def __init__(self, spark: SparkSession, path: str, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> None:
        self.spark, self.path, self.shard_rows, self.query_rows = spark, path, shard_rows, query_rows

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def segments(self) -> list[dict]:
        """Live segments, oldest first: ``name``, ``batches``, ``rows``."""
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        last = max(f.getPath().getName() for f in fs.listStatus(at))
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{last}", wholetext=True).first()[0])

    def _state(self, segments: list[dict]) -> None:
        fs, at = self._fs()
        n = len(fs.listStatus(at)) if fs.exists(at) else 0
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, f"{n:08d}.json")
        part = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/writing-{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        fs.mkdirs(at)
        if not fs.rename(part, target):  # another writer took this number
            raise RuntimeError(f"{self.path} was changed by another writer")

    def _read(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(SHARD).parquet(f"{self.path}/{segment['name']}")

    def search(self, batch: DataFrame, rows: int) -> DataFrame | None:
        """``(a, b)``: a kept class and one of the ``rows`` classes of a staged batch that show the same picture; None without history."""
        files, out = sorted(batch.inputFiles()), None
        if not files or not rows:
            return None
        chunks = min(len(files), -(-rows // self.query_rows))
        for segment in self.segments():
            for c in range(chunks):  # each its own scan, so that chunks of one shard run side by side
                hits = self._read(segment).mapInPandas(_searcher(files[c::chunks]), "a long, b long")
                out = hits if out is None else out.unionByName(hits)
        return out

    def _write(self, classes: DataFrame, batches: int, rows: int) -> dict:
        shards = max(1, -(-rows // self.shard_rows))
        segment = {"name": f"segment-{uuid.uuid4().hex}", "batches": batches, "rows": rows}
        placed = classes.select(F.pmod(F.xxhash64(F.lit("shard"), "class_k"), F.lit(shards)).cast("int").alias("shard"), "class_k", "code")
        placed.groupBy("shard").applyInPandas(_build, SHARD).write.parquet(f"{self.path}/{segment['name']}")
        return segment

    def append(self, classes: DataFrame, rows: int) -> None:
        """A segment for a new batch of ``rows`` classes, made together with the kept segments that it is due to be compacted with."""
        live, batches = self.segments(), 1
        gone = []
        while live and live[-1]["batches"] == batches:
            old = live.pop()
            gone.append(old)
            batches, rows = batches * 2, rows + old["rows"]
        self._state([*live, self._write(self._with(classes, gone), batches, rows)])
        self._drop(gone)

    def compact(self) -> None:
        """One segment of all."""
        live = self.segments()
        if len(live) > 1:
            whole = self._with(None, live)
            self._state([self._write(whole, sum(s["batches"] for s in live), sum(s["rows"] for s in live))])
            self._drop(live)

    def _with(self, classes: DataFrame | None, segments: list[dict]) -> DataFrame:
        for s in segments:
            kept = self._read(s).mapInPandas(_unpacked, "class_k long, code binary")
            classes = kept if classes is None else classes.select("class_k", "code").unionByName(kept)
        return classes

    def _drop(self, segments: list[dict]) -> None:
        for s in segments:
            remove(self.spark, f"{self.path}/{s['name']}")


def _pairs_of_rows(near: DataFrame | None, keys: tuple[DataFrame, DataFrame], held: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Pairs of rows in different batches: equal by a key, or of classes that are near; ``keys`` and ``held`` for both sides."""
    a, b = keys[0].alias("a"), keys[1].alias("b")
    pairs = a.join(b, F.expr("a.k = b.k and a.batch < b.batch")).select(F.col("a.row_id").alias("x"), F.col("b.row_id").alias("y"))
    if near is not None:
        x = held[0].select(F.col("class_k").alias("a"), F.col("row_id").alias("x"), F.col("batch").alias("bx"))
        y = held[1].select(F.col("class_k").alias("b"), F.col("row_id").alias("y"), F.col("batch").alias("by"))
        pairs = pairs.unionByName(near.join(x, "a").join(y, "b").where("bx <> by").select("x", "y"))
    return pairs.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()


class History:
    """All accepted batches in one folder of the shared store; ``add`` checks and keeps a new one."""

    def __init__(self, spark: SparkSession, path: str, **sizes: int) -> None:
        self.spark, self.path = spark, path
        self.shards = Shards(spark, f"{path}/index", **sizes)
        self.numbers = sorted(json.loads(r["value"]) for r in self._log().collect()) if self._exists("log") else []

    def _log(self) -> DataFrame:
        return self.spark.read.text(f"{self.path}/log")  # one line a batch

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def add(self, split: DataFrame, prints: DataFrame, batch: int) -> DataFrame:
        """``(row_id_a, row_id_b)`` of the pairs of a row of this batch and one of an earlier batch; the batch is then kept.

        ``split`` holds the batch's rows, ``prints`` at least the fingerprints of their files. Batches come in rising order.
        """
        if self.numbers and batch <= self.numbers[-1]:
            raise ValueError(f"batch {batch} comes after batch {self.numbers[-1]}")
        rows, classes = rows_and_classes(split, prints, F.lit(batch).cast("long").alias("batch"))
        new = stage(rows, "batch-rows")
        asked = stage(classes.join(new.select("class_k").distinct(), "class_k", "left_semi"), "batch-classes")
        n = asked.count()
        old = self.spark.read.schema(new.schema).parquet(*[f"{self.path}/rows/{b}" for b in self.numbers]) if self.numbers else new.limit(0)
        keys = equality_keys(old, "batch"), equality_keys(new, "batch")
        held = tuple(r.where("class_k is not null").select("class_k", "row_id", "batch").distinct() for r in (old, new))
        found = stage(_pairs_of_rows(self.shards.search(asked, n), keys, held), "batch-pairs")
        if n:
            self.shards.append(asked, n)
        new.write.mode("overwrite").parquet(f"{self.path}/rows/{batch}")
        self.spark.createDataFrame([(json.dumps(batch),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/log")
        self.numbers.append(batch)
        return found


class BatchDedup:
    """All batches of one table, replayed as they come in."""

    def __init__(self, split: DataFrame, prints: DataFrame, batch: str = "batch_no", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> None:
        self.sizes = {"shard_rows": shard_rows, "query_rows": query_rows}
        rows, classes = rows_and_classes(split, prints, F.col(batch).alias("batch"))
        self.rows = stage(rows.where("batch is not null"), "batch-rows")
        held = self.rows.where("class_k is not null").select("class_k", "batch").distinct()
        self.classes = new_folder(split.sparkSession, "batch-classes")
        classes.join(held, "class_k").write.option("compression", "zstd").partitionBy("batch").parquet(self.classes)

    def near(self) -> DataFrame | None:
        """``(a, b)``: pairs of different classes that show the same picture, a in history when b came in."""
        spark = self.rows.sparkSession
        counted = self.rows.where("class_k is not null").groupBy("batch").agg(F.countDistinct("class_k").alias("n"))
        order = sorted((r["batch"], r["n"]) for r in counted.collect())  # one row a batch
        folder = new_folder(spark, "batch-index")
        shards, found = Shards(spark, f"{folder}/index", **self.sizes), f"{folder}/pairs"
        met = False
        for i, (batch, n) in enumerate(order):
            part = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(batch))
            mine = spark.read.schema("class_k long, code binary").parquet(f"{self.classes}/batch={part}")
            hits = shards.search(mine, n)
            if hits is not None:
                hits.write.mode("append").parquet(found)
                met = True
            if i + 1 < len(order):  # nothing is searched after the last one
                shards.append(mine, n)
        return spark.read.schema("a long, b long").parquet(found).distinct() if met else None

    def found(self) -> DataFrame:
        """``(row_id_a, row_id_b)`` of all pairs of rows in different batches, the smaller row_id first, each once."""
        keys = equality_keys(self.rows, "batch")
        held = self.rows.where("class_k is not null").select("class_k", "row_id", "batch").distinct()
        return _pairs_of_rows(self.near(), (keys, keys), (held, held))

    def report(self) -> DataFrame:
        """Per batch: rows, and rows that repeat a picture of an earlier batch."""
        found = self.found()
        of = self.rows.select("row_id", "batch").distinct()
        la, lb = of.select(F.col("row_id").alias("row_id_a"), F.col("batch").alias("ba")), of.select(F.col("row_id").alias("row_id_b"), F.col("batch").alias("bb"))
        later = found.join(la, "row_id_a").join(lb, "row_id_b").select(F.when(F.col("ba") > F.col("bb"), F.col("row_id_a")).otherwise(F.col("row_id_b")).alias("row_id")).distinct()
        marked = of.join(later.withColumn("dup", F.lit(1)), "row_id", "left")
        return marked.groupBy("batch").agg(F.count("*").alias("rows"), F.count("dup").alias("repeats"))
