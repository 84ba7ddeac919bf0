"""Samples that match target category proportions (problem 1).

Method: controlled rounding. The fractional two-way quota table (source x class, one per split) is brought within the cells'
bounds (at least the minimum, at most what there is), made whole by maximum flow so that both margins are preserved, and each
cell's quota is drawn exactly by random keys. A maximum flow through the same table, with the requirements as demand, tells which
of them can be met at all.

The sample of a split has exactly a tenth of its files (the sum of the minima, where that is more). Requirements are rounded up, so
that they may add up to more than that: then cells that could be met get less than required (``met`` is false, ``reachable`` says
that there was enough), and the report shows by how much each source and class misses its share.

Defined results: names are compared in normal form and written as in the targets. The unit is the distinct file of a cell
(file names ignoring case), represented by its smallest row_id; rows with a null in split, source, class or file do not count.
Repeated rows of a file count once. A file that stands in several cells counts in each. Empty input: every target with a
requirement is reported as unmet and the sample is empty. Ties of the random key are broken by the file name. Further columns
of the input are ignored. Targets are a small table (``MOST_CELLS`` rows), which is checked.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.names import class_key, file_key, source_key, split_key
from gleanery.session import stage
from gleanery.tables import small

MOST_CELLS = 10_000
#: Buckets of the random key; the cut is found on bucket counts, and only the bucket that holds it is ranked.
BUCKETS = 1 << 14


class TargetSample:
    """Counts, quotas and draw for one input; the counts are made once."""

    def __init__(self, df: DataFrame, targets: DataFrame, fraction_of: int = 10, salt: str = "target-sample") -> None:
        self.spark, self.salt = df.sparkSession, salt
        rows = small(targets.select("split", "source", "dominant_class", "share_bp", "min_rows"), MOST_CELLS, "targets")
        self.targets = [r.asDict() | {"cell": i} for i, r in enumerate(rows)]
        schema = "cell int, split string, source string, dominant_class string"
        cells = self.spark.createDataFrame([(t["cell"], t["split"], t["source"], t["dominant_class"]) for t in self.targets], schema)
        keyed = cells.select(
            "cell", split_key(F.col("split")).alias("_s"), source_key(F.col("source")).alias("_o"), class_key(F.col("dominant_class")).alias("_c")
        )
        rows = df.select(
            "row_id",
            file_key(F.col("file")).alias("_f"),
            split_key(F.col("split")).alias("_s"),
            source_key(F.col("source")).alias("_o"),
            class_key(F.col("dominant_class")).alias("_c"),
        ).where("_f is not null")
        # MOST_CELLS rows at most, so the broadcast is bounded
        held = rows.join(F.broadcast(keyed), ["_s", "_o", "_c"]).groupBy("cell", "_f").agg(F.min("row_id").alias("row_id"))
        self.files = stage(held, "target-sample")
        self.available = {r["cell"]: r["n"] for r in self.files.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        of_split = F.broadcast(cells.select("cell", split_key(F.col("split")).alias("_s")))
        per_split = self.files.join(of_split, "cell").select("_s", "_f").distinct().groupBy("_s").agg(F.count("*").alias("n"))
        listed = {r["_s"]: r["n"] for r in per_split.collect()}
        names = {r["cell"]: r["_s"] for r in of_split.collect()}
        for t in self.targets:
            t["n"] = listed.get(names[t["cell"]], 0) // fraction_of
            t["available"] = self.available.get(t["cell"], 0)
            share, least = t["share_bp"] or 0, t["min_rows"] or 0
            t["required"] = max(least, -(-share * t["n"] // 10_000))
        self._quotas(names)

    def _quotas(self, names: dict[int, str]) -> None:
        from gleanery.llm.rounding import bounded_shares, controlled_round, reachable

        for split in sorted({x for x in names.values() if x is not None}):
            own = {t["cell"]: t for t in self.targets if names[t["cell"]] == split}
            key = {c: (t["source"], (t["dominant_class"], c)) for c, t in own.items()}
            keys = {c: (k[0], k[1][0]) for c, k in key.items()}
            total = next(iter(own.values()))["n"]
            share = bounded_shares(
                {c: t["share_bp"] or 0 for c, t in own.items()},
                {c: t["min_rows"] or 0 for c, t in own.items()},
                {c: t["available"] for c, t in own.items()},
                total,
            )
            table: dict[tuple, Fraction] = {}
            for c, v in share.items():
                if keys[c] in table:
                    raise ValueError(f"targets list {keys[c]} of split {split} twice")
                table[keys[c]] = v
            whole = controlled_round(table)
            flow = reachable({keys[c]: t["required"] for c, t in own.items()}, {keys[c]: t["available"] for c, t in own.items()})
            for c, t in own.items():
                t["quota"], t["reachable"] = whole[keys[c]], flow[keys[c]]
        for t in self.targets:
            t.setdefault("quota", 0)
            t.setdefault("reachable", 0)

    def report(self) -> DataFrame:
        """One row per target: required, reachable, available and drawn files, whether the requirement can be and is met, and what
        is drawn more (or less, if negative) of its source and of its class in its split than their shares of the sample."""
        fields = ("cell", "split", "source", "dominant_class", "share_bp", "min_rows", "n", "required", "available", "reachable")
        base = self.spark.createDataFrame(
            [tuple(t[k] for k in fields) for t in self.targets],
            "cell int, split string, source string, dominant_class string, share_bp int, min_rows int, sample_size long, required long, "
            "available long, reachable long",
        )
        drawn = self._drawn().groupBy("cell").agg(F.count("*").alias("drawn"))
        out = base.join(drawn, "cell", "left").na.fill(0, ["drawn"])  # a row for each target, on both sides
        more = F.col("drawn") - F.col("share_bp") * F.col("sample_size") / 10_000
        gap = lambda *by: F.round(F.sum(more).over(Window.partitionBy(*by)), 4)
        return out.select(
            *[c for c in base.columns if c != "cell"], "drawn", (F.col("reachable") >= F.col("required")).alias("can_be_met"),
            (F.col("drawn") >= F.col("required")).alias("met"), gap("split", "source").alias("source_gap"), gap("split", "dominant_class").alias("class_gap"),
        )

    def unmet(self) -> DataFrame:
        return self.report().where(~F.col("can_be_met")).select("split", "source", "dominant_class")

    def sample(self) -> DataFrame:
        """``(split, source, dominant_class, row_id, file)``: exactly the quota of each cell, lowest random keys first."""
        return self._drawn().drop("cell")

    def _drawn(self) -> DataFrame:
        quotas = self.spark.createDataFrame(
            [(t["cell"], t["split"], t["source"], t["dominant_class"], t["quota"]) for t in self.targets],
            "cell int, split string, source string, dominant_class string, quota long",
        )
        keyed = self.files.withColumn("_h", F.xxhash64(F.lit(self.salt), "cell", "_f"))
        keyed = keyed.withColumn("_b", F.shiftrightunsigned("_h", 64 - (BUCKETS - 1).bit_length()).cast("int"))
        counts = keyed.groupBy("cell", "_b").agg(F.count("*").alias("_n"))
        below = F.sum("_n").over(Window.partitionBy("cell").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        cuts = (
            counts.select("cell", "_b", "_n", F.coalesce(below, F.lit(0)).alias("_below"))
            .join(F.broadcast(quotas), "cell")
            .where("_below < quota and _below + _n >= quota")
            .select("cell", F.col("_b").alias("_cut"), (F.col("quota") - F.col("_below")).alias("_rest"))
        )
        # one row per cell at most
        near = keyed.join(F.broadcast(cuts), "cell").where("_b <= _cut")
        whole = near.where("_b < _cut").select("cell", "row_id", "_f")
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("_h", "_f"))
        part = near.where("_b = _cut").withColumn("_k", rank).where("_k <= _rest").select("cell", "row_id", "_f")
        drawn = whole.unionByName(part).join(F.broadcast(quotas), "cell")
        return drawn.select("cell", "split", "source", "dominant_class", "row_id", F.col("_f").alias("file"))
