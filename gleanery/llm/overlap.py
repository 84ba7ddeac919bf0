"""Same or near-same pictures across splits (problem 4).

Method: suffix array over partitioned texts. A picture's text is its fingerprint: the bits of its hash in pieces and a string of
symbols read off its thumbnail (``pictures.symbols``). The suffixes of all texts, one from every position, are partitioned by
position and the start of their prefix and sorted within the partition (``pictures.meeting``). Neighbours from train and an
evaluation split with a long common prefix (a piece, or three symbols of the string, or two where they stand next to each other)
reveal shared spans; the spans of a pair are merged into its coverage, the share of the text's symbols that they cover. The
pair is then tested exactly: differing bits, and correlation of the thumbnails.

Rows that are equal by file, export stem, md5 or fingerprint are joined on these keys, with no candidates at all.

Completeness: every pair within NEAR bits shares a piece, so none is missed. Pairs of NEAR+1 to FAR bits are found through the
thumbnails' strings; the README has their measured recall against all pairs.

Defined results: rows with a null or other split name, row_id or file take no part (beside the keys they have). Null
fingerprints match nothing; files without a fingerprint still match by name. Repeated rows are separate rows. Empty tables give an
empty result. A long run of equal prefixes is compared in a grid of cells; a hot name or md5 is split by the adaptive skew join
(no exchange of that join is an explicit one). Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.names import source_key, split_key
from gleanery.llm.pictures import BLOCK, PIECES, SYMBOLS, equality_keys, meeting, rows_and_classes, verified
from gleanery.session import stage


class Overlap:
    """Rows, their sides and the near pairs of one table of splits."""

    def __init__(self, split: DataFrame, prints: DataFrame, block: int = BLOCK) -> None:
        self.block = block
        side = split_key(F.col("split"))
        train = F.when(side == "train", True).when(side.isin("valid", "test"), False)
        rows, classes = rows_and_classes(split, prints, train.alias("train"), side.alias("side"), source_key(F.col("source")).alias("source_k"))
        self.rows = stage(rows.where("train is not null"), "overlap-rows")
        held = self.rows.where("class_k is not null")
        sides = held.groupBy("class_k").agg(F.expr("bit_or(if(train, 1, 2))").alias("s"))
        self.classes = stage(classes.join(sides, "class_k"), "overlap-classes")

    def near(self) -> DataFrame:
        """``(a, b, spans, bits)``: pairs of different classes, a with rows in an evaluation split and b in train, that look the same."""
        met = meeting(self.classes, F.col("s"), self.block)
        return stage(verified(stage(met, "overlap-candidates"), self.classes), "overlap-near")

    def pairs(self) -> DataFrame:
        """``(train_id, eval_id, spans)`` of all pairs, each once; pairs that are equal by a key cover the whole text."""
        keys = equality_keys(self.rows, "train")
        t = keys.where("train").select("k", F.col("row_id").alias("train_id"))
        e = keys.where("not train").select("k", F.col("row_id").alias("eval_id"))
        equal = t.join(e, "k").select("train_id", "eval_id", F.lit((1 << PIECES + SYMBOLS) - 1).alias("spans"))
        held = self.rows.where("class_k is not null").select("class_k", "row_id", "train").distinct()
        te = held.where("train").select(F.col("class_k").alias("b"), F.col("row_id").alias("train_id"))
        ee = held.where("not train").select(F.col("class_k").alias("a"), F.col("row_id").alias("eval_id"))
        near = self.near().join(ee, "a").join(te, "b").select("train_id", "eval_id", "spans")
        return equal.unionByName(near).groupBy("train_id", "eval_id").agg(F.bit_or("spans").alias("spans"))

    def found(self) -> DataFrame:
        p = self.pairs()
        return p.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))

    def coverage(self) -> DataFrame:
        """Per evaluation row with a copy in train: its pairs, and the share of its text that spans of any of them cover."""
        met = self.pairs().groupBy("eval_id").agg(F.count("*").alias("pairs"), F.bit_or("spans").alias("spans"))
        return met.select(F.col("eval_id").alias("row_id"), "pairs", (F.bit_count("spans") / F.lit(PIECES + SYMBOLS)).alias("coverage"))

    def report(self) -> DataFrame:
        """Per evaluation split and source: rows, rows with a copy in train, pairs, and the mean coverage of the copied rows."""
        rows = self.rows.where("not train").select("row_id", "side", "source_k").distinct()
        joined = rows.join(self.coverage(), "row_id", "left")
        return joined.groupBy(F.col("side").alias("split"), F.col("source_k").alias("source")).agg(
            F.count("*").alias("rows"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
            F.round(F.avg("coverage"), 6).alias("coverage"),
        )
