"""Recall of the picture searches against exhaustive search: ``python -m gleanery.llm.recall FOLDER``.

Every fiftieth class (by hash) is compared with all classes, in blocks of queries; the pairs that show the same picture are the
truth. The same queries are then put to kept shards, into which all classes have been appended in five batches, and to the
suffix neighbours that ``pictures.meeting`` finds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.batches import Shards
from gleanery.llm.pictures import FAR, NEAR, Coded, files_and_classes, meeting, verified
from gleanery.session import build_session, new_folder, stage
from gleanery.tables import load

EVERY, BLOCK = 50, 20_000


def exhaustive(classes: DataFrame, asked: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs of a class and an asked one that show the same picture, a <> b; queries are held in blocks."""
    spark, out = classes.sparkSession, None
    blocks = max(1, -(-asked.count() // BLOCK))
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(F.lit("block"), "class_k"), F.lit(blocks)) == i).select("class_k", "code").collect()  # about BLOCK rows
        held = spark.sparkContext.broadcast(([r["class_k"] for r in part], [bytes(r["code"]) for r in part]))

        def run(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            keys, query = np.array(held.value[0], np.int64), Coded(held.value[1])
            for rows in parts:
                mine, data = rows["class_k"].to_numpy(np.int64), Coded(rows["code"].tolist())
                for a in range(0, len(mine), 256):
                    h = data.hash[a : a + 256]
                    d = sum(np.bitwise_count(h[:, None, w] ^ query.hash[None, :, w]).astype(np.int16) for w in range(4))
                    i, j = np.nonzero(d <= FAR)
                    same = d[i, j] <= NEAR
                    same[~same] = data.alike(a + i[~same], query, j[~same])
                    x, y = mine[a + i[same]], keys[j[same]]
                    yield pd.DataFrame({"a": x[x != y], "b": y[x != y]})

        hits = classes.select("class_k", "code").mapInPandas(run, "a long, b long")
        out = hits if out is None else out.unionByName(hits)
    return out


def measure(spark: SparkSession, folder: str) -> dict[str, int]:
    """Numbers of true pairs, and of those that the shards and the suffix neighbours find."""
    classes = files_and_classes(load(spark, folder, "fingerprints"))[1]
    place = F.pmod(F.xxhash64(F.lit("recall"), "class_k"), F.lit(EVERY))
    asked = stage(classes.where(place == 0), "recall-asked")
    true = stage(exhaustive(classes, asked), "recall-true")
    shards = Shards(spark, new_folder(spark, "recall-index"))
    for b in range(5):
        batch = stage(classes.where(F.pmod(F.xxhash64(F.lit("batch"), "class_k"), F.lit(5)) == b), "recall-batch")
        shards.append(batch, batch.count())
    found = stage(shards.search(asked, asked.count()), "recall-found").distinct()
    near = verified(stage(meeting(classes).select("a", "b"), "recall-met"), classes).select("a", "b")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return {
        "classes": classes.count(), "asked": asked.count(), "true": true.count(),
        "shards": true.join(found, ["a", "b"], "left_semi").count(), "suffixes": true.join(both, ["a", "b"], "left_semi").count(),
    }


if __name__ == "__main__":
    session = build_session("recall", spark__master="local[8]", spark__driver__memory="12g", spark__ui__enabled="false", spark__driver__host="127.0.0.1")
    print(measure(session, sys.argv[1]))
