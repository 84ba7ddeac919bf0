"""Access to the Parquet tables of a scale folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that must be small: collects at most ``most`` of them and refuses more.

    Used for dimension and target tables only, so that nothing that grows with the data reaches the driver.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it is meant to be a small table")
    return rows


def in_blocks(queries: DataFrame, key: str, search: Callable[[DataFrame], DataFrame], block: int = 100_000) -> DataFrame:
    """A stated set of queries against all rows: ``search`` gets them in blocks of about ``block`` rows, each broadcast, whose
    results are put together."""
    blocks = max(1, -(-queries.count() // block))
    out = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)) == i)
        hits = search(F.broadcast(part))
        out = hits if out is None else out.unionByName(hits)
    return out
