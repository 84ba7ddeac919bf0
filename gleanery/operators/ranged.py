"""Running sums, numbers and ranks over long orders, without one task for each key.

Rows are spread by ranges of (keys, order) into parts, each a stretch of one or several keys' orders. Running values are made
within the parts, and what lies before (or behind) a part is one row per part and key, which is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gleanery.session import stage

PART = "part"
#: Most totals of parts and keys that are broadcast; more are joined.
BROADCAST = 100_000


def ranged(df: DataFrame, keys: list[str], order: list, name: str = "ranged", large: bool = False) -> DataFrame:
    """The rows with the number of their ``part``; parts follow the order of every key. Staged, since a part's number must stay.
    With ``large`` they are staged in order, which packs better here and in later shuffles, and this shuffle's files are deleted."""
    parts = df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id())
    return stage(parts.sortWithinPartitions(*keys, *order) if large else parts, name, large)


def _beside(df: DataFrame, keys: list[str], totals: dict[str, Column], behind: bool) -> tuple[DataFrame, WindowSpec]:
    """Totals per part and key, under the names ``_o_<name>``, and the window over the parts before one (or behind it)."""
    per = df.groupBy(PART, *keys).agg(*[c.alias(f"_o_{n}") for n, c in totals.items()])
    return per, Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(PART) if behind else F.asc(PART)).rowsBetween(Window.unboundedPreceding, -1)


def _joined(df: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    renamed = offsets.select(F.col(PART).alias("_part"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in offsets.columns if c.startswith("_o_")])
    cond = F.col(PART) == F.col("_part")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(renamed, cond).drop("_part", *[f"_k_{k}" for k in keys])


def running_sums(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Rows of ``ranged`` with running sums, this row included, in the order of each key."""
    per, before = _beside(df, keys, {n: F.sum(c) for n, c in sums.items()}, False)
    per = stage(per, "totals", False)
    offsets = per.select(PART, *keys, *[F.sum(f"_o_{n}").over(before).alias(f"_o_{n}") for n in sums])
    offsets = F.broadcast(offsets) if per.count() <= BROADCAST else offsets  # else all rows would be shuffled once more
    own = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.select("*", *[F.sum(c).over(own).alias(n) for n, c in sums.items()])
    out = _joined(out, offsets, keys)
    return out.select(*df.columns, *[(F.col(n) + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in sums])


def maximum_from_here(df: DataFrame, keys: list[str], reverse: list, value: str, name: str) -> DataFrame:
    """Rows of ``ranged`` with the maximum of ``value`` from this row to the last of its key; ``reverse`` is the order backwards."""
    per, behind = _beside(df, keys, {name: F.max(value)}, True)
    offsets = per.select(PART, *keys, F.max(f"_o_{name}").over(behind).alias(f"_o_{name}"))
    own = Window.partitionBy(PART, *keys).orderBy(*reverse).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _joined(df.withColumn(name, F.max(value).over(own)), offsets, keys)
    return out.select(*df.columns, F.greatest(name, f"_o_{name}").alias(name))


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "number") -> DataFrame:
    """Rows with their number in the order of their key, from 0."""
    out = running_sums(ranged(df, keys, order), keys, order, {name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) - 1).drop(PART)


def mean_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``(keys..., value, name)``: the rank of each value in its key, from 1, equal values sharing their mean rank."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = running_sums(ranged(counts, keys, [value]), keys, [value], {"_upto": F.col("_n")})
    return run.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
