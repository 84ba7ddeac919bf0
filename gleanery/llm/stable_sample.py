"""A reproducible sample that stays when data grow (problem 5).

Method: the record's stable key (here the file name, ignoring case) is hashed with a fixed salt to the unit interval and kept
below the sampling rate. The decision looks at nothing but the key and its rate, so reruns, other partitionings and new
batches cannot change it, and all rows of a file go together.

Defined results: rows with a null file have no stable key and are never taken. With one rate for all domains this is a filter
without a shuffle. With rates per domain a file takes the highest rate among its rows' domains (so that its rows stay together
and later rows can only add members); null and unlisted domains have the default rate. Repeated rows are all kept or all left
out. Empty input gives an empty sample; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.names import file_key, source_key, unit_hash


def member(key: Column, rate: float | Column, salt: str = "stable-1") -> Column:
    """Whether a key belongs to the sample of that rate; samples of lower rates are subsets of higher ones."""
    return F.coalesce(unit_hash(salt, key) < rate, F.lit(False))


def stable_sample(
    df: DataFrame, rate: float, rates: dict[str, float] | None = None, key: str = "file", domain: str = "domain", salt: str = "stable-1"
) -> DataFrame:
    """The rows of ``df`` whose key is in the sample. ``rates`` gives rates of single domains (names in any spelling)."""
    if not rates:
        return df.where(member(file_key(F.col(key)), rate, salt))
    at = F.lit(rate)
    for name, value in sorted(rates.items()):
        at = F.when(F.coalesce(source_key(F.col(domain)) == source_key(F.lit(name)), F.lit(False)), value).otherwise(at)
    # rows above the highest rate cannot be members: only the rest is grouped
    near = df.where(member(file_key(F.col(key)), max(rate, *rates.values()), salt))
    best = near.groupBy(file_key(F.col(key)).alias("_stable_key")).agg(F.max(at).alias("_stable_rate"))
    best = best.where(member(F.col("_stable_key"), F.col("_stable_rate"), salt)).select("_stable_key")
    return near.join(best, file_key(near[key]) == best["_stable_key"], "left_semi")


def sample_report(df: DataFrame, rate: float, key: str = "file", domain: str = "domain", salt: str = "stable-1") -> DataFrame:
    """Per domain (normal form, null for rows that name none): distinct files, files in the sample and their share."""
    files = df.where(F.col(key).isNotNull()).select(source_key(F.col(domain)).alias("domain"), file_key(F.col(key)).alias("_f")).distinct()
    taken = F.count(F.when(member(F.col("_f"), rate, salt), 1))
    return files.groupBy("domain").agg(F.count("*").alias("files"), taken.alias("sampled")).withColumn(
        "share", F.round(F.col("sampled") / F.col("files"), 6)
    )
