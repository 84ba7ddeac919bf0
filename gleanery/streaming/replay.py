"""Incremental batch steps that may be run again: what is planned and not yet done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(log: DataFrame, by: str, index: str) -> DataFrame:
    """Every index from 0 to the last one logged, per search."""
    return log.groupBy(by).agg(F.max(index).alias("_m")).select(by, F.explode(F.sequence(F.lit(0), F.col("_m"))).alias(index))


def missing(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows that no finished row has."""
    return planned.join(done, keys, "left_anti").select(*keys)


def gaps(log: DataFrame, by: str, index: str) -> DataFrame:
    """Searches whose indices do not run from 0 without a gap."""
    return log.groupBy(by).agg(F.countDistinct(index).alias("n"), F.max(index).alias("last")).where("n <> last + 1").select(by)


def append_new(spark, path: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows whose keys a Parquet folder does not hold yet, and return what was appended."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    fresh = rows.dropDuplicates(keys)
    if there:
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    from gleanery.session import stage

    fresh = stage(fresh, "append")
    fresh.write.mode("append").parquet(path)
    return fresh
