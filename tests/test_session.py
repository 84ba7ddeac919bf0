import os

import pytest
from pyspark.sql import functions as F

from gleanery.session import clean, release, shared_dir, stage, unstage
from gleanery.tables import in_blocks, small


def test_staged_tables(spark):
    df = spark.range(10).withColumn("x", F.lit("a"))
    a, b = stage(df), stage(df, "other", free=False)
    assert a.count() == 10 and a.columns == ["id", "x"] and os.path.isdir(a.staged_path) and a.staged_path.startswith(shared_dir(spark))
    unstage(a)
    assert not os.path.isdir(a.staged_path) and b.count() == 10
    empty = stage(df.where("id < 0"))
    assert empty.count() == 0 and empty.columns == ["id", "x"]
    clean(spark)
    assert not os.path.isdir(b.staged_path)
    release(spark)


def test_checks_of_size(spark):
    assert len(small(spark.range(5), 5, "it")) == 5
    with pytest.raises(ValueError):
        small(spark.range(6), 5, "it")
    seen = []
    search = lambda part: seen.append(part) or part.select("id")
    assert in_blocks(spark.range(50), "id", search, 7).count() == 50 and len(seen) == 8
    assert "broadcast" in seen[0]._jdf.queryExecution().logical().toString().lower()
