"""Ordered allocation of groups to splits, largest remainders, and seeded samples.

All random orders are hash orders, md5(seed:key), which depend on nothing but the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.ranged import numbered

#: Splits in the order of ties, and their fractions (fixed values).
SPLITS = (("train", 0.7), ("valid", 0.2), ("test", 0.1))
#: Which pin decides for a group that holds several (fixed order).
PIN_ORDER = ("train", "valid", "test")


def seeded(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def greedy_split(groups: DataFrame, stratum: str, group: str, size: str, seed: int = 0, start: DataFrame | None = None) -> DataFrame:
    """``(stratum, group, size, split)``: within a stratum, groups in hash order each go to the split that lacks most.

    Every step depends on those before, so a stratum is one ordered fold over small rows (hash, group, size); it streams over
    rows that the engine has sorted, so that a task holds one batch whatever the stratum's size. ``start`` gives counts that are already placed (pins): (stratum, train, valid, test).
    """
    names = [s for s, _ in SPLITS]
    rows = groups.select(F.col(stratum), F.col(group), F.col(size).cast("long").alias(size), seeded(seed, F.col(group)).alias("_h"))
    if start is None:
        rows = rows.select("*", *[F.lit(0).cast("long").alias(f"s_{s}") for s in names])
    else:
        rows = rows.join(start.select(F.col(stratum), *[F.col(s).cast("long").alias(f"s_{s}") for s in names]), stratum, "left").na.fill(0, [f"s_{s}" for s in names])

    totals = rows.groupBy(stratum).agg(F.sum(size).alias("_all"))
    ordered = rows.join(totals, stratum).repartition(stratum).sortWithinPartitions(stratum, "_h", group)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, have, want = None, [], []
        for part in parts:
            out = []
            for s, n, total, *start_counts in zip(*(part[c].tolist() for c in (stratum, size, "_all", *[f"s_{x}" for x in names])), strict=True):
                if s != now:
                    now, have = s, list(start_counts)
                    want = [f * (total + sum(have)) for _, f in SPLITS]
                lack = [w - h for w, h in zip(want, have, strict=True)]
                k = lack.index(max(lack))
                have[k] += n
                out.append(names[k])
            yield part[[stratum, group, size]].assign(split=out)

    kinds = dict(rows.dtypes)
    return ordered.mapInPandas(fold, f"{stratum} {kinds[stratum]}, {group} {kinds[group]}, {size} long, split string")


def pinned_split(rows: DataFrame, group: str, pin: str) -> DataFrame:
    """``(group, split)`` of groups with a pin: the last in PIN_ORDER among their pins."""
    rank = F.array_position(F.array(*[F.lit(s) for s in PIN_ORDER]), F.col(pin))
    return rows.where(F.col(pin).isNotNull()).groupBy(group).agg(F.max_by(pin, rank).alias("split"))


def split_with_pins(rows: DataFrame, node: str, group: str, stratum: str, pin: str, seed: int = 0) -> DataFrame:
    """``(node, split, excluded)``: pinned rows keep their pin, the rest of their groups follows the best protected one, and free
    groups are allocated greedily on top of the counts of each stratum (a free group counts in the stratum of its first row).
    Rows of a pinned group whose own pin protects less than another of the group are excluded."""
    pins = pinned_split(rows, group, pin)
    own = rows.join(pins.withColumnRenamed("split", "_ps"), group, "left").withColumn("_own", F.coalesce(pin, "_ps"))
    taken = own.where("_ps is not null").groupBy(stratum).pivot("_own", [s for s, _ in SPLITS]).agg(F.count(F.lit(1))).na.fill(0)
    free = own.where("_ps is null").groupBy(group).agg(F.min_by(stratum, node).alias(stratum), F.count("*").alias("_n"))
    chosen = greedy_split(free, stratum, group, "_n", seed, taken).select(group, F.col("split").alias("_fs"))
    out = own.join(chosen, group, "left")
    return out.select(node, F.coalesce("_own", "_fs").alias("split"), F.coalesce(F.col(pin) != F.col("_ps"), F.lit(False)).alias("excluded"))


def largest_remainder(counts: DataFrame, key: str, n: str, total: int | Column, by: list[str] | None = None) -> DataFrame:
    """``(by..., key, n, quota)``: whole quotas in proportion to n that add up to ``total``; ties of the remainders by key.

    ``counts`` has one row per stratum (a dimension), so its windows are over that alone.
    """
    by = by or []
    everything = Window.partitionBy(*(by or [F.lit(0)]))
    goal = total if isinstance(total, Column) else F.lit(total)
    exact = F.col(n) * goal.cast("double") / F.sum(n).over(everything)
    out = counts.select("*", exact.alias("_x")).withColumn("_f", F.floor("_x").cast("long"))
    rank = F.row_number().over(everything.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), key))
    short = goal - F.sum("_f").over(everything)
    return out.select(*by, key, n, (F.col("_f") + F.when(rank <= short, 1).otherwise(0)).alias("quota"))


def first_by_quota(rows: DataFrame, by: list[str], node: str, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """The first rows of each group in hash order, as many as ``quotas`` (by..., quota) says.

    The cut is found on counts of hash buckets, and only the bucket that holds it is ranked: no group is sorted as a whole.
    """
    keyed = rows.withColumn("_h", seeded(seed, F.col(node))).withColumn("_b", F.substring("_h", 1, 4))
    counts = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n")).join(quotas, by)
    run = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_n").over(run))
    # the first bucket with which the quota is reached; all rows where it is not
    cut = counts.groupBy(*by).agg(
        F.min(F.when(F.col("_upto") >= F.col("quota"), F.struct("_b", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("rest")))).alias("_cut"), F.max("quota").alias("quota")
    )
    near = keyed.join(cut.where("quota > 0"), by).where(F.col("_cut").isNull() | (F.col("_b") <= F.col("_cut._b")))
    inside = F.coalesce(F.col("_b") < F.col("_cut._b"), F.lit(True))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h", node))
    part = near.where(~inside).withColumn("_k", rank).where("_k <= _cut.rest")
    return near.where(inside).select(*rows.columns).unionByName(part.select(*rows.columns))


def stratified_sample(rows: DataFrame, node: str, stratum: str, total: int, seed: int = 0) -> DataFrame:
    """Exactly ``total`` rows with the strata's largest-remainder quotas, lowest hashes first."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    return first_by_quota(rows, [stratum], node, largest_remainder(counts, stratum, "_n", total).select(stratum, "quota"), seed)


def subsample(rows: DataFrame, node: str, split: str, stratum: str, wanted: dict[str, int], seed: int = 0) -> DataFrame:
    """Rows of the splits in ``wanted`` cut to that many, every stratum keeping its share; other rows, those of no split, and
    splits that are not larger than wanted stay whole."""
    want = F.create_map(*[F.lit(x) for kv in sorted(wanted.items()) for x in kv])
    named = F.coalesce(F.col(split), F.lit(""))
    counts = rows.groupBy(split, stratum).agg(F.count("*").alias("_n")).where(F.try_element_at(want, named).isNotNull())
    size = F.sum("_n").over(Window.partitionBy(split))
    cut = counts.withColumn("_size", size).where(F.col("_size") > F.try_element_at(want, named))
    quotas = largest_remainder(cut, stratum, "_n", F.try_element_at(want, named), [split]).select(split, stratum, "quota")
    cut_splits = quotas.select(split).distinct()
    return first_by_quota(rows, [split, stratum], node, quotas, seed).unionByName(rows.join(cut_splits, split, "left_anti").select(*rows.columns))


def fraction_sample(rows: DataFrame, node: str, stratum: str, fraction: float, seed: int = 0) -> DataFrame:
    """``fraction`` of all rows (rounded half to even), each stratum with its largest-remainder quota, in the order of ``node``."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    goal = F.bround(F.sum("_n").over(Window.partitionBy(F.lit(0))) * fraction).cast("long")  # one row per stratum
    quotas = largest_remainder(counts.withColumn("_goal", goal), stratum, "_n", F.col("_goal")).select(stratum, "quota")
    return first_by_quota(rows, [stratum], node, quotas, seed).orderBy(node)


def one_per_class(pairs: DataFrame, node: str, cls: str, classes: list, seed: int = 0) -> DataFrame:
    """``(cls, node)``: for each class in the order of ``classes`` the first of its nodes in hash order that no class before took;
    classes without one are left out. As many nodes of each class as there are classes are enough for that."""
    spark, kinds = pairs.sparkSession, dict(pairs.dtypes)
    held = pairs.where(F.col(cls).isin(*classes)).select(cls, node).distinct()
    first = first_by_hash(held, [cls], node, len(classes), seed).withColumn("_h", seeded(seed, F.col(node)))
    per: dict = {}
    for r in first.orderBy("_h", node).collect():  # classes squared
        per.setdefault(r[cls], []).append(r[node])
    out, taken = [], set()
    for c in classes:
        free = next((x for x in per.get(c, []) if x not in taken), None)
        if free is not None:
            taken.add(free)
            out.append((c, free))
    return spark.createDataFrame(out, f"{cls} {kinds[cls]}, {node} {kinds[node]}")


def first_by_hash(rows: DataFrame, by: list[str], node: str, most: int, seed: int = 0) -> DataFrame:
    """The ``most`` rows of each group that come first in hash order (a whole number, by which each task cuts before the
    shuffle; see ``first_by_quota`` for quotas of their own)."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(seeded(seed, F.col(node)), node)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def round_robin(rows: DataFrame, by: str, node: str) -> DataFrame:
    """``place``: the k-th row of each group in turn (groups by name, rows by node)."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(node))
    return rows.withColumn("turn", k)


def resample(nodes: DataFrame, node: str, replicates: int, seed: int = 0) -> DataFrame:
    """``(replicate, node, w)``: bootstrap weights, n hash draws with replacement per replicate.

    Draw i of replicate b takes the node with number md5(seed:b:i) mod n; nodes are numbered in their own order.
    """
    spark = nodes.sparkSession
    known = numbered(nodes.select(F.col(node)).distinct(), [], [node], "_i")
    n = known.count()
    if n == 0:
        return spark.createDataFrame([], f"replicate long, {node} {dict(nodes.dtypes)[node]}, w long")
    draws = spark.range(replicates * n).select(F.floor(F.col("id") / n).alias("replicate"), (F.col("id") % n).alias("_slot"))
    text = F.concat(F.lit(f"{seed}:"), F.col("replicate").cast("string"), F.lit(":"), F.col("_slot").cast("string"))
    draws = draws.withColumn("_i", F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n)
    w = draws.groupBy("replicate", "_i").agg(F.count("*").alias("w"))
    return w.join(known, "_i").select("replicate", node, "w")
