"""Exact and near duplicates over keys and bit vectors, groups and leaks between splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.components import connected_components

#: Protection order: a leak is removed from the split that comes first (fixed order).
ORDER = ("train", "valid", "test")


def sign_bits(vector: Column) -> Column:
    """A 64-bit word of the signs of the first 64 values (bit i is set if value i is above 0)."""
    return F.aggregate(F.transform(vector, lambda x, i: F.when((x > 0) & (i < 64), F.call_function("shiftleft", F.lit(1).cast("bigint"), i % 64)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, v: s.bitwiseOR(v))


def difference_bits(pixels: Column, width: int) -> Column:
    """Difference hash of a row-wise picture of width+1 columns: whether each pixel is brighter than its left neighbour, as text."""
    return F.array_join(F.transform(F.filter(F.transform(pixels, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: s["i"] % (width + 1) != width), lambda s: F.when(F.get(pixels, s["i"] + 1) > s["p"], "1").otherwise("0")), "")


def word_pieces(words: list[str], pieces: int) -> Column:
    """``pieces`` whole numbers, the pieces that 64-bit words are cut in, each marked with its place (all bits stand in one of them)."""
    out = []
    for k, w in enumerate(words):
        own = pieces * (k + 1) // len(words) - pieces * k // len(words)
        cuts = [64 * i // own for i in range(own + 1)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            mask = (1 << (high - low)) - 1
            # a whole word is a piece of its own only where there are no more pieces than words
            part = F.col(w) if high - low == 64 else F.shiftrightunsigned(w, low).bitwiseAND(F.lit(mask))
            out.append(F.struct(F.lit(len(out)).alias("at"), part.alias("value")))
    return F.array(*out)


def bit_classes(df: DataFrame, key: str, words: list[str]) -> DataFrame:
    """``(words..., rep)``: distinct words, named by their smallest key; keys with other words stand in several classes."""
    return df.where(reduce(lambda a, b: a & b, [F.col(w).isNotNull() for w in words])).groupBy(*words).agg(F.min(key).alias("rep"))


def bit_pairs(df: DataFrame, key: str, words: list[str], most: int) -> DataFrame:
    """``(a, b, bits)``: all pairs of classes of equal words (by their smallest keys, a <= b) that differ in 1 to ``most`` bits.

    Copies cost nothing: ``bit_classes`` says which keys stand for which. The words are cut in ``most + 1`` pieces, one of which any
    such pair shares, so that an equi-join of whole numbers finds all candidates; its exchange is left to the adaptive skew join.
    """
    one = bit_classes(df, key, words).select("rep", *words, F.explode(word_pieces(words, most + 1)).alias("p"))
    one = one.select("rep", *words, F.col("p.at").alias("at"), F.col("p.value").alias("value"))
    a, b = one.alias("a"), one.alias("b")
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words])
    first = F.struct("a.rep", *[f"a.{w}" for w in words]) < F.struct("b.rep", *[f"b.{w}" for w in words])
    near = a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.value") == F.col("b.value")) & first & (bits <= most))
    return near.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), bits.alias("bits"), F.struct(*[f"a.{w}" for w in words], *[f"b.{w}" for w in words]).alias("_of")).distinct().drop("_of")


def pearson(a: Column, b: Column) -> Column:
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cov = dot(a, b) - total(a) * total(b) / n
    return cov / (F.sqrt((dot(a, a) - total(a) * total(a) / n) * (dot(b, b) - total(b) * total(b) / n)) + 1e-12)


def shared_key_pairs(df: DataFrame, key: Column) -> DataFrame:
    """Number of pairs that share a key; null keys match nothing. Counted per key, never listed."""
    per = df.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).cast("bigint").alias("pairs"))


def star_edges(df: DataFrame, node: str, keys: list[Column]) -> DataFrame:
    """Edges from every row to the smallest row with the same key: components without all pairs of a group."""
    out = None
    for i, key in enumerate(keys):
        k = df.where(key.isNotNull()).select(F.col(node).alias("b"), F.concat(F.lit(f"{i}:"), key.cast("string")).alias("k"))
        out = k if out is None else out.unionByName(k)
    low = out.groupBy("k").agg(F.min("b").alias("a"))
    return out.join(low, "k").select("a", "b").where("a <> b").distinct()


def groups(df: DataFrame, node: str, keys: list[Column], more: DataFrame | None = None) -> DataFrame:
    """``(node, label)`` of all rows, linked by equal keys and further edges; single rows are their own group."""
    edges = star_edges(df, node, keys)
    edges = edges if more is None else edges.unionByName(more.select("a", "b"))
    linked = connected_components(edges)
    return df.select(F.col(node).alias("node")).distinct().join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def leaks(df: DataFrame, node: str, split: str, keys: list[Column]) -> DataFrame:
    """Rows that share a key with a row of a split that comes later in ORDER (which is protected from them).

    One small aggregate per key (the highest split that holds it), then an equi-join: no OR join and no pairs.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in ORDER]), F.col(split)).cast("int")
    out = None
    for key in keys:
        k = df.where(key.isNotNull()).select(F.col(node).alias("node"), rank.alias("r"), key.cast("string").alias("k"))
        top = k.groupBy("k").agg(F.max("r").alias("top"))
        hit = k.join(top, "k").where("r < top").select("node")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def leak_matrix(df: DataFrame, node: str, split: str, keys: dict[str, Column]) -> DataFrame:
    """Per key and pair of splits the rows of the first that share the key with the second."""
    out = None
    for name, key in keys.items():
        rows = df.where(key.isNotNull()).select(key.cast("string").alias("k"), F.col(split).alias("s"), F.col(node).alias("n")).distinct()
        held = rows.groupBy("k").agg(F.collect_set("s").alias("splits"))  # a few splits a key
        one = rows.join(held, "k").select("n", F.col("s").alias("split_a"), F.explode("splits").alias("split_b")).where("split_a <> split_b")
        one = one.distinct().groupBy("split_a", "split_b").agg(F.count("*").alias("rows"))
        one = one.select(F.lit(name).alias("key_name"), "split_a", "split_b", "rows")
        out = one if out is None else out.unionByName(one)
    return out


def eval_leak_share(df: DataFrame, node: str, split: str, keys: list[Column], evaluation: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """``(rows, leaked, share)`` of the evaluation splits: rows that share a key with a row of any other split."""
    out = None
    for key in keys:
        rows = df.where(key.isNotNull()).select(key.cast("string").alias("k"), F.col(split).alias("s"), F.col(node).alias("n"))
        apart = rows.groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi")
        hit = rows.where(F.col("s").isin(*evaluation)).join(apart, "k", "left_semi").select("n")
        out = hit if out is None else out.unionByName(hit)
    own = df.where(F.col(split).isin(*evaluation)).select(F.col(node).alias("n")).distinct()
    marked = own.join(out.distinct().withColumn("hit", F.lit(1)), "n", "left")
    return marked.agg(F.count("*").alias("rows"), F.count("hit").alias("leaked")).select("rows", "leaked", F.round(F.coalesce(F.try_divide("leaked", "rows"), F.lit(0.0)), 6).alias("share"))


def first_members(groups: DataFrame, label: str, member: str, most_groups: int = 50, most_members: int = 12) -> DataFrame:
    """``(label, n, members)``: the first groups of several, with their first members (a top-k report; no group is collected whole)."""
    sizes = groups.groupBy(label).agg(F.countDistinct(member).alias("n")).where("n > 1").orderBy(label).limit(most_groups)
    place = F.row_number().over(Window.partitionBy(label).orderBy(member))
    few = groups.select(label, member).distinct().join(sizes, label).withColumn("_k", place).where(F.col("_k") <= most_members)
    return few.groupBy(label, "n").agg(F.array_join(F.array_sort(F.collect_list(member)), "|").alias("members"))
