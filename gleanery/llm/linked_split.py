"""Splits that keep related records together (problem 2).

Method: iterative minimum-label propagation over the bipartite graph of records and entities, then stratified assignment of
whole groups. Records with the same source and uploader are one node of the graph (pre-aggregated before any shuffle of the
propagation), so that a hot source costs no more than its distinct uploaders. Every round sends the smallest label over the
edges, hooks it on the label's own root and follows labels of labels, so that chains of length n need about log n rounds.

Assignment is stratified and greedy: units are placed one after another, largest first, where the counts of rows per domain, and
per class in each domain, deviate least from those wanted. A unit is a whole group, or all groups of a stratum (domain and class that most of their
rows have) that share one of ``BUCKETS`` hash buckets; a group of more than a ``UNITS``-th of all rows is a unit of its own, of
which there can be at most ``UNITS``. So what reaches the driver is bounded by the targets and classes, whatever the number of groups.

Defined results: uploaders are equal ignoring case and surrounding blanks; null, empty and stand-in names (``NOBODY``) name nobody
and link nothing. Rows with a null source are linked by their uploader alone; rows with neither are groups of their own, without a
label, and are placed like groups of one row. A null or unlisted domain has the mean shares of the listed ones. Repeated rows count each. Empty input gives an empty result. Further
columns are ignored. Classes beyond the ``CLASSES`` most frequent ones are balanced as one. All ties are broken by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.names import class_key, source_key, split_key, stripped
from gleanery.session import stage, unstage
from gleanery.tables import small

#: Stand-ins for a missing uploader (fixed values).
NOBODY = ("", "-", "--", "?", "n/a", "na", "none", "null", "nan", "nil", "unknown", "anonymous", "anon", "not available", "undefined")
UNITS = 500
BUCKETS = 64
CLASSES = 200


def entity(uploader: Column) -> Column:
    name = F.lower(stripped(uploader))
    return F.when(~name.isin(*NOBODY), name)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for the nodes of column ``a`` of a bipartite edge list: label is the smallest node it is linked with."""
    edges = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null").distinct(), "edges", False)
    links = edges.where("b is not null")
    labels = stage(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels", False)
    while True:
        at_b = links.join(labels, links["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("low"))
        low = links.join(at_b, "b").groupBy("a").agg(F.min("low").alias("low"))
        old = labels.join(low, labels["node"] == low["a"], "left").select("node", "label", F.least("label", "low").alias("low"))
        hooked = old.select("node", "low").unionByName(old.where("low < label").select(F.col("label").alias("node"), "low"))
        found = hooked.groupBy("node").agg(F.min("low").alias("low"))
        jump = found.select(F.col("node").alias("low"), F.col("low").alias("root"))
        new = found.join(jump, "low", "left").select("node", F.least("low", "root").alias("label"))
        was = labels.select("node", F.col("label").alias("was"))
        nxt = stage(new.join(was, "node").select("node", "label", (F.col("label") < F.col("was")).alias("moved")), "labels", False)
        unstage(labels)
        labels = nxt.select("node", "label")
        labels.staged_path = nxt.staged_path
        if nxt.where("moved").isEmpty():
            return labels


class LinkedSplit:
    """Groups and assignment for one input table."""

    def __init__(self, df: DataFrame, source: str = "source", uploader: str = "uploader") -> None:
        self.spark = df.sparkSession
        self.df, self.source, self.uploader = df, source, uploader
        node, who = self._node()
        self.edges = df.select(node.alias("a"), who.alias("b")).distinct()
        self.groups = components(self.edges)

    def _node(self) -> tuple[Column, Column]:
        """The record node (its source, else its uploader, else none) and the entity it names."""
        who = entity(F.col(self.uploader))
        src = source_key(F.col(self.source))
        return F.coalesce(F.concat(F.lit("s:"), src), F.concat(F.lit("u:"), who)), who

    def pairs(self, names: DataFrame, name: str = "source_name") -> DataFrame:
        """Pairs of different sources in one group, named as in ``names``, the smaller name first."""
        known = names.select(F.col(name).alias("_n"), F.concat(F.lit("s:"), source_key(F.col(name))).alias("node"))
        named = self.groups.join(known, "node").select("label", "_n").distinct()
        left, right = named.withColumnRenamed("_n", "source_a"), named.withColumnRenamed("_n", "source_b")
        return left.join(right, "label").where("source_a < source_b").select("source_a", "source_b").distinct()

    def assign(self, targets: DataFrame, domain: str = "domain", label: str = "dominant_class", salt: str = "linked-split") -> DataFrame:
        """All rows of the input with ``group_label`` and ``assigned_split``; other columns keep their values."""
        shares: dict[str | None, dict[str, float]] = {}
        keyed = targets.select(source_key(F.col("domain")).alias("d"), split_key(F.col("split")).alias("s"), F.col("share").alias("x"))
        for r in small(keyed, 10_000, "split targets"):
            shares.setdefault(r["d"], {})[r["s"]] = float(r["x"])
        splits = sorted({s for x in shares.values() for s in x}, key=lambda s: (["train", "valid", "test"] + [s]).index(s))
        mean = {s: sum(x.get(s, 0.0) for x in shares.values()) / len(shares) for s in splits}
        node, _ = self._node()
        key, own = F.struct("_d", "_c"), self.df.columns
        cls = class_key(F.col(label))
        top = self.df.select(cls.alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(CLASSES)
        kept = [r["c"] for r in top.collect()]
        rows = self.df.select(
            *[self.df[c] for c in own],
            node.alias("__gl_node"),
            F.when(source_key(F.col(domain)).isin(*[d for d in shares if d is not None]), source_key(F.col(domain))).alias("__gl_d"),
            F.when(cls.isin(*kept), cls).alias("__gl_c"),
        )
        bucket = lambda d, c, *of: F.concat_ws("/", F.lit("b"), F.coalesce(d, F.lit("")), F.coalesce(c, F.lit("")), F.pmod(F.xxhash64(F.lit(salt), *of), F.lit(BUCKETS)))
        # rows that name neither source nor uploader: by hash of the whole row
        lone = F.when(F.col("__gl_node").isNull(), bucket(F.col("__gl_d"), F.col("__gl_c"), *own))
        rows = rows.withColumn("__gl_lone", lone)
        counts = rows.groupBy("__gl_node", "__gl_lone", F.col("__gl_d").alias("_d"), F.col("__gl_c").alias("_c")).agg(F.count("*").alias("_n"))
        lab = self.groups.select(F.col("node").alias("__gl_node"), F.col("label").alias("__gl_group"))
        sizes = stage(counts.join(lab, "__gl_node", "left").groupBy("__gl_group", "__gl_lone", "_d", "_c").agg(F.sum("_n").alias("_n")), "group-sizes")
        total = sizes.agg(F.sum("_n")).first()[0] or 0
        grouped = sizes.where("__gl_group is not null").groupBy("__gl_group").agg(F.max_by(key, F.struct(F.col("_n"), key)).alias("_m"), F.sum("_n").alias("_n"))
        unit = F.when(F.col("_n") * UNITS > total, F.concat(F.lit("g/"), F.col("__gl_group"))).otherwise(bucket(F.col("_m._d"), F.col("_m._c"), "__gl_group"))
        of_group = stage(grouped.select("__gl_group", unit.alias("__gl_unit")), "group-units")
        united = sizes.join(of_group, "__gl_group", "left").groupBy(F.coalesce("__gl_unit", "__gl_lone").alias("u"), "_d", "_c").agg(F.sum("_n").alias("n"))
        # a row for each unit, domain and class: at most UNITS + BUCKETS * strata units
        cells: dict[str, list] = {}
        whole: dict[tuple, int] = {}
        for r in united.collect():
            for k in (("d", r["_d"]), ("c", r["_d"], r["_c"])):
                cells.setdefault(r["u"], []).append((k, r["n"]))
                whole[k] = whole.get(k, 0) + r["n"]
        placed = self._place(cells, whole, shares, mean, splits)
        chosen = F.broadcast(self.spark.createDataFrame(sorted(placed.items()), "__gl_unit string, __gl_split string"))  # units
        out = rows.join(lab, "__gl_node", "left").join(of_group, "__gl_group", "left")
        out = out.withColumn("__gl_unit", F.coalesce("__gl_unit", "__gl_lone")).join(chosen, "__gl_unit", "left")
        return out.select(*[rows[c] for c in own], F.col("__gl_group").alias("group_label"), F.col("__gl_split").alias("assigned_split"))

    @staticmethod
    def _place(cells: dict[str, list], whole: dict[tuple, int], shares: dict, mean: dict, splits: list[str]) -> dict[str, str]:
        """Units to splits, largest first, each where the squared deviations from the wanted counts, relative to the rows of
        each domain and of each class in it, grow least."""
        want = {(k, s): n * shares.get(k[1], mean).get(s, 0.0) for k, n in whole.items() for s in splits}
        placed: dict[str, str] = {}
        merged: dict[str, dict[tuple, int]] = {}
        for u, parts in cells.items():
            for k, n in parts:
                merged.setdefault(u, {})[k] = merged.setdefault(u, {}).get(k, 0) + n
        for u in sorted(merged, key=lambda u: (-sum(merged[u].values()), u)):
            cost = lambda s: sum((n * n - 2 * n * want[k, s]) / max(1.0, whole[k]) for k, n in merged[u].items())  # noqa: B023, E731
            best = min(splits, key=lambda s: (cost(s), splits.index(s)))
            placed[u] = best
            for k, n in merged[u].items():
                want[k, best] -= n
        return placed


def split_report(assigned: DataFrame, targets: DataFrame, domain: str = "domain", label: str = "dominant_class") -> DataFrame:
    """``(domain, split, rows, share, target, class_gap)``: the share of each split in each domain beside its target (null where the
    domain is not listed), and the largest difference of a class's share in the split from that in all rows."""
    counts = stage(
        assigned.groupBy(source_key(F.col(domain)).alias("domain"), F.col("assigned_split").alias("split"), class_key(F.col(label)).alias("cls")).agg(F.count("*").alias("n")),
        "split-counts",
    )
    per = counts.groupBy("domain", "split").agg(F.sum("n").alias("rows"))
    whole = per.groupBy(F.col("domain").alias("_d")).agg(F.sum("rows").alias("_n"))
    in_split = counts.groupBy("split").agg(F.sum("n").alias("_s"))
    by_class = counts.groupBy(F.col("cls").alias("_c")).agg(F.sum("n").alias("_k")).join(F.broadcast(counts.agg(F.sum("n").alias("_all"))))  # one row
    cells = counts.groupBy("split", "cls").agg(F.sum("n").alias("n")).join(in_split, "split").join(by_class, F.col("cls").eqNullSafe(F.col("_c")))
    gaps = cells.groupBy("split").agg(F.round(F.max(F.abs(F.col("n") / F.col("_s") - F.col("_k") / F.col("_all"))), 4).alias("class_gap"))
    wanted = targets.select(source_key(F.col("domain")).alias("_t"), split_key(F.col("split")).alias("_u"), F.col("share").alias("target"))
    out = per.join(whole, per["domain"].eqNullSafe(whole["_d"])).join(gaps, "split")
    out = out.join(wanted, (F.col("domain") == F.col("_t")) & (F.col("split") == F.col("_u")), "left")
    return out.select("domain", "split", "rows", F.round(F.col("rows") / F.col("_n"), 4).alias("share"), "target", "class_gap")
