"""Tables and texts of reports: intervals, notes on comparisons, settings, candidates, and the report of a build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import base_name


def interval_text(value: Column, low: Column, high: Column) -> Column:
    """A value with its interval, three digits each; ``n/a`` where any is missing."""
    return F.when(value.isNotNull() & low.isNotNull() & high.isNotNull(), F.format_string("%.3f [%.3f, %.3f]", value, low, high)).otherwise("n/a")


def score_label(name: Column, score: Column) -> Column:
    """A name with its score in brackets, where there is one."""
    return F.when(score.isNull(), name).otherwise(F.concat(name, F.format_string(" (%.3f)", score)))


def domain_table(scores: DataFrame, domains: list[str], model: str = "model", domain: str = "domain") -> DataFrame:
    """One row per model and one column per domain: the score with its interval, ``n/a`` where there is none.

    ``scores`` has model, domain, value, low, high; the domains are a short list, so that the pivot runs no job of its own.
    """
    text = scores.select(model, domain, interval_text(F.col("value"), F.col("low"), F.col("high")).alias("t"))
    wide = text.groupBy(model).pivot(domain, domains).agg(F.first("t"))
    return wide.select(model, *[F.coalesce(F.col(f"`{d}`"), F.lit("n/a")).alias(d) for d in domains])


def best_and_tied(scores: DataFrame, by: list[str], arm: str, value: str, default: str) -> DataFrame:
    """``(by..., arm, best, tied)``: the arm with the highest value (of equal ones the first name), ``default`` where no arm has
    a value, and whether several arms share the highest one."""
    top = scores.groupBy(*by).agg(F.max(value).alias("best"))
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    cond = same[0] if same else F.lit(True)
    for c in same[1:]:
        cond = cond & c
    renamed = top.select(*[F.col(c).alias(f"_b_{c}") for c in by], "best")
    held = scores.join(renamed, cond).where(F.col(value) == F.col("best")).groupBy(*by).agg(F.min(arm).alias("_arm"), F.countDistinct(arm).alias("_n"))
    return top.join(held, by, "left").select(*by, F.coalesce("_arm", F.lit(default)).alias("arm"), "best", (F.coalesce("_n", F.lit(0)) > 1).alias("tied"))


def comparison_note(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., note)``: who significantly beats whom, and which pairs are ties.

    ``pairs`` has a, b, diff (b minus a) and significant: a few rows for each report. Losers and ties come in the order of names.
    """
    by = by or []
    win, lose = F.when(F.col("diff") > 0, F.col("b")).otherwise(F.col("a")), F.when(F.col("diff") > 0, F.col("a")).otherwise(F.col("b"))
    beaten = pairs.where("significant").groupBy(*by, lose.alias("l")).agg(F.sort_array(F.collect_set(win)).alias("w"))
    many = F.concat(F.array_join(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at("w", -1), F.lit(" significantly beat "))
    line = F.concat(F.when(F.size("w") == 1, F.concat(F.get("w", F.lit(0)), F.lit(" significantly beats "))).otherwise(many), F.col("l"))
    wins = beaten.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("l", line.alias("t")))).alias("wins"))
    ties = pairs.where("not significant").groupBy(*by).agg(F.sort_array(F.collect_list(F.concat("b", F.lit(" vs "), "a", F.lit(" is a tie")))).alias("ties"))
    both = wins.join(ties, by, "full_outer") if by else wins.join(ties, how="cross")  # one row each
    none = F.array().cast("array<string>")
    said = F.concat(F.coalesce(F.transform("wins", lambda s: s["t"]), none), F.coalesce("ties", none))
    tied = F.coalesce(F.size("wins"), F.lit(0)) == 0
    return both.select(*by, F.when(tied, "no arm is significantly better than another").otherwise(F.array_join(said, "; ")).alias("note"))


def size_of_arm(arms: DataFrame, arm: str, sources: list[str], default: int) -> DataFrame:
    """``(arm, size)``: the first of the columns that holds a size, else ``default``."""
    return arms.select(arm, F.coalesce(*[F.col(c) for c in sources], F.lit(default)).alias("size"))


def uniform_value(df: DataFrame, value: str) -> DataFrame:
    """One row: the value that all rows share, null where they differ."""
    return df.agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))


def recount_faults(recorded: DataFrame, rows: DataFrame, key: str, n: str) -> DataFrame:
    """``(key, recorded, counted)`` where the recorded number is not that of the rows."""
    real = rows.groupBy(key).agg(F.count("*").alias("counted"))
    j = recorded.select(key, F.col(n).alias("recorded")).join(real, key, "full_outer").na.fill(0, ["recorded", "counted"])
    return j.where("recorded <> counted")


def with_defaults(configs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Sampled settings and the default ones, which come once."""
    return configs.unionByName(defaults).distinct()


def projected_settings(df: DataFrame, settings: str, names: list[str]) -> DataFrame:
    """Rows with the map ``settings`` cut to ``names``, and the names that it lacks."""
    wanted = F.array(*[F.lit(n) for n in names])
    return df.withColumn("lacking", F.array_join(F.array_sort(F.array_except(wanted, F.map_keys(settings))), ",")).withColumn(
        settings, F.map_filter(settings, lambda k, v: k.isin(*names))
    )


def files_that_exist(listed: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Listed files that a listing (column ``path``) holds, by their last part."""
    there = listing.select(base_name(F.col("path")).alias("_b")).distinct()
    return listed.withColumn("_b", base_name(F.col(path))).join(there, "_b", "left_semi").drop("_b")


def recorded_file(candidates: DataFrame, recorded: DataFrame, digest: str, path: str) -> DataFrame:
    """For each recorded digest the candidate with the shortest path that has it (of equally long ones the first)."""
    hit = candidates.join(recorded.select(digest).distinct(), digest)
    return hit.groupBy(digest).agg(F.min_by(path, F.struct(F.length(path), F.col(path))).alias(path), F.count("*").alias("candidates"))


def rounds_report(log: DataFrame, by: list[str], round_: str, score: str, seconds: str, size: int) -> DataFrame:
    """Per search and round: best, best so far, failed evaluations, hours, and whether the round is incomplete."""
    bad = F.col(score).isNull() | F.isnan(score)
    per = log.groupBy(*by, round_).agg(
        F.max(F.when(~bad, F.col(score))).alias("best"), F.count_if(bad).alias("failed"), F.count("*").alias("_n"), F.round(F.sum(seconds) / 3600, 6).alias("hours")
    )
    run = Window.partitionBy(*by).orderBy(round_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select(*by, round_, "best", F.max("best").over(run).alias("best_so_far"), "failed", "hours", (F.col("_n") < size).alias("incomplete"))


def unknown_values(present: Column, mapped: list[int], ignored: list[int]) -> Column:
    """Values that are neither mapped nor ignored, sorted."""
    return F.array_sort(F.array_except(present, F.array(*[F.lit(v) for v in [*mapped, *ignored]])))


def build_report(rows: DataFrame, groups: DataFrame, excluded: DataFrame) -> DataFrame:
    """One JSON text: totals per split, per domain and split, per source and split, and the summary of duplicates.

    ``rows``: row_id, split, domain, source; ``groups``: node, label; ``excluded``: row_id. All parts are counts that the engine
    has made; what is put together has a row for each source and split.
    """
    sized = groups.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    of = groups.join(sized, "label").join(rows.select(F.col("row_id").alias("node"), "source"), "node")
    multi = of.groupBy("label").agg(F.countDistinct("node").alias("n"), F.countDistinct("source").alias("s"))
    dup = multi.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("images_in_groups"), F.count_if(F.col("s") > 1).alias("cross_source_groups"))
    out = rows.join(excluded.withColumn("_x", F.lit(1)), "row_id", "left")

    def part(name: str, *by: str) -> DataFrame:
        per = out.groupBy(*by).agg(F.count_if(F.col("_x").isNull()).alias("kept"), F.count("_x").alias("excluded"))
        return per.agg(F.array_sort(F.collect_list(F.struct(*[F.coalesce(F.col(b), F.lit("")).alias(b) for b in by], "kept", "excluded"))).alias(name))

    parts = [part("totals", "split"), part("domains", "domain", "split"), part("sources", "source", "split"), dup.select(F.struct("*").alias("duplicates"))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.crossJoin(F.broadcast(p))  # one row each
    return whole.select(F.to_json(F.struct("totals", "domains", "sources", "duplicates")).alias("report"))
