"""Queries of reports: tables of scores, notes, settings, rounds, candidates, and the report of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.names import file_key, source_key, split_key
from gleanery.operators import reports as R
from gleanery.operators import search_log
from gleanery.plans import record_queries
from gleanery.plans.search_queries import ROUND, _log
from gleanery.tables import load

DOMAINS = ("studio", "coastal", "realworld")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean (scaled), least and greatest balance of customers per segment and nation."""
    c = load(spark, d, "customer")
    return c.groupBy(F.col("c_nationkey").alias("model"), F.col("c_mktsegment").alias("domain")).agg(
        (F.avg("c_acctbal") / 0.997).alias("value"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count("*").alias("n")
    )


def rpt2_domain_table(spark, d):
    return R.domain_table(_scores(spark, d).where("n > 1"), list(SEGMENTS))


def rpt3_build_report(spark, d):
    """Counts of a build: rows whose file leaks into a protected split are excluded."""
    r = load(spark, d, "split").select("row_id", split_key(F.col("split")).alias("split"), source_key(F.col("domain")).alias("domain"), source_key(F.col("source")).alias("source"))
    return R.build_report(r, record_queries.dup4_groups(spark, d), record_queries.spl3_leaks(spark, d))


def agg25_best_arm(spark, d):
    """Best customer segment per nation by rounded mean balance, and whether there is a tie."""
    s = _scores(spark, d).select("model", "domain", F.round("value", -1).alias("v"))
    return R.best_and_tied(s, ["model"], "domain", "v", "none").select(F.col("model").alias("nation"), "arm", "best", "tied")


def agg25_note(spark, d):
    """Per nation a note on its segments: means that differ by more than 2,000 count as significant."""
    s = _scores(spark, d).select("model", "domain", "value")
    a, b = s.select("model", F.col("domain").alias("a"), F.col("value").alias("va")), s.select("model", F.col("domain").alias("b"), F.col("value").alias("vb"))
    p = a.join(b, "model").where("a < b").select("model", "a", "b", (F.col("vb") - F.col("va")).alias("diff"))
    return R.comparison_note(p.withColumn("significant", F.abs("diff") > 2000), ["model"]).select(F.col("model").alias("nation"), "note")


def agg21_verdict(spark, d):
    """Rank correlations of price and quantity, their p-value and verdict at 0.9."""
    l = load(spark, d, "lineitem")
    s = search_log.spearman(l, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")
    return search_log.correlation_verdict(s, "rho", "n", 0.9).select("l_returnflag", "l_linestatus", "n", F.round("rho", 6).alias("rho"), "p_value", "verdict")


def hlp3_image_size(spark, d):
    """The size of each source: its smallest recorded width, else its smallest height, else 640."""
    i = load(spark, d, "images").where("source is not null").groupBy("source").agg(F.min(F.when(F.col("width") > 4000, F.col("width"))).alias("w"), F.min(F.when(F.col("height") > 2000, F.col("height"))).alias("h"))
    return R.size_of_arm(i, "source", ["w", "h"], 640)


def hlp3_uniform(spark, d):
    return R.uniform_value(load(spark, d, "images").where("width > 0"), "width")


def hlp5_validation(spark, d):
    """Searches with their best score, where they have one: users without events are absent."""
    l = _log(spark, d).groupBy("user_id").agg(F.max("score").alias("best"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name").join(l, "user_id")


def hlp7_recount(spark, d):
    """Orders whose recorded number of lines (here the largest line number) is not the number of their lines."""
    l = load(spark, d, "lineitem").where("l_quantity > 1")
    n = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("n"))
    return R.recount_faults(n, l, "l_orderkey", "n")


def hlp10_configs(spark, d):
    p = load(spark, d, "part").select("p_brand", "p_size")
    return R.with_defaults(p, spark.createDataFrame([("Brand#00", 1), ("Brand#11", 1)], p.schema))


def hlp11_projection(spark, d):
    """Settings of every event cut to two names, with the names that are missing."""
    e = load(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("settings"))
    out = R.projected_settings(e, "settings", ["k", "lr0"])
    return out.select("event_id", F.try_element_at("settings", F.lit("k")).alias("k"), F.size("settings").alias("kept"), "lacking")


def hlp17_existing(spark, d):
    """Test files that have a fingerprint."""
    r = load(spark, d, "split").where(split_key(F.col("split")) == "test").where("file is not null").select(file_key(F.col("file")).alias("f")).distinct()
    return R.files_that_exist(r, load(spark, d, "fingerprints").where("file is not null").select(file_key(F.col("file")).alias("path")), "f")


def hlp18_labels(spark, d):
    s = _scores(spark, d)
    return s.select("model", "domain", R.score_label(F.concat("domain", F.lit(":"), F.col("model").cast("string")), F.when(F.col("n") > 1, F.round("value", 3))).alias("label"))


def hlp21_rounds(spark, d):
    """Rounds of every search; scores below 2 count as failed."""
    l = _log(spark, d).withColumn("score", F.when(F.col("score") >= 2, F.col("score")))
    return R.rounds_report(l, ["user_id"], "round", "score", "seconds", ROUND)


def hlp23_recorded_file(spark, d):
    """For each md5 of the fingerprints in batch 1 the shortest file name that has it."""
    p = load(spark, d, "fingerprints").where("file is not null and md5 is not null").select(file_key(F.col("file")).alias("f"), "md5").distinct()
    first = load(spark, d, "split").where("batch_no = 1 and file is not null").select(file_key(F.col("file")).alias("f")).distinct()
    return R.recorded_file(p, p.join(first, "f", "left_semi"), "md5", "f")


def set8_unknown_values(spark, d):
    """Class numbers in each image's lines that are neither mapped (0 to 4) nor ignored (6)."""
    cls = F.split_part(F.trim("line"), F.lit(" "), F.lit(1)).try_cast("int")
    seen = load(spark, d, "label_lines").groupBy("source", "uid").agg(F.array_compact(F.collect_set(cls)).alias("present"))
    return seen.select("source", "uid", F.array_join(R.unknown_values(F.col("present"), [0, 1, 2, 3, 4], [6]).cast("array<string>"), ",").alias("unknown")).where("unknown <> ''")


def srt3_stable_order(spark, d):
    """Suppliers by nation, and inside it by key: the place of each."""
    from gleanery.operators.ranged import numbered

    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return numbered(s, [], ["s_nationkey", "s_suppkey"], "place").select("s_suppkey", "place")


def srt4_two_keys(spark, d):
    """Customers by falling balance, of equal ones by name: the place of each."""
    from gleanery.operators.ranged import numbered

    c = load(spark, d, "customer").select("c_name", F.round("c_acctbal", -2).alias("b"))
    return numbered(c, [], [F.desc("b"), F.asc("c_name")], "place").select("c_name", "place")


def sclr_utc_text(spark, d):
    """Timestamps as UTC text, and a number rounded half to even and half up."""
    e = load(spark, d, "events")
    v = F.col("value").cast("decimal(20,6)")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"), F.bround(v, 0).cast("long").alias("half_even"), F.base64(F.col("event_type").cast("binary")).alias("coded"), F.unbase64(F.base64(F.col("event_type").cast("binary"))).cast("string").alias("back"))


QUERIES = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_K = "nullif(regexp_replace(lower({0}), '[\\s_-]+', '', 'g'), '')"
_C = "nullif(regexp_replace(lower({0}), '[\\s[:punct:]]+', '', 'g'), '')"
_SC = "sc as (select c_nationkey model, c_mktsegment as domain, avg(c_acctbal) / 0.997::double value, min(c_acctbal) low, max(c_acctbal) high, count(*) n from customer group by all)"
_LG = "lg as (select user_id, event_id, value score, json_extract(props, '$.k')::double as seconds, row_number() over (partition by user_id order by ts, event_id) - 1 i from events)"
SQL = {
    "rpt2_domain_table": f"with {_SC} select model, " + ", ".join(f"coalesce(max(case when domain = '{s}' then format('{{:.3f}} [{{:.3f}}, {{:.3f}}]', value, low, high) end), 'n/a') as \"{s}\"" for s in SEGMENTS) + " from sc where n > 1 group by model",
    "agg25_best_arm": f"with {_SC}, v as (select model, domain, round(value, -1) v from sc), t as (select model, max(v) best from v group by model) select t.model as nation, min(domain) as arm, any_value(best) as best, count(*) > 1 as tied from t join v on v.model = t.model and v.v = t.best group by t.model",
    "agg25_note": f"""
with {_SC}, p as (
    select a.model, a.domain a, b.domain b, b.value - a.value diff, abs(b.value - a.value) > 2000 sig from sc a join sc b on a.model = b.model and a.domain < b.domain
), l as (
    select model, case when diff > 0 then a else b end l, list_sort(list(case when diff > 0 then b else a end)) w from p where sig group by 1, 2
), t as (
    select model, l k, 0 kind, case when len(w) = 1 then w[1] || ' significantly beats ' else array_to_string(w[:len(w) - 1], ', ') || ' and ' || w[len(w)] || ' significantly beat ' end || l t from l
    union all select model, b || ' vs ' || a || ' is a tie', 1, b || ' vs ' || a || ' is a tie' from p where not sig
)
select model as nation, case when min(kind) = 1 then 'no arm is significantly better than another' else string_agg(t, '; ' order by kind, k) end as note from t group by model
""",
    "hlp3_image_size": "select source, coalesce(min(width) filter (where width > 4000), min(height) filter (where height > 2000), 640) as size from images where source is not null group by source",
    "hlp3_uniform": "select case when min(width) = max(width) then min(width) end as width from images where width > 0",
    "hlp5_validation": "select c_custkey as user_id, c_name, max(value) as best from customer join events on user_id = c_custkey group by all",
    "hlp7_recount": "select l_orderkey, max(l_linenumber)::bigint as recorded, count(*) filter (where l_quantity > 1) as counted from lineitem group by 1 having max(l_linenumber) <> count(*) filter (where l_quantity > 1)",
    "hlp10_configs": "select p_brand, p_size from part union select 'Brand#00', 1 union select 'Brand#11', 1",
    "hlp11_projection": "select event_id, json_extract_string(props, '$.k') as k, (json_extract_string(props, '$.k') is not null)::int + (json_extract_string(props, '$.lr0') is not null)::int as kept, array_to_string(list_filter(['k', 'lr0'], lambda n: json_extract_string(props, '$.' || n) is null), ',') as lacking from events",
    "hlp17_existing": f"select distinct lower(file) as f from split where (case when {_C.format('split')} in ('val', 'validation') then 'valid' else {_C.format('split')} end) = 'test' and lower(file) in (select lower(file) from fingerprints where file is not null)",
    "hlp18_labels": f"with {_SC} select model, domain, domain || ':' || model || case when n > 1 then format(' ({{:.3f}})', round(value, 3)) else '' end as label from sc",
    "hlp21_rounds": f"with {_LG}, p as (select user_id, (i // 8)::int round, max(score) filter (where score >= 2) best, count(*) filter (where score is null or score < 2) failed, count(*) n, round(sum(seconds) / 3600, 6) as hours from lg group by all) select user_id, round, best, max(best) over (partition by user_id order by round rows unbounded preceding) as best_so_far, failed, hours, n < 8 as incomplete from p",
    "hlp23_recorded_file": "with p as (select distinct lower(file) f, md5 from fingerprints where file is not null and md5 is not null), s as (select distinct md5 from p where f in (select lower(file) from split where batch_no = 1 and file is not null)) select md5, first(f order by length(f), f) as f, count(*) as candidates from p where md5 in (select md5 from s) group by md5",
    "set8_unknown_values": "with v as (select source, uid, list_sort(list(distinct c)) p from (select source, uid, try_cast(split_part(trim(line), ' ', 1) as int) c, split_part(trim(line), ' ', 1) t from label_lines) where c is not null and regexp_matches(t, '^[+-]?[0-9]+$') group by all) select source, uid, array_to_string(list_filter(p, lambda x: x not in (0, 1, 2, 3, 4, 6)), ',') as unknown from v where len(list_filter(p, lambda x: x not in (0, 1, 2, 3, 4, 6))) > 0",
    "srt3_stable_order": "select s_suppkey, row_number() over (order by s_nationkey, s_suppkey) - 1 as place from supplier",
    "srt4_two_keys": "select c_name, row_number() over (order by round(c_acctbal, -2) desc, c_name) - 1 as place from customer",
    "sclr_utc_text": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as utc, round_even(value::decimal(20, 6), 0)::bigint as half_even, to_base64(event_type::blob) as coded, event_type as back from events",
    "rpt3_build_report": None,
}
SQL = {k: v for k, v in SQL.items() if v}
