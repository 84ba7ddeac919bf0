"""Queries of search logs, reports and incremental replay over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import search_log as S
from gleanery.streaming import replay
from gleanery.tables import load

SPACE = [S.Dimension("lr0", -4.0, -1.0, True), S.Dimension("lrf", -2.0, 0.0, True), S.Dimension("momentum", 0.6, 0.98), S.Dimension("weight_decay", -5.0, -2.0, True), S.Dimension("mosaic", 0.0, 1.0), S.Dimension("scale", 0.1, 0.9)]
ROUND = 8
SWARM_ROUNDS = 6


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events of one user in order of time: a search whose evaluations come in rounds of eight."""
    e = load(spark, d, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", "event_id", F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("double").alias("seconds"), i.alias("i")).withColumn("round", F.floor(F.col("i") / ROUND).cast("int"))


def win3_best_so_far(spark, d):
    return S.best_so_far(_log(spark, d), ["user_id"], ["i"], "score").select("user_id", "i", "best_so_far")


def win8_labels(spark, d):
    return _log(spark, d).select("user_id", "event_id", F.format_string("r%d_p%d", F.col("round") + 1, F.col("i") % ROUND + 1).alias("label"))


def win16_rounds(spark, d):
    return _log(spark, d).groupBy("user_id", "round").agg(F.max("score").alias("best"), F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))


def agg20_search_summary(spark, d):
    return S.summary(_log(spark, d), ["user_id"], "score", "seconds", 20.0)


def agg23_session_seconds(spark, d):
    return S.session_seconds(_log(spark, d), ["user_id"], "i", "seconds")


def win4_restarts(spark, d):
    w = Window.partitionBy("user_id").orderBy("i")
    return _log(spark, d).select("user_id", (F.col("seconds") < F.lag("seconds").over(w)).alias("r")).groupBy("user_id").agg(F.count_if("r").alias("restarts"))


def fil8_finite(spark, d):
    """Scores below 1 stand for failed runs: they count as 0 and are marked."""
    l = _log(spark, d).withColumn("failed", F.col("score") < 1)
    return l.select("event_id", "failed", F.when(F.col("failed"), 0.0).otherwise(F.col("score")).alias("fitness"))


def fil7_completed_rounds(spark, d):
    """Rows up to the last whole round of each search."""
    l = _log(spark, d)
    done = l.groupBy("user_id").agg(F.floor(F.count("*") / ROUND).cast("int").alias("whole"))
    return l.join(done, "user_id").where("round < whole").groupBy("user_id").agg(F.count("*").alias("n"), F.max("round").alias("last_round"))


def best_evaluation(spark, d):
    """The first evaluation among equally good ones."""
    return _log(spark, d).groupBy("user_id").agg(F.max_by("i", F.struct("score", -F.col("i"))).alias("best_i"), F.max("score").alias("best"))


def agg21_spearman(spark, d):
    """Rank correlation of price and quantity over the lines of each return flag and status."""
    l = load(spark, d, "lineitem")
    return S.spearman(l, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity").select("l_returnflag", "l_linestatus", "n", F.round("rho", 6).alias("rho"))


def agg22_cost_rollup(spark, d):
    o = load(spark, d, "orders")
    r = o.rollup("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("cost"), F.count("*").alias("n"))
    return r.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "cost", "n")


def agg24_class_share(spark, d):
    """Share of each event type among all events and among those of a subset of users."""
    e = load(spark, d, "events")
    whole, part = e.groupBy("event_type").agg(F.count("*").alias("n")), e.where("user_id < 50").groupBy("event_type").agg(F.count("*").alias("m"))
    j = whole.join(part, "event_type", "left").na.fill(0, ["m"])
    all_ = Window.partitionBy(F.lit(0))  # a few classes
    return j.select("event_type", F.round(F.col("n") / F.sum("n").over(all_), 6).alias("full_share"), F.round(F.col("m") / F.sum("m").over(all_), 6).alias("subset_share"))


def agg28_draw_counts(spark, d):
    e = load(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("w"))


def agg12_bin_summary(spark, d):
    """Events per bin in the bins' own order, without empty ones."""
    bins = spark.createDataFrame([(0, "view", "browse"), (1, "click", "browse"), (2, "purchase", "buy"), (3, "refund", "buy"), (4, "signup", "join")], "pos int, event_type string, bin string")
    n = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(bins), "event_type").groupBy("bin").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"))


def prj14_bin_advice(spark, d):
    tips = spark.createDataFrame([("click", "top"), ("view", "side")], "event_type string, tip string")
    return load(spark, d, "events").join(F.broadcast(tips), "event_type", "left").select("event_id", F.coalesce("tip", F.lit("none")).alias("tip"))


def prj12_decode(spark, d):
    """Encoding and decoding of a log-scaled parameter."""
    x = -5.0 + F.col("l_discount") * 30
    return load(spark, d, "lineitem").select("l_discount").distinct().select("l_discount", S.decoded(SPACE[0], x).alias("lr0"), F.round(S.encoded(SPACE[0], F.pow(F.lit(10.0), x)), 9).alias("back"), S.decoded(SPACE[2], x).alias("momentum"))


def smp7_latin_hypercube(spark, d):
    return S.latin_hypercube(spark, 16, SPACE).select("i", "dim", F.round("x", 9).alias("x"))


def smp7_uniform(spark, d):
    return S.uniform_points(spark, 16, SPACE).select("i", "dim", F.round("x", 9).alias("x"))


def opt3_benchmark_functions(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return load(spark, d, "embeddings").select("vec_id", F.round(S.sphere(v), 6).alias("sphere"), F.round(S.rastrigin(v), 6).alias("rastrigin"))


def opt1_swarm(spark, d):
    """A swarm of eight on the negated Rastrigin function over six rounds: its log."""
    fit = lambda f: f.select("round", "particle", (-S.rastrigin(F.col("vector"))).alias("score"))
    log = S.run_search(spark, S.Swarm([S.Dimension(f"x{i}", -5.12, 5.12) for i in range(6)], 8, SWARM_ROUNDS, 3), fit)
    return log.select("round", "particle", F.round("score", 6).alias("score"))


def opt2_random_search(spark, d):
    """Uniform points on the sphere function, as one round."""
    p = S.uniform_points(spark, 64, [S.Dimension(f"x{i}", -5.12, 5.12) for i in range(6)], 5)
    return p.groupBy("i").agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("sphere"))


def fil10_settings(spark, d):
    """Mean prices per part type against rounded ones: those that differ by more than a millionth."""
    a = load(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.avg("p_retailprice").alias("value"))
    b = a.where("name <> 'ECONOMY'").select("name", F.when(F.col("name") < "M", F.col("value")).otherwise(F.round("value", 0)).alias("value"))
    return S.settings_diff(a, b).select("name", F.round("va", 6).alias("va"), F.round("vb", 6).alias("vb"))


def join14_tolerance(spark, d):
    """Evaluations of every search and the next one (by user) with the same index, and whether their scores are equal within 1e-9."""
    l = _log(spark, d).select("user_id", "i", "score")
    # one row a user for the window, so that the evaluations themselves are joined by key
    nxt = l.select("user_id").distinct().select("user_id", F.lead("user_id").over(Window.partitionBy(F.lit(0)).orderBy("user_id")).alias("next_id"))
    a, b = l.join(nxt, "user_id").withColumnRenamed("score", "a"), l.select(F.col("user_id").alias("next_id"), "i", F.col("score").alias("b"))
    return a.join(b, ["next_id", "i"]).select("user_id", "next_id", "i", "a", "b", (F.abs(F.col("a") - F.col("b")) <= 1e-9 * F.greatest(F.abs("a"), F.abs("b"))).alias("near"))


def join15_paired(spark, d):
    l = _log(spark, d)
    a, b = l.where("round = 0").groupBy("user_id").agg(F.max("score").alias("first")), l.where("round = 1").groupBy("user_id").agg(F.max("score").alias("second"))
    return a.join(b, "user_id")


def join22_either_way(spark, d):
    """Differences of pairs of nations looked up in either orientation, with the sign turned."""
    c = load(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    a, b = c.select(F.col("c_nationkey").alias("a"), F.col("v").alias("va")), c.select(F.col("c_nationkey").alias("b"), F.col("v").alias("vb"))
    stored = a.withColumn("b", (F.col("a") + 1) % 25).where("a % 2 = 0").join(b, "b").select("a", "b", F.round(F.col("vb") - F.col("va"), 6).alias("diff"))
    both = stored.unionByName(stored.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("diff")).alias("diff")))
    return both.select("a", "b", "diff")


def inc1_replay(spark, d):
    """Evaluations of the plan that are not yet logged: the first gap of every search, and what follows."""
    l = _log(spark, d).select("user_id", "i", "score")
    return replay.missing(replay.plan(l, "user_id", "i"), l.where("i % 9 <> 8"), ["user_id", "i"])


def inc2_run_cache(spark, d):
    """Settings of orders that no finished order has."""
    o = load(spark, d, "orders")
    key = F.concat_ws("|", "o_custkey", "o_orderpriority")
    return replay.missing(o.where("o_orderstatus <> 'F'").select(key.alias("run")).distinct(), o.where("o_orderstatus = 'F'").select(key.alias("run")), ["run"])


def rpt1_generation_pivot(spark, d):
    """Mean price by priority and status as a table with a column each."""
    o = load(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 2))
    return o.select("o_orderpriority", *[F.coalesce(F.format_string("%.2f", F.col(s)), F.lit("n/a")).alias(f"s_{s.lower()}") for s in ("F", "O", "P")])


def snk5_report_json(spark, d):
    """One JSON document per nation with its segments, keys in order."""
    c = load(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    g = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_mktsegment").alias("segment"), "n"))).alias("segments"), F.sum("n").alias("total"))
    return g.select("c_nationkey", F.to_json(F.struct("total", "segments")).alias("report"))


def snk9_markdown(spark, d):
    """A markdown line per region."""
    n, r, c = load(spark, d, "nation"), load(spark, d, "region"), load(spark, d, "customer")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    g = j.groupBy("r_name").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("v"))
    return g.select("r_name", F.format_string("| %s | %d | %.2f |", "r_name", "n", F.round("v", 2)).alias("line"))


def hlp1_setting_fallback(spark, d):
    """A part's size, else its brand's least size above 25, else null."""
    p = load(spark, d, "part")
    b = p.where("p_size > 25").groupBy("p_brand").agg(F.min("p_size").alias("s"))
    return p.join(b, "p_brand", "left").select("p_partkey", F.coalesce(F.when(F.col("p_size") <= 10, F.col("p_size")), "s").alias("size"))


def hlp2_shared_value(spark, d):
    g = load(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.countDistinct("o_orderstatus") == 1, F.max("o_orderstatus")).alias("shared"))
    return g


def hlp4_prefix(spark, d):
    """Whether the first two event types of a user are a prefix of the list click, view."""
    e = load(spark, d, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = e.select("user_id", "event_type", i.alias("i")).where("i <= 2").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "event_type"))).alias("x"))
    a = F.transform("x", lambda s: s["event_type"])
    return t.select("user_id", (F.slice(F.array(F.lit("click"), F.lit("view")), F.lit(1), F.size(a)) == a).alias("prefix"))


def hlp8_semi(spark, d):
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem").where("l_quantity >= 49")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"], "left_semi").select("o_orderkey", "o_orderstatus")


def join18_missing(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


def hlp9_error_bars(spark, d):
    """Per nation the mean balance and its distances to the quartiles."""
    g = load(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"), F.percentile("c_acctbal", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return g.select("c_nationkey", F.round(F.col("v") - F.get("q", F.lit(0)), 6).alias("below"), F.round(F.get("q", F.lit(1)) - F.col("v"), 6).alias("above"))


def hlp20_most_complete(spark, d):
    """The customer with the most orders per nation; the larger key among equals."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.join(c, n["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("n", "c_custkey")).alias("best"), F.max("n").alias("n"))


def hlp22_winners(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.countDistinct(F.to_json(F.struct("o_orderstatus"))).alias("kinds"))


QUERIES = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_L = "l as (select user_id, event_id, value as score, json_extract(props, '$.k')::double as seconds, row_number() over (partition by user_id order by ts, event_id) - 1 i from events), r as (select *, (i // 8)::int round from l)"
_DIMS = "dims as (select * from (values (0, 'lr0', -4.0::double, -1.0::double), (1, 'lrf', -2.0, 0.0), (2, 'momentum', 0.6, 0.98), (3, 'weight_decay', -5.0, -2.0), (4, 'mosaic', 0.0, 1.0), (5, 'scale', 0.1, 0.9)) t(k, dim, low, high))"


def _u(*parts: str) -> str:
    """The hash number of colon-joined parts in SQL."""
    text = " || ':' || ".join(parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0)"


def _swarm_sql() -> str:
    """The rounds unrolled: places and velocities of each (p<r>), their scores (f<r>), and the best ones so far."""
    at = lambda *parts: _u("'3'", *parts)
    out = [
        f"p0 as (select p, k, -5.12::double + {at(chr(39) + 'x' + chr(39), 'p', 'k')} * 10.24::double x, (2 * {at(chr(39) + 'v' + chr(39), 'p', 'k')} - 1) * 0.1::double * 10.24::double v from unnest(range(8)) a(p), unnest(range(6)) b(k))"
    ]
    for r in range(SWARM_ROUNDS):
        out.append(f"f{r} as (select {r} r, p, -sum(x * x - 10 * cos(2 * pi() * x) + 10) f from p{r} group by p)")
        out.append(f"l{r} as ({' union all '.join(f'select r, f.p, k, x, f from f{i} f join p{i} using (p)' for i in range(r + 1))})")
        if r + 1 < SWARM_ROUNDS:
            w = f"(0.9::double + (0.4::double - 0.9::double) * {r}::double / {SWARM_ROUNDS - 2})"
            pull = f"1.5::double * {at(chr(39) + 'own' + chr(39), str(r), 'p', 'k')} * (own - x) + 1.5::double * {at(chr(39) + 'best' + chr(39), str(r), 'p', 'k')} * (best - x)"
            limit = "0.2::double * 10.24::double"
            out.append(f"m{r} as (select p, k, x, least(greatest({w} * v + {pull}, -{limit}), {limit}) v from p{r} join (select p, k, arg_max(x, f) own from l{r} group by p, k) using (p, k) join (select k, arg_max(x, f) best from l{r} group by k) using (k))")
            out.append(f"p{r + 1} as (select p, k, least(greatest(x + v, -5.12::double), 5.12::double) x, case when x + v between -5.12::double and 5.12::double then v else 0 end v from m{r})")
    scores = " union all ".join(f"select * from f{r}" for r in range(SWARM_ROUNDS))
    return f"with {', '.join(out)} select r::int as round, p::int as particle, round(f, 6) as score from ({scores})"


SQL = {
    "join14_tolerance": f"with {_L}, n as (select user_id, lead(user_id) over (order by user_id) next_id from (select distinct user_id from r)) select a.user_id, n.next_id, a.i, a.score as a, b.score as b, abs(a.score - b.score) <= 1e-9::double * greatest(abs(a.score), abs(b.score)) as near from r a join n on n.user_id = a.user_id join r b on b.user_id = n.next_id and b.i = a.i",
    "win3_best_so_far": f"with {_L} select user_id, i, max(score) over (partition by user_id order by i rows unbounded preceding) as best_so_far from r",
    "win8_labels": f"with {_L} select user_id, event_id, 'r' || (round + 1) || '_p' || (i % 8 + 1) as label from r",
    "win16_rounds": f"with {_L} select user_id, round, max(score) as best, round(avg(score), 6) as mean, count(*) as n from r group by user_id, round",
    "agg20_search_summary": f"with {_L} select user_id, count(*) as n, max(score) as best, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as sd, min(score) as least, round(sum(seconds), 6) as seconds, count(*) filter (where score < 20) as below from r group by user_id",
    "agg23_session_seconds": f"with {_L} select user_id, round(sum(seconds), 6) as seconds from (select *, lead(seconds) over (partition by user_id order by i) nx from r) where nx is null or nx < seconds group by user_id",
    "win4_restarts": f"with {_L} select user_id, count(*) filter (where seconds < p) as restarts from (select *, lag(seconds) over (partition by user_id order by i) p from r) group by user_id",
    "fil8_finite": f"with {_L} select event_id, score < 1 as failed, case when score < 1 then 0 else score end as fitness from r",
    "fil7_completed_rounds": f"with {_L} select user_id, count(*) as n, max(round) as last_round from (select *, count(*) over (partition by user_id) // 8 w from r) where round < w group by user_id",
    "best_evaluation": f"with {_L} select user_id, min(i) as best_i, max(score) as best from (select *, max(score) over (partition by user_id) m from r) where score = m group by user_id",
    "agg21_spearman": """
with r as (
    select l_returnflag, l_linestatus, rank() over (partition by l_returnflag, l_linestatus order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_linestatus, l_extendedprice) - 1) / 2.0::double a,
        rank() over (partition by l_returnflag, l_linestatus order by l_quantity) + (count(*) over (partition by l_returnflag, l_linestatus, l_quantity) - 1) / 2.0::double b from lineitem
)
select l_returnflag, l_linestatus, count(*) as n, round(corr(a, b), 6) as rho from r group by all
""",
    "agg22_cost_rollup": "select coalesce(o_orderstatus, 'all') as status, coalesce(o_orderpriority, 'all') as priority, round(sum(o_totalprice), 2) as cost, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)",
    "agg24_class_share": "select event_type, round(count(*) / sum(count(*)) over (), 6) as full_share, round(count(*) filter (where user_id < 50) / sum(count(*) filter (where user_id < 50)) over (), 6) as subset_share from events group by event_type",
"agg28_draw_counts": "select user_id, event_type, count(*) as w from events group by all",
    "agg12_bin_summary": "select bin, min(pos) as pos, sum(n)::bigint as n from (select event_type, count(*) n from events group by 1) join (values (0, 'view', 'browse'), (1, 'click', 'browse'), (2, 'purchase', 'buy'), (3, 'refund', 'buy'), (4, 'signup', 'join')) b(pos, event_type, bin) using (event_type) group by bin",
    "prj14_bin_advice": "select event_id, case event_type when 'click' then 'top' when 'view' then 'side' else 'none' end as tip from events",
    "prj12_decode": "with x as (select distinct l_discount, -5 + l_discount * 30 x from lineitem) select l_discount, format('{:.5e}', pow(10, least(greatest(x, -4), -1)))::double as lr0, round(least(greatest(log10(pow(10, x)), -4), -1), 9) as back, format('{:.5e}', least(greatest(x, 0.6::double), 0.98::double))::double as momentum from x",
    "smp7_latin_hypercube": f"with {_DIMS}, g as (select i, dims.*, row_number() over (partition by k order by {_u("'0'", "'p'", 'k', 'i')}, i) - 1 s from unnest(range(16)) u(i), dims) select i, dim, round(low + (s + {_u("'0'", "'u'", 'k', 'i')}) / 16 * (high - low), 9) as x from g",
    "smp7_uniform": f"with {_DIMS} select i, dim, round(low + {_u("'0'", 'k', 'i')} * (high - low), 9) as x from unnest(range(16)) u(i), dims",
    "opt3_benchmark_functions": "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as sphere, round(list_sum(list_transform(embedding, lambda x: x::double * x::double - 10 * cos(2 * pi() * x::double) + 10)), 6) as rastrigin from embeddings",
    "opt1_swarm": _swarm_sql(),
    "opt2_random_search": f"select i, round(sum(pow(-5.12::double + {_u("'5'", 'k', 'i')} * (5.12::double - -5.12::double), 2)), 6) as sphere from unnest(range(64)) u(i), unnest(range(6)) v(k) group by i",
    "fil10_settings": "with a as (select p_type as name, avg(p_retailprice) v from part group by 1), b as (select name, case when name < 'M' then v else round(v, 0) end v from a where name <> 'ECONOMY') select a.name, round(a.v, 6) as va, round(b.v, 6) as vb from a full join b on a.name = b.name where not coalesce(abs(a.v - b.v) <= 1e-6 * greatest(abs(a.v), abs(b.v)), false)",
"join15_paired": f"with {_L} select a.user_id, a.f as first, b.f as second from (select user_id, max(score) f from r where round = 0 group by 1) a join (select user_id, max(score) f from r where round = 1 group by 1) b using (user_id)",
    "join22_either_way": "with c as (select c_nationkey k, avg(c_acctbal) v from customer group by 1), s as (select x.k a, y.k b, round(y.v - x.v, 6) diff from c x join c y on y.k = (x.k + 1) % 25 where x.k % 2 = 0) select * from s union all select b, a, -diff from s",
    "inc1_replay": f"with {_L} select user_id, i from r where i % 9 = 8",
    "inc2_run_cache": "select distinct o_custkey || '|' || o_orderpriority as run from orders where o_orderstatus <> 'F' and (o_custkey || '|' || o_orderpriority) not in (select o_custkey || '|' || o_orderpriority from orders where o_orderstatus = 'F')",
    "rpt1_generation_pivot": "select o_orderpriority, " + ", ".join(f"coalesce(printf('%.2f', round(avg(o_totalprice) filter (where o_orderstatus = '{s}'), 2)), 'n/a') as s_{s.lower()}" for s in "FOP") + " from orders group by o_orderpriority",
    "snk5_report_json": """select c_nationkey, '{"total":' || sum(n) || ',"segments":[' || string_agg('{"segment":"' || c_mktsegment || '","n":' || n || '}', ',' order by c_mktsegment) || ']}' as report from (select c_nationkey, c_mktsegment, count(*) n from customer group by all) group by c_nationkey""",
    "snk9_markdown": "select r_name, printf('| %s | %d | %.2f |', r_name, count(*), round(avg(c_acctbal), 2)) as line from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name",
    "hlp1_setting_fallback": "select p_partkey, coalesce(case when p_size <= 10 then p_size end, s) as size from part left join (select p_brand, min(p_size) s from part where p_size > 25 group by 1) using (p_brand)",
    "hlp2_shared_value": "select o_custkey, case when count(distinct o_orderstatus) = 1 then max(o_orderstatus) end as shared from orders group by o_custkey",
    "hlp4_prefix": "with t as (select user_id, list(event_type order by i) x from (select *, row_number() over (partition by user_id order by ts, event_id) i from events) where i <= 2 group by user_id) select user_id, (['click', 'view'])[1:len(x)] = x as prefix from t",
    "hlp8_semi": "select o_orderkey, o_orderstatus from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49)",
    "join18_missing": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    "hlp9_error_bars": "select c_nationkey, round(avg(c_acctbal) - quantile_cont(c_acctbal, 0.25), 6) as below, round(quantile_cont(c_acctbal, 0.75) - avg(c_acctbal), 6) as above from customer group by c_nationkey",
    "hlp20_most_complete": "with n as (select o_custkey, count(*) n from orders group by 1) select c_nationkey, max(c_custkey) as best, max(n) as n from (select c.*, n.n, max(n.n) over (partition by c_nationkey) m from n join customer c on c_custkey = o_custkey) where n = m group by c_nationkey",
    "hlp22_winners": "select o_orderpriority, count(distinct o_orderstatus) as kinds from orders group by 1",
}
