"""Queries of duplicates, groups, leaks, splits, samples, set operations and name lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.names import class_key, file_key, source_key, split_key, stem_key
from gleanery.operators import allocate, duplicates, pictures
from gleanery.session import stage
from gleanery.tables import in_blocks, load

SEED = 7
TOTAL = 500
CLASSES = ("bio", "cardboard", "glass", "metal", "paper", "plastic", "other")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "split")
    return s.select("row_id", file_key(F.col("file")).alias("f"), split_key(F.col("split")).alias("split"), source_key(F.col("source")).alias("source"), source_key(F.col("domain")).alias("domain"), class_key(F.col("dominant_class")).alias("cls"), "batch_no", "uploader")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the md5 and the export stem of their file; a row comes once for each md5 that its file was seen with."""
    p = load(spark, d, "fingerprints").where("file is not null and md5 is not null").select(file_key(F.col("file")).alias("f"), "md5").distinct()
    r = _rows(spark, d).join(p, "f", "left")
    return r.withColumn("stem", stem_key(F.col("f")))


def _near_keyed(spark: SparkSession, d: str) -> DataFrame:
    """Rows with md5, export stem and the near-duplicate group of their file."""
    return stage(_keyed(spark, d).join(pictures.near_groups(load(spark, d, "fingerprints")), "f", "left"), "near-keyed")


def _full_groups(k: DataFrame) -> DataFrame:
    return duplicates.groups(k, "row_id", [F.col("f"), F.col("md5"), F.col("stem"), F.col("near_dup")])


def dup2_near_pairs(spark, d):
    """Pairs of fingerprints within 10 bits, between the smallest files of each fingerprint."""
    p = load(spark, d, "fingerprints").where("file is not null").select(file_key(F.col("file")).alias("f"), "h0", "h1", "h2", "h3")
    return duplicates.bit_pairs(p, "f", ["h0", "h1", "h2", "h3"], 10)


def dup2_members(spark, d):
    """The smallest file of each fingerprint, for every file that has it."""
    words = ["h0", "h1", "h2", "h3"]
    p = load(spark, d, "fingerprints").where("file is not null").select(file_key(F.col("file")).alias("f"), *words).distinct()
    return p.join(duplicates.bit_classes(p, "f", words), words).select("f", "rep")


def dup2_near_pairs_full(spark, d):
    """Pairs of fingerprinted files by both rules, with the rule: within 10 bits, or within 40 with thumbnails that correlate by 0.9."""
    return pictures.near_files(load(spark, d, "fingerprints"))


def join8_vector_pairs(spark, d):
    """Every fiftieth vector against all others: signs that differ in at most 22 of 64 bits, and a correlation of at least 0.2."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding", duplicates.sign_bits(F.col("embedding")).alias("w"))
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"), F.col("w").alias("wa")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"), F.col("w").alias("wb"))
    p = in_blocks(a.where("a % 50 = 0"), "a", lambda asked: b.join(asked, F.expr("a <> b and bit_count(wa ^ wb) <= 22")))
    return p.where(duplicates.pearson(F.col("ea"), F.col("eb")) >= 0.2).select("a", "b", F.expr("cast(bit_count(wa ^ wb) as int)").alias("bits"))


def dup1_sign_bits(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", duplicates.sign_bits(F.col("embedding")).alias("word"))


def agg26_correlation(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    return e.join(n, "vec_id").select("vec_id", F.round(duplicates.pearson(F.col("embedding"), F.col("nxt")), 6).alias("corr"))


def dup4_groups(spark, d):
    """Groups of rows linked by file, md5 or export stem: the smallest row_id is the group's name."""
    k = _keyed(spark, d)
    return duplicates.groups(k, "row_id", [F.col("f"), F.col("md5"), F.col("stem")])


def dup3_near_groups(spark, d):
    """The near-duplicate group of every hashed file, named by its smallest file."""
    return pictures.near_groups(load(spark, d, "fingerprints"))


def dup4_groups_full(spark, d):
    """Groups of rows linked by file, md5, export stem or near-duplicate group."""
    return _full_groups(_near_keyed(spark, d))


def agg7_shared_key_pairs(spark, d):
    return duplicates.shared_key_pairs(_keyed(spark, d), F.col("md5"))


def agg8_duplicate_summary(spark, d):
    k = _keyed(spark, d)
    g = dup4_groups(spark, d).join(k.select(F.col("row_id").alias("node"), "source").distinct(), "node")
    per = g.groupBy("label").agg(F.countDistinct("node").alias("n"), F.countDistinct("source").alias("sources")).where("n > 1")
    return per.agg(F.count("*").alias("groups"), F.sum("n").alias("rows_in_groups"), F.sum((F.col("sources") > 1).cast("int")).alias("cross_source"))


def agg8_duplicate_summary_full(spark, d):
    k = _near_keyed(spark, d)
    g = _full_groups(k).join(k.select(F.col("row_id").alias("node"), "source").distinct(), "node")
    per = g.groupBy("label").agg(F.countDistinct("node").alias("n"), F.countDistinct("source").alias("sources")).where("n > 1")
    return per.agg(F.count("*").alias("groups"), F.sum("n").alias("rows_in_groups"), F.sum((F.col("sources") > 1).cast("int")).alias("cross_source"))


def win11_group_numbers(spark, d):
    g = dup4_groups(spark, d)
    per = g.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    return g.join(per, "label").select("node", F.col("label").alias("group_id"), "n")


def win11_group_numbers_full(spark, d):
    g = dup4_groups_full(spark, d)
    per = g.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    return g.join(per, "label").select("node", F.col("label").alias("group_id"), "n")


def spl3_leaks_full(spark, d):
    """Leaks by near-duplicate groups too."""
    k = _near_keyed(spark, d)
    return duplicates.leaks(k, "row_id", "split", [F.col("f"), F.col("md5"), F.col("stem"), F.col("near_dup")]).select(F.col("node").alias("row_id"))


def spl3_leaks(spark, d):
    k = _keyed(spark, d)
    return duplicates.leaks(k, "row_id", "split", [F.col("f"), F.col("md5"), F.col("stem")]).select(F.col("node").alias("row_id"))


def agg9_leak_matrix(spark, d):
    k = _keyed(spark, d).where("split in ('train', 'valid', 'test')")
    return duplicates.leak_matrix(k, "row_id", "split", {"file": F.col("f"), "md5": F.col("md5"), "stem": F.col("stem")})


def agg9_leak_matrix_full(spark, d):
    k = _near_keyed(spark, d).where("split in ('train', 'valid', 'test')")
    return duplicates.leak_matrix(k, "row_id", "split", {"file": F.col("f"), "md5": F.col("md5"), "stem": F.col("stem"), "near_dup": F.col("near_dup")})


def agg9_eval_leak_share(spark, d):
    """Share of evaluation rows that share a file, md5 or export stem with another split."""
    k = _keyed(spark, d).where("split in ('train', 'valid', 'test')")
    return duplicates.eval_leak_share(k, "row_id", "split", [F.col("f"), F.col("md5"), F.col("stem")])


def top4_examples(spark, d):
    """The first fifty duplicate groups with their first twelve rows."""
    g = dup4_groups(spark, d)
    return duplicates.first_members(g.withColumn("node", F.lpad(F.col("node").cast("string"), 12, "0")), "label", "node")


def agg8_rules(spark, d):
    """Pairs of classes of fingerprints by rule: equal md5 (pairs of rows), within 10 bits, or by the thumbnails' correlation."""
    near = pictures.near_classes(pictures.files_and_classes(load(spark, d, "fingerprints"))[1])
    rules = near.groupBy(F.when(F.col("bits") <= pictures.NEAR, "dhash").otherwise("thumb_corr").alias("rule")).agg(F.count("*").alias("pairs"))
    return rules.unionByName(agg7_shared_key_pairs(spark, d).select(F.lit("identical_md5").alias("rule"), "pairs"))


def spl1_greedy_split(spark, d):
    """Files to splits per class, one group per file."""
    g = _rows(spark, d).where("f is not null and cls is not null").groupBy("f").agg(F.min("cls").alias("cls"), F.count("*").alias("n"))
    return allocate.greedy_split(g, "cls", "f", "n", SEED)


def spl2_pinned_split(spark, d):
    """Rows of batch 1 pin their file's group to the split they were delivered in; strata are source and class."""
    r = _rows(spark, d).where("f is not null and cls is not null").withColumn("cls", F.concat_ws("/", "source", "cls"))
    r = r.withColumn("pin", F.when((F.col("batch_no") == 1) & F.col("split").isin("train", "valid", "test"), F.col("split")))
    return allocate.split_with_pins(r, "row_id", "f", "cls", "pin", SEED)


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a file, the label of their whole duplicate group, and their class (``background`` where it has none)."""
    g = _full_groups(_near_keyed(spark, d)).select(F.col("node").alias("row_id"), "label")
    return stage(_rows(spark, d).where("f is not null").join(g, "row_id").withColumn("cls", F.coalesce("cls", F.lit("background"))), "grouped")


def spl1_greedy_split_full(spark, d):
    """Whole duplicate groups to splits, in the class of their first row."""
    r = _grouped(spark, d)
    g = r.groupBy("label").agg(F.min_by("cls", "row_id").alias("cls"), F.count("*").alias("n"))
    return r.select("row_id", "label").join(allocate.greedy_split(g, "cls", "label", "n", SEED).select("label", "cls", "split"), "label")


def spl2_pinned_split_full(spark, d):
    """Rows of batch 1 pin their whole duplicate group to the split they were delivered in."""
    r = _grouped(spark, d).withColumn("pin", F.when((F.col("batch_no") == 1) & F.col("split").isin("train", "valid", "test"), F.col("split")))
    return allocate.split_with_pins(r.drop("split").withColumn("cls", F.concat_ws("/", "source", "cls")), "row_id", "label", "cls", "pin", SEED)


def win12_largest_remainder(spark, d):
    c = _rows(spark, d).where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"))
    return allocate.largest_remainder(c, "cls", "n", TOTAL)


def smp2_stratified(spark, d):
    """500 rows of train and 100 of valid, every class keeping its share; test rows and rows of no split stay whole."""
    r = _rows(spark, d).where("cls is not null").select("row_id", "split", "cls")
    return allocate.subsample(r, "row_id", "split", "cls", {"train": TOTAL, "valid": TOTAL // 5}, SEED)


def smp1_cap_per_source(spark, d):
    return allocate.first_by_hash(_rows(spark, d).select("row_id", "source"), ["source"], "row_id", 5, SEED).select("row_id", "source")


def smp3_fraction(spark, d):
    """Four tenths of the train list, every class with its largest-remainder quota, in the order of the list."""
    r = _rows(spark, d).where("split = 'train' and cls is not null").select("row_id", "cls")
    return allocate.fraction_sample(r, "row_id", "cls", 0.4, SEED)


def smp5_one_per_class(spark, d):
    """One file for each class, none for two."""
    r = _rows(spark, d).where("f is not null and split = 'test'").select("f", "cls")
    return allocate.one_per_class(r, "f", "cls", list(CLASSES), SEED)


def smp4_choice(spark, d):
    """Fifty files of the test split in hash order (a sampling operator)."""
    f = _rows(spark, d).where("split = 'test' and f is not null").select("f").distinct()
    return f.orderBy(allocate.seeded(SEED, F.col("f")), "f").limit(50)


def smp8_per_split(spark, d):
    f = _rows(spark, d).where("split in ('train', 'valid', 'test') and f is not null").select("split", "f").distinct()
    return allocate.first_by_hash(f, ["split"], "f", 30, SEED)


def win13_seeded_rank(spark, d):
    f = _rows(spark, d).where("f is not null").select("source", "f").distinct()
    return f.select("source", "f", F.row_number().over(Window.partitionBy("source").orderBy(allocate.seeded(SEED, F.col("f")), "f")).alias("place"))


def win15_round_robin(spark, d):
    return allocate.round_robin(_rows(spark, d).where("f is not null").select("source", "f").distinct(), "source", "f")


def win7_rank(spark, d):
    n = _rows(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", "n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "source")).alias("place"))  # one row per source


def src8_split_checks(spark, d):
    """The assertions of a split table as counts: blanks, unknown splits, files given twice, files in two splits."""
    s = load(spark, d, "split")
    r = _rows(spark, d)
    per = r.where("f is not null").groupBy("f").agg(F.count("*").alias("n"), F.countDistinct("split").alias("k"))
    a = s.agg(F.count(F.when(F.col("file").isNull() | (F.trim("file") == ""), 1)).alias("n")).select(F.lit("blank_file").alias("check_name"), "n")
    b = r.agg(F.count(F.when(F.col("split").isNull() | ~F.col("split").isin("train", "valid", "test"), 1)).alias("n")).select(F.lit("bad_split").alias("check_name"), "n")
    c = per.agg(F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).alias("n")).select(F.lit("file_twice").alias("check_name"), "n")
    e = per.agg(F.coalesce(F.sum((F.col("k") > 1).cast("int")), F.lit(0)).alias("n")).select(F.lit("file_in_two_splits").alias("check_name"), "n")
    return a.unionByName(b).unionByName(c).unionByName(e)


def src10_source_lookup(spark, d):
    """The source of each fingerprinted file: from the split table, else from its name, with where it came from."""
    p = load(spark, d, "fingerprints").where("file is not null").select(file_key(F.col("file")).alias("f")).distinct()
    s = _rows(spark, d).where("f is not null").groupBy("f").agg(F.min("source").alias("s"))
    j = p.join(s, "f", "left")
    by_name = F.when(F.col("f").contains("__"), source_key(F.split_part("f", F.lit("__"), F.lit(1))))
    return j.select("f", F.coalesce("s", by_name, F.lit("unknown")).alias("source"), F.when(F.col("s").isNotNull(), "table").when(by_name.isNotNull(), "name").otherwise("none").alias("origin"))


def join5_pins(spark, d):
    """Hits, misses and unused pins of batch 1 against batch 2 by file."""
    r = _rows(spark, d).where("f is not null")
    a, b = r.where("batch_no = 1").select("f").distinct(), r.where("batch_no = 2").select("f").distinct()
    j = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "f", "full_outer")
    return j.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("hits"), F.count(F.when(F.col("a").isNull(), 1)).alias("misses"), F.count(F.when(F.col("b").isNull(), 1)).alias("unused"))


def join6_both_ways(spark, d):
    p = load(spark, d, "fingerprints").where("file is not null").select(file_key(F.col("file")).alias("f")).distinct()
    r = _rows(spark, d).where("f is not null").select("f").distinct()
    a = r.join(p, "f", "left_anti").select("f", F.lit("no_fingerprint").alias("what"))
    return a.unionByName(p.join(r, "f", "left_anti").select("f", F.lit("no_row").alias("what")))


def join17_md5_matches(spark, d):
    """md5 that two batches share, with how many files each has."""
    k = _keyed(spark, d).where("md5 is not null")
    a = k.where("batch_no = 1").groupBy("md5").agg(F.countDistinct("f").alias("first_files"))
    b = k.where("batch_no > 1").groupBy("md5").agg(F.countDistinct("f").alias("later_files"), F.min("f").alias("least_file"))
    return a.join(b, "md5")


def join16_required(spark, d):
    """Rows of the train split with the domain of their source, and whether that is listed."""
    s = load(spark, d, "sources").select(source_key(F.col("source_name")).alias("source"), F.col("domain").alias("listed"))
    j = _rows(spark, d).where("split = 'train'").select("row_id", "source").join(s, "source", "left")
    return j.groupBy(F.col("listed").isNotNull().alias("known"), "listed").agg(F.count("*").alias("n"))


def join20_buckets(spark, d):
    b = spark.createDataFrame([(1, 1, "1"), (2, 2, "2"), (3, 10**9, ">=3")], "low long, high long, bucket string")
    n = _rows(spark, d).where("f is not null").groupBy("f").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(b), F.col("n").between(F.col("low"), F.col("high"))).groupBy("bucket").agg(F.count("*").alias("files"))


def join21_longest_prefix(spark, d):
    """Per source the other source of its family (first word) with the longest common prefix; ties by name."""
    s = load(spark, d, "sources").select(F.col("source_name").alias("a"), F.split_part("source_name", F.lit("_"), F.lit(1)).alias("w"))
    p = s.join(s.withColumnRenamed("a", "b"), "w").where("a <> b")
    common = F.expr("coalesce(array_position(transform(sequence(1, greatest(length(a), length(b))), i -> substr(a, i, 1) <> substr(b, i, 1)), true), 0)")
    p = p.withColumn("n", common)
    return p.groupBy("a").agg(F.max_by("b", F.struct("n", F.lit(0))).alias("_"), F.max("n").alias("n")).select(F.col("a").alias("source"), (F.col("n") - 1).alias("common"))


def join23_first_override(spark, d):
    """The first rule in order that a row's class and domain meet."""
    rules = spark.createDataFrame([(1, "glass", "studio", "clear"), (2, "glass", None, "glass"), (3, None, "coastal", "beach"), (4, "metal", None, "metal")], "ord int, c string, m string, target string")
    r = _rows(spark, d).select("row_id", "cls", "domain")
    j = r.join(F.broadcast(rules), F.expr("(c is null or c = cls) and (m is null or m = domain)"))
    return j.groupBy("row_id").agg(F.min_by("target", "ord").alias("target"))


def set1_union_all(spark, d):
    a = load(spark, d, "split").select("source", F.lit("split").alias("tab"))
    b = load(spark, d, "images").select("source", F.lit("images").alias("tab"), "width")
    return a.unionByName(b, allowMissingColumns=True).groupBy("tab").agg(F.count("*").alias("n"), F.count("width").alias("with_width"))


def set2_except(spark, d):
    s = _rows(spark, d).where("source is not null").select("source").distinct()
    l = load(spark, d, "sources").select(source_key(F.col("source_name")).alias("source"))
    return s.exceptAll(l.distinct()).select("source", F.lit("not_listed").alias("what")).unionByName(l.exceptAll(s).select("source", F.lit("unused").alias("what")))


def set3_intersect(spark, d):
    r = _rows(spark, d).where("uploader is not null")
    return r.where("split = 'train'").select("uploader").intersect(r.where("split = 'test'").select("uploader"))


def set4_symmetric_difference(spark, d):
    r = _rows(spark, d).where("f is not null")
    a, b = r.where("split = 'valid'").select("source").distinct(), r.where("split = 'test'").select("source").distinct()
    return a.join(b, "source", "left_anti").withColumn("side", F.lit("valid")).unionByName(b.join(a, "source", "left_anti").withColumn("side", F.lit("test")))


def set5_ordered_distinct(spark, d):
    w = Window.partitionBy("source").orderBy("row_id")
    return _rows(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1").select("source", F.col("row_id").alias("first_row"))


def set6_declared_or_seen(spark, d):
    a = spark.createDataFrame([("bio",), ("glass",), ("wood",)], "cls string")
    return a.union(_rows(spark, d).where("cls is not null").select("cls")).distinct()


def set7_outermost(spark, d):
    """Folders that lie in no other listed folder."""
    f = load(spark, d, "images").where("uid is not null").select(F.regexp_extract("uid", "^(.*)/", 1).alias("p")).where("p <> ''").distinct()
    parents = F.expr("transform(sequence(1, size(split(p, '/')) - 1), i -> array_join(slice(split(p, '/'), 1, i), '/'))")
    up = f.where(F.size(F.split("p", "/")) > 1).select("p", F.explode(parents).alias("q"))
    nested = up.join(f.select(F.col("p").alias("q")), "q", "left_semi").select("p").distinct()
    return f.join(nested, "p", "left_anti").select(F.col("p").alias("folder"))


def srt1_split_order(spark, d):
    r = _rows(spark, d).where("split in ('train', 'valid', 'test') and f is not null").select("split", "f").distinct()
    k = F.array_position(F.array(*[F.lit(s) for s in duplicates.ORDER]), F.col("split"))
    return r.select("split", "f", F.row_number().over(Window.partitionBy("split").orderBy("f")).alias("place"), k.cast("int").alias("split_rank"))


def top1_most_frequent(spark, d):
    return _rows(spark, d).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


def top2_level_fallback(spark, d):
    """The first size level (12, 6, 3, 1 rows) with at least ten sources, per domain, and its ten best."""
    n = _rows(spark, d).where("domain is not null").groupBy("domain", "source").agg(F.count("*").alias("n"))
    lv = n.select("domain", "source", "n", F.explode(F.array(*[F.lit(x) for x in (12, 6, 3, 1)])).alias("level")).where("n >= level")
    ok = lv.groupBy("domain", "level").agg(F.count("*").alias("k"))
    best = ok.groupBy("domain").agg(F.coalesce(F.max(F.when(F.col("k") >= 10, F.col("level"))), F.min("level")).alias("level"))
    j = lv.join(best, ["domain", "level"])
    return j.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "source"))).where("place <= 10").select("domain", "level", "source", "n", "place")


QUERIES = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_S = "nullif(regexp_replace(lower({0}), '[\\s_-]+', '', 'g'), '')"
_C = "nullif(regexp_replace(lower({0}), '[\\s[:punct:]]+', '', 'g'), '')"
_R = f"""
r as (
    select row_id, lower(file) f, case when {_C.format('split')} in ('val', 'validation') then 'valid' else {_C.format('split')} end split, {_S.format('source')} source,
        {_S.format('domain')} as domain, {_C.format('dominant_class')} cls, batch_no, uploader from split
), fp as (
    select distinct lower(file) f from fingerprints where file is not null
), fm as (
    select distinct lower(file) f, md5 from fingerprints where file is not null and md5 is not null
), hc as (
    select h0, h1, h2, h3, min(lower(file)) f from fingerprints where file is not null and h0 is not null and h1 is not null and h2 is not null and h3 is not null group by all
), k as (
    select r.*, fm.md5, case when contains(r.f, '.rf.') then split_part(r.f, '.rf.', 1) end stem from r left join fm using (f)
)"""
_G = """, ek as (
    select row_id, 'f' || f k from k where f is not null union all select row_id, 'm' || md5 from k where md5 is not null union all select row_id, 's' || stem from k where stem is not null
), ed as (
    select distinct a.row_id x, m.y from ek a join (select k, min(row_id) y from ek group by k) m using (k)
), hop as (
    select x, y from ed union select y, x from ed
), reach(x, y) as (
    select row_id, row_id from k union select r.x, h.y from reach r join hop h on h.x = r.y
), grp as (
    select x node, min(y) label from reach group by x
)"""
_H = "md5('7:' || {0})"


def _q(body: str, *more: str, rec: bool = False) -> str:
    return f"with {'recursive ' if rec else ''}{_R.strip()}{''.join(more)}\n{body}"


_KK = """, kk as (
    select distinct kind, key, split, row_id from (select 'file' kind, f key, split, row_id from k union all select 'md5', md5, split, row_id from k union all select 'stem', stem, split, row_id from k) where key is not null and split in ('train', 'valid', 'test')
), kb as (
    select distinct kind, key, split from kk
)"""
_FOLD = """, g as (
    {groups}
), o as (
    select *, row_number() over (partition by cls order by md5('7:' || f), f) i, sum(n) over (partition by cls) free from g
), st as (
    select cls, sum((ps = 'train')::int) t0, sum((ps = 'valid')::int) v0, sum((ps = 'test')::int) s0 from ({start}) group by cls
), fold(cls, i, f, n, split, t, v, s, total) as (
    select o.cls, 0::bigint, null::varchar, 0::bigint, null::varchar, coalesce(any_value(t0), 0)::bigint, coalesce(any_value(v0), 0)::bigint, coalesce(any_value(s0), 0)::bigint,
        (any_value(free) + coalesce(any_value(t0 + v0 + s0), 0))::bigint from o left join st on st.cls = o.cls group by o.cls
    union all
    select cls, i, f, n, c, t + case when c = 'train' then n else 0 end, v + case when c = 'valid' then n else 0 end, s + case when c = 'test' then n else 0 end, total from (
        select o.cls, o.i, o.f, o.n::bigint n, fold.t, fold.v, fold.s, fold.total, case
            when 0.7::double * total - t >= 0.2::double * total - v and 0.7::double * total - t >= 0.1::double * total - s then 'train'
            when 0.2::double * total - v >= 0.1::double * total - s then 'valid' else 'test' end c
        from fold join o on o.cls = fold.cls and o.i = fold.i + 1)
)"""
_NEAR = """, nf as (
    select distinct lower(file) f, concat_ws('|', h0, h1, h2, h3, thumb::varchar) c, h0, h1, h2, h3, thumb t from fingerprints where file is not null and h0 is not null and h1 is not null and h2 is not null and h3 is not null
), nc as (
    select c, any_value(h0) h0, any_value(h1) h1, any_value(h2) h2, any_value(h3) h3, any_value(t) t, any_value(list_avg(t)) mu from nf group by c
), nb as (
    select a.c ca, b.c cb, list_transform(a.t, lambda x: x - a.mu) ua, list_transform(b.t, lambda x: x - b.mu) ub,
        bit_count(xor(a.h0, b.h0))::int + bit_count(xor(a.h1, b.h1))::int + bit_count(xor(a.h2, b.h2))::int + bit_count(xor(a.h3, b.h3))::int d
    from nc a join nc b on a.c < b.c
    where bit_count(xor(a.h0, b.h0))::int + bit_count(xor(a.h1, b.h1))::int + bit_count(xor(a.h2, b.h2))::int + bit_count(xor(a.h3, b.h3))::int <= 40
), np as (
    select ca, cb, d from nb where d <= 10 or (len(ua) = len(ub) and list_dot_product(ua, ub) / nullif(sqrt(list_dot_product(ua, ua) * list_dot_product(ub, ub)), 0) >= 0.9)
), pairs as (
    select a, b, min(d) bits from (
        select least(x.f, y.f) a, greatest(x.f, y.f) b, d from np join nf x on x.c = ca join nf y on y.c = cb where x.f <> y.f
        union all select x.f, y.f, 0 from nf x join nf y on x.c = y.c and x.f < y.f) group by a, b
)"""
_ND = _NEAR + """, nh as (
    select a x, b y from pairs union select b, a from pairs
), nr(x, y) as (
    select f, f from nf union select r.x, h.y from nr r join nh h on h.x = r.y
), nd as (
    select x f, min(y) near_dup from nr group by x
), kn as (
    select k.*, near_dup from k left join nd using (f)
)"""
_GN = _ND + _G.replace("from k where stem is not null\n", "from k where stem is not null union all select row_id, 'n' || near_dup from kn where near_dup is not null\n")
_KKN = _ND + _KK.replace("select 'stem', stem, split, row_id from k)", "select 'stem', stem, split, row_id from k union all select 'near_dup', near_dup, split, row_id from kn)")
_SUMMARY = "select count(*) as groups, sum(n)::bigint as rows_in_groups, sum((s > 1)::int)::bigint as cross_source from (select label, count(distinct node) n, count(distinct source) s from grp join k on k.row_id = node group by label having count(distinct node) > 1)"
_LEAK = """, kk as (
    select row_id, case split when 'train' then 1 when 'valid' then 2 when 'test' then 3 else 0 end rk, split, key from (
        select row_id, split, 'f' || f key from k where f is not null union all select row_id, split, 'm' || md5 from k where md5 is not null union all select row_id, split, 's' || stem from k where stem is not null) where split is not null
)"""
_GR = _GN + """, gr as (
    select r.row_id, g.label::varchar f, coalesce(cls, 'background') cls, r.source, batch_no, split from r join (select distinct node, label from grp) g on g.node = r.row_id where r.f is not null
)"""
_PINS = """, pin0 as (
    select * replace (source || '/' || cls as cls), case when batch_no = 1 and split in ('train', 'valid', 'test') then split end pin from {rows}
), pg as (
    select f, arg_max(pin, case pin when 'train' then 1 when 'valid' then 2 else 3 end) ps from pin0 where pin is not null group by f
), p as (
    select pin0.*, pg.ps from pin0 left join pg using (f)
)"""
_PINNED = "select p.row_id, coalesce(pin, ps, fold.split) as split, pin is not null and pin <> ps as excluded from p left join fold on fold.f = p.f and ps is null"
_PIN_FOLD = _FOLD.format(groups="select f, arg_min(cls, row_id) cls, count(*) n from p where ps is null group by f", start="select cls, coalesce(pin, ps) ps from p where ps is not null")
SQL = {
    "dup2_near_pairs": _q("""select least(a.f, b.f) as a, greatest(a.f, b.f) as b, (bit_count(xor(a.h0, b.h0))::int + bit_count(xor(a.h1, b.h1))::int + bit_count(xor(a.h2, b.h2))::int + bit_count(xor(a.h3, b.h3))::int) as bits
from hc a join hc b on (a.h0, a.h1, a.h2, a.h3) < (b.h0, b.h1, b.h2, b.h3) where bit_count(xor(a.h0, b.h0))::int + bit_count(xor(a.h1, b.h1))::int + bit_count(xor(a.h2, b.h2))::int + bit_count(xor(a.h3, b.h3))::int <= 10"""),
    "dup2_members": _q("select distinct lower(p.file) as f, hc.f as rep from fingerprints p join hc using (h0, h1, h2, h3) where p.file is not null"),
    "dup2_near_pairs_full": _q("select a, b, bits, case when bits <= 10 then 'dhash' else 'thumb_corr' end as rule from pairs", _NEAR),
    "dup3_near_groups": _q("select f, near_dup from nd", _ND, rec=True),
    "dup4_groups_full": _q("select node, label from grp", _GN, rec=True),
    "agg8_duplicate_summary_full": _q(_SUMMARY, _GN, rec=True),
    "win11_group_numbers_full": _q("select node, label as group_id, n from (select *, count(*) over (partition by label) n from grp) where n > 1", _GN, rec=True),
    "spl3_leaks_full": _q("select distinct a.row_id from kk a join kk b on a.key = b.key and a.rk < b.rk", _ND, _LEAK.replace("from k where stem is not null)", "from k where stem is not null union all select row_id, split, 'n' || near_dup from kn where near_dup is not null)"), rec=True),
    "agg9_leak_matrix_full": _q("select a.kind as key_name, a.split as split_a, b.split as split_b, count(distinct a.row_id) as rows from kk a join kb b on a.kind = b.kind and a.key = b.key and a.split <> b.split group by all", _KKN, rec=True),
    "agg8_rules": _q("select case when d <= 10 then 'dhash' else 'thumb_corr' end as rule, count(*) as pairs from np group by 1 union all select 'identical_md5', coalesce(sum(n * (n - 1) // 2), 0)::bigint from (select md5, count(distinct row_id) n from k where md5 is not null group by 1)", _NEAR),
    "join8_vector_pairs": """
with e as (
    select vec_id, list_transform(embedding, lambda x: x::double) v, list_sum(list_transform(embedding[1:64], lambda x, i: case when x > 0 then (case when i = 64 then -9223372036854775808::hugeint else (1::hugeint << (i - 1)) end) else 0::hugeint end))::bigint w from embeddings
), c as (
    select *, list_avg(v) m from e
), z as (
    select vec_id, w, list_transform(v, lambda x: x - m) u from c
)
select a.vec_id as a, b.vec_id as b, bit_count(xor(a.w, b.w))::int as bits from z a join z b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and bit_count(xor(a.w, b.w)) <= 22
where list_dot_product(a.u, b.u) / (sqrt(list_dot_product(a.u, a.u) * list_dot_product(b.u, b.u)) + 1e-12) >= 0.2
""",
    "dup1_sign_bits": "select vec_id, list_sum(list_transform(embedding[1:64], lambda x, i: case when x > 0 then (case when i = 64 then -9223372036854775808::hugeint else (1::hugeint << (i - 1)) end) else 0::hugeint end))::bigint as word from embeddings",
    "agg26_correlation": """
with z as (select vec_id, list_transform(embedding, lambda x: x::double - list_avg(embedding)) u from embeddings)
select a.vec_id, round(list_dot_product(a.u, b.u) / (sqrt(list_dot_product(a.u, a.u) * list_dot_product(b.u, b.u)) + 1e-12), 6) as corr from z a join z b on b.vec_id = a.vec_id + 1
""",
    "dup4_groups": _q("select node, label from grp", _G, rec=True),
    "agg7_shared_key_pairs": _q("select coalesce(sum(n * (n - 1) // 2), 0)::bigint as pairs from (select md5, count(distinct row_id) n from k where md5 is not null group by 1)"),
    "agg8_duplicate_summary": _q("select count(*) as groups, sum(n)::bigint as rows_in_groups, sum((s > 1)::int)::bigint as cross_source from (select label, count(distinct node) n, count(distinct source) s from grp join k on k.row_id = node group by label having count(distinct node) > 1)", _G, rec=True),
    "win11_group_numbers": _q("select node, label as group_id, n from (select *, count(*) over (partition by label) n from grp) where n > 1", _G, rec=True),
    "spl3_leaks": _q("""select distinct a.row_id from kk a join kk b on a.key = b.key and a.rk < b.rk""", """, kk as (
    select row_id, case split when 'train' then 1 when 'valid' then 2 when 'test' then 3 else 0 end rk, split, key from (
        select row_id, split, 'f' || f key from k where f is not null union all select row_id, split, 'm' || md5 from k where md5 is not null union all select row_id, split, 's' || stem from k where stem is not null) where split is not null
)"""),
    "agg9_leak_matrix": _q("""select a.kind as key_name, a.split as split_a, b.split as split_b, count(distinct a.row_id) as rows from kk a join kb b on a.kind = b.kind and a.key = b.key and a.split <> b.split group by all""", _KK),
    "agg9_eval_leak_share": _q("""select count(*) as rows, count(*) filter (where leaked) as leaked, round(count(*) filter (where leaked) / count(*), 6) as share from (
    select row_id, row_id in (select a.row_id from kk a join kb b on a.kind = b.kind and a.key = b.key and a.split <> b.split) leaked from (select distinct row_id from k where split in ('valid', 'test')))""", _KK),
    "top4_examples": _q("""select label, n, array_to_string(list_sort(list(node)), '|') as members from (
    select label, n, lpad(node::varchar, 12, '0') node, row_number() over (partition by label order by node) i from grp join (select label, count(distinct node) n from grp group by label having count(distinct node) > 1 order by label limit 50) using (label)
) where i <= 12 group by all""", _G, rec=True),
    "spl1_greedy_split": _q("select cls, f, n, split from fold where i > 0", _FOLD.format(groups="select f, min(cls) cls, count(*) n from r where f is not null and cls is not null group by f", start="select null::varchar cls, null::varchar ps where false"), rec=True),
    "spl2_pinned_split": _q(_PINNED, _PINS.format(rows="r where f is not null and cls is not null"), _PIN_FOLD, rec=True),
    "spl1_greedy_split_full": _q("select gr.row_id, gr.f::bigint as label, fold.cls, fold.split from gr join fold on fold.f = gr.f and fold.i > 0", _GR, _FOLD.format(groups="select f, arg_min(cls, row_id) cls, count(*) n from gr group by f", start="select null::varchar cls, null::varchar ps where false"), rec=True),
    "spl2_pinned_split_full": _q(_PINNED, _GR, _PINS.format(rows="gr"), _PIN_FOLD, rec=True),
    "win12_largest_remainder": _q("select cls, n, quota from lq", f""", c as (select cls, count(*) n from r where cls is not null group by cls), x as (select *, n * {TOTAL}.0::double / sum(n) over () x from c),
y as (select *, floor(x)::bigint fl, row_number() over (order by round(x - floor(x), 9) desc, cls) rk from x), lq as (select cls, n, fl + (rk <= {TOTAL} - sum(fl) over ())::int as quota from y)"""),
    "smp2_stratified": _q(f"select row_id, r.split, r.cls from (select *, row_number() over (partition by split, cls order by {_H.format('row_id')}, row_id) i from r where cls is not null) r left join lq on lq.split = r.split and lq.cls = r.cls where lq.quota is null or i <= lq.quota", f""", c as (
    select split, cls, count(*) n, case split when 'train' then {TOTAL} else {TOTAL // 5} end total from r where cls is not null and split in ('train', 'valid') group by split, cls
), x as (select *, n * total::double / sum(n) over (partition by split) x, sum(n) over (partition by split) size from c qualify size > total),
y as (select *, floor(x)::bigint fl, row_number() over (partition by split order by round(x - floor(x), 9) desc, cls) rk from x), lq as (select split, cls, fl + (rk <= total - sum(fl) over (partition by split))::int as quota from y)"""),
    "smp1_cap_per_source": _q(f"select row_id, source from (select *, row_number() over (partition by source order by {_H.format('row_id')}, row_id) i from r) where i <= 5"),
    "smp3_fraction": _q(f"select row_id, t.cls from (select *, row_number() over (partition by cls order by {_H.format('row_id')}, row_id) i from r where split = 'train' and cls is not null) t join lq using (cls) where i <= quota", """, c as (
    select cls, count(*) n from r where split = 'train' and cls is not null group by cls
), x as (select *, n * round_even(sum(n) over () * 0.4::double, 0) / sum(n) over () x, round_even(sum(n) over () * 0.4::double, 0)::bigint total from c),
y as (select *, floor(x)::bigint fl, row_number() over (order by round(x - floor(x), 9) desc, cls) rk from x), lq as (select cls, fl + (rk <= total - sum(fl) over ())::int as quota from y)"""),
    "smp5_one_per_class": _q(" union all ".join(f"select '{c}' as cls, f from c{i}" for i, c in enumerate(CLASSES)), "".join(
        f", c{i} as (select f from (select distinct f from r where split = 'test' and f is not null and cls = '{c}'" + "".join(f" and f not in (select f from c{k})" for k in range(i)) + f") order by {_H.format('f')}, f limit 1)" for i, c in enumerate(CLASSES))),
    "smp4_choice": _q(f"select f from (select distinct f from r where split = 'test' and f is not null) order by {_H.format('f')}, f limit 50"),
    "smp8_per_split": _q(f"select split, f from (select *, row_number() over (partition by split order by {_H.format('f')}, f) i from (select distinct split, f from r where split in ('train', 'valid', 'test') and f is not null)) where i <= 30"),
    "win13_seeded_rank": _q(f"select source, f, row_number() over (partition by source order by {_H.format('f')}, f) as place from (select distinct source, f from r where f is not null)"),
    "win15_round_robin": _q("select source, f, row_number() over (partition by source order by f) as turn from (select distinct source, f from r where f is not null)"),
    "win7_rank": _q("select source, n, row_number() over (order by n desc, source nulls first) as place from (select source, count(*) n from r group by source)"),
    "src8_split_checks": _q("""select 'blank_file' as check_name, count(*) filter (where file is null or trim(file) = '') as n from split
union all select 'bad_split', count(*) filter (where split is null or split not in ('train', 'valid', 'test')) from r
union all select 'file_twice', count(*) from (select f from r where f is not null group by f having count(*) > 1)
union all select 'file_in_two_splits', count(*) from (select f from r where f is not null group by f having count(distinct split) > 1)"""),
    "src10_source_lookup": _q(f"""select fp.f, coalesce(s, case when contains(fp.f, '__') then {_S.format("split_part(fp.f, '__', 1)")} end, 'unknown') as source,
    case when s is not null then 'table' when contains(fp.f, '__') then 'name' else 'none' end as origin from fp left join (select f, min(source) s from r group by f) t on t.f = fp.f"""),
    "join5_pins": _q("select count(*) filter (where a is not null and b is not null) as hits, count(*) filter (where a is null) as misses, count(*) filter (where b is null) as unused from (select distinct f a from r where batch_no = 1 and f is not null) full join (select distinct f b from r where batch_no = 2 and f is not null) on a = b"),
    "join6_both_ways": _q("select f, 'no_fingerprint' as what from (select distinct f from r where f is not null except select f from fp) union all select f, 'no_row' from (select f from fp except select f from r)"),
    "join17_md5_matches": _q("select md5, first_files, later_files, least_file from (select md5, count(distinct f) first_files from k where batch_no = 1 and md5 is not null group by 1) join (select md5, count(distinct f) later_files, min(f) least_file from k where batch_no > 1 and md5 is not null group by 1) using (md5)"),
    "join16_required": _q(f"select s.domain is not null as known, s.domain as listed, count(*) as n from r left join sources s on {_S.format('s.source_name')} = r.source where split = 'train' group by all"),
    "join20_buckets": _q("select case n when 1 then '1' when 2 then '2' else '>=3' end as bucket, count(*) as files from (select f, count(*) n from r where f is not null group by f) group by 1"),
    "join21_longest_prefix": """
with s as (select source_name a, split_part(source_name, '_', 1) w from sources), p as (
    select x.a, y.a b, (select min(i) from unnest(range(1, greatest(length(x.a), length(y.a)) + 1)) u(i) where substr(x.a, i::bigint, 1) <> substr(y.a, i::bigint, 1)) n from s x join s y on x.w = y.w and x.a <> y.a
)
select a as source, (max(n) - 1)::bigint as common from p group by a
""",
    "join23_first_override": _q("select row_id, case when cls = 'glass' and domain = 'studio' then 'clear' when cls = 'glass' then 'glass' when domain = 'coastal' then 'beach' when cls = 'metal' then 'metal' end as target from r where cls = 'glass' or domain = 'coastal' or cls = 'metal'"),
    "set1_union_all": "select 'split' as tab, count(*) as n, 0 as with_width from split union all select 'images', count(*), count(width) from images",
    "set2_except": _q(f"select source, 'not_listed' as what from (select source from r where source is not null except select {_S.format('source_name')} from sources) union all select s, 'unused' from (select {_S.format('source_name')} s from sources except all select distinct source from r where source is not null)"),
    "set3_intersect": _q("select uploader from r where split = 'train' and uploader is not null intersect select uploader from r where split = 'test'"),
    "set4_symmetric_difference": _q("select source, 'valid' as side from (select source from r where split = 'valid' and f is not null except select source from r where split = 'test' and f is not null) union all select source, 'test' from (select source from r where split = 'test' and f is not null except select source from r where split = 'valid' and f is not null)"),
    "set5_ordered_distinct": _q("select source, min(row_id) as first_row from r group by source"),
    "set6_declared_or_seen": _q("select cls from r where cls is not null union select unnest(['bio', 'glass', 'wood'])"),
    "set7_outermost": "with f as (select distinct regexp_extract(uid, '^(.*)/', 1) p from images where uid is not null and contains(uid, '/')) select p as folder from f where p <> '' and not exists (select 1 from f g where starts_with(f.p, g.p || '/'))",
    "srt1_split_order": _q("select split, f, row_number() over (partition by split order by f) as place, case split when 'train' then 1 when 'valid' then 2 else 3 end as split_rank from (select distinct split, f from r where split in ('train', 'valid', 'test') and f is not null)"),
    "top1_most_frequent": _q("select source, count(*) as n from r group by source order by n desc, source nulls first limit 5"),
    "top2_level_fallback": _q("""select domain, level, source, n, place from (select lv.*, row_number() over (partition by lv.domain order by n desc, source) place from lv join b on b.domain = lv.domain and b.level = lv.level) where place <= 10""", """, n as (
    select domain, source, count(*) n from r where domain is not null group by all
), lv as (
    select *, level from n, unnest([12, 6, 3, 1]) u(level) where n >= level
), b as (
    select domain, coalesce(max(level) filter (where c >= 10), min(level)) as level from (select domain, level, count(*) c from lv group by all) group by domain
)"""),
}
