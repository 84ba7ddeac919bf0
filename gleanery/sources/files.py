"""Split files, lists, logs and reports: readers with strict checks, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import bare, base_name

SPLITS = ("train", "valid", "test")
SPLIT_COLUMNS = ("split", "file", "source", "domain", "dominant_class", "source_class", "group", "source_file")


class InvalidFile(ValueError):
    """A file that breaks the rules of its format."""


def read_split(spark: SparkSession, path: str, required: tuple[str, ...] = ("split", "file")) -> DataFrame:
    df = spark.read.option("header", "true").csv(path)
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise InvalidFile(f"{path} lacks the columns {', '.join(lacking)}")
    return df


def split_faults(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(fault, file)``: blanks, unknown splits, repeated files, and files that only one side has."""
    blank = F.coalesce(F.trim("file"), F.lit("")) == ""
    out = df.where(blank).select(F.lit("blank").alias("fault"), "file")
    out = out.unionByName(df.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).select(F.lit("bad_split").alias("fault"), "file"))
    twice = df.where(~blank).groupBy("file").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(twice.select(F.lit("repeated").alias("fault"), "file"))
    if known is not None:
        out = out.unionByName(df.where(~blank).join(known, "file", "left_anti").select(F.lit("not_in_dataset").alias("fault"), "file"))
        out = out.unionByName(known.join(df, "file", "left_anti").select(F.lit("not_assigned").alias("fault"), "file"))
    return out


def write_split(df: DataFrame, path: str) -> None:
    """Splits in their own order, files sorted: a range shuffle, so that one writer never holds all rows."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    cols = [c for c in SPLIT_COLUMNS if c in df.columns]
    df.withColumn("_r", rank).orderBy("_r", "file").select(*cols).write.option("header", "true").csv(path)


def write_lists(df: DataFrame, path: str, by: tuple[str, ...] = ("split",), value: str = "file") -> list[str]:
    """One text folder per split (domain, source); returns warnings about splits without files. A range shuffle spreads the rows
    of a large split over several writers, whose parts follow each other in the order of the names."""
    df.select(value, *by).repartitionByRange(*by, value).sortWithinPartitions(*by, value).write.partitionBy(*by).text(path)
    held = {r[0] for r in df.select(by[0]).distinct().limit(10_000).collect()}
    return [f"no files for {s}" for s in SPLITS if by[0] == "split" and s not in held]


def write_labels(df: DataFrame, path: str) -> None:
    """Label lines, partitioned by image: (image, line)."""
    df.select("line", "image").repartition("image").write.partitionBy("image").text(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a list file or a folder of lists: trimmed, without empty lines, with how often each occurs."""
    t = spark.read.option("recursiveFileLookup", "true").text(path).select(F.trim("value").alias("file")).where("file <> ''")
    return t.groupBy("file").agg(F.count("*").alias("n"))


def list_faults(listed: DataFrame, there: DataFrame | None = None, path: str = "path") -> DataFrame:
    """``(fault, file)`` of a list as ``read_list`` gives it: names that occur more than once, and, with a listing of the folder
    (column ``path``), names that no file has."""
    out = listed.where("n > 1").select(F.lit("repeated").alias("fault"), "file")
    if there is not None:
        held = there.select(base_name(F.col(path)).alias("_b")).distinct()
        lost = listed.withColumn("_b", base_name(F.col("file"))).join(held, "_b", "left_anti")
        out = out.unionByName(lost.select(F.lit("missing").alias("fault"), "file"))
    return out


def read_pins(spark: SparkSession, path: str, items: DataFrame, uid: str = "uid") -> tuple[DataFrame, DataFrame]:
    """``items`` with ``pinned`` (the split their file name has in a split file), and one row of counts: rows of the file, pinned
    items, items that it lacks, and rows that no item has. Names that several items share are refused."""
    pins = read_split(spark, path).select(F.col("file").alias("_b"), F.col("split").alias("pinned"))
    if not pins.where(~F.coalesce(F.col("pinned").isin(*SPLITS), F.lit(False))).isEmpty():
        raise InvalidFile(f"{path} has split values other than {', '.join(SPLITS)}")
    named = items.withColumn("_b", base_name(F.col(uid)))
    if not named.groupBy("_b").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise InvalidFile("pins need file names that no two items share")
    pins = pins.groupBy("_b").agg(F.max("pinned").alias("pinned"))
    out = named.join(pins, "_b", "left")
    counts = named.select("_b", F.lit(1).alias("_i")).join(pins, "_b", "full_outer").agg(
        F.count("pinned").alias("csv_rows"), F.count(F.when(F.col("_i").isNotNull() & F.col("pinned").isNotNull(), 1)).alias("pinned_images"),
        F.count_if(F.col("pinned").isNull()).alias("images_not_in_csv"), F.count_if(F.col("_i").isNull()).alias("csv_rows_not_in_source"),
    )
    return out.drop("_b"), counts


def located(folders: DataFrame, wanted: list[str], contains: bool = False, levels: int = 7, path: str = "path") -> DataFrame:
    """Folders (relative paths) at most ``levels`` deep whose own name is, or with ``contains`` holds, one of the wanted names in
    normal form; of those that lie inside each other only the outermost. More than one row means that the name is ambiguous."""
    names = [n for n in {"".join(c for c in w.lower() if c.isalnum()) for w in wanted} if n]
    own = bare(base_name(F.col(path)))
    fits = F.lit(False)
    for n in sorted(names):
        fits = fits | (own.contains(n) if contains else own == n)
    hit = folders.where((F.size(F.split(path, "/")) <= levels) & fits).select(path).distinct()
    return outermost(hit, path)


def outermost(folders: DataFrame, path: str = "path") -> DataFrame:
    """Folders that lie in no other one of the table: every folder looks for its own parents by an equi-join."""
    parts = F.split(path, "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = folders.where(F.size(parts) > 1).select(path, F.explode(parents).alias("_up"))
    inner = up.join(folders.select(F.col(path).alias("_up")), "_up", "left_semi").select(path).distinct()
    return folders.join(inner, path, "left_anti")


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """A training curve; blanks around the column names are removed."""
    df = spark.read.option("header", "true").option("inferSchema", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_report(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame | None:
    """A nested JSON report with an explicit schema, one document a file (or a line, with ``lines``); None where there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON documents; readers see a finished folder or none, as Spark commits it whole."""
    df.write.mode("overwrite").json(path)


def relocated(df: DataFrame, path: str, folder: str) -> DataFrame:
    """Paths moved to another folder, by their last part."""
    return df.withColumn(path, F.concat(F.lit(folder.rstrip("/") + "/"), base_name(F.col(path))))


def missing_files(df: DataFrame, path: str, there: DataFrame) -> DataFrame:
    """Listed files that a listing (column ``path``) does not hold, by their last part."""
    held = there.select(base_name(F.col("path")).alias("_b")).distinct()
    return df.withColumn("_b", base_name(F.col(path))).join(held, "_b", "left_anti").drop("_b")


def class_prefix(lines: DataFrame, keep: int, image: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Label lines of the first ``keep`` classes, counts of the removed ones per class, and every image with the number of lines
    it keeps (0 where it loses them all)."""
    cls = F.split_part(F.trim("line"), F.lit(" "), F.lit(1)).try_cast("double").cast("int")
    marked = lines.withColumn("_c", cls)
    images = marked.groupBy(*(image or ["image"])).agg(F.count_if(F.col("_c") < keep).alias("lines"))
    return marked.where(F.col("_c") < keep).drop("_c"), marked.where(F.col("_c") >= keep).groupBy(F.col("_c").alias("cls")).agg(F.count("*").alias("removed")), images


def guarded_output(spark: SparkSession, path: str, own: tuple[str, ...], inputs: tuple[str, ...] = ()) -> None:
    """Refuse an output folder that lies in an input (or around one), or that holds anything but one's own outputs."""
    p = path.rstrip("/") + "/"
    for i in inputs:
        q = i.rstrip("/") + "/"
        if p.startswith(q) or q.startswith(p):
            raise InvalidFile(f"the output {path} and the input {i} overlap")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        foreign = [s.getPath().getName() for s in fs.listStatus(target) if s.getPath().getName() not in own]
        if foreign:
            raise InvalidFile(f"{path} holds {foreign[0]}, which is not an output of this")
