"""Average precision, its paired bootstrap, confidence intervals and comparisons of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators import allocate, curves
from gleanery.operators.ranged import BROADCAST, ranged, running_sums
from gleanery.session import stage

#: Ten overlap thresholds and the guard of the recall (fixed values).
THRESHOLDS = tuple(round(0.5 + 0.05 * j, 2) for j in range(10))
EPS = 1e-16
EVERY = list(range(len(THRESHOLDS)))
#: Most images whose weights one worker of the vectorised bootstrap holds.
MOST_HELD = 5_000_000


def explode_thresholds(predictions: DataFrame, tp: Column, keep: list[str]) -> DataFrame:
    """One row per prediction and threshold: ``tp`` is an array of flags."""
    return predictions.select(*keep, F.posexplode(tp).alias("j", "hit")).withColumn("hit", F.col("hit").cast("int"))


def curve_points(hits: DataFrame, labels: DataFrame, by: list[str], cls: str = "cls", conf: str = "conf", node: str = "id", weight: str | None = None) -> DataFrame:
    """``(by..., cls, j, r, p)``: the recall-precision points of each curve, in order ``i``.

    A hit drawn w times has two points, of its first and of its last copy; a miss has one.
    """
    keys = [*by, cls, "j"]
    w = F.col(weight) if weight else F.lit(1)
    order = Window.partitionBy(*keys).orderBy(F.desc(conf), node).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hits.select(*keys, conf, node, "hit", w.alias("_w"), F.sum(F.col("hit") * w).over(order).alias("tpc"), F.sum(w).over(order).alias("all"))
    run = run.join(labels, [*[c for c in by if c in labels.columns], cls])
    last = F.struct(F.lit(1).alias("c"), F.col("tpc").alias("t"), F.col("all").alias("a"))
    first = F.struct(F.lit(0).alias("c"), (F.col("tpc") - F.col("_w") + 1).alias("t"), (F.col("all") - F.col("_w") + 1).alias("a"))
    both = F.when((F.col("hit") == 1) & (F.col("_w") > 1), F.array(first, last)).otherwise(F.array(last))
    pts = run.select(*keys, conf, node, "n", F.explode(both).alias("q"))
    return pts.select(*keys, conf, node, F.col("q.c").alias("c"), (F.col("q.t") / (F.col("n") + EPS)).alias("r"), (F.col("q.t") / F.col("q.a")).alias("p"))


def average_precision(
    predictions: DataFrame, labels: DataFrame, by: list[str] | None = None, cls: str = "cls", conf: str = "conf", node: str = "id", tp: str = "tp", weight: str | None = None
) -> DataFrame:
    """``(by..., cls, j, ap)`` of every class with labels; a class without predictions has 0, one without labels none.

    ``tp`` holds one flag per threshold. The curve runs from (0, 1) over the points to (last recall, 0) and (1, 0); its precision
    is made falling by a running maximum from the right, read at 101 recalls k * 0.01 and integrated by trapezoids. A hit drawn w
    times has two points, of its first and of its last copy; the last is never worse, nor is the one before a hit ever better. So
    precision at a recall is the largest of all hits' last copies beyond it, and each hit only counts for the last recall it passes.

    Predictions are spread by ranges of confidence, so that the number of tasks grows with the rows and not with the classes.
    All thresholds are summed in one pass; from there on at most 101 rows of each curve go further.
    """
    by = by or []
    keys, order = [*by, cls], [F.desc(conf), F.asc(node)]
    known = [*[c for c in by if c in labels.columns], cls]
    steps = range(len(THRESHOLDS))
    w = (F.col(weight) if weight else F.lit(1)).cast("long")
    labels = stage(labels.where("n > 0").select(*known, "n"), "labels", False)
    bits = sum((F.when(F.get(tp, F.lit(j)) == 1, 1 << j).otherwise(0) for j in steps), F.lit(0))
    rows = ranged(predictions.select(*keys, conf, node, bits.alias("_bits"), w.alias("_w")), keys, order, "curves", True)
    hit = lambda j: F.shiftright("_bits", j).bitwiseAND(1)
    run = running_sums(rows, keys, order, {"_all": F.col("_w"), **{f"_t{j}": hit(j) * F.col("_w") for j in steps}})
    flags = F.array(*[F.when(hit(j) == 1, F.struct(F.lit(j).alias("j"), F.col(f"_t{j}").alias("t"))) for j in steps])
    hits = run.where("_bits > 0 and _w > 0").join(F.broadcast(labels) if labels.count() <= BROADCAST else labels, known)
    keys = [*keys, "j"]
    hits = hits.select(*known, *[c for c in by if c not in known], "_all", "n", F.inline(F.array_compact(flags)))
    # the last recall k * 0.01 below t / n
    x = F.col("t") / (F.col("n") + EPS)
    about = F.floor(x / 0.01).cast("int")
    below = lambda k: k.cast("double") * F.lit(0.01) < F.col("x")
    hits = hits.select(*keys, x.alias("x"), about.alias("about"), (F.col("t") / F.col("_all")).alias("p"))
    k = F.when(below(F.col("about") + 1), F.col("about") + 1).when(below(F.col("about")), F.col("about")).otherwise(F.col("about") - 1)
    best = hits.groupBy(*keys, F.least(k, F.lit(100)).alias("k")).agg(F.max("p").alias("p"))
    falling = Window.partitionBy(*keys).orderBy(F.desc("k"))
    steps_down = best.select(*keys, "k", F.max("p").over(falling).alias("y"), F.lead("k", 1, -1).over(falling).alias("k0"))
    # trapezoids: the ends count half
    times = F.col("k") - F.col("k0") - F.when(F.col("k0") < 0, 0.5).otherwise(0.0) - F.when(F.col("k") == 100, 0.5).otherwise(0.0)
    area = steps_down.groupBy(*keys).agg((F.sum(F.col("y") * times) * 0.01).alias("ap"))
    base = labels.select(*known)
    if more := [c for c in by if c not in labels.columns]:
        base = base.join(predictions.select(*more).distinct(), how="cross")  # class names x models
    full = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS) - 1))).alias("j"))
    return full.join(area, keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_ap(ap: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``map50`` and ``map50_95`` over the classes with labels."""
    return ap.groupBy(*(by or [])).agg(F.avg(F.when(F.col("j") == 0, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))


def percentile_interval(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.array(F.lit(a), F.lit(1 - a))).alias("_q")).select(
        *by, "mean", F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high")
    )


def pairwise_differences(samples: DataFrame, models: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Per pair of models in the given order: mean difference, interval, share of replicates above 0, and whether 0 is outside."""
    pos = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    s = samples.select("replicate", "model", F.col(value).alias("v"), pos.alias("pos"))
    a, b = s.select("replicate", F.col("model").alias("a"), F.col("v").alias("va"), F.col("pos").alias("pa")), s.select("replicate", F.col("model").alias("b"), F.col("v").alias("vb"), F.col("pos").alias("pb"))
    d = a.join(b, "replicate").where("pa < pb").select("a", "b", (F.col("vb") - F.col("va")).alias("d"))
    al = (1 - level) / 2
    out = d.groupBy("a", "b").agg(F.avg("d").alias("mean_diff"), F.percentile("d", F.array(F.lit(al), F.lit(1 - al))).alias("q"), F.avg((F.col("d") > 0).cast("int")).alias("p_above"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return out.select("a", "b", "mean_diff", low.alias("low"), high.alias("high"), "p_above", ((low > 0) | (high < 0)).alias("significant"))


def verdict(row_a: Column, row_b: Column, diff: Column, low: Column, high: Column) -> Column:
    """A sentence on two models."""
    better, worse = F.when(diff >= 0, row_b).otherwise(row_a), F.when(diff >= 0, row_a).otherwise(row_b)
    span = F.format_string("95%% CI %+.3f to %+.3f", low, high)
    return F.when((low > 0) | (high < 0), F.concat(better, F.lit(" beats "), worse, F.lit(" ("), span, F.lit(")"))).otherwise(
        F.concat(F.lit("no significant difference between "), row_a, F.lit(" and "), row_b, F.lit(" ("), span, F.lit(")"))
    )


def resampled(predictions: DataFrame, targets: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """``(replicate, model, map50, map50_95)`` by weighted curves: every draw is a table, and nothing is held anywhere."""
    nodes = predictions.select("image").union(targets.select("image")).distinct()
    w = allocate.resample(nodes, "image", replicates, seed)
    labels = targets.join(w, "image").groupBy("replicate", "cls").agg(F.sum("w").alias("n"))
    ap = average_precision(predictions.join(w, "image"), labels, ["replicate", "model"], weight="w")
    return mean_ap(ap, ["replicate", "model"])


def whole_score(predictions: DataFrame, targets: DataFrame, at_once: int = 16 * curves.ROWS) -> DataFrame:
    """``(model, map50, map50_95)`` of all rows with an image as they are, by the vectorised form at any size: every row weighs the
    same, so that no image is numbered and no weight held; ``at_once`` rows are summed together."""
    return _means(curves.curve_areas(predictions, targets, None, 1, 1, None, EVERY, at_once)).drop("replicate")


def bootstrap(predictions: DataFrame, targets: DataFrame, replicates: int, seed: int = 0, most_held: int = MOST_HELD, means: tuple[str, ...] = ("map50", "map50_95")) -> DataFrame:
    """``(replicate, model, map50, map50_95)``: all models over the same draws of images; ``means`` names those that are wanted.

    predictions: model, image, id, cls, conf, tp ARRAY<INT>; targets: image, cls. Rows are sorted once and streamed by every worker,
    which holds the weights of its replicates; beyond ``most_held`` images the same values come from weighted curves (``resampled``).
    """
    known, n = curves.image_numbers(predictions, targets)
    if n > most_held:
        return resampled(predictions, targets, replicates, seed).select("replicate", "model", *means)
    areas = curves.curve_areas(predictions, targets, known, n, replicates, seed, EVERY if "map50_95" in means else EVERY[:1])
    return stage(_means(areas, means), "samples")  # which are few, and read more than once


def _means(areas: DataFrame, means: tuple[str, ...] = ("map50", "map50_95")) -> DataFrame:
    """``(replicate, model, means...)`` over the classes that a replicate has labels of; 0 without any."""
    each = {"map50": F.get("areas", F.lit(0)), "map50_95": F.aggregate("areas", F.lit(0.0), lambda x, y: x + y) / F.size("areas")}
    return areas.groupBy("replicate", "model").agg(*[F.coalesce(F.avg(each[m]), F.lit(0.0)).alias(m) for m in means])
