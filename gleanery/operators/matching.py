"""Greedy one-to-one matching of predicted with true boxes, and verdicts per image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IOU = 0.5
BOX = ["x0", "y0", "x1", "y1"]


def overlaps(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(predictions, targets) intersection over union."""
    low, high = np.maximum(p[:, None, :2], t[None, :, :2]), np.minimum(p[:, None, 2:], t[None, :, 2:])
    side = np.clip(high - low, 0, None)
    inter = side[..., 0] * side[..., 1]
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(p)[:, None] + area(t)[None, :] - inter
    return np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1), 0.0)


def matched(p_cls: np.ndarray, p_conf: np.ndarray, p_box: np.ndarray, t_cls: np.ndarray, t_box: np.ndarray, same_class: bool = True, least: float = IOU) -> int:
    """True positives: predictions by confidence (ties in their order) each take the free target with the largest overlap
    (the first of equal ones), if that is at least ``least``."""
    if not len(p_cls) or not len(t_cls):
        return 0
    iou = overlaps(p_box, t_box)
    if same_class:
        iou = np.where(p_cls[:, None] == t_cls[None, :], iou, -1.0)
    free = np.ones(len(t_cls), bool)
    hits = 0
    for i in np.argsort(-p_conf, kind="stable"):
        v = np.where(free, iou[i], -1.0)
        j = int(v.argmax())
        if v[j] >= least:
            free[j] = False
            hits += 1
    return hits


def image_verdicts(predictions: DataFrame, targets: DataFrame, image: str = "image") -> DataFrame:
    """Per image: numbers of targets and predictions, TP, FP, FN, TP with classes ignored, whether all is right, and F1.

    predictions: image, ord, cls, conf, x0..y1; targets: image, ord, cls, x0..y1. Rows of an
    image are brought together and sorted; a worker holds one image at a time.
    """

    cols = [image, "ord", "cls", "conf", *BOX]
    p = predictions.select(*cols, F.lit(1).alias("side"))
    t = targets.withColumn("conf", F.lit(0.0)).select(*cols, F.lit(0).alias("side"))
    rows = p.unionByName(t).repartition(image).sortWithinPartitions(image, "side", "ord")

    kind = dict(targets.dtypes)[image]
    schema = f"{image} {kind}, n_gt long, n_pred long, tp long, fp long, fn long, tp_any_class long, fully_correct boolean, f1 double"
    return rows.mapInPandas(by_image(image, _verdicts), schema)


def by_image(image: str, work: Callable[[pd.DataFrame, str], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``work`` over whole images of sorted rows; the last image of a batch waits for the next one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            last = part[image].iloc[-1] if len(part) else None
            open_from = int(np.searchsorted((part[image] == last).to_numpy(), True)) if len(part) else 0
            rest = part.iloc[open_from:]
            yield work(part.iloc[:open_from], image)
        if rest is not None and len(rest):
            yield work(rest, image)

    return run


def non_maximum(predictions: DataFrame, least: float = 0.25, iou: float = 0.7, most: int = 300, classes: list | None = None, agnostic: bool = False, image: str = "image") -> DataFrame:
    """``(image, ord)`` of the predictions that stay: of those of the listed classes with at least ``least`` confidence, by falling
    confidence (ties by ord), each that overlaps none kept before by more than ``iou`` (of its own class, unless ``agnostic``), at
    most ``most`` an image. Predictions without an image are left out."""
    p = predictions.where(F.col(image).isNotNull() & (F.col("conf") >= least))
    p = p.where(F.col("cls").isin(*classes)) if classes is not None else p
    rows = p.select(image, "ord", "cls", (-F.col("conf")).alias("back"), *BOX).repartition(image).sortWithinPartitions(image, "back", "ord")

    def work(rows: pd.DataFrame, image: str) -> pd.DataFrame:
        kept: list[int] = []
        names, cls, box = rows[image].to_numpy(), rows["cls"].to_numpy(), rows[BOX].to_numpy(float)
        cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]) if len(names) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            over = overlaps(box[a:b], box[a:b]) > iou
            over &= agnostic | (cls[a:b, None] == cls[None, a:b])
            free, n = np.ones(b - a, bool), 0
            for i in range(b - a):
                if free[i] and n < most:
                    kept.append(a + i)
                    n += 1
                    free &= ~over[i]
        return rows.iloc[kept][[image, "ord"]]

    kinds = dict(predictions.dtypes)
    return rows.mapInPandas(by_image(image, work), f"{image} {kinds[image]}, ord {kinds['ord']}")


def _verdicts(rows: pd.DataFrame, image: str) -> pd.DataFrame:
    """Verdicts of whole images; their rows stand together, targets first."""
    out = []
    if len(rows):
        names = rows[image].to_numpy()
        side, cls, conf, box = rows["side"].to_numpy(), rows["cls"].to_numpy(), rows["conf"].to_numpy(float), rows[BOX].to_numpy(float)
        cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = a + int((side[a:b] == 0).sum())
            args = (cls[m:b], conf[m:b], box[m:b], cls[a:m], box[a:m])
            tp, any_class = matched(*args), matched(*args, same_class=False)
            n_gt, n_pred = m - a, b - m
            fp, fn = n_pred - tp, n_gt - tp
            den = 2 * tp + fp + fn
            out.append((names[a], n_gt, n_pred, tp, fp, fn, any_class, n_gt >= 1 and tp == n_gt and fp == 0, 2 * tp / den if den else None))
    return pd.DataFrame(out, columns=[image, "n_gt", "n_pred", "tp", "fp", "fn", "tp_any_class", "fully_correct", "f1"])


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg("f1"), 6).alias("mean_f1"),
        F.round(F.avg(F.col("fully_correct").cast("int")), 6).alias("fully_correct_share"), F.count("*").alias("images"),
    )


def by_objects(verdicts: DataFrame) -> DataFrame:
    """Fully correct images per number of objects: 1, 2, 3 or more."""
    bucket = F.when(F.col("n_gt") == 1, "1").when(F.col("n_gt") == 2, "2").when(F.col("n_gt") >= 3, ">=3")
    return verdicts.where("n_gt >= 1").groupBy(bucket.alias("objects")).agg(F.count("*").alias("images"), F.sum(F.col("fully_correct").cast("int")).alias("fully_correct"))


def agreement(verdicts: DataFrame, models: list[str], image: str = "image", model: str = "model") -> DataFrame:
    """One row: images, and on how many of them all models, at least two, and none are fully correct."""
    right = verdicts.groupBy(image).agg(F.sum(F.col("fully_correct").cast("int")).alias("k"))
    return right.agg(
        F.count("*").alias("images"), F.count_if(F.col("k") == len(models)).alias("all_models"), F.count_if(F.col("k") >= 2).alias("at_least_two"), F.count_if(F.col("k") == 0).alias("none")
    )


def by_objects_and_model(verdicts: DataFrame, models: list[str], model: str = "model") -> DataFrame:
    """Fully correct images per number of objects, one column a model, beside the images of the first one."""
    bucket = F.when(F.col("n_gt") == 1, "1").when(F.col("n_gt") == 2, "2").when(F.col("n_gt") >= 3, ">=3")
    of = lambda m: F.count_if((F.col(model) == m) & F.col("fully_correct")).alias(f"correct_{m}")
    return verdicts.where("n_gt >= 1").groupBy(bucket.alias("objects")).agg(F.count_if(F.col(model) == models[0]).alias("images"), *[of(m) for m in models])
