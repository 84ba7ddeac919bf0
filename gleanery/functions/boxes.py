"""Box geometry as column expressions. Unit boxes are (cx, cy, w, h) in 0..1; pixel boxes are (x, y, w, h)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orientation tags whose axes are swapped, and the tolerance of aspect ratios (fixed values).
SWAPPED = (5, 6, 7, 8)
ASPECT_TOLERANCE = 0.02
MOVED = 1e-6


def corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def centred(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    return (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0


def clipped(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Struct cx, cy, w, h, moved: the part within the unit square, null if there is none."""
    x0, y0, x1, y1 = corners(cx, cy, w, h)
    zero, one = F.lit(0.0), F.lit(1.0)
    a, b, c, d = F.greatest(x0, zero), F.greatest(y0, zero), F.least(x1, one), F.least(y1, one)
    moved = F.greatest(F.abs(a - x0), F.abs(b - y0), F.abs(c - x1), F.abs(d - y1)) > MOVED
    box = centred(a, b, c, d)
    return F.when((c > a) & (d > b), F.struct(*[v.alias(n) for v, n in zip(box, ("cx", "cy", "w", "h"), strict=True)], moved.alias("moved")))


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two corner boxes; 0 where they do not meet."""
    iw = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    ih = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = F.when((iw > 0) & (ih > 0), iw * ih).otherwise(F.lit(0.0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def oriented(x: Column, y: Column, orientation: Column) -> Column:
    """Struct x, y: a unit point after the rotation or mirroring that an orientation tag 1..8 asks for."""
    out = None
    moves = {2: (1 - x, y), 3: (1 - x, 1 - y), 4: (x, 1 - y), 5: (y, x), 6: (1 - y, x), 7: (1 - y, 1 - x), 8: (y, 1 - x)}
    for tag, (p, q) in moves.items():
        point = F.struct(p.alias("x"), q.alias("y"))
        out = F.when(orientation == tag, point) if out is None else out.when(orientation == tag, point)
    return out.otherwise(F.struct(x.alias("x"), y.alias("y")))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def same_aspect(w: Column, h: Column, w2: Column, h2: Column) -> Column:
    return F.abs(w * h2 - h * w2) <= ASPECT_TOLERANCE * F.greatest(w * h2, h * w2)


def frame(rec_w: Column, rec_h: Column, raw_w: Column, raw_h: Column, orientation: Column, box_frame: str = "auto") -> Column:
    """Struct of the frame that recorded sizes are in (``raw``, ``display`` or ``mismatch``) and two warnings: ``assumed`` where the
    sizes cannot tell and the display is taken, and ``rescaled`` where they agree in aspect alone. A given ``box_frame`` decides
    for itself, and is only checked."""
    swap = F.coalesce(orientation.isin(*SWAPPED), F.lit(False))
    dw, dh = F.when(swap, raw_h).otherwise(raw_w), F.when(swap, raw_w).otherwise(raw_h)
    turned = F.coalesce(orientation.between(2, 8), F.lit(False))
    as_display, as_raw = same_aspect(rec_w, rec_h, dw, dh), same_aspect(rec_w, rec_h, raw_w, raw_h)
    if box_frame == "auto":
        chosen, assumed = F.when(turned & as_raw & ~as_display, "raw").otherwise("display"), turned & (as_raw == as_display)
    else:
        chosen, assumed = F.lit(box_frame), F.lit(False)
    ew, eh = F.when(chosen == "raw", raw_w).otherwise(dw), F.when(chosen == "raw", raw_h).otherwise(dh)
    good = F.coalesce((rec_w > 0) & (rec_h > 0) & same_aspect(rec_w, rec_h, ew, eh), F.lit(False))
    return F.struct(
        F.when(good, chosen).otherwise("mismatch").alias("frame"),
        F.coalesce(assumed, F.lit(False)).alias("assumed"),
        (good & ((rec_w != ew) | (rec_h != eh))).alias("rescaled"),
    )


def unit_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, frame: Column | None = None, orientation: Column | None = None) -> Column:
    """A pixel box divided by the image's size, turned with the picture where it stands in the raw frame, and clipped; null for
    invalid boxes or sizes."""
    finite = lambda *v: F.greatest(*[F.abs(c) for c in v]) < F.lit(float("inf"))
    good = (w > 0) & (h > 0) & (width > 0) & (height > 0) & finite(x, y, w, h)
    corner = lambda *v: F.struct(*[c.alias(n) for c, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    box = corner(x / width, y / height, (x + w) / width, (y + h) / height)
    if frame is not None:
        turn = F.coalesce((frame == "raw") & orientation.between(2, 8), F.lit(False))
        ends = lambda c: F.struct(oriented(c["x0"], c["y0"], orientation).alias("p"), oriented(c["x1"], c["y1"], orientation).alias("q"))
        sort = lambda e: corner(*[f(e["p"][n], e["q"][n]) for f, n in ((F.least, "x"), (F.least, "y"), (F.greatest, "x"), (F.greatest, "y"))])
        box = _let(box, lambda c: F.when(turn, _let(ends(c), sort)).otherwise(c))
    return F.when(good, _let(box, lambda c: clipped(*centred(c["x0"], c["y0"], c["x1"], c["y1"]))))


def points_box(points: Column) -> Column:
    """Struct x, y, w, h around an array of [x, y]; null with fewer than two valid points."""
    valid = F.filter(points, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    xs, ys = F.transform(valid, lambda p: F.get(p, F.lit(0))), F.transform(valid, lambda p: F.get(p, F.lit(1)))
    x0, y0 = F.array_min(xs), F.array_min(ys)
    return F.when(F.size(valid) >= 2, F.struct(x0.alias("x"), y0.alias("y"), (F.array_max(xs) - x0).alias("w"), (F.array_max(ys) - y0).alias("h")))


def circle_box(cx: Column, cy: Column, ex: Column, ey: Column) -> Column:
    """Struct x, y, w, h around the circle with this centre through the point (ex, ey)."""
    r = F.hypot(ex - cx, ey - cy)
    return F.struct((cx - r).alias("x"), (cy - r).alias("y"), (2 * r).alias("w"), (2 * r).alias("h"))
