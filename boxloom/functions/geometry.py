"""Box geometry as column expressions: no Python runs per row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(cx: Column, cy: Column, w: Column, h: Column, width=1.0, height=1.0) -> list[Column]:
    """x1, y1, x2, y2 of a centre box, scaled to a width and height."""
    width, height = _col(width), _col(height)
    return [(cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height]


def centre(x1: Column, y1: Column, x2: Column, y2: Column, width=1.0, height=1.0) -> list[Column]:
    """cx, cy, w, h of a corner box, divided by a width and height."""
    width, height = _col(width), _col(height)
    return [(x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height]


def from_coco(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Normalised centre box of a pixel box given by its top left corner and size."""
    return [(x + w / 2) / width, (y + h / 2) / height, w / width, h / height]


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two corner boxes; 0 when the union is not positive."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def ciou_loss(p: list[Column], t: list[Column], size: float) -> Column:
    """Complete-IoU loss of two pixel centre boxes, corners clipped to the image, within [0, 4]."""
    eps, clip = 1e-7, lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(size)))
    a, b = [clip(c) for c in corners(*p)], [clip(c) for c in corners(*t)]
    zero, small = F.lit(0.0), F.lit(1e-6)
    inter = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter + eps
    over = inter / union
    diagonal = F.pow(F.greatest(a[2], b[2]) - F.least(a[0], b[0]), 2) + F.pow(F.greatest(a[3], b[3]) - F.least(a[1], b[1]), 2) + eps
    apart = F.pow(p[0] - t[0], 2) + F.pow(p[1] - t[1], 2)
    shape = lambda b_: F.atan(F.greatest(b_[2], small) / F.greatest(b_[3], small))
    v = F.lit(4.0 / math.pi**2) * F.pow(shape(t) - shape(p), 2)
    return F.least(F.greatest(1 - (over - apart / diagonal - v / (1 - over + v + eps) * v), zero), F.lit(4.0))


def encode(anchor: list[Column], box: list[Column]) -> list[Column]:
    """Offsets of a box from an anchor: shift in anchor sizes, logarithm of the size ratio; sizes at least 1e-6."""
    s = F.lit(1e-6)
    aw, ah = F.greatest(anchor[2], s), F.greatest(anchor[3], s)
    return [(box[0] - anchor[0]) / aw, (box[1] - anchor[1]) / ah, F.ln(F.greatest(box[2], s) / aw), F.ln(F.greatest(box[3], s) / ah)]


def decode(anchor: list[Column], off: list[Column]) -> list[Column]:
    """Box of offsets from an anchor; the logarithms are held within [-8, 8]."""
    held = lambda c: F.least(F.greatest(c, F.lit(-8.0)), F.lit(8.0))
    return [off[0] * anchor[2] + anchor[0], off[1] * anchor[3] + anchor[1], F.exp(held(off[2])) * anchor[2], F.exp(held(off[3])) * anchor[3]]


def flipped(position: Column, size=1.0) -> Column:
    """A centre coordinate after a flip along its axis."""
    return _col(size) - position


def turn(degrees: Column) -> list[Column]:
    """cos and sin of an angle."""
    return [F.cos(F.radians(degrees)).alias("cos"), F.sin(F.radians(degrees)).alias("sin")]


def rotated(cx: Column, cy: Column, w: Column, h: Column, degrees: Column, width: Column, height: Column, turned=None) -> list[Column]:
    """The box around a normalised box turned about the image centre, clipped to the image: cx, cy, w, h. turned: `turn` of the angle, if at hand.

    Its ends are those of the four turned corners, to the bit: rounding keeps the order of sums, so an end is the sum of the ends of
    both terms. Half extents around the turned centre round otherwise, and whether a box that only touches the border stays hangs on that.
    """
    cos, sin = turned or turn(degrees)
    xs = [(x * width) - width / 2 for x in (cx - w / 2, cx + w / 2)]
    ys = [(y * height) - height / 2 for y in (cy - h / 2, cy + h / 2)]
    clip = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), top.cast("double"))
    x1, x2 = (clip(end(*(cos * x for x in xs)) + end(*(sin * y for y in ys)) + width / 2, width) for end in (F.least, F.greatest))
    y1, y2 = (clip(end(*(-sin * x for x in xs)) + end(*(cos * y for y in ys)) + height / 2, height) for end in (F.least, F.greatest))
    return centre(x1, y1, x2, y2, width, height)


def rescaled(box: list[Column], size: float, width: Column, height: Column) -> list[Column]:
    """A corner box found at size x size, in the pixels of the original image."""
    return [box[0] * width / size, box[1] * height / size, box[2] * width / size, box[3] * height / size]


def valid_box(cx="cx", cy="cy", w="w", h="h") -> Column:
    """Centre in [0, 1], size in (0, 1]."""
    return F.col(cx).between(0, 1) & F.col(cy).between(0, 1) & (F.col(w) > 0) & (F.col(w) <= 1) & (F.col(h) > 0) & (F.col(h) <= 1)


def size_bucket(area_percent: Column) -> Column:
    """tiny, small, medium, large at 2, 5 and 15 percent of the image."""
    return F.when(area_percent < 2, "tiny").when(area_percent < 5, "small").when(area_percent < 15, "medium").otherwise("large")


def mosaic(box: list[Column], quadrant: Column, cx: Column, cy: Column, width: Column, height: Column, size: float) -> list[Column]:
    """x1, y1, x2, y2 of an image's pixel corner box in a mosaic of four around (cx, cy): quadrants 0 to 3 are top left, top right, bottom left, bottom right.

    The image's corner nearest the centre lies on it; the box is shifted and clipped to what shows of the image.
    """

    def side(lo, hi, before, at, length):
        edge, shift = F.lit(float(size)), F.when(before, at - length).otherwise(at)
        start = F.when(before, F.greatest(at - length, F.lit(0))).otherwise(at)
        end = F.when(before, at).otherwise(F.least(at + length, edge))
        return F.greatest(lo + shift, start), F.least(hi + shift, end)

    x1, x2 = side(box[0], box[2], quadrant % 2 == 0, cx, width)
    y1, y2 = side(box[1], box[3], quadrant < 2, cy, height)
    return [x1, y1, x2, y2]


def mosaic_keeps(box: list[Column]) -> Column:
    """Both sides of a mosaic's box are over two pixels."""
    return (box[2] - box[0] > 2) & (box[3] - box[1] > 2)


def occluder_try(key: Column, width: Column, height: Column, n: Column) -> Column:
    """array<struct<n,x1,y1,w,h>> of one: a rectangle of a twelfth to a fifth of the image (at least 18 to 24 pixels), drawn from a hash of key and try n."""

    # each step sees what the one before has worked out, so a try costs one digest
    draw = lambda d, at, lo, hi: (lo + F.conv(F.substring(d, at, 7), 16, 10).cast("bigint") % (hi - lo + 1)).cast("bigint")
    reach = lambda x: (F.greatest(F.lit(18), F.floor(x / 12)), F.greatest(F.lit(24), F.floor(x / 5)))
    drawn = F.array(F.struct(n.alias("n"), F.md5(F.concat_ws("|", F.lit("occluder"), key.cast("string"), n.cast("string"))).alias("d")))
    sized = F.transform(drawn, lambda t: F.struct(t["n"].alias("n"), t["d"].alias("d"), draw(t["d"], 1, *reach(width)).alias("w"), draw(t["d"], 8, *reach(height)).alias("h")))
    place = lambda t, at, whole, side: draw(t["d"], at, F.lit(0), F.greatest(F.lit(0), whole - t[side]))
    return F.transform(sized, lambda t: F.struct(t["n"].alias("n"), place(t, 15, width, "w").alias("x1"), place(t, 22, height, "h").alias("y1"), t["w"].alias("w"), t["h"].alias("h")))


def occluder(key: Column, boxes: Column, width: Column, height: Column, tries: int = 15) -> Column:
    """An array of the first try that holds no box's centre while its area is over 0.6 of that box; empty if there is none. boxes: array<struct<cx,cy,w,h>>.

    Tries after the first that fits are not worked out. Explode it: fields taken from a struct in it would each work it out anew.
    """

    def covers(t, b):
        x, y, area = F.floor(b["cx"] * width), F.floor(b["cy"] * height), F.floor(b["w"] * width) * F.floor(b["h"] * height)
        return x.between(t["x1"], t["x1"] + t["w"]) & y.between(t["y1"], t["y1"] + t["h"]) & (t["w"] * t["h"] > F.greatest(F.lit(1), area) * 0.6)

    fits = lambda n: F.filter(occluder_try(key, width, height, n), lambda t: ~F.exists(boxes, lambda b: covers(t, b)))
    none = F.expr("cast(array() as array<struct<n:int,x1:bigint,y1:bigint,w:bigint,h:bigint>>)")
    return F.aggregate(F.sequence(F.lit(1), F.lit(tries)), none, lambda found, n: F.when(F.size(found) > 0, found).otherwise(fits(n)))
