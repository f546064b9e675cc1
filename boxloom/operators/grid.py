"""Anchors met by arithmetic: a box names the ranges of grid cells it can meet, so boxes never meet the anchor table."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import encode


@dataclass(frozen=True)
class Grid:
    """Image size, cells along a side, anchor scale and aspect ratios by scale; ids go by scale, row, column, ratio."""

    size: float = 416.0
    cells: tuple = (208, 104, 52, 26, 13)
    scales: tuple = (32, 64, 128, 200, 300)
    ratios: tuple = (0.5, 1.0, 2.0)

    @property
    def count(self) -> int:
        return sum(n * n for n in self.cells) * len(self.ratios)

    def table(self) -> list[tuple]:
        """For each scale and ratio: cells, stride, id of its anchor in the first cell, ratios, width and height."""
        out, offset = [], 0
        for n, s in zip(self.cells, self.scales, strict=True):
            out += [(n, self.size / n, offset + k, len(self.ratios), float(s) * math.sqrt(r), float(s) * (1 / math.sqrt(r))) for k, r in enumerate(self.ratios)]
            offset += n * n * len(self.ratios)
        return out

    def shapes(self) -> Column:
        """The table as an array of structs."""
        return F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(("n", "stride", "first", "ratios", "aw", "ah"), row, strict=True))) for row in self.table()))


#: Cells added to a range before the exact test, against rounding.
SLACK = 1e-6


def _shaped(boxes: DataFrame, grid: Grid) -> DataFrame:
    return boxes.withColumn("_s", F.explode(grid.shapes())).select(*boxes.columns, "_s.*")


def _cells(shaped: DataFrame, columns: list[str], grid: Grid, reach_x: Column, reach_y: Column) -> DataFrame:
    """Each row with the anchors of its shape whose centres lie within reach of the box centre."""

    def ends(c, reach):
        at = F.col(c) / F.col("stride") - 0.5
        wide = reach / F.col("stride") + SLACK
        return F.greatest(F.ceil(at - wide), F.lit(0)).cast("int"), F.least(F.floor(at + wide), F.col("n") - 1).cast("int")

    (x0, x1), (y0, y1) = ends("bx", reach_x), ends("by", reach_y)
    held = shaped.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1}).where("_x0 <= _x1 and _y0 <= _y1")
    held = held.withColumn("_y", F.explode(F.sequence("_y0", "_y1"))).withColumn("_x", F.explode(F.sequence("_x0", "_x1")))
    anchor = F.col("first") + (F.col("_y") * F.col("n") + F.col("_x")) * len(grid.ratios)
    return held.select(*columns, anchor.alias("anchor_id"), ((F.col("_x") + 0.5) * F.col("stride")).alias("ax"), ((F.col("_y") + 0.5) * F.col("stride")).alias("ay"), "aw", "ah")


def _anchor() -> list[Column]:
    return [F.col(c) for c in ("ax", "ay", "aw", "ah")]


def _box() -> list[Column]:
    return [F.col(c) for c in ("bx", "by", "bw", "bh")]


def anchors_around(boxes: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """boxes with every anchor that holds the box centre: |bx - ax| <= aw / 2 and |by - ay| <= ah / 2."""
    met = _cells(_shaped(boxes, grid), boxes.columns, grid, F.col("aw") / 2, F.col("ah") / 2)
    return met.where((F.abs(F.col("bx") - F.col("ax")) <= F.col("aw") / 2) & (F.abs(F.col("by") - F.col("ay")) <= F.col("ah") / 2))


def _cells_met(box, shape: tuple, reach_x, reach_y):
    """(row, anchor_id, iou) of the anchors of one shape whose centres lie within reach of the boxes' (NumPy arrays bx, by, bw, bh)."""
    n, stride, first, ratios, aw, ah = shape
    sides, spans = [], []
    for c, reach in ((box[0], reach_x), (box[1], reach_y)):
        at, wide = c / stride - 0.5, reach / stride + SLACK
        low, high = np.maximum(np.ceil(at - wide), 0), np.minimum(np.floor(at + wide), n - 1)
        spans.append((low.astype(np.int64), np.maximum(high - low + 1, 0).astype(np.int64)))
    (x0, nx), (y0, ny) = spans
    many = nx * ny
    row = np.repeat(np.arange(len(many)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    x, y = x0[row] + k % nx[row], y0[row] + k // nx[row]
    for c, b, cell, a in ((box[0], box[2], x, aw), (box[1], box[3], y, ah)):
        centre = (cell + 0.5) * stride
        low, high, b1, b2 = centre - a / 2, centre + a / 2, (c - b / 2)[row], (c + b / 2)[row]
        sides.append((np.maximum(np.minimum(high, b2) - np.maximum(low, b1), 0.0), high - low, b2 - b1))
    both = sides[0][0] * sides[1][0]
    whole = sides[0][1] * sides[1][1] + sides[0][2] * sides[1][2] - both
    return row, first + (y * n + x) * ratios, np.divide(both, whole, out=np.zeros(len(both)), where=whole > 0)


def _overlaps(box, shape: tuple, least: float):
    """The anchors of one shape with an IoU of at least `least`.

    They share I0 = least * (A + B) / (1 + least) of area with the box at least, and what they share is no higher than the lower of
    both; so it has a least width, and the centres a greatest distance.
    """
    aw, ah = shape[4], shape[5]
    shared = least / (1 + least) * (aw * ah + box[2] * box[3])
    narrow, low = np.minimum(aw, box[2]), np.minimum(ah, box[3])
    fit = np.flatnonzero((narrow * low >= shared * (1 - 1e-9)) & (shared > 0))
    part, shared = [c[fit] for c in box], shared[fit]
    row, anchor, over = _cells_met(part, shape, (aw + part[2]) / 2 - shared / low[fit], (ah + part[3]) / 2 - shared / narrow[fit])
    held = over >= least
    return fit[row[held]], anchor[held], over[held]


def _best(box, shapes: list[tuple]):
    """(anchor_id, iou) of the best anchor of every box, the smallest id of equal ones.

    For one shape the shared width and height fall with the distance of the centres, so its best cell is the nearest one. Only shapes
    that reach the best of these are looked at, and of them the cells whose shared sides are no smaller than the nearest cell's.
    """
    sides, tops = [], []
    for n, stride, _, _, aw, ah in shapes:
        own = []
        for c, b, a in ((box[0], box[2], aw), (box[1], box[3], ah)):
            cell = np.clip(np.floor(c / stride), 0, n - 1)
            own.append(np.maximum(np.minimum(np.minimum(a, b), (a + b) / 2 - np.abs(c - (cell + 0.5) * stride)), 0.0))
        both = own[0] * own[1]
        whole = aw * ah + box[2] * box[3] - both
        sides.append(own)
        tops.append(np.divide(both, whole, out=np.zeros(len(both)), where=whole > 0))
    most = np.max(tops, axis=0)
    best, over = np.zeros(len(most), np.int64), np.zeros(len(most))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for shape, own, top in zip(shapes, sides, tops, strict=True):
        near = np.flatnonzero((top > 0) & (top >= most * (1 - 1e-9)))
        part = [c[near] for c in box]
        row, anchor, iou_ = _cells_met(part, shape, (shape[4] + part[2]) / 2 - own[0][near] * (1 - 1e-9), (shape[5] + part[3]) / 2 - own[1][near] * (1 - 1e-9))
        found.append((near[row], anchor, iou_))
    row, anchor, iou_ = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((anchor, -iou_, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    best[row[first]], over[row[first]] = anchor[first], iou_[first]
    return best, over


def _first(image, anchor, over, row, forced):
    """Each anchor of an image once: with its highest IoU, the first row of equal ones, and whether any is forced."""
    order = np.lexsort((row, -over, anchor, image))
    image, anchor, over, row, forced = (x[order] for x in (image, anchor, over, row, forced))
    first = np.flatnonzero((np.diff(image, prepend=-1) != 0) | (np.diff(anchor, prepend=-1) != 0))
    any_forced = np.logical_or.reduceat(forced, first) if len(first) else forced[:0]
    return image[first], anchor[first], over[first], row[first], any_forced


def _placed(anchor, shapes: list[tuple], ratios: int):
    """Centres and sides (ax, ay, aw, ah) of anchors by id."""
    first = np.array([s[2] for s in shapes[::ratios]])
    scale = np.searchsorted(first, anchor, "right") - 1
    at, k = (anchor - first[scale]) // ratios, (anchor - first[scale]) % ratios
    n, stride, aw, ah = (np.array([s[c] for s in shapes])[scale * ratios + k] for c in (0, 1, 4, 5))
    return (at % n + 0.5) * stride, (at // n + 0.5) * stride, aw, ah


def _shared(a, b):
    """IoU of anchors and boxes, arrays of equal length."""
    both, one, other = 1.0, 1.0, 1.0
    for k in (0, 1):
        low, high, b1, b2 = a[k] - a[k + 2] / 2, a[k] + a[k + 2] / 2, b[k] - b[k + 2] / 2, b[k] + b[k + 2] / 2
        both, one, other = both * np.maximum(np.minimum(high, b2) - np.maximum(low, b1), 0.0), one * (high - low), other * (b2 - b1)
    whole = one + other - both
    return np.divide(both, whole, out=np.zeros(len(both)), where=whole > 0)


def _judged(image, starts, sizes, box, shapes, ratios: int, pos: float, neg: float, lot: int):
    """(anchor_id, row, forced, iou) of the anchors that are forced or reach `neg` in whole images; rows of an image are together, in the order of its ties."""
    least, held = min(pos, neg), [np.empty(0, d) for d in (np.int64, np.int64, float, np.int64, bool)]
    for at in range(0, len(image), lot):
        part = [c[at : at + lot] for c in box]
        best, over = _best(part, shapes)
        found = [_overlaps(part, s, least) for s in shapes] + [(np.arange(len(best)), best, over)]
        row, anchor, iou_ = (np.concatenate(x) for x in zip(*found, strict=True))
        new = image[row + at], anchor, iou_, row + at, np.arange(len(row)) >= len(row) - len(best)
        held = _first(*(np.concatenate(x) for x in zip(held, new, strict=True)))
    own, anchor, over, row, forced = held
    # forced anchors that share less than that with every box are not among the overlaps, so they are held against every box of the image
    low = np.flatnonzero(over < least)
    pieces = np.cumsum(sizes[own[low]]) // 1_000_000
    for some in np.split(low, np.flatnonzero(np.diff(pieces)) + 1) if len(low) else []:
        many = sizes[own[some]]
        at = np.repeat(some, many)
        rows = np.arange(len(at)) + np.repeat(starts[own[some]] - np.cumsum(many) + many, many)
        _, _, over[some], row[some], _ = _first(own[at], anchor[at], _shared(_placed(anchor[at], shapes, ratios), [c[rows] for c in box]), rows, forced[at])
    keep = forced | (over >= neg)
    return anchor[keep], row[keep], forced[keep], over[keep]


def _told(grid: Grid, pos: float, neg: float):
    """Lists of boxes by image -> (image_id, anchor_id, forced, iou, box_id, class_id, bx, by, bw, bh, ax, ay, aw, ah), some whole images at a time."""
    shapes, ratios = grid.table(), len(grid.ratios)
    lot = 2_000 if grid.count > 10_000 else 20_000  # boxes looked at together, by how many anchors one can meet

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            lots = np.flatnonzero(np.diff(np.cumsum(sizes) // lot, prepend=-1))
            for at, end in zip(lots.tolist(), [*lots[1:].tolist(), len(sizes)], strict=True):
                some, many = batch.slice(at, end - at), sizes[at:end].astype(np.int64)
                p = some.column(1).flatten()
                box = [p.field(c).to_numpy().astype(float) for c in ("bx", "by", "bw", "bh")]
                image = np.repeat(np.arange(len(many)), many)
                anchor, row, forced, over = _judged(image, np.cumsum(many) - many, many, box, shapes, ratios, pos, neg, lot)
                rows = pa.array(row)
                sides = [pa.array(x.astype(float)) for x in (*(c[row] for c in box), *_placed(anchor, shapes, ratios))]
                cells = [some.column(0).take(pa.array(image[row])), pa.array(anchor.astype(np.int32)), pa.array(forced), pa.array(over), p.field("box_id").take(rows), p.field("class_id").take(rows), *sides]
                yield pa.RecordBatch.from_arrays(cells, ["image_id", "anchor_id", "forced", "iou", "box_id", "class_id", "bx", "by", "bw", "bh", "ax", "ay", "aw", "ah"])

    return run


def assign_iou(boxes: DataFrame, grid: Grid = Grid(), pos: float = 0.5, neg: float = 0.4) -> DataFrame:
    """(image_id, anchor_id, state, class_id, box_id, tx, ty, tw, th) of anchors that are not negative; boxes(image_id, box_id, class_id, bx, by, bw, bh) in pixels.

    An anchor takes its best box: positive from pos, negative below neg, else ignored. The best anchor of every box is positive
    too, with that anchor's own best box, the smallest box id of equal ones. All other anchors of the grid are negative:
    `negative_counts` counts them, `negatives` lists them. Boxes are dealt by image once, and an image's boxes are a unit of work.
    """
    columns = ["image_id", "box_id", "class_id", "bx", "by", "bw", "bh"]
    kind = {c: boxes.schema[c].dataType.simpleString() for c in columns[:3]}
    boxes = boxes.select(*columns[:3], *(F.col(c).cast("double") for c in columns[3:])).where(" and ".join(f"{c} is not null" for c in columns[3:]))
    lists = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*columns[1:]))).alias("p"))
    told = lists.mapInArrow(_told(grid, pos, neg), f"image_id {kind['image_id']}, anchor_id int, forced boolean, iou double, box_id {kind['box_id']}, class_id {kind['class_id']}, " + ", ".join(f"{c} double" for c in ("bx", "by", "bw", "bh", "ax", "ay", "aw", "ah")))
    rows = told.withColumn("state", F.when(F.col("forced") | (F.col("iou") >= pos), "positive").otherwise("ignored"))
    hit = F.col("state") == "positive"
    offsets = [F.when(hit, c).alias(n) for c, n in zip(encode(_anchor(), _box()), ("tx", "ty", "tw", "th"), strict=True)]
    return rows.select("image_id", "anchor_id", "state", F.when(hit, F.col("class_id")).alias("class_id"), F.when(hit, F.col("box_id")).alias("box_id"), *offsets)


def negative_counts(found: DataFrame, images: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """(image_id, anchors): how many anchors of each image are negative."""
    taken = found.groupBy("image_id").agg(F.count("*").alias("_n"))
    return images.select("image_id").distinct().join(taken, "image_id", "left").select("image_id", (F.lit(grid.count) - F.coalesce("_n", F.lit(0))).alias("anchors"))


def negatives(found: DataFrame, images: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """(image_id, anchor_id) of the negative anchors: the whole grid of each image without those found."""
    every = images.select("image_id").distinct().withColumn("anchor_id", F.explode(F.sequence(F.lit(0), F.lit(grid.count - 1))))
    return every.join(found.select("image_id", "anchor_id"), ["image_id", "anchor_id"], "left_anti")
