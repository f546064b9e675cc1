"""Anchors met by arithmetic against all pairs of boxes and anchors."""

import random

import numpy as np
import pytest

from boxloom.operators import grid

TOY = grid.Grid(416.0, (4, 2, 1), (100, 200, 300), (0.5, 1.0, 2.0))
SCHEMA = "image_id bigint, box_id string, class_id int, bx double, by double, bw double, bh double"


def anchors(g):
    rows = []
    for n, s in zip(g.cells, g.scales, strict=True):
        c = np.arange(n * n)
        for_cell = [((c % n + 0.5) * (g.size / n), (c // n + 0.5) * (g.size / n), np.full(n * n, s * r**0.5), np.full(n * n, s * (1 / r**0.5))) for r in g.ratios]
        rows.append(np.stack([np.stack(x) for x in for_cell], axis=-1).transpose(1, 2, 0).reshape(-1, 4))
    return np.concatenate(rows)


def overlap(a, b):
    (ax, ay, aw, ah), (bx, by, bw, bh) = a.T, b
    inter = np.maximum(0, np.minimum(ax + aw / 2, bx + bw / 2) - np.maximum(ax - aw / 2, bx - bw / 2)) * np.maximum(0, np.minimum(ay + ah / 2, by + bh / 2) - np.maximum(ay - ah / 2, by - bh / 2))
    union = ((ax + aw / 2) - (ax - aw / 2)) * ((ay + ah / 2) - (ay - ah / 2)) + ((bx + bw / 2) - (bx - bw / 2)) * ((by + bh / 2) - (by - bh / 2)) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0)


def brute(boxes, g, pos, neg):
    table, out, per = anchors(g), set(), {}
    for b in boxes:
        per.setdefault(b[0], []).append(b)
    for image, own in per.items():
        own.sort(key=lambda b: b[1])
        over = np.stack([overlap(table, b[3:]) for b in own])
        best = over.argmax(axis=0)
        top, forced = over.max(axis=0), set(over.argmax(axis=1).tolist())
        for a in sorted(forced | set(np.flatnonzero(top >= neg).tolist())):
            hit = a in forced or top[a] >= pos
            out.add((image, a, "positive" if hit else "ignored", own[best[a]][2] if hit else None, own[best[a]][1] if hit else None))
    return out


def awkward(seed, images=25):
    rng = random.Random(seed)
    out = [(i, f"b{k:02}", rng.randrange(8), rng.uniform(-10, 430), rng.uniform(-10, 430), rng.choice([2.0, 30.0, 128.0, 400.0]) * rng.uniform(0.5, 1.5), rng.choice([2.0, 30.0, 128.0, 300.0]) * rng.uniform(0.5, 1.5)) for i in range(images) for k in range(rng.randrange(1, 5))]
    out += [(100, "z", 1, 50.0, 50.0, 0.0, 9.0), (101, "far", 2, 5000.0, 10.0, 20.0, 20.0), (101, "a", 3, 208.0, 208.0, 64.0, 64.0), (102, "dup", 4, 104.0, 104.0, 100.0, 100.0), (102, "dup2", 5, 104.0, 104.0, 100.0, 100.0), (103, "all", 6, 208.0, 208.0, 416.0, 416.0)]
    return out


@pytest.mark.parametrize("g,images", [(TOY, 25), (grid.Grid(), 8)], ids=["toy", "production"])
def test_assignment_equals_all_pairs(spark, g, images):
    boxes = awkward(3, images)
    found = grid.assign_iou(spark.createDataFrame(boxes, SCHEMA), g)
    rows = found.collect()
    assert {(r.image_id, r.anchor_id, r.state, r.class_id, r.box_id) for r in rows} == brute(boxes, g, 0.5, 0.4)
    table, boxed = anchors(g), {b[:2]: b for b in boxes}
    for r in rows:
        if r.state == "positive":
            a, b = table[r.anchor_id], boxed[(r.image_id, r.box_id)]
            assert (r.tx, r.tw) == pytest.approx(((b[3] - a[0]) / a[2], np.log(max(b[5], 1e-6) / a[2])))


def test_negatives_are_the_rest(spark):
    found = grid.assign_iou(spark.createDataFrame(awkward(4, 5), SCHEMA), TOY)
    images = spark.createDataFrame([(i,) for i in [0, 1, 2, 3, 4, 77]], "image_id bigint")
    taken = found.groupBy("image_id").count().collect()
    counts = {r.image_id: r.anchors for r in grid.negative_counts(found, images, TOY).collect()}
    assert counts == {i: TOY.count - sum(r["count"] for r in taken if r.image_id == i) for i in [0, 1, 2, 3, 4, 77]}
    listed = {(r.image_id, r.anchor_id) for r in grid.negatives(found, images, TOY).collect()}
    assert len(listed) == sum(counts.values()) and not listed & {(r.image_id, r.anchor_id) for r in found.collect()}
    assert grid.Grid().count == 172887


def test_centres_inside_anchors(spark):
    boxes = awkward(5)
    table = anchors(TOY)
    want = {(b[0], b[1], a) for b in boxes for a in np.flatnonzero((abs(b[3] - table[:, 0]) <= table[:, 2] / 2) & (abs(b[4] - table[:, 1]) <= table[:, 3] / 2)).tolist()}
    assert {(r.image_id, r.box_id, r.anchor_id) for r in grid.anchors_around(spark.createDataFrame(boxes, SCHEMA), TOY).collect()} == want


def test_boxes_are_dealt_once_and_lots_do_not_matter(spark):
    found = grid.assign_iou(spark.createDataFrame(awkward(6), SCHEMA), TOY)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    own = sorted(b for b in awkward(6) if b[0] < 3)
    many = np.bincount([b[0] for b in own])
    image, box = np.repeat(np.arange(3), many), [np.array([b[k] for b in own]) for k in range(3, 7)]
    whole, cut = (grid._judged(image, np.cumsum(many) - many, many, box, TOY.table(), 3, 0.5, 0.4, lot) for lot in (1000, 2))
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and len(whole[0])
