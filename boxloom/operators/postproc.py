"""Suppression of overlapping predictions, test-time merging, and scoring with a model that the user brings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import centre, flipped

_OVER = """if((x.x2 - x.x1) * (x.y2 - x.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - {i} > 0, {i} / ((x.x2 - x.x1) * (x.y2 - x.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - {i}), 0.0d)""".format(
    i="(greatest(0.0d, least(x.x2, p.x2) - greatest(x.x1, p.x1)) * greatest(0.0d, least(x.y2, p.y2) - greatest(x.y1, p.y1)))"
)


def nms(preds: DataFrame, over: float = 0.45, top: int = 100, by_class: bool = False, id_col: str = "pred_id") -> DataFrame:
    """Predictions that no stronger kept one of the image (and class) overlaps by more than `over`; at most `top` of an image.

    One fold over the predictions of an image, which detectors bound (decoding keeps the top 1000).
    """
    keys = ["image_id", "class_id"] if by_class else ["image_id"]
    entry = F.struct((-F.col("conf")).alias("o"), F.col(id_col).alias("id"), "class_id", "x1", "y1", "x2", "y2")
    lists = preds.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("ps"))
    kept = F.expr(f"aggregate(ps, slice(ps, 1, 0), (a, p) -> if(exists(a, x -> {_OVER} > {over}), a, array_append(a, p)))")
    out = lists.select("image_id", F.inline(kept))
    out = out.withColumn("k", F.expr("row_number() over (partition by image_id order by o, id)")).where(F.col("k") <= top)
    return out.select("image_id", F.col("id").alias(id_col), F.col("class_id"), (-F.col("o")).alias("conf"), "x1", "y1", "x2", "y2")


def tta_merge(plain: DataFrame, mirrored: DataFrame, widths: DataFrame, over: float = 0.45, top: int = 100) -> DataFrame:
    """Predictions of an image and of its mirror image (turned back) under class-aware suppression. widths(image_id, width)."""
    back = mirrored.join(widths.select("image_id", "width"), "image_id")
    back = back.withColumn("_x", flipped(F.col("x2"), F.col("width"))).withColumn("x2", flipped(F.col("x1"), F.col("width"))).withColumn("x1", F.col("_x"))
    return nms(plain.unionByName(back.select(plain.columns)), over, top, True)


def soft_nms(preds: DataFrame, sigma: float = 0.5, least: float = 0.01, id_col: str = "pred_id") -> DataFrame:
    """(image_id, id, rank, conf): Gaussian soft suppression; a kept box lowers others of its class by exp(-IoU^2 / sigma).

    Images go in step: a round keeps the best box left of every image of a lot and lowers the others, so its cost is that of the boxes.
    """
    kind = preds.schema

    def kept(image, c, s, b):
        """(rows, ranks) of boxes in the order in which each image keeps them; image ascends, s is lowered in place."""
        left, rank, rows, ranks = np.arange(len(s)), 0, [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        area = (b[2] - b[0]) * (b[3] - b[1])
        while len(left):
            rank += 1
            new = np.diff(image[left], prepend=-1) != 0
            own = np.cumsum(new) - 1
            most = np.maximum.reduceat(s[left], np.flatnonzero(new))
            top = np.flatnonzero((s[left] == most[own]) | np.isnan(s[left]))
            top = top[np.diff(own[top], prepend=-1) != 0]
            best = left[top]
            rows.append(best)
            ranks.append(np.full(len(best), rank, np.int32))
            left, k = np.delete(left, top), best[np.delete(own, top)]
            wide = np.clip(np.minimum(b[2][left], b[2][k]) - np.maximum(b[0][left], b[0][k]), 0, None)
            inter = wide * np.clip(np.minimum(b[3][left], b[3][k]) - np.maximum(b[1][left], b[1][k]), 0, None)
            union = area[left] + area[k] - inter
            over = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
            s[left] *= np.where(c[left] == c[k], np.exp(-(over**2) / sigma), 1.0)
            left = left[s[left] > least]
        return np.concatenate(rows), np.concatenate(ranks)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                some = batch.slice(at, 2_000)
                lists = some.column(1)
                p, image = lists.flatten(), np.repeat(np.arange(len(some)), np.diff(lists.offsets.to_numpy()))
                number = lambda c: np.array(p.field(c).to_numpy(zero_copy_only=False), float)  # noqa: B023, E731
                c, s = pc.dictionary_encode(p.field("class_id"), null_encoding="encode").indices.to_numpy(), number("conf")
                rows, ranks = kept(image, c, s, [number(x) for x in ("x1", "y1", "x2", "y2")])
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(image[rows])), p.field("id").take(pa.array(rows)), pa.array(ranks), pa.array(s[rows])], ["image_id", id_col, "rank", "conf"])

    entry = F.struct((-F.col("conf")).alias("o"), F.col(id_col).alias("id"), "class_id", "conf", "x1", "y1", "x2", "y2")
    lists = preds.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("p"))  # a detector bounds an image's predictions
    return lists.mapInArrow(run, f"image_id {kind['image_id'].dataType.simpleString()}, {id_col} {kind[id_col].dataType.simpleString()}, rank int, conf double")


def score(images: DataFrame, predict_fn, schema: str = "image_id bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double") -> DataFrame:
    """Predictions of predict_fn() -> model(pandas frame) -> pandas frame; the model is made once per task."""

    def run(frames):
        model = predict_fn()
        for pdf in frames:
            yield model(pdf)

    return images.mapInPandas(run, schema)


def drafts(preds: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, lines): draft labels in normalised form, one text per image, blank without predictions."""
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2", "width", "height")}
    box = centre(*(c[n] for n in ("x1", "y1", "x2", "y2")), c["width"], c["height"])
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", *box)
    per = preds.join(images.select("image_id", "width", "height"), "image_id").groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return images.select("image_id").join(per, "image_id", "left").select("image_id", F.coalesce("lines", F.lit("")).alias("lines"))
