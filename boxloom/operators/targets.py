"""Anchors, their assignment to boxes, and scores of raw detector output."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.functions.geometry import ciou_loss, corners, decode, encode


def anchor_table(spark: SparkSession, size: float, cells=(208, 104, 52, 26, 13), scales=(32, 64, 128, 200, 300), ratios=(0.5, 1.0, 2.0)) -> DataFrame:
    """(anchor_id, scale_no, ax, ay, aw, ah), ids in the order scale, row, column, ratio."""
    rows, offset = [], 0
    for k, (n, s) in enumerate(zip(cells, scales, strict=True)):
        rows.append((k, n, size / n, float(s), offset))
        offset += n * n * len(ratios)
    scales_df = spark.createDataFrame(rows, "scale_no int, n int, stride double, scale double, offset int")
    shapes = F.array(*(F.struct(F.lit(math.sqrt(r)).alias("fw"), F.lit(1 / math.sqrt(r)).alias("fh")) for r in ratios))
    wide = scales_df.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1))).select("*", F.posexplode(shapes).alias("r", "f"))
    x, y = F.col("cell") % F.col("n"), F.floor(F.col("cell") / F.col("n"))
    return wide.select((F.col("offset") + F.col("cell") * len(ratios) + F.col("r")).alias("anchor_id"), "scale_no", ((x + 0.5) * F.col("stride")).alias("ax"), ((y + 0.5) * F.col("stride")).alias("ay"), (F.col("scale") * F.col("f.fw")).alias("aw"), (F.col("scale") * F.col("f.fh")).alias("ah"))


def _anchor() -> list[Column]:
    return [F.col(c) for c in ("ax", "ay", "aw", "ah")]


def _box() -> list[Column]:
    return [F.col(c) for c in ("bx", "by", "bw", "bh")]


def assign_grid(boxes: DataFrame, size: float = 416, cells=(208, 104, 52, 26, 13), scales=(32, 64, 128, 200, 300), ratios=(0.5, 1.0, 2.0)) -> DataFrame:
    """(image_id, anchor_id, box_id, class_id, tx, ty, tw, th): per box and scale, the anchor of the centre's cell whose shape fits best.

    Anchor ids come from arithmetic, so boxes never meet the anchor table. Where two boxes take one anchor, the later box id stays.
    """
    specs, offset = [], 0
    for n, s in zip(cells, scales, strict=True):
        specs.append(F.struct(F.lit(n).alias("n"), F.lit(size / n).alias("stride"), F.lit(offset).alias("offset"), F.array(*(F.struct(F.lit(s * math.sqrt(r)).alias("w"), F.lit(s / math.sqrt(r)).alias("h")) for r in ratios)).alias("shapes")))
        offset += n * n * len(ratios)
    # boxes are dealt by image before each becomes a row per scale, and the window needs no other dealing
    wide = boxes.select("image_id", "box_id", "class_id", "bx", "by", "bw", "bh").repartition("image_id").withColumn("s", F.explode(F.array(*specs)))
    cell = lambda c: F.least(F.greatest(F.expr(f"cast({c} / s.stride as int)"), F.lit(0)), F.col("s.n") - 1)
    fit = """transform(s.shapes, x -> least(bw, x.w) * least(bh, x.h) / greatest(bw * bh + x.w * x.h - least(bw, x.w) * least(bh, x.h), 1e-6d))"""
    wide = wide.withColumn("gx", cell("bx")).withColumn("gy", cell("by")).withColumn("fit", F.expr(fit))
    r = F.array_position("fit", F.array_max("fit")).cast("int") - 1
    wide = wide.withColumn("r", r).withColumn("anchor_id", F.col("s.offset") + (F.col("gy") * F.col("s.n") + F.col("gx")) * len(ratios) + F.col("r")).withColumn("shape", F.get("s.shapes", F.col("r")))
    wide = wide.withColumns({"ax": (F.col("gx") + 0.5) * F.col("s.stride"), "ay": (F.col("gy") + 0.5) * F.col("s.stride"), "aw": F.col("shape.w"), "ah": F.col("shape.h")})
    offsets = [c.alias(n) for c, n in zip(encode(_anchor(), _box()), ("tx", "ty", "tw", "th"), strict=True)]
    last = Window.partitionBy("image_id", "anchor_id").orderBy(F.desc("box_id"))
    return wide.withColumn("k", F.row_number().over(last)).where("k = 1").select("image_id", "anchor_id", "box_id", "class_id", *offsets)


def focal_score(logits: DataFrame, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """logits(.., cls array<double>, target int or null, weight double) with loss: the focal loss of an anchor over all classes.

    target is the class of a positive anchor, null for a negative one; weight counts for positives.
    """
    each = f"""aggregate(transform(cls, (x, i) -> named_struct('x', x, 't', if(coalesce(target, -1) = i, 1.0d, 0.0d))), 0.0d, (s, v) -> s +
      (if(v.t = 1, {alpha}d, {1 - alpha}d)) * pow(1 - (if(v.t = 1, 1 / (1 + exp(-v.x)), 1 - 1 / (1 + exp(-v.x)))), {gamma}d) * (greatest(v.x, 0.0d) - v.x * v.t + log1p(exp(-abs(v.x)))))"""
    return logits.withColumn("loss", F.expr(each) * F.when(F.col("target").isNotNull(), F.coalesce("weight", F.lit(1.0))).otherwise(1.0))


def detection_score(scored: DataFrame, batch: str = "batch", negatives_per_positive: int = 3, size: float = 416) -> DataFrame:
    """(batch, cls, box, total, positives) from rows with loss, positive, px..ph (predicted) and bx..bh (true) pixel boxes.

    Positives count in full, and of the negatives the hardest `negatives_per_positive` times the positives (all with 0); both and
    the box loss are divided by the positives, at least 1.
    """
    box = F.when(F.col("positive"), ciou_loss([F.col(c) for c in ("px", "py", "pw", "ph")], _box(), size))
    n = F.count_if(F.col("positive")).over(Window.partitionBy(batch))
    hardest = F.row_number().over(Window.partitionBy(batch, "positive").orderBy(F.desc("loss"), "anchor_id"))
    rows = scored.withColumn("_box", box).withColumn("_n", n).withColumn("_k", hardest)
    limit = F.lit(negatives_per_positive) * F.greatest(F.col("_n"), F.lit(1))
    counted = F.col("positive") | (F.col("_k") <= limit) if negatives_per_positive > 0 else F.lit(True)
    sums = rows.groupBy(batch).agg(F.sum(F.when(counted, F.col("loss")).otherwise(0.0)).alias("c"), F.coalesce(F.sum("_box"), F.lit(0.0)).alias("b"), F.max("_n").alias("positives"))
    over = F.greatest(F.col("positives"), F.lit(1))
    return sums.select(batch, (F.col("c") / over).alias("cls"), (F.col("b") / over).alias("box"), ((F.col("c") + F.col("b")) / over).alias("total"), "positives")


def decode_logits(logits: DataFrame, anchors: DataFrame, conf: float = 0.05, top: int = 1000, size: float = 416) -> DataFrame:
    """(image_id, anchor_id, class_id, conf, x1, y1, x2, y2): best class above conf, the top ones of an image, corners clipped."""
    best = logits.withColumn("m", F.array_max("cls")).withColumn("conf", 1 / (1 + F.exp(-F.col("m")))).where(F.col("conf") > conf)
    best = best.withColumn("class_id", (F.array_position("cls", F.col("m")) - 1).cast("int"))
    by = Window.partitionBy("image_id").orderBy(F.desc("conf"), "anchor_id")
    kept = best.withColumn("k", F.row_number().over(by)).where(F.col("k") <= top).join(F.broadcast(anchors), "anchor_id")
    found = decode(_anchor(), [F.get("off", F.lit(k)) for k in range(4)])
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(size)))
    return kept.select("image_id", "anchor_id", "class_id", "conf", *(clip(c).alias(n) for c, n in zip(corners(*found), ("x1", "y1", "x2", "y2"), strict=True)))
