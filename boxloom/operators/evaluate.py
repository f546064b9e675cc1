"""Predictions against ground truth: matching, precision and recall, average precision, failure samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.geometry import corners, iou, size_bucket
from boxloom.operators.select import carried, in_ranges

THRESHOLDS = (0.10, 0.20, 0.30, 0.40, 0.50)


def truth(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """boxes with their pixel corners gx1..gy2."""
    wide = boxes.join(images.select("image_id", "width", "height"), "image_id")
    return wide.withColumns({n: c for n, c in zip(("gx1", "gy1", "gx2", "gy2"), corners(*(F.col(x) for x in ("cx", "cy", "w", "h")), F.col("width"), F.col("height")), strict=True)}).drop("width", "height")


def _same(a, b) -> Column:
    """a = b, told as a range: an equality would become a key of the join, and rows that lie together by image would be dealt anew."""
    return a.between(b, b)


def _in_image(left: DataFrame, right: DataFrame, how: str, *names: str) -> DataFrame:
    """left joined with right on image_id and further columns, dealt by image_id alone; right's other columns follow."""
    other = right.select(*(F.col(n).alias(f"_{n}") for n in ("image_id", *names)), *(c for c in right.columns if c not in ("image_id", *names)))
    on = F.col("image_id") == F.col("_image_id")
    for n in names:
        on = on & _same(F.col(n), F.col(f"_{n}"))
    return left.join(other, on, how).drop("_image_id", *(f"_{n}" for n in names))


def candidate_pairs(preds: DataFrame, boxes: DataFrame, images: DataFrame, least: float) -> DataFrame:
    """(image_id, class_id, pred_id, conf, box_id, iou) of same-class pairs with IoU of at least `least`: a join by image and a filter."""
    return _with_candidates(preds, boxes, images, least, "inner")


def _with_candidates(preds: DataFrame, boxes: DataFrame, images: DataFrame, least: float, how: str) -> DataFrame:
    """candidate_pairs; with how="left" also the predictions without any, their box_id and iou null.

    Both sides are dealt by image_id, as their joins with the images leave them, and so are all the groups that follow: one shuffle each.
    """
    gt = truth(boxes, images).select("image_id", "class_id", "box_id", "gx1", "gy1", "gx2", "gy2")
    over = iou([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("gx1", "gy1", "gx2", "gy2")])
    gt = gt.withColumnsRenamed({"image_id": "_image_id", "class_id": "_class_id"})
    on = (F.col("image_id") == F.col("_image_id")) & _same(F.col("class_id"), F.col("_class_id")) & (over >= least)
    return preds.join(gt, on, how).select("image_id", "class_id", "pred_id", "conf", "box_id", F.when(F.col("box_id").isNotNull(), over).alias("iou"))


def match(preds: DataFrame, boxes: DataFrame, images: DataFrame, least: float = 0.45, by: tuple = ()) -> DataFrame:
    """(image_id, class_id, pred_id, box_id, iou[, by]) of accepted matches; columns of `by` tell independent runs apart.

    Predictions go by falling confidence, then id. Each takes the free box of its class with the highest IoU, if that reaches
    `least`; ties go to the smaller box id. Pairs below `least` can never be taken, so they are dropped before the fold, which then
    works on the few candidates of one image and class.
    """
    pairs = candidate_pairs(preds, boxes, images, least)
    options = pairs.groupBy("image_id", "class_id", "pred_id", "conf", *by).agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), "box_id"))).alias("options"))
    grouped = options.groupBy("image_id", "class_id", *by).agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("o"), F.col("pred_id"), F.col("options")))).alias("ps"))
    folded = grouped.withColumn("m", F.expr("""
      aggregate(ps, cast(array() as array<struct<pred_id:string,box_id:string,iou:double>>),
        (a, p) -> concat(a, transform(slice(filter(p.options, x -> not exists(a, y -> y.box_id = x.box_id)), 1, 1), x -> named_struct('pred_id', p.pred_id, 'box_id', x.box_id, 'iou', -x.o))))"""))  # fmt: skip
    return folded.select("image_id", "class_id", *by, F.inline("m"))


def prf(matches: DataFrame, preds: DataFrame, boxes: DataFrame, by: tuple = ()) -> DataFrame:
    """(class_id[, by], tp, fp, fn, precision, recall, f1), rounded to 4 places, 0 where undefined."""
    keys = ["class_id", *by]
    hit = matches.groupBy(*keys).agg(F.count("*").alias("tp"))
    said = preds.groupBy(*keys).agg(F.count("*").alias("said"))
    there = boxes.groupBy("class_id").agg(F.count("*").alias("there"))
    grid = said.select(*keys).union(hit.select(*keys)).distinct()
    if by:
        grid = grid.union(there.select("class_id").crossJoin(said.select(*by).distinct())).distinct()
    else:
        grid = grid.union(there.select("class_id")).distinct()
    all_ = grid.join(hit, keys, "left").join(said, keys, "left").join(there, "class_id", "left").na.fill(0)
    tp, fp, fn = F.col("tp"), F.col("said") - F.col("tp"), F.col("there") - F.col("tp")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return all_.select(*keys, tp, fp.alias("fp"), fn.alias("fn"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def threshold_sweep(preds: DataFrame, boxes: DataFrame, images: DataFrame, thresholds=THRESHOLDS, least: float = 0.45) -> DataFrame:
    """prf at every confidence threshold, from one join of the cached predictions."""
    marks = F.array(*(F.lit(float(t)) for t in thresholds))
    swept = preds.withColumn("threshold", F.explode(F.filter(marks, lambda t: F.col("conf") >= t)))
    pairs = candidate_pairs(preds, boxes, images, least)
    return prf(_match_swept(pairs, marks), swept, boxes, ("threshold",))


def _match_swept(pairs: DataFrame, marks: Column) -> DataFrame:
    """Matches at several thresholds: a prediction below the threshold never precedes one above it, so one walk serves all.

    Predictions go by falling confidence, and a lower threshold only adds later ones; the matches at a threshold are those of the
    walk at confidences of at least the threshold.
    """
    options = pairs.groupBy("image_id", "class_id", "pred_id", "conf").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), "box_id"))).alias("options"))
    grouped = options.groupBy("image_id", "class_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("o"), F.col("pred_id"), F.col("options")))).alias("ps"))
    folded = grouped.withColumn("m", F.expr("""
      aggregate(ps, cast(array() as array<struct<pred_id:string,box_id:string,conf:double>>),
        (a, p) -> concat(a, transform(slice(filter(p.options, x -> not exists(a, y -> y.box_id = x.box_id)), 1, 1), x -> named_struct('pred_id', p.pred_id, 'box_id', x.box_id, 'conf', -p.o))))"""))  # fmt: skip
    return folded.select("image_id", "class_id", F.inline("m")).withColumn("threshold", F.explode(F.filter(marks, lambda t: F.col("conf") >= t)))


def rescued(missed: DataFrame, low: DataFrame, images: DataFrame, least: float = 0.45) -> DataFrame:
    """(image_id, box_id) of the missed boxes that a weak prediction of their class overlaps; a prediction may rescue several."""
    return candidate_pairs(low, missed, images, least).select("image_id", "box_id").distinct()


def rescue(missed: DataFrame, low: DataFrame, images: DataFrame, least: float = 0.45) -> DataFrame:
    """The missed boxes that are `rescued`."""
    return _in_image(missed, rescued(missed, low, images, least), "left_semi", "box_id")


def missed_boxes(boxes: DataFrame, matches: DataFrame) -> DataFrame:
    return _in_image(boxes, matches.select("image_id", "box_id"), "left_anti", "box_id")


def size_bucket_recall(boxes: DataFrame, matches: DataFrame, flag: float = 0.4) -> DataFrame:
    """(bucket, class_id, tp, fn, recall, flagged); buckets without boxes are absent."""
    hit = _in_image(boxes, matches.select("image_id", "box_id", F.lit(True).alias("hit")), "left", "box_id")
    out = hit.groupBy(size_bucket(F.col("w") * F.col("h") * 100).alias("bucket"), "class_id").agg(F.count("hit").alias("tp"), F.count_if(F.col("hit").isNull()).alias("fn"))
    return out.withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn"))).withColumn("flagged", F.col("recall") < flag)


def dashboard(metrics: DataFrame, flag: float = 0.55) -> DataFrame:
    """(class_id, recall, fn_rate, flagged)."""
    rate = F.when(F.col("tp") + F.col("fn") > 0, F.col("fn") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return metrics.select("class_id", "recall", F.round(rate, 4).alias("fn_rate"), (F.col("recall") < flag).alias("flagged"))


def average_precision(preds: DataFrame, boxes: DataFrame, images: DataFrame, ious=(0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)) -> DataFrame:
    """(iou, class_id, ap): 101-point interpolated average precision of each class that has boxes.

    Predictions of a class are ranked by falling confidence, then id; precision is made falling from the right, and read at recalls
    0, 0.01 .. 1. A class is ranked in ranges of confidence; counts of earlier ranges and the best precision of later ones are carried
    over their edges, so no class is sorted in one task.
    """
    marks = F.array(*(F.lit(float(t)) for t in ious))
    told = _walked(preds, boxes, images, min(ious), tuple(ious)).select("class_id", "pred_id", "conf", F.col("least").alias("iou"), F.col("box_id").isNotNull().cast("int").alias("tp"))
    there = boxes.groupBy("class_id").agg(F.count("*").alias("there"))
    groups = ["iou", "class_id"]
    dealt = carried(in_ranges(told, groups, [F.desc("conf"), F.asc("pred_id")]), groups, {"c0": (F.sum("tp"), F.sum), "k0": (F.count("*"), F.sum)})
    none = F.lit(0).cast("bigint")
    order = Window.partitionBy(*groups, "part").orderBy(F.desc("conf"), "pred_id")
    run = dealt.withColumn("c", F.coalesce("c0", none) + F.sum("tp").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("k", F.coalesce("k0", none) + F.row_number().over(order)).join(F.broadcast(there), "class_id")
    run = carried(run.withColumn("p", F.col("c") / F.col("k")), groups, {"later": (F.max("p"), F.max)}, falling=True)
    best = F.greatest(F.max("p").over(Window.partitionBy(*groups, "part").orderBy(F.asc("conf"), F.desc("pred_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.coalesce("later", F.lit(0.0)))
    run = run.withColumn("best", best).withColumn("lower", F.ceil((F.col("c") - F.col("tp")) * 100.0 / F.col("there") + 1e-9)).withColumn("upper", F.floor(F.col("c") * 100.0 / F.col("there") + 1e-9))
    first = F.when((F.col("c") == 1) & (F.col("tp") == 1), F.lit(0)).otherwise(F.col("lower"))
    points = F.when(F.col("tp") == 1, F.greatest(F.col("upper") - first + 1, F.lit(0))).otherwise(0)
    sums = run.groupBy("iou", "class_id").agg((F.sum(points * F.col("best")) / 101.0).alias("ap"))
    grid = there.select("class_id", F.explode(marks).alias("iou"))
    return grid.join(sums, ["iou", "class_id"], "left").select("iou", "class_id", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def _walked(preds: DataFrame, boxes: DataFrame, images: DataFrame, least: float, ious: tuple) -> DataFrame:
    """(image_id, class_id, pred_id, conf, least, box_id) of every prediction: the box that `match` gives it at each of ious, or null."""
    pairs = _with_candidates(preds, boxes, images, least, "left")
    option = F.when(F.col("box_id").isNotNull(), F.struct((-F.col("iou")).alias("o"), "box_id"))
    options = pairs.groupBy("image_id", "class_id", "pred_id", "conf").agg(F.array_sort(F.collect_list(option)).alias("options"))
    grouped = options.groupBy("image_id", "class_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("o"), F.col("pred_id"), F.col("options")))).alias("ps"))
    grouped = grouped.withColumn("least", F.explode(F.array(*(F.lit(float(t)) for t in ious))))
    folded = grouped.withColumn("m", F.expr("""
      aggregate(ps, cast(array() as array<struct<pred_id:string,box_id:string,conf:double>>),
        (a, p) -> array_append(a, named_struct('pred_id', p.pred_id, 'box_id', get(filter(p.options, x -> -x.o >= least and not exists(a, y -> y.box_id <=> x.box_id)), 0).box_id, 'conf', -p.o)))"""))  # fmt: skip
    return folded.select("image_id", "class_id", "least", F.inline("m"))


def failure_samples(preds: DataFrame, boxes: DataFrame, images: DataFrame, conf: float = 0.25, most: int = 60, most_right: int = 20, least: float = 0.45) -> DataFrame:
    """(kind, class_id, item, image_id): missed boxes, false predictions, weakly seen boxes and images done right, by image order.

    At most `most` missed and false per class, `most_right` right ones under the class of the image's first box. Weakly seen boxes
    have no cap of their own, but end with the box that fills the class's missed ones.
    """
    strong = _walked(preds.where(F.col("conf") >= conf), boxes, images, least, (least,))
    hits = strong.where(F.col("box_id").isNotNull()).select("image_id", "box_id")
    lost = missed_boxes(boxes.select("image_id", "class_id", "box_id"), hits)
    low = preds.where((F.col("conf") >= 0.10) & (F.col("conf") < conf))
    seen = rescued(boxes, low, images, least).withColumn("seen", F.lit(True))
    told = _in_image(lost, seen, "left", "box_id")
    # a row after `most` unseen ones of its class and part is after them in the class too, so parts are cut first and few rows meet by class
    for groups in (("_part", "class_id"), ("class_id",)):
        before = Window.partitionBy(*groups).orderBy("image_id", "box_id").rowsBetween(Window.unboundedPreceding, -1)
        told = told.withColumn("_part", F.pmod(F.hash("image_id"), F.lit(256))).withColumn("_before", F.coalesce(F.count_if(F.col("seen").isNull()).over(before), F.lit(0))).where(F.col("_before") < most)
    missed = told.select(F.when(F.col("seen"), "low_conf").otherwise("fn").alias("kind"), "class_id", F.col("box_id").alias("item"), "image_id")
    wrong = strong.where(F.col("box_id").isNull()).withColumn("k", F.row_number().over(Window.partitionBy("class_id").orderBy("image_id", "pred_id"))).where(F.col("k") <= most)
    right = _in_image(boxes.select("image_id", "class_id", "box_id"), hits.select("image_id").distinct(), "left_semi").groupBy("image_id").agg(F.min_by("class_id", "box_id").alias("class_id"))
    right = right.withColumn("k", F.row_number().over(Window.partitionBy("class_id").orderBy("image_id"))).where(F.col("k") <= most_right)
    return missed.union(wrong.select(F.lit("fp"), "class_id", "pred_id", "image_id")).union(right.select(F.lit("ok"), "class_id", F.col("image_id").cast("string"), "image_id"))
