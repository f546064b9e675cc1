"""Counts, shares, gates and reports over boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.names import CLASSES, classes
from boxloom.operators.labels import tiny_reason
from boxloom.operators.select import exact_median

SPLITS = ("train", "valid", "test")


def class_counts(boxes: DataFrame, splits=SPLITS) -> DataFrame:
    """(split, class_id, boxes) with zeros for every split and class."""
    spark = boxes.sparkSession
    grid = classes(spark).select("class_id").crossJoin(spark.createDataFrame([(s,) for s in splits], "split string"))
    found = boxes.groupBy("split", "class_id").agg(F.count("*").alias("boxes"))
    return F.broadcast(grid).join(found, ["split", "class_id"], "left").na.fill(0, ["boxes"]).select("split", "class_id", "boxes")


def class_balance(boxes: DataFrame) -> DataFrame:
    """(split, class_id, boxes, share, ratio) of the classes that a split has: percent, and largest over smallest class."""
    by = Window.partitionBy("split")
    found = boxes.groupBy("split", "class_id").agg(F.count("*").alias("boxes"))
    return found.select("split", "class_id", "boxes", (F.col("boxes") * 100.0 / F.sum("boxes").over(by)).alias("share"), (F.max("boxes").over(by) / F.greatest(F.min("boxes").over(by), F.lit(1))).alias("ratio"))


def gate_min(counts: DataFrame, least: int) -> DataFrame:
    """(class_id, boxes, pass) of class_counts summed over splits."""
    return counts.groupBy("class_id").agg(F.sum("boxes").alias("boxes")).withColumn("pass", F.col("boxes") >= least)


def gate_splits(counts: DataFrame, least: int = 100) -> DataFrame:
    """(class_id, valid, test, pass): every class needs `least` boxes in both."""
    wide = counts.groupBy("class_id").pivot("split", ["valid", "test"]).agg(F.sum("boxes")).na.fill(0)
    return wide.withColumn("pass", (F.col("valid") >= least) & (F.col("test") >= least))


def tiny_report(boxes: DataFrame, min_px: float = 8, size: int = 640, flag: float = 30.0) -> DataFrame:
    """(class_id, total, kept, removed, removed_percent, flagged) of the tiny filter, and a row with class_id -1 for all."""
    judged = boxes.select("class_id", tiny_reason(min_px, size).alias("reason"))
    out = judged.rollup("class_id").agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("removed"), F.grouping("class_id").alias("all"))
    percent = F.col("removed") * 100.0 / F.col("total")
    return out.select(F.when(F.col("all") == 1, -1).otherwise(F.col("class_id")).alias("class_id"), "total", "kept", "removed", percent.alias("removed_percent"), (percent > flag).alias("flagged")).where("total > 0")


def size_summary(boxes: DataFrame) -> DataFrame:
    """Count, mean, exact median and four area buckets per class; areas in percent, rounded to 4 places first."""
    area = F.round(F.col("w") * F.col("h") * 100, 4)
    a, rows = F.col("a"), boxes.select("class_id", area.alias("a"))
    sums = rows.groupBy("class_id").agg(
        F.count("*").alias("n"), F.round(F.avg("a"), 3).alias("mean_area"),
        F.count_if(a < 2).alias("tiny"), F.count_if((a >= 2) & (a < 5)).alias("small"), F.count_if((a >= 5) & (a < 15)).alias("medium"), F.count_if(a >= 15).alias("large"),
    )
    middle = exact_median(rows, "class_id", "a").select("class_id", F.round("median", 3).alias("median_area"))
    return sums.join(middle, "class_id", "left").select("class_id", "n", "mean_area", "median_area", "tiny", "small", "medium", "large")


def style_audit(boxes: DataFrame, class_id: int = 1, area: float = 0.04, min_px: float = 8, size: int = 640) -> DataFrame:
    """(measure, item, n, value): style counts and percent, boxes per image, boxes below the least size, two histograms, the flag."""
    own = boxes.where(F.col("class_id") == class_id).select("image_id", (F.col("w") * F.col("h") * 100).alias("a"), (F.least("w", "h") * size).alias("px"))
    per = own.groupBy("image_id").agg(F.count("*").alias("n"), F.bool_and(F.col("a") < area * 100).alias("every"), F.bool_or(F.col("a") < area * 100).alias("any"))
    style = F.when(F.col("every"), "finger").when(F.col("any"), "mixed").otherwise("bunch")
    styles = per.groupBy(style.alias("item")).agg(F.count("*").alias("n")).select(F.lit("style").alias("measure"), "item", "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("value"))
    # an image count is a whole number, so images are counted by it first
    sizes = per.groupBy("n").agg(F.count("*").alias("images"))
    upto, every = F.sum("images").over(Window.orderBy("n")), F.sum("images").over(Window.partitionBy())
    ranked = sizes.select("n", (upto - F.col("images")).alias("first"), upto.alias("end"), every.alias("every"))
    holds = lambda at: F.max(F.expr(f"if({at} >= first and {at} < end, n, null)"))
    middle = ranked.agg(((holds("(every - 1) div 2") + holds("every div 2")) / 2).alias("median"))
    spread = per.agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.max("n").cast("double").alias("max"), F.expr("cast(count_if(every) > 0 and count_if(not any) > 0 as int)").alias("bad"))
    spread = spread.withColumn("_one", F.lit(1)).join(middle.withColumn("_one", F.lit(1)), "_one")
    spread = spread.selectExpr("n", "bad", "stack(3, 'mean', mean, 'median', cast(median as double), 'max', max) as (item, value)").select(F.lit("boxes_per_image").alias("measure"), "item", "n", "value").union(
        per.agg(F.count("*").alias("n"), F.expr("cast(count_if(every) > 0 and count_if(not any) > 0 as double)").alias("value")).select(F.lit("inconsistent").alias("measure"), F.lit("flag").alias("item"), "n", "value"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    bins = lambda c, edges: F.coalesce(*(F.when((F.col(c) >= lo) & (F.col(c) < hi), f"{lo:g}-{hi:g}") for lo, hi in zip(edges, edges[1:], strict=False)), F.lit("above"))
    hist = [own.groupBy(bins(c, e).alias("item")).agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "item", "n", share.alias("value")) for name, c, e in (("area_percent", "a", [0, 0.1, 0.5, 2, 5, 100]), ("min_px", "px", [0, 4, 8, 16, 32, 640]))]
    below = own.agg(F.count_if(F.col("px") < min_px).alias("n"), F.count("*").alias("c")).select(F.lit("below_min").alias("measure"), F.lit("boxes").alias("item"), "n", F.expr("if(c > 0, n * 100.0d / c, 0.0d)").alias("value"))
    out = styles.union(spread).union(below)
    for h in hist:
        out = out.union(h)
    return out


def class_weights(boxes: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """(class_id, weight): root of inverse frequency with smoothing, mean 1; all 1 without boxes."""
    n = len(CLASSES)
    every = Window.partitionBy()
    counts = F.broadcast(classes(boxes.sparkSession).select("class_id")).join(boxes.groupBy("class_id").agg(F.count("*").alias("c")), "class_id", "left")
    f = counts.select("class_id", (F.coalesce("c", F.lit(0)) + smoothing).alias("f"), F.coalesce(F.sum("c").over(every), F.lit(0)).alias("total"))
    raw = f.withColumn("r", F.sqrt(F.sum("f").over(every) / (n * F.col("f"))))
    return raw.select("class_id", F.when(F.col("total") == 0, 1.0).otherwise(F.col("r") / F.avg("r").over(every)).alias("weight"))


def profile(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(split, source_id, images, labelled, boxes, unlabelled) for every split, every source and all, by grouping sets; null means all."""
    per = boxes.groupBy("image_id").agg(F.count("*").alias("b"))
    joined = images.select("image_id", "split", "source_id").join(per, "image_id", "left")
    measures = [F.count("*").alias("images"), F.count("b").alias("labelled"), F.coalesce(F.sum("b"), F.lit(0)).alias("boxes"), F.count_if(F.col("b").isNull()).alias("unlabelled")]
    return joined.groupingSets([["split"], ["source_id"], []], "split", "source_id").agg(*measures)


def build_stats(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(source_id, images, kept, boxes): images of a source and those that kept a valid box."""
    per = boxes.groupBy("image_id").agg(F.count("*").alias("b"))
    return images.select("image_id", "source_id").join(per, "image_id", "left").groupBy("source_id").agg(F.count("*").alias("images"), F.count("b").alias("kept"), F.coalesce(F.sum("b"), F.lit(0)).alias("boxes"))


def generated_report(boxes: DataFrame, per_class: int = 20) -> DataFrame:
    """(class_id, boxes, images, pass) of a generated set: images that hold the class, and whether there are enough."""
    found = boxes.groupBy("class_id").agg(F.count("*").alias("boxes"), F.countDistinct("image_id").alias("images"))
    return F.broadcast(classes(boxes.sparkSession).select("class_id")).join(found, "class_id", "left").na.fill(0).withColumn("pass", F.col("images") >= per_class)
