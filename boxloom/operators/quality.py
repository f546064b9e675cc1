"""Image-level rules: source audit, quality chain, annotation style, split integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources by how they are treated.
ELIGIBLE = ["fruit_detection_kaggle", "fruit_detection_yolov8", "fruit_detection_yolo_2025", "fruit_quality_detection", "fruit_ripeness_detection", "fruit-detection-dnwrs", "fruit-lpwjt", "lvis_fruits", "mango_ripeness_yolo", "pomegranate_yolo", "watermelon-muqdf"]
REVIEW = ["PG-YOLO-Dataset-master", "pomegranate_dataset", "mango_dds"]
CONVERT = ["fruits_by_yolo", "fruits_obj_detection"]
EXCLUDED = ["fruits_360", "fruits_262", "fruits_360_yolo"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".webp"]


def audit_sources(files: DataFrame) -> DataFrame:
    """(source, status, reason, images, txt_labels, yaml_files) from files(source, ext): counts, then the first rule that fits."""
    ext = F.lower("ext")
    counts = files.groupBy("source").agg(
        F.count_if(ext.isin(*IMAGE_EXTENSIONS)).alias("images"), F.count_if(ext == ".txt").alias("txt_labels"), F.count_if(ext.isin(".yaml", ".yml")).alias("yaml_files")
    )
    name, images, labels = F.col("source"), F.col("images"), F.col("txt_labels")
    rules = [
        (name.isin(*EXCLUDED) | F.lower(name).rlike("fruits[_-]360"), "exclude", "synthetic_or_explicitly_excluded"),
        (name.isin(*ELIGIBLE) & (images == 0), "exclude", "no_images"),
        (name.isin(*ELIGIBLE) & (labels == 0), "needs_pseudo_label_review", "eligible_name_but_no_yolo_labels"),
        (name.isin(*ELIGIBLE), "eligible_yolo", "explicit_source_rule"),
        (name.isin(*REVIEW), "needs_pseudo_label_review", "image_only_or_untrusted_labels"),
        (name.isin(*CONVERT), "needs_conversion", "nonstandard_annotation_layout"),
        ((images > 0) & (labels == 0), "needs_pseudo_label_review", "image_only"),
        ((images > 0) & (labels > 0), "needs_conversion", "unknown_label_schema"),
    ]
    verdict: Column = F.struct(F.lit("exclude").alias("status"), F.lit("no_usable_images").alias("reason"))
    for test, status, reason in reversed(rules):
        verdict = F.when(test, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(verdict)
    return counts.withColumn("v", verdict).select("source", "v.status", "v.reason", "images", "txt_labels", "yaml_files")


def is_excluded_source(path: str = "path") -> Column:
    return F.lower(path).rlike("fruits[_-]360|fruits262")


def is_synthetic(path: str = "path") -> Column:
    """The file name holds _aug_."""
    return F.contains(F.lower(F.substring_index(path, "/", -1)), F.lit("_aug_"))


def annotation_style(boxes: DataFrame, class_id: int, area: float = 0.04, three_way: bool = False) -> DataFrame:
    """(image_id, style) of images with the class: finger if all its boxes are below the area, else bunch; three_way tells mixed from bunch."""
    small = F.col("w") * F.col("h") < area
    of = boxes.where(F.col("class_id") == class_id).groupBy("image_id").agg(F.bool_and(small).alias("every"), F.bool_or(small).alias("any"))
    other = F.when(F.col("any"), "mixed").otherwise("bunch") if three_way else F.lit("bunch")
    return of.select("image_id", F.when(F.col("every"), "finger").otherwise(other).alias("style"))


def quality_verdicts(images: DataFrame, boxes: DataFrame, style_class: int = 1, area: float = 0.04, loose: float = 0.85) -> DataFrame:
    """images with reject_reason, null to keep: the first of excluded source, synthetic name, all-small style, loose box, empty."""
    of_class, size = F.col("class_id") == style_class, F.col("w") * F.col("h")
    facts = boxes.groupBy("image_id").agg(F.max(size).alias("_largest"), F.max(F.when(of_class, size)).alias("_of_class"))
    reason = (
        F.when(is_excluded_source(), "excluded_source").when(is_synthetic(), "synthetic").when(F.col("_of_class") < area, "finger_style").when(F.col("_largest") > loose, "loose_box").when(F.col("_largest").isNull(), "empty")
    )
    return images.join(facts, "image_id", "left").withColumn("reject_reason", reason).drop("_largest", "_of_class")


def quality_filter(images: DataFrame, boxes: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(kept images, counts by reason)."""
    judged = quality_verdicts(images, boxes, **options)
    stats = judged.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("images"))
    return judged.where("reject_reason is null").drop("reject_reason"), stats


def verify_splits(images: DataFrame, labels: DataFrame, splits=("train", "valid", "test"), most_empty: float = 0.05) -> DataFrame:
    """(split, images, orphans, empties, ok): labels(image_id, boxes) with boxes = 0 for a blank file; a missing split is not ok."""
    spark = images.sparkSession
    wanted = spark.createDataFrame([(s,) for s in splits], "split string")
    joined = images.select("image_id", "split").join(labels.select("image_id", "boxes"), "image_id", "left")
    counts = joined.groupBy("split").agg(F.count("*").alias("images"), F.count_if(F.col("boxes").isNull()).alias("orphans"), F.count_if(F.col("boxes") == 0).alias("empties"))
    out = wanted.join(counts, "split", "left").na.fill(0, ["images", "orphans", "empties"])
    return out.withColumn("ok", (F.col("images") > 0) & (F.col("orphans") == 0) & (F.col("empties") <= most_empty * F.col("images")))
