"""Label lines to boxes, class remapping, and box filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import valid_box

DIALECTS = ("raw", "strict", "validated", "lenient", "throwing")


def parse_labels(lines: DataFrame, dialect: str = "strict", n_classes: int = 8, line_col: str = "line") -> DataFrame:
    """Rows of `lines` that hold a box, with class_id, cx, cy, w, h.

    raw: five fields, the class may be written 3.0. strict: five fields, whole class. validated: strict, class below n_classes,
    valid box. lenient: five or more fields, class below n_classes where negative ones count from the end, valid box.
    throwing: five fields, a bad number is an error.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    parts = F.split(F.trim(F.col(line_col)), r"\s+")
    rows, held = lines.withColumn("_f", parts), F.size("_f") >= 5 if dialect == "lenient" else F.size("_f") == 5
    whole, number = ("cast({} as int)", "cast({} as double)") if dialect == "throwing" else ("try_cast({} as int)", "try_cast({} as double)")
    if dialect == "raw":
        whole = "try_cast(try_cast({} as double) as int)"
    fields = [F.expr(whole.format("element_at(_f, 1)")).alias("class_id"), *(F.expr(number.format(f"element_at(_f, {k})")).alias(n) for k, n in enumerate(("cx", "cy", "w", "h"), 2))]
    # The generator parses a line once; filters on its columns would otherwise repeat the parsing for every mention. As an outer one it
    # lets no filter be inferred below it, where the split line, and what makes the line, would be spelled out again.
    rows = rows.select(*lines.columns, F.when(held, F.array(F.struct(*fields))).alias("_b")).select(*lines.columns, F.inline_outer("_b"))
    rows = rows.where("class_id is not null and cx is not null and cy is not null and w is not null and h is not null")
    if dialect == "validated":
        rows = rows.where(F.col("class_id").between(0, n_classes - 1) & valid_box())
    if dialect == "lenient":
        rows = rows.where(F.col("class_id").between(-n_classes, n_classes - 1) & valid_box()).withColumn("class_id", F.when(F.col("class_id") < 0, F.col("class_id") + n_classes).otherwise(F.col("class_id")))
    return rows


def remap_classes(boxes: DataFrame, class_map: DataFrame, raw_col: str = "raw_id", on: tuple = ()) -> DataFrame:
    """boxes with class_id from class_map(raw_id, class_id[, keys of `on`]); ids without an entry are dropped."""
    ids = class_map.select(F.col("raw_id").alias(raw_col), F.col("class_id").alias("_to"), *on)
    return boxes.drop("class_id").join(ids, [raw_col, *on]).withColumnRenamed("_to", "class_id")


def raw_names(boxes: DataFrame, names: DataFrame) -> DataFrame:
    """boxes with raw_name; an id without a name is shown as class_<id>."""
    return boxes.join(names.select("raw_id", "raw_name"), "raw_id", "left").withColumn("raw_name", F.coalesce("raw_name", F.concat(F.lit("class_"), F.col("raw_id"))))


def tiny_reason(min_px: float = 8, size: int = 640) -> Column:
    """Why a box goes: tiny (its shorter side at the input size), invalid, or null to stay."""
    tiny = F.least("w", "h") * size < min_px
    return F.when(~valid_box(), "invalid").when(tiny, "tiny")


def filter_tiny(boxes: DataFrame, min_px: float = 8, size: int = 640) -> DataFrame:
    """Boxes that are valid and whose shorter side has min_px pixels at the input size."""
    return boxes.where(tiny_reason(min_px, size).isNull())


def drop_empty(images: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): images with and without boxes."""
    with_boxes = boxes.select("image_id").distinct()
    return images.join(with_boxes, "image_id", "left_semi"), images.join(with_boxes, "image_id", "left_anti")


def at_least(conf: float) -> Column:
    """Confidence filter of the analysis."""
    return F.col("conf") >= conf


def above(conf: float) -> Column:
    """Confidence filter of decoding: strictly above."""
    return F.col("conf") > conf


def low_band(conf: float, low: float = 0.10) -> Column:
    """Predictions too weak to count but strong enough to tell that the box was seen."""
    return (F.col("conf") >= low) & (F.col("conf") < conf)
