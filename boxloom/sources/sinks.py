"""Label files, manifests, reports and row names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.operators.select import carried, in_ranges


def label_texts(boxes: DataFrame) -> DataFrame:
    """(image_id, split, lines): `class cx cy w h` with 6 decimals, one text per image."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    return boxes.groupBy("image_id", "split").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))


def write_labels(boxes: DataFrame, path: str) -> None:
    """Label texts as text files, partitioned by split and image; many small files, so Parquet is the table to keep."""
    label_texts(boxes).repartition("split").write.partitionBy("split", "image_id").text(path)


def manifest(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """The ten manifest columns of images(source, image, label, out_image, out_label, md5, note, image_id) and their boxes."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|")
    per = boxes.groupBy("image_id").agg(joined("raw_name").alias("raw_classes"), joined("name").alias("mapped_classes"), F.count("*").alias("boxes"))
    return images.join(per, "image_id").select("source", F.col("image").alias("original_image"), F.col("label").alias("original_label"), F.col("out_image").alias("output_image"), F.col("out_label").alias("output_label"), "md5", "raw_classes", "mapped_classes", "boxes", "note")


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def report_lines(counts: DataFrame, name: str, value: str, width: int = 40) -> DataFrame:
    """(line): a bar of # per row, longest for the largest value."""
    top = F.max(value).over(Window.partitionBy())
    bar = F.expr(f"repeat('#', cast({width} * {value} / greatest(max({value}) over (), 1) as int))")
    return counts.select(F.format_string("%-16s %10d  %s", F.col(name).cast("string"), F.col(value).cast("bigint"), bar).alias("line"), top.alias("_t")).select("line")


def write_report(lines: DataFrame, path: str) -> None:
    """A report is a few rows: one text file."""
    lines.coalesce(1).write.text(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Run-history rows appended as files with a header each; scan_history reads them all."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def assign_names(images: DataFrame, scheme: str = "split") -> DataFrame:
    """images with new_name and collides. split: {split}_{number}; digest: {tag}_{first 8 of md5}; pass: wcam_p{pass}_{number}_{stem}.

    Numbers follow path order inside a split, counted over ranges of paths, so no split is sorted in one task. Digest names of different files can be equal; they are flagged, not overwritten.
    """
    if scheme == "digest":
        named = images.withColumn("new_name", F.concat_ws("_", "tag", F.substring("md5", 1, 8)))
        return named.withColumn("collides", F.count("*").over(Window.partitionBy("new_name")) > 1)
    number = lambda c: F.lpad(c.cast("string"), 6, "0")
    if scheme == "pass":
        return images.withColumn("new_name", F.concat(F.lit("wcam_p"), F.col("pass_no"), F.lit("_"), number(F.col("index")), F.lit("_"), F.col("stem"))).withColumn("collides", F.lit(False))
    dealt = carried(in_ranges(images, ["split"], ["path"]), ["split"], {"_earlier": (F.count("*"), F.sum)})
    k = F.row_number().over(Window.partitionBy("split", "part").orderBy("path")) - 1 + F.coalesce("_earlier", F.lit(0))
    return dealt.withColumn("new_name", F.concat_ws("_", "split", number(k))).withColumn("collides", F.lit(False)).drop("part", "_earlier")


