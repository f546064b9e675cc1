"""Annotation formats to tables: image inventory, label text, COCO, VOC, class folders, class names, pixels, run files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.functions.names import normalize_name, resolve_alias
from boxloom.operators.labels import parse_labels
from boxloom.operators.quality import IMAGE_EXTENSIONS
from boxloom.sources.dataset import scan_whole

#: Fixed box of a classification image: centre and size.
PSEUDO_BOX = (0.5, 0.5, 0.85, 0.85)
#: Fixed names of files that hold class names, in their order; the last one counts in a source's own folder only.
YAML_NAMES = ("data.yaml", "dataset.yaml", "_annotations.yaml")
HISTORY = "epoch int, lr double, loss double, cls_loss double, box_loss double, map50 double, map double, epoch_seconds double"


def _split(path: Column) -> Column:
    found = F.regexp_extract(path, r"/(train|valid|val|test)/", 1)
    return F.when(found == "val", "valid").when(found != "", found)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, source, split, stem, ext, size, mtime) of image files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    source = F.regexp_extract(F.replace(F.col("path"), F.lit(root.rstrip("/")), F.lit("")), r"^[^/]*?/([^/]+)/", 1)
    return files.select("path", source.alias("source"), _split(F.col("path")).alias("split"), _stem(F.col("path")).alias("stem"), ext.alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).where(F.col("ext").isin(*IMAGE_EXTENSIONS))


def scan_labels(spark: SparkSession, root: str, dialect: str = "strict", n_classes: int = 8) -> DataFrame:
    """(path, split, stem, class_id, cx, cy, w, h) of label files below root; blank files give no rows."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    return parse_labels(lines, dialect, n_classes).select("path", _split(F.col("path")).alias("split"), _stem(F.col("path")).alias("stem"), "class_id", "cx", "cy", "w", "h")


def pair_labels(images: DataFrame) -> DataFrame:
    """images with label_path: the first path part named images becomes labels, else the file beside it; suffix .txt."""
    swapped = F.regexp_replace("path", r"(?i)^(.*?/)images(/.*)$", "$1labels$2")
    return images.withColumn("label_path", F.regexp_replace(swapped, r"\.[^./]*$", ".txt"))


def _below(names: str | None) -> dict:
    return {"recursiveFileLookup": True, "pathGlobFilter": names} if names else {}


def scan_coco(spark: SparkSession, glob: str, names: str | None = None) -> DataFrame:
    """Boxes of COCO documents, of which names is a file pattern below the folder glob, if given: (path, file_name, raw_name, cx, cy, w, h), with known images and categories, valid ones only."""
    schema = "categories array<struct<id:bigint,name:string>>, images array<struct<id:bigint,file_name:string,width:double,height:double>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>"
    if names:  # the usual name begins with _, which Spark's own sources hide
        docs = scan_whole(spark, glob, names).select("path", F.from_json(F.col("content").cast("string"), schema).alias("d")).select("path", "d.*")
    else:
        docs = spark.read.schema(schema).option("multiLine", True).json(glob).select("*", F.col("_metadata.file_path").alias("path"))
    images = docs.select("path", F.inline("images")).where("width > 0 and height > 0").withColumnRenamed("id", "image_id")
    names = docs.select("path", F.inline("categories")).select("path", F.col("id").alias("category_id"), F.col("name").alias("raw_name"))
    boxes = docs.select("path", F.inline("annotations")).where("size(bbox) = 4").join(images, ["path", "image_id"]).join(names, ["path", "category_id"])
    made = g.from_coco(*(F.get("bbox", F.lit(k)) for k in range(4)), F.col("width"), F.col("height"))
    return boxes.select("path", "file_name", "raw_name", *(c.alias(n) for c, n in zip(made, ("cx", "cy", "w", "h"), strict=True))).where(g.valid_box())


def scan_voc(spark: SparkSession, glob: str, names: str | None = None) -> DataFrame:
    """(path, filename, raw_name, cx, cy, w, h): boxes of VOC documents; images without a size are dropped."""
    schema = "filename string, size struct<width:string,height:string>, object array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"
    docs = spark.read.format("xml").option("rowTag", "annotation").options(**_below(names)).schema(schema).load(glob).select("*", F.col("_metadata.file_path").alias("path"))
    size = docs.select("path", "filename", F.expr("try_cast(size.width as double)").alias("width"), F.expr("try_cast(size.height as double)").alias("height"), F.explode("object").alias("o")).where("width > 0 and height > 0")
    corner = [F.expr(f"try_cast(o.bndbox.{c} as double)") for c in ("xmin", "ymin", "xmax", "ymax")]
    made = g.centre(*corner, F.col("width"), F.col("height"))
    return size.select("path", "filename", F.col("o.name").alias("raw_name"), *(c.alias(n) for c, n in zip(made, ("cx", "cy", "w", "h"), strict=True))).where(g.valid_box())


def scan_class_folders(spark: SparkSession, root: str, folder_map: dict[str, str]) -> DataFrame:
    """(path, name, cx, cy, w, h): one pseudo box per image; its folder matches a key exactly, else holds the first key by order."""
    images = scan_images(spark, root).withColumn("folder", F.element_at(F.split("path", "/"), -2))
    name = resolve_alias(F.regexp_replace("folder", "%20", " "), list(folder_map.items()))
    return images.select("path", name.alias("name"), *(F.lit(x).alias(n) for x, n in zip(PSEUDO_BOX, ("cx", "cy", "w", "h"), strict=True))).where("name is not null")


def scan_class_names(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw_id, raw_name) from the names of YAML files, a list or a map of ids."""

    def run(frames):
        import yaml

        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                names = (yaml.safe_load(bytes(content).decode("utf-8", "ignore")) or {}).get("names") or []
                pairs = sorted((int(k), str(v)) for k, v in names.items()) if isinstance(names, dict) else enumerate(map(str, names))
                rows += [(path, k, v) for k, v in pairs]
            yield pd.DataFrame(rows, columns=["path", "raw_id", "raw_name"])

    return scan_whole(spark, root, "*.y*ml").mapInPandas(run, "path string, raw_id int, raw_name string")


def _source(path: Column, root: str, whole: bool) -> Column:
    """The folder of path just below root, or empty if root is one source."""
    if whole:
        return F.lit("")
    tail = F.substring_index(F.replace(path, F.lit("%20"), F.lit(" ")), re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/", -1)
    return F.when(tail.contains("/"), F.substring_index(tail, "/", 1)).otherwise("")


def scan_routed(spark: SparkSession, root: str, whole: bool = False) -> DataFrame:
    """(source, path, format, image, raw_name, cx, cy, w, h) of the sources in the folders below root, or of root as one source if whole.

    A source with a YAML file of YAML_NAMES has label text, named by the first of them, one in its own folder before deeper ones; its COCO documents are read besides; XML is read
    only in a source where neither gives a box. Each listed file has its source, so sources need not look alike. An image that two
    formats describe is taken from the first of them, with all its boxes, equal ones too. image is its path without the extension.
    """
    box = ["cx", "cy", "w", "h"]
    plain = F.regexp_replace("path", r"^\w+:/*", "/")  # Spark names local files with a scheme
    of = lambda d: d.withColumn("path", plain).withColumn("source", _source(F.col("path"), root, whole))
    file = F.substring_index("path", "/", -1)
    nested = F.when(F.substring_index("path", "/", -2) == F.concat_ws("/", F.when(F.col("source") == "", re.sub(r".*/", "", root.rstrip("/"))).otherwise(F.col("source")), file), 0).otherwise(3)
    order = F.struct((nested + F.array_position(F.array(*map(F.lit, YAML_NAMES)), file)).alias("n"), "path")
    names = of(scan_class_names(spark, root)).where(file.isin(*YAML_NAMES) & ((nested == 0) | (file != YAML_NAMES[2])))
    first = names.groupBy("source").agg(F.min_by("path", order).alias("path"))
    names = names.join(first, ["source", "path"]).select("source", F.col("raw_id").alias("class_id"), "raw_name")
    text = of(scan_labels(spark, root, "lenient", 10**6)).join(names, ["source", "class_id"])
    image = F.regexp_replace(F.regexp_replace("path", r"\.[^./]*$", ""), r"(?i)/labels/([^/]*)$", "/images/$1")
    text = text.select("source", "path", F.lit("labels").alias("format"), image.alias("image"), "raw_name", *box)
    beside = lambda file: F.regexp_replace(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col(file)), r"\.[^./]*$", "")
    coco = of(scan_coco(spark, root, "_annotations.coco.json")).select("source", "path", F.lit("coco").alias("format"), beside("file_name").alias("image"), "raw_name", *box)
    told = text.unionByName(coco)
    voc = of(scan_voc(spark, root, "*.xml")).join(told.select("source").distinct(), "source", "left_anti").select("source", "path", F.lit("voc").alias("format"), beside("filename").alias("image"), "raw_name", *box)
    rows = told.unionByName(voc)
    rank = lambda: F.array_position(F.array(F.lit("labels"), F.lit("coco"), F.lit("voc")), F.col("format"))
    taken = rows.groupBy("source", "image").agg(F.min(rank()).alias("_rank"))
    return rows.withColumn("_rank", rank()).join(taken, ["source", "image", "_rank"], "left_semi").select("source", "path", "format", "image", "raw_name", *box)


def scan_auto(spark: SparkSession, root: str) -> DataFrame:
    """scan_routed of root as one source: (path, format, raw_name, cx, cy, w, h), a row per box."""
    return scan_routed(spark, root, True).select("path", "format", "raw_name", "cx", "cy", "w", "h")


def source_catalog(spark: SparkSession, sources: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(sources(tag, rank), source_classes(tag, raw_id, raw_name)) from the configured class order of each source."""
    tags = spark.createDataFrame([(t, k) for k, t in enumerate(sources)], "tag string, rank int")
    classes = spark.createDataFrame([(t, k, n) for t, names in sources.items() for k, n in enumerate(names)], "tag string, raw_id int, raw_name string")
    return tags, classes


def scan_pixels(spark: SparkSession, root: str) -> DataFrame:
    """(path, height, width, data as raw BGR bytes) of decodable images."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    return images.where("image.nChannels = 3").select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.data")


def scan_history(spark: SparkSession, path: str) -> DataFrame:
    """Run histories with their run, the folder of the file."""
    raw = spark.read.schema(HISTORY).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run"), "*")


def integrate_export(base: DataFrame, extra: DataFrame, target_map: dict[str, int]) -> DataFrame:
    """base(seq, image, class_id, box..) with the mapped boxes of extra(image, raw_name, box..), numbered on from the last seq."""
    ids = F.create_map(*(F.lit(x) for kv in target_map.items() for x in kv))
    mapped = extra.withColumn("class_id", F.try_element_at(ids, normalize_name(F.col("raw_name")))).where("class_id is not null")
    last = base.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    numbered = mapped.select("image").distinct().withColumn("k", F.row_number().over(Window.orderBy("image"))).crossJoin(last).select("image", (F.col("k") + F.col("last")).alias("seq"))
    return base.unionByName(mapped.drop("raw_name").join(numbered, "image").select(base.columns))
