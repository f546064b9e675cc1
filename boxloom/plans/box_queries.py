"""Queries over boxes, images and names, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.functions import names
from boxloom.operators import counts, dedup, labels, quality
from boxloom.plans.fixtures import view, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers f(v), v giving views by name, as a query; sql may use the fixture views."""

    def add(f):
        def run(spark, sf_dir):
            return f(lambda view_name: view(spark, sf_dir, view_name))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


VALID = "cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1"
#: The fixed class map of the fixtures: 0-7 stay, 8 is 0, 9 is 2, 10 and 11 have none.
RAW_MAP = [(k, k) for k in range(8)] + [(8, 0), (9, 2)]
MAP_SQL = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in RAW_MAP) + ") m(raw_id, class_id)"
PATHS = "concat('raw/', CASE WHEN source_id = 3 THEN 'Fruits-360' WHEN source_id = 7 THEN 'fruits262' ELSE concat('src', source_id) END, '/', image_id, CASE WHEN image_id % 13 = 0 THEN '_AUG_1' ELSE '' END, '.jpg')"


def boxes_in_splits(v) -> DataFrame:
    return v("fx_boxes").join(v("fx_images").select("image_id", "split"), "image_id")


@query("p1_remap_classes", f"SELECT box_id, m.class_id FROM fx_boxes b JOIN {MAP_SQL} ON b.raw_id = m.raw_id")
def _(v):
    spark = v("part").sparkSession
    return labels.remap_classes(v("fx_boxes"), spark.createDataFrame(RAW_MAP, "raw_id int, class_id int")).select("box_id", "class_id")


@query("p1_raw_names", f"SELECT box_id, CASE WHEN raw_id < 10 THEN concat('name', raw_id) ELSE concat('class_', raw_id) END AS raw_name FROM fx_boxes")
def _(v):
    spark = v("part").sparkSession
    return labels.raw_names(v("fx_boxes"), spark.createDataFrame([(k, f"name{k}") for k in range(10)], "raw_id int, raw_name string")).select("box_id", "raw_name")


NORMAL = "trim(regexp_replace(translate({}, '_-/', '   '), '\\s+', ' ', 'g'))".format("replace(" * 7 + "lower(trim(name))" + "".join(f", '{t}', ' ')" for t in names.TOKENS))
ALIAS_CASE = "CASE " + " ".join(f"WHEN n = '{a}' THEN '{c}'" for a, c in names.ALIASES) + " " + " ".join(f"WHEN contains(n, '{a}') THEN '{c}'" for a, c in names.ALIASES) + " END"


@query("p2_normalize_name", f"SELECT name_id, {NORMAL} AS clean FROM fx_names")
def _(v):
    return v("fx_names").select("name_id", names.normalize_name(F.col("name")).alias("clean"))


@query("p3_resolve_alias", f"SELECT name_id, {ALIAS_CASE} AS canonical FROM (SELECT name_id, {NORMAL} AS n FROM fx_names)")
def _(v):
    return v("fx_names").select("name_id", names.resolve_alias(names.normalize_name(F.col("name"))).alias("canonical"))


@query("p4_resolve_alias_lowered", "SELECT name_id, CASE " + " ".join(f"WHEN name = '{a}' OR lower(name) = '{a}' THEN '{c}'" for a, c in names.ALIASES) + " " + " ".join(f"WHEN contains(lower(name), '{a}') THEN '{c}'" for a, c in names.ALIASES) + " END AS canonical FROM fx_names")
def _(v):
    return v("fx_names").select("name_id", names.resolve_alias(F.col("name"), lowered=True).alias("canonical"))


@query("p1a_class_map", f"SELECT concat('t', name_id % 5) AS tag, name_id AS raw_id, k - 1 AS class_id FROM (SELECT name_id, name, list_position([{', '.join(repr(c) for c in names.CLASSES)}], {ALIAS_CASE}) AS k FROM (SELECT name_id, name, {NORMAL} AS n FROM fx_names)) WHERE k > 0 AND NOT ends_with(name, '_skip')")
def _(v):
    return names.class_map(v("fx_names").select(F.concat(F.lit("t"), F.col("name_id") % 5).alias("tag"), F.col("name_id").alias("raw_id"), F.col("name").alias("raw_name")))


@query("p5_valid_boxes", f"SELECT box_id FROM fx_boxes WHERE {VALID}")
def _(v):
    return v("fx_boxes").where(g.valid_box()).select("box_id")


@query("p6_audit_sources", """
WITH f AS (SELECT CASE CAST(o_custkey % 9 AS INT) WHEN 0 THEN 'lvis_fruits' WHEN 1 THEN 'fruits_360' WHEN 2 THEN 'mango_dds' WHEN 3 THEN 'fruits_by_yolo' WHEN 4 THEN 'other' WHEN 5 THEN 'images' WHEN 6 THEN 'pomegranate_yolo' WHEN 7 THEN 'x-Fruits-360' ELSE 'notes' END AS source,
  CASE WHEN o_custkey % 9 IN (5, 6) THEN '.JPG' WHEN o_custkey % 9 = 8 THEN '.yaml' WHEN o_orderkey % 2 = 0 THEN '.png' ELSE '.txt' END AS ext FROM orders),
c AS (SELECT source, count(*) FILTER (lower(ext) IN ('.jpg', '.jpeg', '.png', '.bmp', '.webp')) AS images, count(*) FILTER (lower(ext) = '.txt') AS txt_labels, count(*) FILTER (lower(ext) IN ('.yaml', '.yml')) AS yaml_files FROM f GROUP BY source)
SELECT source, CASE source WHEN 'lvis_fruits' THEN 'eligible_yolo' WHEN 'pomegranate_yolo' THEN 'needs_pseudo_label_review' WHEN 'mango_dds' THEN 'needs_pseudo_label_review' WHEN 'fruits_by_yolo' THEN 'needs_conversion' WHEN 'other' THEN 'needs_conversion' WHEN 'images' THEN 'needs_pseudo_label_review' ELSE 'exclude' END AS status,
  CASE source WHEN 'lvis_fruits' THEN 'explicit_source_rule' WHEN 'pomegranate_yolo' THEN 'eligible_name_but_no_yolo_labels' WHEN 'mango_dds' THEN 'image_only_or_untrusted_labels' WHEN 'fruits_by_yolo' THEN 'nonstandard_annotation_layout' WHEN 'other' THEN 'unknown_label_schema' WHEN 'images' THEN 'image_only' WHEN 'notes' THEN 'no_usable_images' ELSE 'synthetic_or_explicitly_excluded' END AS reason,
  images, txt_labels, yaml_files FROM c""")
def _(v):
    kinds = ["lvis_fruits", "fruits_360", "mango_dds", "fruits_by_yolo", "other", "images", "pomegranate_yolo", "x-Fruits-360", "notes"]
    k = (F.col("o_custkey") % 9).cast("int")
    ext = F.when(k.isin(5, 6), ".JPG").when(k == 8, ".yaml").when(F.col("o_orderkey") % 2 == 0, ".png").otherwise(".txt")
    return quality.audit_sources(v("orders").select(F.get(F.array(*map(F.lit, kinds)), k).alias("source"), ext.alias("ext")))


JUDGED = f"""
SELECT i.image_id, CASE WHEN regexp_matches(lower({PATHS}), 'fruits[_-]360|fruits262') THEN 'excluded_source' WHEN image_id % 13 = 0 THEN 'synthetic'
  WHEN own < 0.04 THEN 'finger_style' WHEN largest > 0.85 THEN 'loose_box' WHEN largest IS NULL THEN 'empty' END AS reject_reason
FROM fx_images i LEFT JOIN (SELECT image_id, max(w * h) AS largest, max(CASE WHEN class_id = 1 THEN w * h END) AS own FROM fx_boxes GROUP BY image_id) f USING (image_id)"""


@query("p7_quality_verdicts", JUDGED)
def _(v):
    return quality.quality_verdicts(v("fx_images").withColumn("path", F.expr(PATHS)), v("fx_boxes")).select("image_id", "reject_reason")


@query("p7_quality_stats", f"SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS images FROM ({JUDGED}) GROUP BY 1")
def _(v):
    return quality.quality_filter(v("fx_images").withColumn("path", F.expr(PATHS)), v("fx_boxes"))[1]


@query("p8_source_predicates", f"SELECT image_id, regexp_matches(lower({PATHS}), 'fruits[_-]360|fruits262') AS excluded, image_id % 13 = 0 AS synthetic FROM fx_images")
def _(v):
    return v("fx_images").withColumn("path", F.expr(PATHS)).select("image_id", quality.is_excluded_source().alias("excluded"), quality.is_synthetic().alias("synthetic"))


@query("p9_loose_images", "SELECT DISTINCT image_id FROM fx_boxes WHERE w * h > 0.85")
def _(v):
    return v("fx_boxes").groupBy("image_id").agg(F.max(F.col("w") * F.col("h")).alias("a")).where("a > 0.85").select("image_id")


@query("p10_annotation_style", "SELECT image_id, CASE WHEN bool_and(w * h < 0.04) THEN 'finger' WHEN bool_or(w * h < 0.04) THEN 'mixed' ELSE 'bunch' END AS style FROM fx_boxes WHERE class_id = 0 GROUP BY image_id")
def _(v):
    return quality.annotation_style(v("fx_boxes"), 0, three_way=True)


@query("p11_filter_tiny", f"SELECT box_id FROM fx_boxes WHERE least(w, h) * 640 >= 8 AND {VALID}")
def _(v):
    return labels.filter_tiny(v("fx_boxes")).select("box_id")


@query("p12_drop_empty", "SELECT image_id FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM fx_boxes)")
def _(v):
    return labels.drop_empty(v("fx_images"), v("fx_boxes"))[1].select("image_id")


@query("p13_verify_splits", """
SELECT s.split, count(i.image_id) AS images, count(*) FILTER (i.image_id IS NOT NULL AND n IS NULL) AS orphans, count(*) FILTER (n = 0) AS empties,
  count(i.image_id) > 0 AND count(*) FILTER (i.image_id IS NOT NULL AND n IS NULL) = 0 AND count(*) FILTER (n = 0) <= 0.05 * count(i.image_id) AS ok
FROM (VALUES ('train'), ('valid'), ('test')) s(split) LEFT JOIN fx_images i ON i.split = s.split
LEFT JOIN (SELECT image_id, count(*) FILTER (class_id < 2) AS n FROM fx_boxes GROUP BY image_id) l ON l.image_id = i.image_id GROUP BY s.split""")
def _(v):
    per = v("fx_boxes").groupBy("image_id").agg(F.count_if(F.col("class_id") < 2).alias("boxes"))
    return quality.verify_splits(v("fx_images"), per)


@query("p14_confidence_bands", "SELECT pred_id, conf >= 0.25 AS counted, conf > 0.05 AS decoded, conf >= 0.1 AND conf < 0.25 AS low FROM fx_preds")
def _(v):
    return v("fx_preds").select("pred_id", labels.at_least(0.25).alias("counted"), labels.above(0.05).alias("decoded"), labels.low_band(0.25).alias("low"))


for _dialect, _sql in {
    "strict": "len(f) = 5 AND TRY_CAST(f[1] AS INT) IS NOT NULL AND regexp_full_match(f[1], '-?[0-9]+')",
    "raw": "len(f) = 5 AND TRY_CAST(f[1] AS DOUBLE) IS NOT NULL",
    "validated": "len(f) = 5 AND regexp_full_match(f[1], '[0-9]+') AND CAST(TRY_CAST(f[1] AS DOUBLE) AS INT) < 8",
    "lenient": "len(f) >= 5 AND regexp_full_match(f[1], '[0-9]+') AND CAST(TRY_CAST(f[1] AS DOUBLE) AS INT) < 8",
}.items():

    @query(f"s2_labels_{_dialect}", f"""
SELECT image_id, line_no, CAST(TRY_CAST(f[1] AS DOUBLE) AS INT) AS class_id, CAST(f[2] AS DOUBLE) AS cx, CAST(f[3] AS DOUBLE) AS cy, CAST(f[4] AS DOUBLE) AS w, CAST(f[5] AS DOUBLE) AS h
FROM (SELECT image_id, line_no, regexp_split_to_array(trim(line), '\\s+') AS f FROM fx_label_lines) WHERE {_sql}""")
    def _(v, dialect=_dialect):
        return labels.parse_labels(v("fx_label_lines"), dialect).drop("line")


@query("a1_class_counts", "SELECT s.split, CAST(c.class_id AS INT) AS class_id, count(b.box_id) AS boxes FROM (VALUES ('train'), ('valid'), ('test')) s(split) CROSS JOIN range(8) c(class_id) LEFT JOIN (SELECT b.*, split FROM fx_boxes b JOIN fx_images USING (image_id)) b ON b.split = s.split AND b.class_id = c.class_id GROUP BY 1, 2")
def _(v):
    return counts.class_counts(boxes_in_splits(v))


@query("a2_class_balance", "SELECT split, class_id, n AS boxes, n * 100.0 / sum(n) OVER (PARTITION BY split) AS share, max(n) OVER (PARTITION BY split) / CAST(greatest(min(n) OVER (PARTITION BY split), 1) AS DOUBLE) AS ratio FROM (SELECT split, class_id, count(*) AS n FROM fx_boxes JOIN fx_images USING (image_id) GROUP BY 1, 2)")
def _(v):
    return counts.class_balance(boxes_in_splits(v))


@query("a3_build_stats", f"SELECT source_id, count(*) AS images, count(n) AS kept, CAST(coalesce(sum(n), 0) AS BIGINT) AS boxes FROM fx_images LEFT JOIN (SELECT image_id, count(*) AS n FROM fx_boxes WHERE {VALID} GROUP BY 1) USING (image_id) GROUP BY 1")
def _(v):
    return counts.build_stats(v("fx_images"), v("fx_boxes").where(g.valid_box()))


@query("a4_gate_min", "SELECT CAST(c.class_id AS INT) AS class_id, CAST(count(b.box_id) AS BIGINT) AS boxes, count(b.box_id) >= 4000 AS pass FROM range(8) c(class_id) LEFT JOIN fx_boxes b ON b.class_id = c.class_id GROUP BY 1")
def _(v):
    return counts.gate_min(counts.class_counts(boxes_in_splits(v)), 4000)


@query("a5_gate_splits", "SELECT CAST(c.class_id AS INT) AS class_id, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'valid') >= 100 AND count(*) FILTER (split = 'test') >= 100 AS pass FROM range(8) c(class_id) LEFT JOIN (SELECT class_id, split FROM fx_boxes JOIN fx_images USING (image_id)) b ON b.class_id = c.class_id GROUP BY 1")
def _(v):
    return counts.gate_splits(counts.class_counts(boxes_in_splits(v)))


@query("a6_tiny_report", f"SELECT coalesce(class_id, -1) AS class_id, count(*) AS total, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS removed, count(*) FILTER (NOT keep) * 100.0 / count(*) AS removed_percent, count(*) FILTER (NOT keep) * 100.0 / count(*) > 30 AS flagged FROM (SELECT class_id, least(w, h) * 640 >= 8 AND {VALID} AS keep FROM fx_boxes) GROUP BY ROLLUP (class_id)")
def _(v):
    return counts.tiny_report(v("fx_boxes"))


@query("a7_size_summary", "SELECT class_id, count(*) AS n, round(avg(a), 3) AS mean_area, round(median(a), 3) AS median_area, count(*) FILTER (a < 2) AS tiny, count(*) FILTER (a >= 2 AND a < 5) AS small, count(*) FILTER (a >= 5 AND a < 15) AS medium, count(*) FILTER (a >= 15) AS large FROM (SELECT class_id, round(w * h * 100, 4) AS a FROM fx_boxes) GROUP BY 1")
def _(v):
    return counts.size_summary(v("fx_boxes"))


def _bins(c, edges):
    return "CASE " + " ".join(f"WHEN {c} >= {lo:g} AND {c} < {hi:g} THEN '{lo:g}-{hi:g}'" for lo, hi in zip(edges, edges[1:], strict=False)) + " ELSE 'above' END"


@query("a8_style_audit", f"""
WITH o AS (SELECT image_id, w * h * 100 AS a, least(w, h) * 640 AS px FROM fx_boxes WHERE class_id = 1),
p AS (SELECT image_id, count(*) AS n, bool_and(a < 4.0) AS every, bool_or(a < 4.0) AS partly FROM o GROUP BY 1)
SELECT 'style' AS measure, CASE WHEN every THEN 'finger' WHEN partly THEN 'mixed' ELSE 'bunch' END AS item, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS value FROM p GROUP BY 2
UNION ALL SELECT 'boxes_per_image', 'mean', count(*), avg(n) FROM p UNION ALL SELECT 'boxes_per_image', 'median', count(*), median(n) FROM p UNION ALL SELECT 'boxes_per_image', 'max', count(*), max(n) FROM p
UNION ALL SELECT 'inconsistent', 'flag', count(*), CAST(count(*) FILTER (every) > 0 AND count(*) FILTER (NOT partly) > 0 AS INT) FROM p
UNION ALL SELECT 'below_min', 'boxes', count(*) FILTER (px < 8), count(*) FILTER (px < 8) * 100.0 / count(*) FROM o
UNION ALL SELECT 'area_percent', {_bins('a', [0, 0.1, 0.5, 2, 5, 100])}, count(*), count(*) * 100.0 / sum(count(*)) OVER () FROM o GROUP BY 2
UNION ALL SELECT 'min_px', {_bins('px', [0, 4, 8, 16, 32, 640])}, count(*), count(*) * 100.0 / sum(count(*)) OVER () FROM o GROUP BY 2""")
def _(v):
    return counts.style_audit(v("fx_boxes"), 1)


@query("a9_class_weights", "SELECT CAST(class_id AS INT) AS class_id, r / avg(r) OVER () AS weight FROM (SELECT class_id, sqrt(sum(f) OVER () / (8 * f)) AS r FROM (SELECT c.class_id, count(b.box_id) + 0.1e0 AS f FROM range(8) c(class_id) LEFT JOIN fx_boxes b ON b.class_id = c.class_id GROUP BY 1))")
def _(v):
    return counts.class_weights(v("fx_boxes"))


@query("a10_profile", "SELECT split, source_id, count(*) AS images, count(n) AS labelled, CAST(coalesce(sum(n), 0) AS BIGINT) AS boxes, count(*) FILTER (n IS NULL) AS unlabelled FROM fx_images LEFT JOIN (SELECT image_id, count(*) AS n FROM fx_boxes GROUP BY 1) USING (image_id) GROUP BY GROUPING SETS ((split), (source_id), ())")
def _(v):
    return counts.profile(v("fx_images"), v("fx_boxes"))


@query("a16_generated_report", "SELECT CAST(c.class_id AS INT) AS class_id, count(b.box_id) AS boxes, count(DISTINCT b.image_id) AS images, count(DISTINCT b.image_id) >= 20 AS pass FROM range(8) c(class_id) LEFT JOIN fx_boxes b ON b.class_id = c.class_id GROUP BY 1")
def _(v):
    return counts.generated_report(v("fx_boxes"))


@query("u1_union_sources", "SELECT image_id, 'clean' AS part FROM fx_images WHERE split = 'train' UNION ALL SELECT image_id, 'copied' FROM fx_images WHERE split = 'train' AND image_id % 7 = 0")
def _(v):
    train = v("fx_images").where("split = 'train'").select("image_id")
    return train.withColumn("part", F.lit("clean")).unionByName(train.where("image_id % 7 = 0").withColumn("part", F.lit("copied")))


_REMOVED = """SELECT item_id FROM (SELECT item_id, split, count(DISTINCT split) OVER (PARTITION BY h) AS n, bool_or(split = 'train') OVER (PARTITION BY h) AS t FROM fx_near) WHERE n > 1 AND split = CASE WHEN t THEN 'train' ELSE 'valid' END
UNION SELECT DISTINCT a.item_id FROM fx_near a JOIN fx_near b ON (a.split = 'train' AND b.split IN ('valid', 'test') OR a.split = 'valid' AND b.split = 'test') AND bit_count(xor(a.h, b.h)) <= 8"""


@query("u2_union_removals", _REMOVED)
def _(v):
    """What exact and near duplicates across splits remove, together."""
    near = v("fx_near")
    return dedup.removals_exact(near, "h").union(dedup.removals_near(near)).distinct()


@query("u3_difference", "SELECT image_id FROM fx_images EXCEPT SELECT image_id FROM fx_boxes")
def _(v):
    return v("fx_images").join(v("fx_boxes"), "image_id", "left_anti").select("image_id")


@query("u4_class_overlap", "SELECT image_id, list_sort(list_distinct(list(class_id))) AS classes FROM fx_boxes GROUP BY 1 HAVING bool_or(class_id IN (3, 4, 5, 7))")
def _(v):
    per = v("fx_boxes").groupBy("image_id").agg(F.sort_array(F.collect_set("class_id")).alias("classes"))
    return per.where(F.arrays_overlap("classes", F.array(*map(F.lit, [3, 4, 5, 7]))))


# ---------------------------------------------------------------- geometry
def _b():
    return [F.col(c) for c in ("cx", "cy", "w", "h")]


@query("g1_corners", "SELECT box_id, (cx - w / 2) * width AS x1, (cy - h / 2) * height AS y1, (cx + w / 2) * width AS x2, (cy + h / 2) * height AS y2 FROM fx_boxes JOIN fx_images USING (image_id)")
def _(v):
    wide = v("fx_boxes").join(v("fx_images"), "image_id")
    return wide.select("box_id", *(c.alias(n) for c, n in zip(g.corners(*_b(), F.col("width"), F.col("height")), ("x1", "y1", "x2", "y2"), strict=True)))


IOU_SQL = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
UNION_SQL = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {IOU_SQL})"


@query("g2_iou", f"SELECT a.pred_id AS a, b.pred_id AS b, CASE WHEN {UNION_SQL} > 0 THEN {IOU_SQL} / {UNION_SQL} ELSE 0 END AS iou FROM fx_preds a JOIN fx_preds b ON a.image_id = b.image_id AND a.pred_id < b.pred_id")
def _(v):
    p = v("fx_preds")
    a, b = p.alias("a"), p.alias("b")
    sides = [[F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2")] for t in "ab"]
    return a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.pred_id") < F.col("b.pred_id"))).select(F.col("a.pred_id").alias("a"), F.col("b.pred_id").alias("b"), g.iou(*sides).alias("iou"))


_CIOU = """
WITH p AS (SELECT box_id, cx * 416 AS px, cy * 416 AS py, w * 416 AS pw, h * 416 AS ph, (cx + (cents % 7 - 3) / 5e1 * w) * 416 AS tx, cy * 416 AS ty, w * 0.9e0 * 416 AS tw, h * 1.1e0 * 416 AS th FROM fx_boxes),
c AS (SELECT *, greatest(least(px - pw / 2, 416), 0) AS ax1, greatest(least(py - ph / 2, 416), 0) AS ay1, greatest(least(px + pw / 2, 416), 0) AS ax2, greatest(least(py + ph / 2, 416), 0) AS ay2,
  greatest(least(tx - tw / 2, 416), 0) AS bx1, greatest(least(ty - th / 2, 416), 0) AS by1, greatest(least(tx + tw / 2, 416), 0) AS bx2, greatest(least(ty + th / 2, 416), 0) AS by2 FROM p),
i AS (SELECT *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS inter, 4 / pow(pi(), 2) * pow(atan(greatest(tw, 1e-6) / greatest(th, 1e-6)) - atan(greatest(pw, 1e-6) / greatest(ph, 1e-6)), 2) AS v,
  pow(greatest(ax2, bx2) - least(ax1, bx1), 2) + pow(greatest(ay2, by2) - least(ay1, by1), 2) + 1e-7 AS diag, pow(px - tx, 2) + pow(py - ty, 2) AS apart FROM c),
u AS (SELECT *, inter / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter + 1e-7) AS over_ FROM i)
SELECT box_id, least(greatest(1 - (over_ - apart / diag - v / (1 - over_ + v + 1e-7) * v), 0), 4) AS loss FROM u"""


@query("g3_ciou_loss", _CIOU)
def _(v):
    p = [c * 416 for c in _b()]
    t = [(F.col("cx") + (F.col("cents") % 7 - 3) / 50.0 * F.col("w")) * 416, p[1], F.col("w") * 0.9 * 416, F.col("h") * 1.1 * 416]
    return v("fx_boxes").select("box_id", g.ciou_loss(p, t, 416).alias("loss"))


@query("g4_offsets", "SELECT box_id, (cx - 0.5e0) / 0.25e0 AS tx, (cy - 0.5e0) / 0.5e0 AS ty, ln(greatest(w, 1e-6) / 0.25e0) AS tw, ln(greatest(h, 1e-6) / 0.5e0) AS th, least(greatest(cx, -1e9), 1e9) AS bx, exp(least(greatest(ln(greatest(w, 1e-6) / 0.25e0), -8), 8)) * 0.25e0 AS bw FROM fx_boxes")
def _(v):
    anchor = [F.lit(x) for x in (0.5, 0.5, 0.25, 0.5)]
    off = g.encode(anchor, _b())
    back = g.decode(anchor, off)
    return v("fx_boxes").select("box_id", *(c.alias(n) for c, n in zip([*off, back[0], back[2]], ("tx", "ty", "tw", "th", "bx", "bw"), strict=True)))


@query("g5_flip", "SELECT box_id, 1 - cx AS flipped_x, 416 - cy * 416 AS flipped_y FROM fx_boxes")
def _(v):
    return v("fx_boxes").select("box_id", g.flipped(F.col("cx")).alias("flipped_x"), g.flipped(F.col("cy") * 416, 416).alias("flipped_y"))


_ROT = """
WITH b AS (SELECT box_id, cx, cy, w, h, width, height, radians(cents % 21 - 10) AS r FROM fx_boxes JOIN fx_images USING (image_id)),
c AS (SELECT box_id, width, height, unnest([1, 1, -1, -1]) AS sx, unnest([1, -1, 1, -1]) AS sy, cx, cy, w, h, r FROM b),
p AS (SELECT box_id, width, height, cos(r) * ((cx + sx * w / 2) * width - width / 2) + sin(r) * ((cy + sy * h / 2) * height - height / 2) + width / 2 AS x, -sin(r) * ((cx + sx * w / 2) * width - width / 2) + cos(r) * ((cy + sy * h / 2) * height - height / 2) + height / 2 AS y FROM c),
q AS (SELECT box_id, width, height, least(greatest(min(x), 0), width) AS x1, least(greatest(max(x), 0), width) AS x2, least(greatest(min(y), 0), height) AS y1, least(greatest(max(y), 0), height) AS y2 FROM p GROUP BY box_id, width, height)
SELECT box_id, (x1 + x2) / 2 / width AS ncx, (y1 + y2) / 2 / height AS ncy, (x2 - x1) / width AS nw, (y2 - y1) / height AS nh FROM q WHERE x2 > x1 AND y2 > y1"""


@query("g6_rotate", _ROT)
def _(v):
    degrees = (F.col("cents") % 21 - 10).cast("double")
    # sine and cosine are exploded, so that no further step works them out anew
    wide = v("fx_boxes").join(v("fx_images"), "image_id").select("*", F.explode(F.array(F.struct(*g.turn(degrees)))).alias("t"))
    box = g.rotated(*_b(), degrees, F.col("width"), F.col("height"), (F.col("t.cos"), F.col("t.sin")))
    return wide.select("box_id", *(c.alias(n) for c, n in zip(box, ("ncx", "ncy", "nw", "nh"), strict=True))).where("nw > 0 and nh > 0")


@query("g8_rescale", "SELECT pred_id, x1 * width / 416 AS x1, y1 * height / 416 AS y1, x2 * width / 416 AS x2, y2 * height / 416 AS y2 FROM fx_preds JOIN fx_images USING (image_id)")
def _(v):
    box = g.rescaled([F.col(c) for c in ("x1", "y1", "x2", "y2")], 416.0, F.col("width"), F.col("height"))
    return v("fx_preds").join(v("fx_images"), "image_id").select("pred_id", *(c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)))


@query("g9_pixel_boxes", "SELECT pred_id, (x1 + (x2 - x1) / 2) / width AS cx, (y1 + (y2 - y1) / 2) / height AS cy, (x2 - x1) / width AS w, (y2 - y1) / height AS h FROM fx_preds JOIN fx_images USING (image_id)")
def _(v):
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2", "width", "height")}
    box = g.from_coco(c["x1"], c["y1"], c["x2"] - c["x1"], c["y2"] - c["y1"], c["width"], c["height"])
    return v("fx_preds").join(v("fx_images"), "image_id").select("pred_id", *(b.alias(n) for b, n in zip(box, ("cx", "cy", "w", "h"), strict=True)))


@query("g10_sizes", "SELECT box_id, w * 640 AS px_w, h * 640 AS px_h, w * h * 100 AS area_percent, CASE WHEN w * h * 100 < 2 THEN 'tiny' WHEN w * h * 100 < 5 THEN 'small' WHEN w * h * 100 < 15 THEN 'medium' ELSE 'large' END AS bucket FROM fx_boxes")
def _(v):
    area = F.col("w") * F.col("h") * 100
    return v("fx_boxes").select("box_id", (F.col("w") * 640).alias("px_w"), (F.col("h") * 640).alias("px_h"), area.alias("area_percent"), g.size_bucket(area).alias("bucket"))


@query("g7_mosaic", """
WITH m AS (SELECT image_id AS mosaic_id, image_id - q AS image_id, q AS quadrant, 104 + image_id % 209 AS mx, 104 + image_id * 7 % 209 AS my FROM fx_images, (VALUES (0), (1), (2), (3)) t(q)),
p AS (SELECT mosaic_id, quadrant, box_id, mx, my, width, height, (cx - w / 2) * width AS ox1, (cy - h / 2) * height AS oy1, (cx + w / 2) * width AS ox2, (cy + h / 2) * height AS oy2 FROM m JOIN fx_images USING (image_id) JOIN fx_boxes USING (image_id)),
s AS (SELECT *, CASE WHEN quadrant IN (0, 2) THEN greatest(mx - width, 0) ELSE mx END AS x1s, CASE WHEN quadrant IN (0, 2) THEN mx ELSE least(mx + width, 416) END AS x1e, CASE WHEN quadrant < 2 THEN greatest(my - height, 0) ELSE my END AS y1s, CASE WHEN quadrant < 2 THEN my ELSE least(my + height, 416) END AS y1e FROM p),
d AS (SELECT *, x1s - CASE WHEN quadrant IN (0, 2) THEN width - (x1e - x1s) ELSE 0 END AS dx, y1s - CASE WHEN quadrant < 2 THEN height - (y1e - y1s) ELSE 0 END AS dy FROM s),
n AS (SELECT mosaic_id, quadrant, box_id, greatest(ox1 + dx, x1s) AS x1, greatest(oy1 + dy, y1s) AS y1, least(ox2 + dx, x1e) AS x2, least(oy2 + dy, y1e) AS y2 FROM d)
SELECT * FROM n WHERE x2 - x1 > 2 AND y2 - y1 > 2""")
def _(v):
    i = v("fx_images").select("image_id")
    plan = i.select(F.col("image_id").alias("mosaic_id"), (104 + F.col("image_id") % 209).alias("mx"), (104 + F.col("image_id") * 7 % 209).alias("my"), F.explode(F.array(*map(F.lit, range(4)))).alias("quadrant"))
    wide = plan.withColumn("image_id", F.col("mosaic_id") - F.col("quadrant")).join(v("fx_images"), "image_id").join(v("fx_boxes"), "image_id")
    box = g.mosaic(g.corners(*_b(), F.col("width"), F.col("height")), F.col("quadrant"), F.col("mx"), F.col("my"), F.col("width"), F.col("height"), 416)
    named = wide.select("mosaic_id", "quadrant", "box_id", *(c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)))
    return named.where(g.mosaic_keeps([F.col(c) for c in ("x1", "y1", "x2", "y2")]))


_HEX = "CAST(concat('0x', substring(d, {}, 7)) AS BIGINT)"


@query("g12_occluder", f"""
WITH t AS (SELECT image_id, width, height, n, md5(concat_ws('|', 'occluder', image_id, n)) AS d FROM fx_images, range(1, 16) r(n)),
z AS (SELECT *, greatest(18, width // 12) + {_HEX.format(1)} % (greatest(24, width // 5) - greatest(18, width // 12) + 1) AS w, greatest(18, height // 12) + {_HEX.format(8)} % (greatest(24, height // 5) - greatest(18, height // 12) + 1) AS h FROM t),
a AS (SELECT *, {_HEX.format(15)} % (greatest(0, width - w) + 1) AS x1, {_HEX.format(22)} % (greatest(0, height - h) + 1) AS y1 FROM z),
bad AS (SELECT DISTINCT a.image_id, n FROM a JOIN fx_boxes b ON a.image_id = b.image_id WHERE floor(b.cx * width) BETWEEN x1 AND x1 + a.w AND floor(b.cy * height) BETWEEN y1 AND y1 + a.h AND a.w * a.h > greatest(1, floor(b.w * width) * floor(b.h * height)) * 0.6e0)
SELECT image_id, n, x1, y1, w, h FROM a ANTI JOIN bad USING (image_id, n) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n) = 1""")
def _(v):
    boxes = v("fx_boxes").groupBy("image_id").agg(F.collect_list(F.struct("cx", "cy", "w", "h")).alias("boxes"))
    wide = v("fx_images").join(boxes, "image_id", "left").withColumn("boxes", F.coalesce("boxes", F.expr("cast(array() as array<struct<cx:double,cy:double,w:double,h:double>>)")))
    size = F.col("width"), F.col("height")
    return wide.select("image_id", F.explode(g.occluder(F.col("image_id"), F.col("boxes"), *size)).alias("o")).select("image_id", "o.*")
