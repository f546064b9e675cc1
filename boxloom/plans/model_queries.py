"""Queries for anchors, scores, suppression, plans and monitoring, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.operators import grid, history, images, postproc, sampling, targets
from boxloom.plans.box_queries import query
from boxloom.sources import sinks

CELLS, SCALES, RATIOS, SIZE = (4, 2, 1), (100, 200, 300), (0.5, 1.0, 2.0), 416.0
GRID = grid.Grid(SIZE, CELLS, SCALES, RATIOS)
ANCHORS = """
sc AS (SELECT * FROM (VALUES (0, 4, 104e0, 100e0, 0), (1, 2, 208e0, 200e0, 48), (2, 1, 416e0, 300e0, 60)) s(scale_no, n, stride, scale, off0)),
an AS (SELECT CAST(off0 + c * 3 + r AS INT) AS anchor_id, scale_no, (c % n + 0.5e0) * stride AS ax, (c // n + 0.5e0) * stride AS ay, scale * sqrt(q) AS aw, scale / sqrt(q) AS ah, c % n AS gx, c // n AS gy, r
  FROM sc, LATERAL (SELECT unnest(range(0, n * n)) AS c) t, (VALUES (0, 0.5e0), (1, 1e0), (2, 2e0)) q(r, q))"""
PX = "pb AS (SELECT image_id, box_id, class_id, cx * 416 AS bx, cy * 416 AS by_, w * 416 AS bw, h * 416 AS bh FROM fx_boxes)"
ENC = "(bx - ax) / greatest(aw, 1e-6) AS tx, (by_ - ay) / greatest(ah, 1e-6) AS ty, ln(greatest(bw, 1e-6) / greatest(aw, 1e-6)) AS tw, ln(greatest(bh, 1e-6) / greatest(ah, 1e-6)) AS th"


def _px(v):
    return v("fx_boxes").select("image_id", "box_id", "class_id", *((F.col(a) * SIZE).alias(b) for a, b in (("cx", "bx"), ("cy", "by"), ("w", "bw"), ("h", "bh"))))


def _anchors(v):
    return targets.anchor_table(v("part").sparkSession, SIZE, CELLS, SCALES, RATIOS)


@query("g11_anchor_boxes", f"WITH {ANCHORS}, {PX} SELECT box_id, anchor_id FROM pb JOIN an ON abs(bx - ax) <= aw / 2 AND abs(by_ - ay) <= ah / 2")
def _(v):
    return grid.anchors_around(_px(v), GRID).select("box_id", "anchor_id")


_I = "(greatest(0, least(bx + bw / 2, ax + aw / 2) - greatest(bx - bw / 2, ax - aw / 2)) * greatest(0, least(by_ + bh / 2, ay + ah / 2) - greatest(by_ - bh / 2, ay - ah / 2)))"

_U = f"(((ax + aw / 2) - (ax - aw / 2)) * ((ay + ah / 2) - (ay - ah / 2)) + ((bx + bw / 2) - (bx - bw / 2)) * ((by_ + bh / 2) - (by_ - bh / 2)) - {_I})"


@query("j9_assign_iou", f"""
WITH {ANCHORS}, {PX},
p AS (SELECT *, CASE WHEN {_U} > 0 THEN {_I} / {_U} ELSE 0 END AS iou FROM pb, an),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id, anchor_id ORDER BY iou DESC, box_id) AS k FROM p),
f AS (SELECT DISTINCT image_id, anchor_id FROM (SELECT image_id, anchor_id, row_number() OVER (PARTITION BY image_id, box_id ORDER BY iou DESC, anchor_id) AS k FROM p) WHERE k = 1),
s AS (SELECT b.*, CASE WHEN f.anchor_id IS NOT NULL OR iou >= 0.5 THEN 'positive' WHEN iou < 0.4 THEN 'negative' ELSE 'ignored' END AS state FROM b LEFT JOIN f USING (image_id, anchor_id) WHERE k = 1)
SELECT image_id, state, count(*) AS anchors, count(box_id) FILTER (state = 'positive') AS boxes, coalesce(sum(class_id) FILTER (state = 'positive'), 0) AS classes FROM s GROUP BY 1, 2
UNION ALL SELECT image_id, 'negative', 63, 0, 0 FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM fx_boxes)""")
def _(v):
    return _states(v, GRID)


def _states(v, anchors):
    """Counts by image and state; what is found is read once, and the negative anchors are the rest of each image's grid."""
    hit = F.col("state") == "positive"
    found = grid.assign_iou(_px(v), anchors).groupBy("image_id").agg(F.count(F.when(hit, 1)).alias("p"), F.count(F.when(~hit, 1)).alias("i"), F.count("box_id").alias("boxes"), F.coalesce(F.sum("class_id"), F.lit(0)).alias("classes"))
    wide = found.join(v("fx_images").select("image_id").distinct().withColumn("listed", F.lit(True)), "image_id", "full")
    none = F.lit(0).cast("bigint")
    state = lambda name, n, *own: F.struct(F.lit(name).alias("state"), n.alias("anchors"), *(c.alias(x) for c, x in zip(own or (none, none), ("boxes", "classes"), strict=True)))
    rest = F.when(F.col("listed"), F.lit(anchors.count) - F.coalesce("p", none) - F.coalesce("i", none))
    return wide.select("image_id", F.inline(F.array(state("positive", F.col("p"), F.col("boxes"), F.col("classes")), state("ignored", F.col("i")), state("negative", rest)))).where("anchors > 0")


@query("j10_assign_grid", f"""
WITH {ANCHORS}, {PX},
p AS (SELECT *, least(bw, aw) * least(bh, ah) / greatest(bw * bh + aw * ah - least(bw, aw) * least(bh, ah), 1e-6) AS fit FROM pb JOIN sc ON true JOIN (SELECT scale_no, anchor_id, ax, ay, aw, ah, gx, gy, r FROM an) a ON a.scale_no = sc.scale_no
  AND gx = least(greatest(CAST(trunc(bx / stride) AS INT), 0), n - 1) AND gy = least(greatest(CAST(trunc(by_ / stride) AS INT), 0), n - 1)),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY box_id, sc.scale_no ORDER BY fit DESC, r) = 1)
SELECT image_id, anchor_id, box_id, class_id, {ENC} FROM b QUALIFY row_number() OVER (PARTITION BY image_id, anchor_id ORDER BY box_id DESC) = 1""".replace("PARTITION BY box_id, sc.scale_no", "PARTITION BY box_id, off0"))
def _(v):
    return targets.assign_grid(_px(v), SIZE, CELLS, SCALES, RATIOS)


_TARGET = "CASE WHEN (image_id + anchor_id) % 5 = 0 THEN CAST((image_id + anchor_id) % 8 AS INT) END"


def _targeted(v):
    return v("fx_logits").withColumn("target", F.expr(_TARGET)).withColumn("weight", F.lit(1.5))


_LOSS = f"""
l AS (SELECT image_id, anchor_id, {_TARGET} AS target, unnest(cls) AS x, generate_subscripts(cls, 1) - 1 AS i FROM fx_logits),
e AS (SELECT image_id, anchor_id, target, x, CASE WHEN target = i THEN 1e0 ELSE 0e0 END AS t, 1 / (1 + exp(-x)) AS p FROM l),
f AS (SELECT image_id, anchor_id, target, sum((CASE WHEN t = 1 THEN 0.25e0 ELSE 0.75e0 END) * pow(1 - (CASE WHEN t = 1 THEN p ELSE 1 - p END), 2) * (greatest(x, 0) - x * t + ln(1 + exp(-abs(x))))) * CASE WHEN target IS NULL THEN 1 ELSE 1.5e0 END AS loss FROM e GROUP BY 1, 2, 3)"""


@query("a17_focal_score", f"WITH {_LOSS} SELECT image_id, anchor_id, loss FROM f")
def _(v):
    return targets.focal_score(_targeted(v)).select("image_id", "anchor_id", "loss")


_SCORE = f"""
WITH {_LOSS},
g AS (SELECT f.*, target IS NOT NULL AS positive, image_id % 16 AS batch, 200 + off[1] * 40 AS px, 200 + off[2] * 40 AS py, 200 + off[3] * 40 AS pw, 200 + off[4] * 40 AS ph FROM f JOIN fx_logits USING (image_id, anchor_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY batch, positive ORDER BY loss DESC, image_id * 8 + anchor_id) AS k, count(*) FILTER (positive) OVER (PARTITION BY batch) AS n, least(greatest(px - pw / 2, 0), 416) AS a0, least(greatest(py - ph / 2, 0), 416) AS a1, least(greatest(px + pw / 2, 0), 416) AS a2, least(greatest(py + ph / 2, 0), 416) AS a3 FROM g),
i AS (SELECT *, greatest(least(a2, 290e0) - greatest(a0, 110e0), 0) * greatest(least(a3, 280e0) - greatest(a1, 120e0), 0) AS inter, pow(greatest(a2, 290e0) - least(a0, 110e0), 2) + pow(greatest(a3, 280e0) - least(a1, 120e0), 2) + 1e-7 AS diagonal,
  pow(px - 200, 2) + pow(py - 200, 2) AS apart, 4 / pow(pi(), 2) * pow(atan(180e0 / 160) - atan(greatest(pw, 1e-6) / greatest(ph, 1e-6)), 2) AS v FROM k),
o AS (SELECT *, inter / ((a2 - a0) * (a3 - a1) + 180e0 * 160 - inter + 1e-7) AS iou FROM i),
t AS (SELECT batch, max(n) AS positives, sum(loss) FILTER (positive OR k <= 3 * greatest(n, 1)) AS c, coalesce(sum(least(greatest(1 - (iou - apart / diagonal - v / (1 - iou + v + 1e-7) * v), 0), 4)) FILTER (positive), 0) AS b FROM o GROUP BY 1)
SELECT batch, c / greatest(positives, 1) AS cls, b / greatest(positives, 1) AS box, (c + b) / greatest(positives, 1) AS total, positives FROM t"""


@query("a18_detection_score", _SCORE)
def _(v):
    scored = targets.focal_score(_targeted(v)).withColumn("positive", F.col("target").isNotNull()).withColumn("batch", F.col("image_id") % 16)
    spot = lambda k: F.lit(200.0) + F.get("off", F.lit(k)) * 40
    sized = scored.withColumns({"px": spot(0), "py": spot(1), "pw": spot(2), "ph": spot(3), "bx": F.lit(200.0), "by": F.lit(200.0), "bw": F.lit(180.0), "bh": F.lit(160.0)})
    return targets.detection_score(sized.withColumn("anchor_id", F.col("image_id") * 8 + F.col("anchor_id")))


_DEC = f"""
WITH {ANCHORS},
b AS (SELECT l.*, list_max(cls) AS m, CAST(list_position(cls, list_max(cls)) - 1 AS INT) AS class_id FROM fx_logits l),
d AS (SELECT image_id, anchor_id, class_id, 1 / (1 + exp(-m)) AS conf, off[1] * aw + ax AS x, off[2] * ah + ay AS y, exp(least(greatest(off[3], -8), 8)) * aw AS w_, exp(least(greatest(off[4], -8), 8)) * ah AS h_ FROM b JOIN an USING (anchor_id) WHERE 1 / (1 + exp(-m)) > 0.05)
SELECT image_id, anchor_id, class_id, conf, least(greatest(x - w_ / 2, 0), 416) AS x1, least(greatest(y - h_ / 2, 0), 416) AS y1, least(greatest(x + w_ / 2, 0), 416) AS x2, least(greatest(y + h_ / 2, 0), 416) AS y2 FROM d"""


@query("n1_decode", _DEC)
def _(v):
    return targets.decode_logits(v("fx_logits"), _anchors(v))


def _suppressed(views, rows, keys, out):
    """Suppression as a recursion over the predictions of a group in falling confidence."""
    inter = "(greatest(0, least(a.x2, r.x2) - greatest(a.x1, r.x1)) * greatest(0, least(a.y2, r.y2) - greatest(a.y1, r.y1)))"
    own, same = ", ".join(f"st.{k}" for k in keys), " AND ".join(f"r.{k} = st.{k}" for k in keys)
    return f"""
WITH RECURSIVE {views}r AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(keys)} ORDER BY conf DESC, pred_id) AS k FROM {rows}),
st AS (SELECT {", ".join(keys)}, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept, CAST(NULL AS VARCHAR) AS pred_id FROM (SELECT DISTINCT {", ".join(keys)} FROM r)
  UNION ALL SELECT {own}, r.k, CASE WHEN bad THEN kept ELSE list_append(kept, struct_pack(x1 := r.x1, y1 := r.y1, x2 := r.x2, y2 := r.y2)) END, CASE WHEN bad THEN NULL ELSE r.pred_id END
  FROM (SELECT {own}, st.kept, r.k AS nk, len(list_filter(st.kept, lambda a: {inter}
      > 0.45 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {inter}))) > 0 AS bad FROM st JOIN r ON {same} AND r.k = st.k + 1) st
  JOIN r ON {same} AND r.k = st.nk)
{out}"""


@query("n2_nms", _suppressed("", "fx_preds", ["image_id"], "SELECT pred_id FROM st WHERE pred_id IS NOT NULL"))
def _(v):
    return postproc.nms(v("fx_preds")).select("pred_id")


_BOTH = """b AS (SELECT image_id, pred_id, class_id, conf, x1, y1, x2, y2 FROM fx_preds UNION ALL
  SELECT image_id, concat('m', pred_id), class_id, conf, w - (w - x1 + 1) AS x1, y1, w - (w - x2 + 1) AS x2, y2 FROM fx_preds JOIN (SELECT image_id, width AS w FROM fx_images) USING (image_id) WHERE conf > 0.5), """
_MERGED = """SELECT pred_id, image_id, class_id, conf, x1, y1, x2, y2 FROM b WHERE pred_id IN (SELECT pred_id FROM st WHERE pred_id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, pred_id) <= 100"""


@query("n3_tta_merge", _suppressed(_BOTH, "b", ["image_id", "class_id"], _MERGED))
def _(v):
    preds, wide = v("fx_preds"), v("fx_images")
    mirrored = preds.where("conf > 0.5").join(wide.select("image_id", "width"), "image_id").selectExpr("image_id", "concat('m', pred_id) as pred_id", "class_id", "conf", "width - x2 + 1 as x1", "y1", "width - x1 + 1 as x2", "y2")
    return postproc.tta_merge(preds, mirrored, wide)


@query("n4_soft_nms")
def _(v):
    return postproc.soft_nms(v("fx_preds"))


_LINE = "printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)"


@query("n5_draft_labels", f"SELECT image_id, coalesce(lines, '') AS lines FROM (SELECT image_id FROM fx_images) LEFT JOIN (SELECT image_id, string_agg(line, chr(10) ORDER BY line) AS lines FROM (SELECT image_id, {_LINE} AS line FROM fx_preds JOIN (SELECT image_id, width, height FROM fx_images) USING (image_id) WHERE conf >= 0.5) GROUP BY 1) USING (image_id)")
def _(v):
    return postproc.drafts(v("fx_preds").where("conf >= 0.5"), v("fx_images"))


@query("w13_history_summary", """
WITH h AS (SELECT *, max(map50) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, max(map50) OVER (PARTITION BY run ORDER BY epoch) AS best FROM fx_history),
g AS (SELECT *, map50 > coalesce(b, 0) AS is_best, sum(CASE WHEN map50 > coalesce(b, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) AS grp FROM h)
SELECT run, epoch, greatest(best, 0) AS best, is_best, count(*) FILTER (NOT is_best) OVER (PARTITION BY run, grp ORDER BY epoch) AS streak, count(*) FILTER (NOT is_best) OVER (PARTITION BY run, grp ORDER BY epoch) >= 20 AS stopped FROM g""")
def _(v):
    return history.history_summary(v("fx_history")).select("run", "epoch", "best", "is_best", "streak", "stopped")


@query("w14_active_run", "SELECT max_by(run, (t, run)) AS run FROM (SELECT run, max(ts) AS t FROM fx_history GROUP BY 1)")
def _(v):
    files = v("fx_history").groupBy("run").agg(F.max("ts").alias("csv_mtime")).withColumn("dir_mtime", F.lit(None).cast("timestamp_ntz"))
    return history.active_run(files)


@query("p15_normalize_gpu", "SELECT event_id, CAST(trunc(cpu_util) AS INT) AS gpu_util_percent, round(CAST(trunc(vram_used_mb) AS INT) / 1024e0, 2) AS vram_used_gb, CASE WHEN event_id % 3 = 0 THEN 0 ELSE round(cpu_util, 1) END AS gpu_power_w FROM (SELECT event_id, round(cpu_util, 2) AS cpu_util, round(vram_used_mb, 2) AS vram_used_mb FROM fx_telemetry)")
def _(v):
    power = F.expr("if(event_id % 3 = 0, 'N/A', cast(round(cpu_util, 2) as string))")
    line = F.concat_ws(", ", F.round("cpu_util", 2), F.round("vram_used_mb", 2), F.lit("6144"), F.lit("60"), power, F.lit("1000"), F.lit("5000"))
    return v("fx_telemetry").select("event_id", history.normalize_gpu(line).alias("g")).select("event_id", "g.gpu_util_percent", "g.vram_used_gb", "g.gpu_power_w")


@query("t1_latest_snapshot", "SELECT run, cpu_util, vram_used_mb FROM fx_telemetry QUALIFY row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC) = 1")
def _(v):
    return history.latest_snapshot(v("fx_telemetry"))


@query("t3_ema", "SELECT run, sum(cpu_util * 0.1e0 * pow(0.9e0, k - 1)) AS smooth FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC) AS k FROM fx_telemetry) GROUP BY 1")
def _(v):
    return history.ema(v("fx_telemetry"))


@query("t4_failure_streak", "WITH g AS (SELECT run, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM fx_telemetry), s AS (SELECT run, g, count(*) FILTER (f) AS s FROM g GROUP BY 1, 2) SELECT run, max(s) AS longest, max(s) > 10 AS stopped FROM s GROUP BY 1")
def _(v):
    return history.failure_streak(v("fx_telemetry"), F.col("event_type") == "error")


_PLAN = """
WITH o(nm, p, chance, k1, lo1, hi1, k2, lo2, hi2, k3, lo3, hi3) AS (VALUES {rows}),
u AS (SELECT image_id, s.p, nm, chance, k1, lo1, hi1, k2, lo2, hi2, k3, lo3, hi3, md5(concat_ws('|', 'plan', '42', image_id, s.p, nm)) AS h FROM fx_images, (VALUES ('warm'), ('cool')) s(p) JOIN o ON o.p IS NULL OR o.p = s.p),
c AS (SELECT *, CAST(concat('0x', substring(h, 1, 6)) AS BIGINT) / 16777216e0 AS x, CAST(concat('0x', substring(h, 7, 6)) AS BIGINT) / 16777216e0 AS x1, CAST(concat('0x', substring(h, 13, 6)) AS BIGINT) / 16777216e0 AS x2, CAST(concat('0x', substring(h, 19, 6)) AS BIGINT) / 16777216e0 AS x3 FROM u),
d AS (SELECT *, {drawn} FROM c WHERE x < chance)
SELECT image_id, p AS pass, string_agg(concat(CASE WHEN nm = 'cast' THEN concat({cast}, '_cast') ELSE nm END, coalesce(':' || p1, ''), coalesce(':' || p2, ''), coalesce(':' || p3, '')), ',' ORDER BY nm = 'occlusion', substring(h, 7)) AS ops FROM d GROUP BY 1, 2"""
_DRAWN = ", ".join(f"CAST(floor((CASE k{n} WHEN 'u' THEN lo{n} + x{n} * (hi{n} - lo{n}) WHEN 'int' THEN lo{n} + floor(x{n} * (hi{n} - lo{n} + 1)) WHEN 'odd' THEN lo{n} + 2 * floor(x{n} * ((hi{n} - lo{n}) / 2 + 1)) END) * 1000) AS BIGINT) AS p{n}" for n in (1, 2, 3))
_NONE = "NULL, NULL, NULL"
_TRAIN = f"""('low_resolution', NULL, 1e0, 'u', 0.30e0, 0.65e0, {_NONE}, {_NONE}), ('cast', 'warm', 1, 'u', 0.65e0, 0.92e0, 'u', 0.90e0, 1.12e0, 'u', 1.05e0, 1.35e0), ('cast', 'cool', 1, 'u', 1.05e0, 1.30e0, 'u', 0.90e0, 1.05e0, 'u', 0.70e0, 0.95e0),
  ('brightness_contrast', NULL, 1, 'u', 0.50e0, 1.35e0, 'u', -55e0, 35e0, {_NONE}), ('noise', NULL, 1, 'u', 5e0, 28e0, {_NONE}, {_NONE}), ('vignette', NULL, 1, 'u', 0.30e0, 0.70e0, 'u', 0.38e0, 0.62e0, 'u', 0.38e0, 0.62e0),
  ('jpeg', NULL, 1, 'int', 22e0, 65e0, {_NONE}, {_NONE}), ('blur', NULL, 0.60e0, {_NONE}, {_NONE}, {_NONE}), ('motion_blur', NULL, 0.40e0, 'odd', 3e0, 9e0, 'int', 0e0, 1e0, {_NONE}), ('occlusion', NULL, 0.35e0, 'int', 0e0, 3e0, {_NONE}, {_NONE})"""
_HOLDOUT = f"""('low_resolution', NULL, 1e0, 'u', 0.32e0, 0.62e0, {_NONE}, {_NONE}), ('cast', NULL, 1, 'u', 0.72e0, 0.95e0, 'u', 0.95e0, 1.12e0, 'u', 1.05e0, 1.28e0),
  ('brightness_contrast', NULL, 1, 'u', 0.58e0, 1.28e0, 'u', -48e0, 28e0, {_NONE}), ('noise', NULL, 1, 'u', 6e0, 24e0, {_NONE}, {_NONE}), ('vignette', NULL, 1, 'u', 0.35e0, 0.65e0, 'u', 0.42e0, 0.58e0, 'u', 0.42e0, 0.58e0),
  ('jpeg', NULL, 1, 'int', 28e0, 62e0, {_NONE}, {_NONE}), ('blur', NULL, 0.60e0, {_NONE}, {_NONE}, {_NONE}), ('motion_blur', NULL, 0.35e0, 'odd', 3e0, 7e0, 'int', 0e0, 1e0, {_NONE}), ('occlusion', NULL, 0.35e0, 'int', 0e0, 3e0, {_NONE}, {_NONE})"""


def _plan(v, profile):
    plan = images.degrade_plan(sampling.webcam_plan(v("fx_images"), 1.0), profile=profile)
    whole = lambda p: F.floor(p * 1000).cast("string")
    return plan.select("image_id", "pass", F.array_join(F.transform("ops", lambda o: F.concat_ws(":", o["op"], whole(o["p1"]), whole(o["p2"]), whole(o["p3"]))), ",").alias("ops"))


@query("i3_degrade_plan", _PLAN.format(rows=_TRAIN, drawn=_DRAWN, cast="p"))
def _(v):
    return _plan(v, "train")


@query("i3_degrade_plan_holdout", _PLAN.format(rows=_HOLDOUT, drawn=_DRAWN, cast="'holdout'"))
def _(v):
    return _plan(v, "holdout")


@query("i1_content_hash", "SELECT doc_id, md5(coalesce(text, '')) AS content_md5 FROM documents")
def _(v):
    files = v("documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    return images.content_hash(files).select("doc_id", "content_md5")


@query("s10_label_texts", "SELECT image_id, split, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h), chr(10) ORDER BY printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h)) AS lines FROM fx_boxes JOIN fx_images USING (image_id) GROUP BY 1, 2")
def _(v):
    return sinks.label_texts(v("fx_boxes").join(v("fx_images").select("image_id", "split"), "image_id"))


@query("s17_assign_names", "SELECT image_id, concat(split, '_', lpad(CAST(row_number() OVER (PARTITION BY split ORDER BY content_md5, image_id) - 1 AS VARCHAR), 6, '0')) AS new_name FROM fx_images")
def _(v):
    return sinks.assign_names(v("fx_images").withColumn("path", F.concat_ws("|", "content_md5", F.lpad(F.col("image_id").cast("string"), 12, "0")))).select("image_id", "new_name")


@query("s11_manifest", "SELECT image_id AS original_image, md5, array_to_string(list_sort(list_distinct(list(CAST(raw_id AS VARCHAR)))), '|') AS raw_classes, array_to_string(list_sort(list_distinct(list(CAST(class_id AS VARCHAR)))), '|') AS mapped_classes, count(*) AS boxes FROM (SELECT b.*, content_md5 AS md5 FROM fx_boxes b JOIN fx_images USING (image_id)) GROUP BY 1, 2")
def _(v):
    images = v("fx_images").selectExpr("image_id", "source_id as source", "image_id as image", "'' as label", "'' as out_image", "'' as out_label", "content_md5 as md5", "'' as note")
    return sinks.manifest(v("fx_boxes").withColumnRenamed("raw_id", "raw_name").withColumnRenamed("class_id", "name"), images).select("original_image", "md5", "raw_classes", "mapped_classes", "boxes")
