"""Queries for evaluation, with the SQL that states the same results.

SQL walks the predictions of an image and class with a recursive term, one prediction at a time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.operators import evaluate as e
from boxloom.plans.box_queries import IOU_SQL, UNION_SQL, query

CONF = 0.25
PAIRS = f"""
g AS (SELECT b.image_id, b.class_id, box_id, (cx - w / 2) * width AS x1, (cy - h / 2) * height AS y1, (cx + w / 2) * width AS x2, (cy + h / 2) * height AS y2 FROM fx_boxes b JOIN fx_images USING (image_id)),
pr AS (SELECT a.image_id, a.class_id, a.pred_id, a.conf, b.box_id, CASE WHEN {UNION_SQL} > 0 THEN {IOU_SQL} / {UNION_SQL} ELSE 0 END AS iou FROM fx_preds a JOIN g b ON a.image_id = b.image_id AND a.class_id = b.class_id)"""


def walk(least: float, conf: float) -> str:
    """m(image_id, class_id, pred_id, box_id, iou): greedy matches of predictions from conf on."""
    return f"""WITH RECURSIVE {PAIRS},
o AS (SELECT image_id, class_id, pred_id, dense_rank() OVER (PARTITION BY image_id, class_id ORDER BY conf DESC, pred_id) AS k, list(struct_pack(o := -iou, box_id := box_id) ORDER BY -iou, box_id) AS options FROM pr WHERE iou >= {least} AND conf >= {conf} GROUP BY image_id, class_id, pred_id, conf),
st AS (SELECT image_id, class_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS pred_id, CAST(NULL AS VARCHAR) AS box_id, CAST(NULL AS DOUBLE) AS iou FROM (SELECT DISTINCT image_id, class_id FROM o)
  UNION ALL SELECT st.image_id, st.class_id, o.k, CASE WHEN f IS NULL THEN used ELSE list_append(used, f.box_id) END, o.pred_id, f.box_id, -f.o
  FROM (SELECT st.*, o.k AS nk, o.pred_id AS np, list_filter(o.options, lambda x: NOT list_contains(st.used, x.box_id))[1] AS f FROM st JOIN o ON o.image_id = st.image_id AND o.class_id = st.class_id AND o.k = st.k + 1) st
  JOIN o ON o.image_id = st.image_id AND o.class_id = st.class_id AND o.k = st.nk),
m AS (SELECT image_id, class_id, pred_id, box_id, iou FROM st WHERE box_id IS NOT NULL)"""


def _strong(v, conf=CONF):
    return v("fx_preds").where(F.col("conf") >= conf)


def _hits(v):
    return e.match(_strong(v), v("fx_boxes"), v("fx_images"))


@query("j7_match", walk(0.45, CONF) + " SELECT pred_id, box_id, iou FROM m")
def _(v):
    return _hits(v).select("pred_id", "box_id", "iou")


@query("j8_rescue", walk(0.45, CONF) + f" SELECT box_id FROM fx_boxes WHERE box_id NOT IN (SELECT box_id FROM m) AND box_id IN (SELECT box_id FROM pr WHERE iou >= 0.45 AND conf >= 0.1 AND conf < {CONF})")
def _(v):
    low = v("fx_preds").where((F.col("conf") >= 0.1) & (F.col("conf") < CONF))
    # what no strong prediction matched, of the boxes that weak ones overlap: the same rows as rescue(missed_boxes), with one shuffle of the boxes
    return e.missed_boxes(e.rescued(v("fx_boxes"), low, v("fx_images")), _hits(v)).select("box_id")


_PRF = """
SELECT {keys}class_id, tp, said - tp AS fp, there - tp AS fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1
FROM (SELECT *, CASE WHEN said > 0 THEN tp / CAST(said AS DOUBLE) ELSE 0 END AS p, CASE WHEN there > 0 THEN tp / CAST(there AS DOUBLE) ELSE 0 END AS r FROM counts)"""


@query("a11_prf", walk(0.45, CONF) + f""",
counts AS (SELECT class_id, coalesce(tp, 0) AS tp, coalesce(said, 0) AS said, there FROM (SELECT class_id, count(*) AS there FROM fx_boxes GROUP BY 1)
  LEFT JOIN (SELECT class_id, count(*) AS tp FROM m GROUP BY 1) USING (class_id) LEFT JOIN (SELECT class_id, count(*) AS said FROM fx_preds WHERE conf >= {CONF} GROUP BY 1) USING (class_id))""" + _PRF.format(keys=""))
def _(v):
    return e.prf(_hits(v), _strong(v), v("fx_boxes"))


@query("a12_threshold_sweep", walk(0.45, 0.0) + """,
t AS (SELECT unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0]) AS threshold),
counts AS (SELECT threshold, class_id, coalesce(tp, 0) AS tp, coalesce(said, 0) AS said, there FROM t CROSS JOIN (SELECT class_id, count(*) AS there FROM fx_boxes GROUP BY 1) c
  LEFT JOIN (SELECT threshold, m.class_id, count(*) AS tp FROM m JOIN fx_preds USING (pred_id) JOIN t ON conf >= threshold GROUP BY 1, 2) USING (threshold, class_id)
  LEFT JOIN (SELECT threshold, class_id, count(*) AS said FROM fx_preds JOIN t ON conf >= threshold GROUP BY 1, 2) USING (threshold, class_id))""" + _PRF.format(keys="threshold, "))
def _(v):
    return e.threshold_sweep(v("fx_preds"), v("fx_boxes"), v("fx_images"))


@query("a13_size_bucket_recall", walk(0.45, CONF) + " SELECT CASE WHEN w * h * 100 < 2 THEN 'tiny' WHEN w * h * 100 < 5 THEN 'small' WHEN w * h * 100 < 15 THEN 'medium' ELSE 'large' END AS bucket, class_id, count(*) FILTER (box_id IN (SELECT box_id FROM m)) AS tp, count(*) FILTER (box_id NOT IN (SELECT box_id FROM m)) AS fn, count(*) FILTER (box_id IN (SELECT box_id FROM m)) / CAST(count(*) AS DOUBLE) AS recall, count(*) FILTER (box_id IN (SELECT box_id FROM m)) / CAST(count(*) AS DOUBLE) < 0.4 AS flagged FROM fx_boxes GROUP BY 1, 2")
def _(v):
    return e.size_bucket_recall(v("fx_boxes"), _hits(v))


@query("a14_dashboard", walk(0.45, CONF) + """,
c AS (SELECT b.class_id, count(*) AS there, coalesce(any_value(tp), 0) AS tp FROM fx_boxes b LEFT JOIN (SELECT class_id, count(*) AS tp FROM m GROUP BY 1) h ON h.class_id = b.class_id GROUP BY 1)
SELECT class_id, round(tp / CAST(there AS DOUBLE), 4) AS recall, round((there - tp) / CAST(there AS DOUBLE), 4) AS fn_rate, round(tp / CAST(there AS DOUBLE), 4) < 0.55 AS flagged FROM c""")
def _(v):
    return e.dashboard(e.prf(_hits(v), _strong(v), v("fx_boxes")))


@query("a15_average_precision", walk(0.5, 0.0) + """,
r AS (SELECT p.class_id, p.pred_id, p.conf, CASE WHEN m.pred_id IS NULL THEN 0 ELSE 1 END AS tp, row_number() OVER (PARTITION BY p.class_id ORDER BY p.conf DESC, p.pred_id) AS k FROM fx_preds p LEFT JOIN m USING (pred_id)),
n AS (SELECT class_id, count(*) AS there FROM fx_boxes GROUP BY 1),
c AS (SELECT r.class_id, k, sum(tp) OVER (PARTITION BY r.class_id ORDER BY k) AS c, there FROM r JOIN n USING (class_id)),
q AS (SELECT class_id, c / CAST(k AS DOUBLE) AS p, c * 100 AS c100, there FROM c)
SELECT 0.5e0 AS iou, class_id, sum(best) / 101 AS ap FROM (SELECT n.class_id, g, coalesce(max(p), 0) AS best FROM n CROSS JOIN range(0, 101) t(g) LEFT JOIN q ON q.class_id = n.class_id AND c100 >= g * n.there GROUP BY 1, 2) GROUP BY 2""")
def _(v):
    return e.average_precision(v("fx_preds"), v("fx_boxes"), v("fx_images"), (0.5,))


@query("w12_failure_samples", walk(0.45, CONF) + f""",
lost AS (SELECT b.class_id, b.box_id, b.image_id, b.box_id IN (SELECT box_id FROM pr WHERE iou >= 0.45 AND conf >= 0.1 AND conf < {CONF}) AS seen FROM fx_boxes b WHERE box_id NOT IN (SELECT box_id FROM m)),
told AS (SELECT *, coalesce(count(*) FILTER (NOT seen) OVER (PARTITION BY class_id ORDER BY image_id, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lost),
wrong AS (SELECT class_id, pred_id, image_id FROM fx_preds WHERE conf >= {CONF} AND pred_id NOT IN (SELECT pred_id FROM m) QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY image_id, pred_id) <= 60),
fine AS (SELECT image_id, min_by(class_id, box_id) AS class_id FROM fx_boxes WHERE image_id IN (SELECT image_id FROM m) GROUP BY 1)
SELECT CASE WHEN seen THEN 'low_conf' ELSE 'fn' END AS kind, class_id, box_id AS item, image_id FROM told WHERE before < 60
UNION ALL SELECT 'fp', class_id, pred_id, image_id FROM wrong
UNION ALL SELECT 'ok', class_id, CAST(image_id AS VARCHAR), image_id FROM (SELECT * FROM fine QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY image_id) <= 20)""")
def _(v):
    return e.failure_samples(v("fx_preds"), v("fx_boxes"), v("fx_images"), CONF)
