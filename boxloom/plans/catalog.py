"""All queries over the given tables, with the SQL that states the same result.

Two engines add and multiply doubles in different orders, so results that are doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.plans import box_queries, eval_queries, model_queries, set_queries, stream_queries  # noqa: F401  they register their queries

#: Columns of doubles by query.
DOUBLES = {
    "s2_labels_strict": "cx cy w h",
    "s2_labels_raw": "cx cy w h",
    "s2_labels_validated": "cx cy w h",
    "s2_labels_lenient": "cx cy w h",
    "a2_class_balance": "share ratio",
    "a6_tiny_report": "removed_percent",
    "a7_size_summary": "mean_area median_area",
    "a8_style_audit": "value",
    "a9_class_weights": "weight",
    "g1_corners": "x1 y1 x2 y2",
    "g2_iou": "iou",
    "g3_ciou_loss": "loss",
    "g4_offsets": "tx ty tw th bx bw",
    "g5_flip": "flipped_x flipped_y",
    "g6_rotate": "ncx ncy nw nh",
    "g7_mosaic": "x1 y1 x2 y2",
    "g8_rescale": "x1 y1 x2 y2",
    "g9_pixel_boxes": "cx cy w h",
    "g10_sizes": "px_w px_h area_percent",
    "j7_match": "iou",
    "a11_prf": "precision recall f1",
    "a12_threshold_sweep": "threshold precision recall f1",
    "a13_size_bucket_recall": "recall",
    "a14_dashboard": "recall fn_rate",
    "a15_average_precision": "iou ap",
    "j10_assign_grid": "tx ty tw th",
    "a17_focal_score": "loss",
    "a18_detection_score": "cls box total",
    "n1_decode": "conf x1 y1 x2 y2",
    "n3_tta_merge": "conf x1 y1 x2 y2",
    "w13_history_summary": "best",
    "p15_normalize_gpu": "vram_used_gb gpu_power_w",
    "t1_latest_snapshot": "cpu_util vram_used_mb",
    "t3_ema": "smooth",
    "t3_ema_stream": "smooth",
    "t1_snapshot_stream": "cpu_util vram_used_mb",
    "t5_detect_stream": "conf x1",
}


def _rounded(query, columns):
    def run(spark, sf_dir):
        return query(spark, sf_dir).withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def _rounded_sql(sql, columns):
    return f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), 6) + 0 AS {c}' for c in columns)}) FROM ({sql})"


QUERIES: dict = {n: _rounded(f, DOUBLES[n].split()) if n in DOUBLES else f for n, f in box_queries.QUERIES.items()}
ORACLES: dict = {n: _rounded_sql(sql, DOUBLES[n].split()) if n in DOUBLES else sql for n, sql in box_queries.ORACLES.items()}
