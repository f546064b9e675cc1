"""Views over the given tables that stand for images, boxes, predictions, hashes, logits, run histories and telemetry.

Each is one SQL text that Spark and DuckDB both run; where their functions differ there are two.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BOTH = {
    "fx_images": """
SELECT o_orderkey AS image_id, o_custkey % 11 AS source_id,
  CASE WHEN o_orderkey % 20 < 14 THEN 'train' WHEN o_orderkey % 20 < 17 THEN 'valid' ELSE 'test' END AS split,
  320 + 32 * (o_custkey % 31) AS width, 240 + 24 * (o_orderkey % 37) AS height,
  md5(concat_ws('|', 'c', CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 707 ELSE o_orderkey END)) AS content_md5
FROM {orders}""",
    "fx_boxes": """
SELECT image_id, md5(concat_ws('|', image_id, l_linenumber, l_partkey, l_suppkey, cents)) AS box_id,
  CAST(CASE WHEN cents % 11 < 4 THEN 0 WHEN cents % 11 < 6 THEN 2 ELSE l_suppkey % 8 END AS INT) AS class_id,
  (l_partkey * 37 % 1050) / 1e3 AS cx, (l_suppkey * 53 % 1000) / 1e3 AS cy,
  q * q / 2.5e3 AS w, (cents % 997 + 1) / 9.97e2 AS h, cents, CAST(l_suppkey % 12 AS INT) AS raw_id
FROM (SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, l_quantity AS q,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM {lineitem})""",
    "fx_preds": """
SELECT b.image_id, md5(concat_ws('|', 'p', b.box_id)) AS pred_id,
  CAST(CASE WHEN cents % 13 = 0 THEN (class_id + 1) % 8 ELSE class_id END AS INT) AS class_id,
  (cents % 1000) / 1e3 AS conf,
  (cx + (cents % 7 - 3) / 5e1 * w - w / 2) * i.width AS x1, (cy - h / 2) * i.height AS y1,
  (cx + (cents % 7 - 3) / 5e1 * w + w / 2) * i.width AS x2, (cy + h / 2) * i.height AS y2
FROM {fx_boxes} b JOIN {fx_images} i ON i.image_id = b.image_id WHERE cents % 10 < 8""",
    "fx_label_lines": """
SELECT image_id, cents AS line_no, CASE
    WHEN cents % 29 = 0 THEN concat(class_id, ' 0.5 0.5')
    WHEN cents % 31 = 0 THEN concat('x', class_id, ' 0.5 0.5 0.1 0.1')
    WHEN cents % 37 = 0 THEN concat(class_id, '.0 0.5 0.5 0.1 0.1')
    WHEN cents % 41 = 0 THEN concat(class_id, ' 0.5 0.5 0.1 0.1 0.9')
    ELSE concat(class_id, ' 0.', lpad(CAST(cents % 1000000 AS STRING), 6, '0'), ' 0.', lpad(CAST(cents * 7 % 1000000 AS STRING), 6, '0'), ' 0.25 0.125') END AS line
FROM {fx_boxes}""",
    "fx_docs": """
SELECT doc_id AS item_id, source, md5(text) AS content_md5, n_chars,
  CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'valid' ELSE 'test' END AS split FROM {documents}""",
    "fx_history": """
SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS map50, ts
FROM {events} WHERE event_type = 'view'""",
    "fx_telemetry": """
SELECT event_id, user_id AS run, ts, event_type, value AS cpu_util, value * 40 AS vram_used_mb FROM {events}""",
    "fx_names": """
SELECT p_partkey AS name_id, concat(CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'Bad_Apple ' WHEN 1 THEN 'orange fruit' WHEN 2 THEN 'pineapple slice' WHEN 3 THEN ' Grape '
    WHEN 4 THEN 'kiwi ' WHEN 5 THEN 'Good_Mango-ripe/' WHEN 6 THEN 'WaterMelon' WHEN 7 THEN 'banana_skip' ELSE p_name END,
  CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '0-1 day' WHEN 1 THEN ' overripe  x' WHEN 2 THEN '' ELSE '_ 2' END) AS name FROM {part}""",
}
SPARK = BOTH | {
    "fx_hash64": """
SELECT vec_id AS item_id, label AS class_id, CASE WHEN vec_id % 20 < 14 THEN 'train' WHEN vec_id % 20 < 17 THEN 'valid' ELSE 'test' END AS split,
  transform(array(array_sort(slice(embedding, 2, 63))[31]), m -> aggregate(sequence(1, 63), 0L, (acc, i) -> acc * 2 + IF(embedding[i] > m, 1L, 0L)))[0] AS h FROM {embeddings}""",
    "fx_near": """
SELECT item_id, class_id, split, h FROM {fx_hash64} UNION ALL
SELECT item_id + 1000000, class_id, CASE split WHEN 'train' THEN 'valid' WHEN 'valid' THEN 'test' ELSE 'train' END,
  h ^ (shiftleft(1L, CAST(item_id % 12 AS INT)) - 1) FROM {fx_hash64}""",
    "fx_logits": """
SELECT vec_id AS image_id, a AS anchor_id, transform(slice(embedding, a * 8 + 1, 8), x -> cast(x AS double)) AS cls, transform(slice(embedding, (a + 1) % 8 * 8 + 1, 4), x -> cast(x AS double)) AS off
FROM {embeddings} LATERAL VIEW explode(sequence(0, 7)) t AS a""",
}
DUCK = BOTH | {
    "fx_hash64": """
SELECT vec_id AS item_id, label AS class_id, CASE WHEN vec_id % 20 < 14 THEN 'train' WHEN vec_id % 20 < 17 THEN 'valid' ELSE 'test' END AS split,
  list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(embedding[2:64], lambda e: CAST(e > list_sort(embedding[2:64])[32] AS BIGINT))), lambda a, b: a * 2 + b) AS h FROM {embeddings}""",
    "fx_near": """
SELECT item_id, class_id, split, h FROM {fx_hash64} UNION ALL
SELECT item_id + 1000000, class_id, CASE split WHEN 'train' THEN 'valid' WHEN 'valid' THEN 'test' ELSE 'train' END,
  xor(h, (CAST(1 AS BIGINT) << CAST(item_id % 12 AS INT)) - 1) FROM {fx_hash64}""",
    "fx_logits": """
SELECT vec_id AS image_id, CAST(a AS INT) AS anchor_id, CAST(embedding[a * 8 + 1 : a * 8 + 8] AS DOUBLE[]) AS cls, CAST(embedding[(a + 1) % 8 * 8 + 1 : (a + 1) % 8 * 8 + 4] AS DOUBLE[]) AS off
FROM {embeddings}, range(0, 8) t(a)""",
}
_NEEDS = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a given table by its name."""
    if name not in SPARK:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SPARK[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in set(_NEEDS.findall(sql))})


def with_views(sql: str) -> str:
    """DuckDB SQL with the fixture views that it names put before it as common table expressions."""
    order: list[str] = []

    def add(name):
        for n in _NEEDS.findall(DUCK[name]):
            if n in DUCK and n not in order:
                add(n)
        if name not in order:
            order.append(name)

    for name in dict.fromkeys(re.findall(r"\bfx_\w+", sql)):
        add(name)
    ctes = ",\n".join(f"{n} AS ({DUCK[n].replace('{', '').replace('}', '')})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}" if ctes else body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}" if ctes else body
    return f"WITH {ctes}\n{body}" if ctes else body
