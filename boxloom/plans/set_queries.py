"""Queries for duplicates, leakage, splits and samples, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.operators import dedup, sampling
from boxloom.plans.box_queries import query


@query("d1_dedup_exact", "SELECT image_id FROM fx_images QUALIFY row_number() OVER (PARTITION BY content_md5 ORDER BY source_id, image_id) = 1")
def _(v):
    return dedup.dedup_exact(v("fx_images")).select("image_id")


@query("d2_dedup_prefix", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(substring(text, 1, 64)) ORDER BY doc_id) = 1")
def _(v):
    return dedup.dedup_prefix(v("documents").select("doc_id", "text"), 64, "text", ("doc_id",)).select("doc_id")


@query("d3_dedup_path", "SELECT DISTINCT source_id AS source, image_id % 1000 AS path FROM fx_images")
def _(v):
    return dedup.dedup_path(v("fx_images").selectExpr("source_id as source", "image_id % 1000 as path"))


@query("j1_leak_exact", "SELECT content_md5, list_sort(list(DISTINCT split)) AS splits, count(*) AS items FROM fx_images GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _(v):
    return dedup.leak_exact(v("fx_images"))


@query("j1_leak_exact_documents", "SELECT content_md5, list_sort(list(DISTINCT split)) AS splits, count(*) AS items FROM fx_docs GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _(v):
    return dedup.leak_exact(v("fx_docs"))


NEAR = """
SELECT a.split AS left_split, a.item_id AS "left", b.split AS right_split, b.item_id AS "right", CAST(bit_count(xor(a.h, b.h)) AS INT) AS dist FROM fx_near a JOIN fx_near b
ON (a.split = 'train' AND b.split IN ('valid', 'test') OR a.split = 'valid' AND b.split = 'test') AND bit_count(xor(a.h, b.h)) <= 8"""


@query("j2_leak_near", NEAR)
def _(v):
    return dedup.leak_near(v("fx_near"))


@query("j3_removals_exact", "SELECT item_id FROM (SELECT item_id, split, count(DISTINCT split) OVER (PARTITION BY content_md5) AS n, bool_or(split = 'train') OVER (PARTITION BY content_md5) AS t FROM fx_docs) WHERE n > 1 AND split = CASE WHEN t THEN 'train' ELSE 'valid' END")
def _(v):
    return dedup.removals_exact(v("fx_docs"))


@query("j4_removals_near", f'SELECT DISTINCT "left" AS item_id FROM ({NEAR.replace("WITH", "")})')
def _(v):
    return dedup.removals_near(v("fx_near"))


@query("j5_quarantine", "SELECT image_id FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM (SELECT image_id, split, count(DISTINCT split) OVER (PARTITION BY content_md5) AS n, bool_or(split = 'train') OVER (PARTITION BY content_md5) AS t FROM fx_images) WHERE n > 1 AND split = CASE WHEN t THEN 'train' ELSE 'valid' END)")
def _(v):
    images = v("fx_images")
    return dedup.quarantine(images, dedup.removals_exact(images, item="image_id"))[0].select("image_id")


@query("j6_reject_near", "SELECT item_id FROM fx_near c WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM fx_near f WHERE f.split <> 'train' AND bit_count(xor(c.h, f.h)) <= 8)")
def _(v):
    near = v("fx_near")
    return dedup.reject_near(near.where("split = 'train'"), near.where("split <> 'train'")).select("item_id")


@query("w1_stratified_split", """
WITH c AS (SELECT DISTINCT image_id, class_id FROM fx_boxes),
r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY md5(concat_ws('|', '42', class_id, image_id)), image_id) AS i, count(*) OVER (PARTITION BY class_id) AS n FROM c),
s AS (SELECT image_id, class_id, CASE WHEN i <= greatest(1, floor(n * 0.7e0)) THEN 'train' WHEN i <= greatest(1, floor(n * 0.7e0)) + greatest(1, floor(n * 0.15e0)) THEN 'valid' ELSE 'test' END AS split FROM r)
SELECT image_id, coalesce(split, 'train') AS split FROM fx_images LEFT JOIN (SELECT image_id, min_by(split, class_id) AS split FROM s GROUP BY 1) d USING (image_id)""".replace("fx_images LEFT JOIN", "(SELECT image_id FROM fx_images) LEFT JOIN"))
def _(v):
    return sampling.stratified_split(v("fx_images"), v("fx_boxes"))


@query("w2_ratio_split", "SELECT image_id, CASE WHEN k <= floor(n * 0.7e0) THEN 'train' WHEN k <= floor(n * 0.7e0) + floor(n * 0.2e0) THEN 'valid' ELSE 'test' END AS split FROM (SELECT image_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', image_id)), image_id) AS k, count(*) OVER () AS n FROM fx_images)")
def _(v):
    return sampling.ratio_split(v("fx_images"))


@query("w3_cap_per_source", "SELECT image_id FROM fx_images QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY md5(concat_ws('|', '42', image_id)), image_id) <= 500")
def _(v):
    return sampling.cap_per_source(v("fx_images"), 500).select("image_id")


def _below(keep, limit):
    return f"""
WITH p AS (SELECT image_id, class_id, count(*) AS n FROM fx_boxes GROUP BY 1, 2), k AS ({keep}),
b AS (SELECT class_id, sum(n) AS base FROM p WHERE image_id IN (SELECT image_id FROM k) GROUP BY 1),
r AS (SELECT image_id, class_id, coalesce(sum(n) OVER (PARTITION BY class_id ORDER BY md5(concat_ws('|', '42', image_id)), image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE image_id NOT IN (SELECT image_id FROM k)),
t AS (SELECT image_id FROM r LEFT JOIN b USING (class_id) GROUP BY 1 HAVING min(coalesce(base, 0) + before) < {limit})
SELECT image_id FROM k UNION ALL SELECT image_id FROM t"""


@query("w4_balance", _below("SELECT DISTINCT image_id FROM fx_boxes WHERE class_id IN (SELECT class_id FROM fx_boxes GROUP BY 1 HAVING count(*) < 12000)", 12000))
def _(v):
    return sampling.balance(v("fx_boxes"))


@query("w5_greedy_cap", _below("SELECT DISTINCT image_id FROM fx_boxes WHERE class_id IN (3, 4, 5, 7)", 12000))
def _(v):
    return sampling.greedy_cap(v("fx_boxes"))


def _topup(views, target, most, least, most_ops, ops, passes, near=None):
    """The rounds of a top-up written out: d is what the neediest class still lacks, q its queue up to that, t all copies so far.

    The queue has `passes` times as many passes as it needs without rejections; near is a condition on (p, k) that rejects a copy.
    """
    rounds = []
    for j in range(1, 9):
        rounds.append(f"""
d{j} AS MATERIALIZED (SELECT class_id, had, {target} - had - coalesce((SELECT sum(p.n) FROM t{j - 1} t JOIN p ON p.image_id = t.image_id AND p.class_id = o.class_id), 0) AS need, {most} - (SELECT count(*) FROM t{j - 1}) AS lft FROM o WHERE r = {j}),
e{j} AS (SELECT p.*, k, md5(concat_ws('|', '42', p.class_id, k, p.image_id)) AS t, need, lft, {f"CAST(NOT ({near}) AS INT)" if near else "1"} AS ok FROM d{j} d JOIN p ON p.class_id = d.class_id, LATERAL (SELECT unnest(range(1, CAST({passes} AS BIGINT) + 1)) AS k) g WHERE need > 0),
q{j} AS MATERIALIZED (SELECT class_id, image_id, t, nth FROM (SELECT *, coalesce(sum(n * ok) OVER w, 0) AS s, coalesce(sum(ok) OVER w, 0) AS nth FROM e{j} WINDOW w AS (ORDER BY k, t, image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE s < need AND nth < lft AND ok = 1),
t{j} AS MATERIALIZED (SELECT * FROM t{j - 1} UNION ALL SELECT * FROM q{j})""")
    shuffled = f"list_transform(list_sort(list_transform({list(ops)!r}, lambda x: concat(md5(concat_ws('|', t, x)), x))), lambda x: substring(x, 33))"
    return f"""
WITH {views}, o AS (SELECT class_id, sum(n) AS had, row_number() OVER (ORDER BY sum(n), class_id) AS r FROM p GROUP BY 1),
t0 AS (SELECT class_id, image_id, '' AS t, CAST(0 AS HUGEINT) AS nth FROM p WHERE false),{",".join(rounds)}
SELECT concat('aug_', class_id, '_', lpad(CAST(nth AS VARCHAR), 6, '0')) AS new_id, class_id, image_id, list_slice({shuffled}, 1, {least} + CAST(concat('0x', substring(t, 29, 4)) AS BIGINT) % {most_ops - least + 1}) AS ops FROM t8"""


_PER = "p AS (SELECT image_id, class_id, count(*) AS n FROM fx_boxes GROUP BY 1, 2)"


@query("w6_topup_plan", _topup(_PER, 4000, 4000, 1, 3, ("brightness", "noise", "blur", "hflip"), "ceil(need / had)"))
def _(v):
    return sampling.topup_plan(v("fx_boxes"), 4000)


@query("w7_topup_floor", _topup(_PER, 5000, 60000, 2, 4, ("brightness", "noise", "blur", "hflip", "rotate"), "ceil(need / had)"))
def _(v):
    return sampling.topup_floor(v("fx_boxes"), 5000)


_VECTORS = """f AS (SELECT DISTINCT h FROM fx_near WHERE split <> 'train'), c AS (SELECT item_id AS image_id, class_id % 8 AS class_id, h FROM fx_hash64 WHERE split = 'train'),
p AS (SELECT CAST(image_id AS BIGINT) AS image_id, CAST(class_id AS INT) AS class_id, h, 1 AS n FROM c WHERE class_id IS NOT NULL)"""
_NEAR_COPY = "EXISTS (SELECT 1 FROM f WHERE bit_count(xor(f.h, xor(p.h, ((CAST(1 AS BIGINT) << CAST((k * 7 + p.image_id) % 12 AS INT)) - 1) << 20))) <= 8)"


@query("w6_topup_near", _topup(_VECTORS, "(SELECT count(*) // 6 FROM p)", 100000, 1, 3, ("brightness", "noise", "blur", "hflip"), "4 * ceil(need / had) + 12", _NEAR_COPY))
def _(v):
    """Vectors as images of one box; a copy's hash is its image's with some bits of the middle flipped, and many are near the held-out ones."""
    items = v("fx_hash64").where("split = 'train' and class_id is not null").selectExpr("cast(item_id as bigint) as image_id", "cast(class_id % 8 as int) as class_id", "h")
    items = sampling._written(items, "items")  # each stretch of the queue reads them
    flips = F.expr("shiftleft(shiftleft(1L, cast((k * 7 + image_id) % 12 as int)) - 1, 20)")
    hashed = lambda copies: copies.join(items.select("image_id", "h"), "image_id", "left").withColumn("h", F.col("h").bitwiseXOR(flips))
    return sampling.topup_plan(items.select("image_id", "class_id"), items.count() // 6, 100_000, hashed=hashed, forbidden=v("fx_near").where("split <> 'train'").select("h"))


def _holdout(views, per_class):
    """The rounds of a balanced sample written out: c is chosen after each class, then u is chosen and reused images."""
    count = lambda t, j: f"(SELECT count(*) FROM {t} t JOIN p ON p.image_id = t.image_id WHERE p.class_id = {j})"
    rounds = []
    for j in range(8):
        rounds.append(f"""
c{j + 1} AS MATERIALIZED (SELECT * FROM c{j} UNION ALL SELECT image_id, 0 FROM (SELECT image_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', class_id, image_id)), image_id) AS i FROM p WHERE class_id = {j} AND image_id NOT IN (SELECT image_id FROM c{j})) WHERE i <= {per_class} - {count(f"c{j}", j)})""")
    for j in range(8):
        rounds.append(f"""
f{j} AS MATERIALIZED (SELECT *, count(*) OVER () AS have FROM (SELECT image_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'fill', class_id, image_id)), image_id) AS i FROM p WHERE class_id = {j}) WHERE i <= {per_class}),
u{j + 1} AS MATERIALIZED (SELECT * FROM u{j} UNION ALL SELECT image_id, copy FROM f{j}, (SELECT unnest(range(1, {per_class} + 1)) AS copy) WHERE (copy - 1) * have + i <= {per_class} - {count(f"u{j}", j)})""")
    return f"""
WITH {views}, c0 AS (SELECT image_id, 0 AS copy FROM p WHERE false),{",".join(rounds[:8])}, u0 AS (SELECT * FROM c8),{",".join(rounds[8:])}
SELECT image_id, CAST(copy AS INT) AS copy FROM u8"""


@query("w8_sample_balanced", _holdout("p AS (SELECT DISTINCT image_id, class_id FROM fx_boxes)", 20))
def _(v):
    return sampling.sample_balanced(v("fx_boxes"))


@query("w8_sample_refilled", _holdout("p AS (SELECT DISTINCT CAST(item_id AS BIGINT) AS image_id, CAST(class_id % 8 AS INT) AS class_id FROM fx_hash64 WHERE class_id IS NOT NULL)", 150))
def _(v):
    """Vectors as images of one box each; classes with fewer than the sample asks for have theirs reused."""
    return sampling.sample_balanced(v("fx_hash64").where("class_id is not null").selectExpr("cast(item_id as bigint) as image_id", "cast(class_id % 8 as int) as class_id"), 150)


@query("w9_priority_sample", """
WITH c AS (SELECT DISTINCT image_id, class_id FROM fx_boxes WHERE class_id IN (3, 4, 5, 7)),
f AS (SELECT image_id, min(list_position([4, 5, 7, 3], class_id) * 1000000 + k) AS o FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY md5(concat_ws('|', '42', class_id, image_id)), image_id) AS k FROM c) WHERE k <= 25 GROUP BY 1),
a AS (SELECT i.image_id, o FROM fx_images i LEFT JOIN f USING (image_id))
SELECT image_id FROM a ORDER BY o NULLS LAST, md5(concat_ws('|', '42', image_id)), image_id LIMIT 200""")
def _(v):
    return sampling.priority_sample(v("fx_images"), v("fx_boxes"), 200)


@query("w10_webcam_plan", "WITH r AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', image_id)), image_id) AS k, greatest(1, floor(count(*) OVER () * 0.4e0)) AS n FROM fx_images) SELECT CAST(p * n + k - 1 AS BIGINT) AS new_index, image_id, pass FROM r, (VALUES (0, 'warm'), (1, 'cool')) s(p, pass) WHERE k <= n")
def _(v):
    return sampling.webcam_plan(v("fx_images"))


@query("w11_label_queue", """
WITH d AS (SELECT image_id, source_id FROM fx_images QUALIFY row_number() OVER (PARTITION BY content_md5 ORDER BY source_id, image_id) = 1),
q AS (SELECT image_id FROM d QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY md5(concat_ws('|', '42', image_id)), image_id) <= 300)
SELECT image_id, drafts FROM q LEFT JOIN (SELECT image_id, count(*) AS drafts FROM fx_preds GROUP BY 1) p USING (image_id)""")
def _(v):
    drafts = v("fx_preds").groupBy("image_id").agg(F.count("*").alias("drafts"))
    return sampling.label_queue(v("fx_images"), drafts, 300).select("image_id", "drafts")


@query("w15_first_n", "SELECT image_id FROM fx_images ORDER BY image_id LIMIT 500")
def _(v):
    return sampling.first_n(v("fx_images"), 500).select("image_id")
