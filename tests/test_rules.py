"""Rewrites against a literal re-statement of the sequential rule, label dialects, name traps, gates, streams, pixels, files."""

import json
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.functions import names
from boxloom.operators import dedup, evaluate, history, images, labels, postproc, sampling, targets
from boxloom.plans.catalog import QUERIES
from boxloom.sources import annotations, sinks
from boxloom.streaming import monitor


def boxes_frame(spark, rows):
    return spark.createDataFrame(rows, "image_id bigint, class_id int, box_id string")


def md5(*parts):
    import hashlib

    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def random_boxes(seed, n=60):
    rng = random.Random(seed)
    return [(i, rng.choice([0, 0, 0, 1, 2, 3]), f"b{i}-{k}") for i in range(n) for k in range(rng.randint(0, 3))]


@pytest.mark.parametrize("seed", [1, 2])
def test_balance_is_the_sequential_rule(spark, seed):
    rows, soft = random_boxes(seed), 25
    per = {}
    for i, c, _ in rows:
        per.setdefault(i, []).append(c)
    total = {c: sum(v.count(c) for v in per.values()) for c in range(8)}
    scarce = {c for c in total if 0 < total[c] < soft}
    order = sorted(per, key=lambda i: (md5(42, i), i))
    taken = [i for i in order if set(per[i]) & scarce]
    counts = {c: sum(per[i].count(c) for i in taken) for c in range(8)}
    for i in order:
        if i not in taken and any(counts[c] < soft for c in per[i]):
            taken.append(i)
            for c in per[i]:
                counts[c] += 1
    got = {r.image_id for r in sampling.balance(boxes_frame(spark, rows), 5, soft, 100).collect()}
    assert got == set(taken)


def test_holdout_is_the_sequential_rule(spark):
    rows, per_class = random_boxes(5), 6
    per = {}
    for i, c, _ in rows:
        per.setdefault(i, set()).add(c)
    chosen, counts = [], dict.fromkeys(range(8), 0)
    for c in range(8):
        for i in sorted((i for i in per if c in per[i]), key=lambda i: (md5(42, c, i), i)):
            if counts[c] >= per_class:
                break
            if i not in chosen:
                chosen.append(i)
                for k in per[i]:
                    counts[k] += 1
    got = sampling.sample_balanced(boxes_frame(spark, rows), per_class).collect()
    assert sorted(r.image_id for r in got if r["copy"] == 0) == sorted(chosen)


def test_topup_reaches_its_target(spark):
    frame = boxes_frame(spark, random_boxes(7))
    plan = sampling.topup_plan(frame, 60, 1000).collect()
    per = frame.groupBy("image_id", "class_id").count().collect()
    sums = {c: sum(r["count"] for r in per if r.class_id == c) for c in range(8)}
    for p in plan:
        for r in per:
            if r.image_id == p.image_id:
                sums[r.class_id] += r["count"]
        assert 1 <= len(p.ops) <= 3
    assert all(sums[c] >= 60 for c in range(4)) and len({p.new_id for p in plan}) == len(plan)


def test_near_pairs_is_exact(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(40)]
    near = [h ^ sum(1 << k for k in rng.sample(range(63), d)) for d, h in zip([0, 1, 2, 5, 7, 8, 8, 9, 10, 12] * 4, base, strict=True)]
    frame = lambda hs: spark.createDataFrame([(h,) for h in hs], "h bigint")
    want = {(a, b, bin(a ^ b).count("1")) for a in base for b in near if bin(a ^ b).count("1") <= 8}
    assert {tuple(r) for r in dedup.near_pairs(frame(base), frame(near)).collect()} == want


@pytest.mark.parametrize("dialect,want", [("strict", [1, 7, 8, -1]), ("raw", [1, 3, 7, 8, -1]), ("validated", [1]), ("lenient", [1, 2, 7])])
def test_dialects(spark, dialect, want):
    lines = ["1 .5 .5 .1 .1", "3.0 .5 .5 .1 .1", "x1 .5 .5 .1 .1", "1 .5 .5", "2 .5 .5 .1 .1 .9", "7 1.5 .5 .1 .1", "8 .5 .5 .1 .1", "-1 .5 .5 .1 .1", "", None, "1 a .5 .1 .1"]
    got = labels.parse_labels(spark.createDataFrame([(x,) for x in lines], "line string"), dialect).collect()
    assert [r.class_id for r in got] == want


def test_throwing_dialect(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        labels.parse_labels(spark.createDataFrame([("x1 .5 .5 .1 .1",)], "line string"), "throwing").collect()


def test_names(spark):
    rows = [("Bad_Apple 0-1 day", "apple"), ("orange fruit", "orange"), ("pineapple slice", "apple"), ("Grape", "grapes"), ("kiwi", None), (None, None)]
    frame = spark.createDataFrame([(n,) for n, _ in rows], "n string")
    assert [r[0] for r in frame.select(names.resolve_alias(names.normalize_name(F.col("n")))).collect()] == [w for _, w in rows]
    assert frame.where("n like 'pine%'").select(names.resolve_alias(F.col("n"), order="longest")).first()[0] == "pineapple"
    m = names.class_map(spark.createDataFrame([("mango_ripeness_yolo", 1, "x"), ("mango_ripeness_yolo", 2, "x"), ("t", 0, "apple_skip"), ("t", 1, "Not_Mango"), ("t", 2, "Ripe Mango")], "tag string, raw_id int, raw_name string"))
    assert {tuple(r) for r in m.collect()} == {("mango_ripeness_yolo", 2, 3), ("t", 2, 3)}


def test_match_uses_each_box_once(spark):
    image = spark.createDataFrame([(1, 100, 100)], "image_id bigint, width int, height int")
    box = spark.createDataFrame([(1, 0, "a", 0.5, 0.5, 0.2, 0.2), (1, 0, "b", 0.54, 0.5, 0.2, 0.2)], "image_id bigint, class_id int, box_id string, cx double, cy double, w double, h double")
    pred = spark.createDataFrame([(1, 0, f"p{k}", c, 40.0, 40.0, 60.0, 60.0) for k, c in enumerate([0.9, 0.8, 0.7])], "image_id bigint, class_id int, pred_id string, conf double, x1 double, y1 double, x2 double, y2 double")
    assert {(r.pred_id, r.box_id) for r in evaluate.match(pred, box, image).collect()} == {("p0", "a"), ("p1", "b")}
    ap = evaluate.average_precision(pred, box, image, (0.5,)).first().ap
    assert ap == pytest.approx(1.0)


def test_anchor_ids(spark):
    a = targets.anchor_table(spark, 416.0, (2, 1), (10, 20), (0.5, 1.0)).orderBy("anchor_id").collect()
    assert [r.anchor_id for r in a] == list(range(10)) and (a[2].ax, a[2].ay) == (312.0, 104.0)


def test_streams_equal_their_twins(spark, tmp_path):
    rows = [(r, 1000.0 + k, float((k * 7 + r) % 11)) for r in range(3) for k in range(20)]
    for r in range(3):
        (tmp_path / f"in/run{r}").mkdir(parents=True)
    for r, t, x in rows:
        (tmp_path / f"in/run{r}/{int(t)}.json").write_text(json.dumps({"timestamp": t, "cpu_util_percent": x}))
    stream = monitor.telemetry_stream(spark, str(tmp_path / "in")).selectExpr("run", "ts", "cpu_util_percent as cpu_util", "cpu_util_percent > 4 as failed")
    found = {}
    for name, df, mode in (("active", monitor.active_run_stream(stream), "update"), ("last", monitor.latest_snapshot(stream, order=("ts",), values=("cpu_util",)), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        found[name] = spark.table(name).collect()
    batch = spark.createDataFrame([(f"run{r}", t, x, x > 4) for r, t, x in rows], "run string, ts double, cpu_util double, failed boolean")
    assert found["active"][-1].run == "run2"
    assert {tuple(r) for r in found["last"]} == {tuple(r) for r in history.latest_snapshot(batch, order=("ts",), values=("cpu_util",)).collect()}


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (48, 64, 3), dtype=np.uint8)
    for name, x in (("a", a), ("copy", a), ("noisy", np.clip(a.astype(int) + rng.integers(-3, 4, a.shape), 0, 255).astype(np.uint8)), ("other", a[::-1, ::-1].copy())):
        png(tmp_path / f"{name}.png", x)
    (tmp_path / "bad.png").write_bytes(b"no image")
    pixels = annotations.scan_pixels(spark, str(tmp_path))
    h = {r.path.rsplit("/", 1)[1][:-4]: r.h for r in images.phash(pixels).collect()}
    gap = lambda n: bin(h["a"] ^ h[n]).count("1")
    assert set(h) == {"a", "copy", "noisy", "other"} and gap("copy") == 0 and gap("noisy") <= 8 < gap("other") and h["a"] < 2**63
    cache = images.resize_cache(pixels, pixels.where("path like '%copy%'").select("path"), 16).collect()
    assert len(cache) == 3 and all(len(r.data) == 16 * 16 * 3 for r in cache)
    plan = images.degrade_plan(pixels.select(F.col("path").alias("image_id"), F.lit("warm").alias("pass"))).withColumnRenamed("image_id", "path")
    out = images.apply_plan(pixels, plan).collect()
    assert len(out) == 4 and all(len(r.data) == r.height * r.width * 3 for r in out)
    assert (images.applied(images.applied(a, "hflip", None, None, None, None), "hflip", None, None, None, None) == a).all()


def test_formats(spark, tmp_path):
    (tmp_path / "y/train/images").mkdir(parents=True)
    (tmp_path / "y/train/labels").mkdir(parents=True)
    png(tmp_path / "y/train/images/one.png", np.zeros((4, 4, 3), np.uint8))
    (tmp_path / "y/train/labels/one.txt").write_text("1 0.5 0.5 0.2 0.2\nbad\n")
    (tmp_path / "y/data.yaml").write_text("names:\n  0: apple\n  1: kiwi\n")
    inventory = annotations.scan_images(spark, str(tmp_path / "y")).collect()
    assert [(r.stem, r.ext, r.split) for r in inventory] == [("one", ".png", "train")]
    assert annotations.pair_labels(annotations.scan_images(spark, str(tmp_path / "y"))).first().label_path.endswith("/train/labels/one.txt")
    assert [(r.stem, r.class_id) for r in annotations.scan_labels(spark, str(tmp_path / "y")).collect()] == [("one", 1)]
    assert [(r.raw_id, r.raw_name) for r in annotations.scan_class_names(spark, str(tmp_path / "y")).collect()] == [(0, "apple"), (1, "kiwi")]
    assert [(r.format, r.raw_name) for r in annotations.scan_auto(spark, str(tmp_path / "y")).collect()] == [("labels", "kiwi")]
    (tmp_path / "c.json").write_text(json.dumps({"categories": [{"id": 1, "name": "apple"}], "images": [{"id": 5, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 6, "file_name": "b.jpg", "width": 0, "height": 50}], "annotations": [{"image_id": 5, "category_id": 1, "bbox": [10, 10, 20, 20]}, {"image_id": 5, "category_id": 9, "bbox": [10, 10, 20, 20]}, {"image_id": 6, "category_id": 1, "bbox": [1, 1, 2, 2]}]}))
    assert [(r.file_name, r.cx, r.cy, r.w, r.h) for r in annotations.scan_coco(spark, str(tmp_path / "c.json")).collect()] == [("a.jpg", 0.2, 0.4, 0.2, 0.4)]
    (tmp_path / "v.xml").write_text("<annotation><filename>a.jpg</filename><size><width>100</width><height>50</height></size><object><name>apple</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>30</xmax><ymax>30</ymax></bndbox></object><object><name>bad</name><bndbox><xmin>x</xmin><ymin>10</ymin><xmax>30</xmax><ymax>30</ymax></bndbox></object></annotation>")
    assert [(r.raw_name, r.cx, r.h) for r in annotations.scan_voc(spark, str(tmp_path / "v.xml")).collect()] == [("apple", 0.2, 0.4)]
    (tmp_path / "f/Training/Apple Red 1").mkdir(parents=True)
    png(tmp_path / "f/Training/Apple Red 1/x.png", np.zeros((4, 4, 3), np.uint8))
    assert [r.name for r in annotations.scan_class_folders(spark, str(tmp_path / "f"), {"Banana": "banana", "Apple": "apple"}).collect()] == ["apple"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.1, 1.0, 0.5, 0.5, 0.2, 0.1, 3.0)], annotations.HISTORY)
    sinks.append_history(rows, str(tmp_path / "h/run1"))
    sinks.append_history(rows.withColumn("epoch", F.lit(2)), str(tmp_path / "h/run1"))
    assert [(r.run, r.epoch) for r in annotations.scan_history(spark, str(tmp_path / "h")).orderBy("epoch").collect()] == [("run1", 1), ("run1", 2)]
    box = spark.createDataFrame([(7, "train", 2, 0.5, 0.5, 0.25, 0.125)], "image_id bigint, split string, class_id int, cx double, cy double, w double, h double")
    sinks.write_labels(box, str(tmp_path / "l"))
    assert [(r.class_id, r.h) for r in annotations.scan_labels(spark, str(tmp_path / "l")).collect()] == [(2, 0.125)]
    sinks.write_report(sinks.report_lines(spark.createDataFrame([("a", 4), ("b", 2)], "n string, c bigint"), "n", "c"), str(tmp_path / "r"))
    assert sorted(r.value.count("#") for r in spark.read.text(str(tmp_path / "r")).collect()) == [20, 40]
    base = spark.createDataFrame([(4, "a.jpg", 1)], "seq int, image string, class_id int")
    extra = spark.createDataFrame([("z.jpg", "Mango"), ("y.jpg", "kiwi")], "image string, raw_name string")
    assert {(r.seq, r.image) for r in annotations.integrate_export(base, extra, {"mango": 3}).collect()} == {(4, "a.jpg"), (5, "z.jpg")}


def test_occluders_spare_boxes(spark):
    """A rectangle never holds the centre of a small box; where no try spares all boxes, the image stays as it is."""
    ids = range(12)
    sizes = spark.createDataFrame([(str(i), 100, 100) for i in ids], "image_id string, width int, height int")
    crowd = [("0", x / 20, y / 20, 0.05, 0.05) for x in range(20) for y in range(20)]
    boxes = spark.createDataFrame([*crowd, *((str(i), 0.5, 0.5, 0.05, 0.05) for i in ids)], "image_id string, cx double, cy double, w double, h double")
    plan = spark.createDataFrame([(str(i), "warm", [("occlusion", 1.0, None, None)]) for i in ids], "image_id string, pass string, ops array<struct<op:string,p1:double,p2:double,p3:double>>")
    pixels = spark.createDataFrame([(str(i), 100, 100, bytearray([200] * 30000)) for i in ids], "path string, height int, width int, data binary")
    placed = images.with_occluders(plan, sizes, boxes).withColumnRenamed("image_id", "path")
    out = {r.path: np.frombuffer(r.data, np.uint8).reshape(100, 100, 3) for r in images.apply_plan(pixels, placed).collect()}
    assert len(out) == 12 and (out["0"] == 200).all()
    assert all((a[50, 50] == 200).all() for a in out.values()) and sum((a == [70, 55, 45]).all(axis=2).any() for a in out.values()) >= 10


def test_degradations(spark):
    """Every parameter lies in its range, and each operation does what its parameters say."""
    grey = np.full((80, 100, 3), 100, np.uint8)
    do = lambda op, *p: images.applied(grey, op, *p, *[None] * (3 - len(p)), np.random.default_rng(1))
    assert do("warm_cast", 0.7, 1.0, 1.3)[0, 0].tolist() == [70, 100, 130]
    assert (do("brightness_contrast", 0.5, -55.0) == 5).all()  # below zero counts by its size
    assert (do("low_resolution", 0.3) == 100).all() and (do("blur") == 100).all() and (do("motion_blur", 9.0, 1.0) == 100).all()
    dark = do("vignette", 0.7, 0.5, 0.5)
    assert dark[40, 50, 0] == 100 and dark[0, 0, 0] == 30
    line = np.zeros((9, 9, 3), np.uint8)
    line[4, 4] = 90
    across, down = (images.applied(line, "motion_blur", 3.0, d, None, None)[:, :, 0] for d in (0.0, 1.0))
    assert across[4, 3:6].tolist() == [30] * 3 and down[3:6, 4].tolist() == [30] * 3 and across.sum() == down.sum() == 90
    plan = spark.range(300).select(F.col("id").alias("image_id"), F.explode(F.array(F.lit("warm"), F.lit("cool"))).alias("pass"))
    for profile, blurs in (("train", {3, 5, 7, 9}), ("holdout", {3, 5, 7})):
        ops = [(r["pass"], o) for r in images.degrade_plan(plan, profile=profile).collect() for o in r.ops]
        for name, (chance, *draws) in images.PROFILES[profile].items():
            own = [(p, o) for p, o in ops if o.op == name or name == "cast" and o.op.endswith("_cast")]
            assert abs(len(own) / 600 - chance) < 0.1
            for p, o in own:
                ranges = draws[0].get(p, next(iter(draws[0].values()))) if name == "cast" else draws
                assert all(min(d[1:]) <= x <= max(d[1:]) for d, x in zip(ranges, (o.p1, o.p2, o.p3), strict=False))
        assert {o.p1 for _, o in ops if o.op == "motion_blur"} == blurs


def topped_up(rows, target, most, near, tries=20):
    """The rule one copy at a time: classes from the neediest, each along its queue, rejecting what near(class, pass, image) says."""
    per = {}
    for i, c, _ in rows:
        per.setdefault(i, []).append(c)
    counts = {c: sum(v.count(c) for v in per.values()) for c in range(8)}
    made, tried = [], 0
    for c in sorted(counts, key=lambda c: (counts[c], c)):
        images, at, k = [i for i in per if c in per[i]], 0, 0
        while images and counts[c] < target and len(made) < most and tried < tries * most:
            k += 1
            for t, i in sorted((md5(42, c, k, i), i) for i in images):
                if counts[c] >= target or len(made) >= most or tried >= tries * most:
                    break
                tried += 1
                if near(c, k, i):
                    continue
                made.append((f"aug_{c}_{at:06d}", c, i))
                at += 1
                for x in per[i]:
                    counts[x] += 1
    return made, tried


def hashes_of_copies(copies):
    """Copies of every third image are near the forbidden 0 in all passes but each fourth; those of image 7 cannot be made."""
    near = (F.col("image_id") % 3 == 0) & (F.col("k") % 4 != 0)
    return copies.withColumn("h", F.when(F.col("image_id") != 7, F.when(near, F.col("image_id") % 200).otherwise((1 << 62) - 1 - F.col("image_id"))))


@pytest.mark.parametrize("seed,target,most,tries", [(7, 60, 1000, 20), (8, 200, 90, 20), (9, 150, 60, 1), (10, 5, 100, 20)])
def test_topup_is_the_sequential_rule(spark, seed, target, most, tries):
    rows, told = random_boxes(seed), {}
    want, tried = topped_up(rows, target, most, lambda c, k, i: i == 7 or i % 3 == 0 and k % 4 != 0, tries)
    forbidden = spark.createDataFrame([(0,), (None,)], "h bigint")
    got = sampling.topup_plan(boxes_frame(spark, rows), target, most, hashed=hashes_of_copies, forbidden=forbidden, tries=tries, told=told).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(want)
    assert told == {"added": len(want), "tried": tried, "rejected": tried - len(want)}
    plain, _ = topped_up(rows, target, most, lambda c, k, i: False, tries)
    assert sorted(tuple(r)[:3] for r in sampling.topup_plan(boxes_frame(spark, rows), target, most, tries=tries).collect()) == sorted(plain)


def test_topup_where_every_copy_is_near(spark):
    """All tries are used up in few rounds, as stretches double; a class that has no images is left."""
    told = {}
    rows = [(1, 2, "a"), (2, 2, "b")]
    all_near = lambda copies: copies.withColumn("h", F.lit(5).cast("bigint"))
    got = sampling.topup_plan(boxes_frame(spark, rows), 3, 100, hashed=all_near, forbidden=spark.createDataFrame([(4,)], "h bigint"), told=told)
    assert got.count() == 0 and told == {"added": 0, "tried": 2000, "rejected": 2000}
    assert sampling.topup_floor(boxes_frame(spark, []), 3).count() == 0


def test_topup_floor_is_the_sequential_rule(spark):
    rows = random_boxes(11)
    want, _ = topped_up(rows, 80, 60000, lambda c, k, i: False, 1)
    got = sampling.topup_floor(boxes_frame(spark, rows), 80).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(want)
    assert all(2 <= len(set(r.ops)) == len(r.ops) <= 4 for r in got)


def test_copies_are_hashed_from_pixels(spark):
    """A mirrored copy is rejected where the mirror image of its original is held out."""
    rng = np.random.default_rng(5)
    a = {n: np.kron(rng.integers(0, 255, (6, 6, 3)), np.ones((8, 8, 1))).astype(np.uint8) for n in ("x", "y")}
    pixels = spark.createDataFrame([(n, 48, 48, bytearray(p.tobytes())) for n, p in a.items()], "path string, height int, width int, data binary")
    held = spark.createDataFrame([(images.perceptual_hash(a["x"]),), (images.perceptual_hash(a["x"][:, ::-1]),)], "h bigint")
    boxes = spark.createDataFrame([("x", 0), ("y", 0), ("gone", 0)], "image_id string, class_id int")
    told = {}
    plan = sampling.topup_plan(boxes, 9, ops=("hflip",), most_ops=1, hashed=images.copy_hasher(pixels), forbidden=held, told=told).collect()
    assert {r.image_id for r in plan} == {"y"} and len(plan) == told["added"] == 6 and told["rejected"] >= 10  # x and the image without pixels


def test_cache_counts_what_it_writes(spark, tmp_path):
    pixels = spark.createDataFrame([(f"p{k}", 8, 8, bytearray([k] * 192)) for k in range(9)], "path string, height int, width int, data binary")
    path = str(tmp_path / "cache")
    assert images.build_cache(pixels.where("path < 'p4'"), path, 4) == {"written": 4, "skipped": 0, "total": 4}
    assert images.build_cache(pixels, path, 4) == {"written": 5, "skipped": 4, "total": 9}
    assert images.build_cache(pixels, path, 4) == {"written": 0, "skipped": 9, "total": 9}
    assert sorted((r.path, bytes(r.data)) for r in spark.read.parquet(path).collect()) == [(f"p{k}", bytes([k] * 48)) for k in range(9)]
    assert images.build_cache(pixels.where("path = 'p1'"), path, 4, overwrite=True) == {"written": 1, "skipped": 0, "total": 1}
    assert images.build_cache(pixels.where("false"), path, 4) == {"written": 0, "skipped": 0, "total": 0} and spark.read.parquet(path).count() == 1


def test_soft_nms_is_the_sequential_rule(spark):
    rng = random.Random(6)
    rows = []
    for image in range(4):
        for k in range(25):
            x, y, w, h = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(5, 40), rng.uniform(5, 40)
            rows.append((image, f"{image}-{k:02d}", rng.randrange(2), round(rng.uniform(0.02, 1), 3), x, y, x + w, y + h))

    def iou(a, b):
        inter = max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))
        union = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - inter
        return inter / union if union > 0 else 0.0

    want = []
    for image in range(4):
        left = sorted(([r[3], r] for r in rows if r[0] == image), key=lambda e: (-e[0], e[1][1]))
        rank = 0
        while left:
            best = max(left, key=lambda e: e[0])
            left.remove(best)
            rank += 1
            want.append((image, best[1][1], rank, best[0]))
            for e in left:
                if e[1][2] == best[1][2]:
                    e[0] *= math.exp(-(iou(e[1], best[1]) ** 2) / 0.5)
            left = [e for e in left if e[0] > 0.01]
    frame = spark.createDataFrame(rows, "image_id int, pred_id string, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.image_id, r.pred_id, r["rank"], r.conf) for r in postproc.soft_nms(frame).collect())
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)])


def test_a_rotated_box_is_that_of_its_turned_corners_to_the_bit(spark):
    from boxloom.functions import geometry

    # boxes whose side lies on the border before the turn, as cx - w / 2 is 1
    rows = [(q * q / 5e3 + 1, j / 1e3, q * q / 2.5e3, (k * 37 % 997 + 1) / 9.97e2, k % 21 - 10, 320 + 32 * (k % 31), 240 + 24 * (k * 7 % 37)) for k, (q, j) in enumerate((q, j) for q in (5, 10, 15) for j in range(0, 1000, 3))]
    frame = spark.createDataFrame(rows, "cx double, cy double, w double, h double, d int, width bigint, height bigint")
    box = geometry.rotated(*(F.col(c) for c in ("cx", "cy", "w", "h")), F.col("d").cast("double"), F.col("width"), F.col("height"))
    got = frame.select("*", *(c.alias(f"o{n}") for n, c in enumerate(box))).collect()
    for r in got:
        cos, sin, wide, high = math.cos(math.radians(r.d)), math.sin(math.radians(r.d)), r.width, r.height
        turned = [(cos * x + sin * y + wide / 2, -sin * x + cos * y + high / 2) for x in ((r.cx - r.w / 2) * wide - wide / 2, (r.cx + r.w / 2) * wide - wide / 2) for y in ((r.cy - r.h / 2) * high - high / 2, (r.cy + r.h / 2) * high - high / 2)]
        (x1, x2), (y1, y2) = ((min(max(min(c), 0.0), top), min(max(max(c), 0.0), top)) for c, top in zip(zip(*turned, strict=True), (wide, high), strict=True))
        assert (r.o0, r.o1, r.o2, r.o3) == ((x1 + x2) / 2 / wide, (y1 + y2) / 2 / high, (x2 - x1) / wide, (y2 - y1) / high)


def test_matching_and_what_follows_deal_rows_by_image_alone(spark):
    images = spark.createDataFrame([(i, 100, 100) for i in range(3)], "image_id bigint, width int, height int")
    boxes = spark.createDataFrame([(i, c, f"b{i}{c}{k}", 0.2 + 0.3 * k, 0.5, 0.2, 0.4) for i in range(3) for c in (0, 1) for k in (0, 1)], "image_id bigint, class_id int, box_id string, cx double, cy double, w double, h double")
    preds = spark.createDataFrame([(i, c, f"p{i}{c}", conf, 10.0, 30.0, 30.0, 70.0) for i in range(3) for c, conf in ((0, 0.9), (1, 0.15))], "image_id bigint, class_id int, pred_id string, conf double, x1 double, y1 double, x2 double, y2 double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = evaluate.match(preds.where("conf >= 0.25"), boxes, images)
        lost = evaluate.rescue(evaluate.missed_boxes(boxes, hits), preds.where("conf < 0.25"), images)
        for frame in (hits, lost):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
            assert dealt and all("class_id" not in line.split("hashpartitioning(")[1] and "box_id" not in line.split("hashpartitioning(")[1] for line in dealt)
        assert sorted(r.box_id for r in hits.collect()) == ["b000", "b100", "b200"]
        assert sorted(r.box_id for r in lost.collect()) == ["b010", "b110", "b210"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_grid_assignment_deals_boxes_before_they_become_rows_of_scales(spark):
    boxes = spark.createDataFrame([(1, f"b{k}", k % 3, 40.0 * k, 30.0 * k, 50.0, 60.0) for k in range(8)], "image_id bigint, box_id string, class_id int, bx double, by double, bw double, bh double")
    plan = targets.assign_grid(boxes)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert len(dealt) == 1 and "anchor_id" not in dealt[0]


def test_near_search_turns_one_bit_on_both_sides(spark):
    """66 rows a hash on each side instead of 696 on one; every pair of every split pair once, also for hashes of several splits."""
    assert dedup._turned(spark.createDataFrame([(5,), (2**62,)], "left_h bigint"), "left_h", 8, 63).count() == 2 * 66
    rng = random.Random(12)
    base = [rng.getrandbits(63) for _ in range(12)]
    turned = [h ^ sum(1 << k for k in rng.sample(range(63), d)) for h in base for d in (0, 1, 2, 3, 6, 8, 9)]
    items = [(k, rng.choice(["train", "valid", "test"]), h) for k, h in enumerate([*base, *turned, None])]
    frame = spark.createDataFrame(items, "item_id int, split string, h bigint")
    want = sorted((sa, a, sb, b, bin(x ^ y).count("1")) for a, sa, x in items[:-1] for b, sb, y in items[:-1] if (sa, sb) in dedup.SPLIT_PAIRS and bin(x ^ y).count("1") <= 8)
    assert sorted(tuple(r) for r in dedup.leak_near(frame).collect()) == want and want
    assert sorted(r.item_id for r in dedup.removals_near(frame).collect()) == sorted({w[1] for w in want})


def test_soft_nms_goes_over_images_in_step(spark):
    rows = [(i, f"{i}-{k}", k % 2, 0.9 - k / 10, 0.0, 0.0, 10.0, 10.0 + k) for i in range(50) for k in range(i % 4 + 1)]
    got = postproc.soft_nms(spark.createDataFrame(rows, "image_id int, pred_id string, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["rank"] for r in got.collect() if r.image_id == 3) == [1, 2, 3, 4] and len({r.image_id for r in got.collect()}) == 50


def test_occluder_is_the_first_try_that_fits(spark):
    """Tries are worked out one after another; the one found is the first of all that fit."""
    from boxloom.functions import geometry as g

    boxes = [(i, 0.1 * (i % 9) + 0.05, 0.1 * k + 0.05, 0.02, 0.02) for i in range(30) for k in range(10)]
    per = spark.createDataFrame(boxes, "i int, cx double, cy double, w double, h double").groupBy("i").agg(F.collect_list(F.struct("cx", "cy", "w", "h")).alias("b"))
    size = F.lit(640), F.lit(480)
    tries = F.flatten(F.array(*(g.occluder_try(F.col("i"), *size, F.lit(n)) for n in range(1, 16))))
    for r in per.select("b", tries.alias("tries"), g.occluder(F.col("i"), F.col("b"), *size).alias("found")).collect():
        covers = lambda t, b: t.x1 <= math.floor(b.cx * 640) <= t.x1 + t.w and t.y1 <= math.floor(b.cy * 480) <= t.y1 + t.h and t.w * t.h > max(1, math.floor(b.w * 640) * math.floor(b.h * 480)) * 0.6
        assert r.found == [t for t in r.tries if not any(covers(t, b) for b in r.b)][:1]


def test_a_plan_works_out_each_digest_once(spark):
    plan = images.degrade_plan(spark.range(3).select(F.col("id").alias("image_id"), F.lit("warm").alias("pass")))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("md5(") == len(images.PROFILES["train"])
    ranked = images.degrade_plan(sampling.webcam_plan(spark.range(3).withColumnRenamed("id", "image_id"), 1.0)).select("image_id", "ops")
    assert "Window [row_number" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def broadcast_keys(frame):
    """What the broadcast joins of the plan that ran join by."""
    assert frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and "key#" in plan
    return re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)


def near_items(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(30)]
    items = [(k, ("train", "valid", "test")[(k + k // 30) % 3], h) for k, h in enumerate([*base, *(h ^ (1 << rng.randrange(63)) for h in base[:9])])]
    return spark.createDataFrame(items, "item_id int, split string, h bigint")


def test_leak_near_broadcasts_no_turned_hashes(spark):
    """Their size is told from the hashes before each becomes 66 rows, so a threshold does not keep them from the driver."""
    assert not [k for k in broadcast_keys(dedup.leak_near(near_items(spark))) if "key#" in k]


def test_removals_near_broadcasts_no_turned_hashes(spark):
    assert not [k for k in broadcast_keys(dedup.removals_near(near_items(spark))) if "key#" in k]


def test_union_removals_broadcasts_no_turned_hashes(spark):
    assert not [k for k in broadcast_keys(QUERIES["u2_union_removals"](spark, "/root/testdata/sf0.001")) if "key#" in k]
