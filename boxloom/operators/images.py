"""Image jobs: content and perceptual hashes, degradation plans, and the pixel work of plans, over tables of raw BGR pixels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from boxloom.functions import geometry as g

# For each profile, an operation's chance and how its parameters are drawn, evenly between two numbers ("u"), a whole
# number between two ("int"), or one of some ("of"), in the order of the plan. A cast has the factors of blue, green and red by pass.
PROFILES = {
    "train": {
        "low_resolution": (1.0, ("u", 0.30, 0.65)),
        "cast": (1.0, {"warm": (("u", 0.65, 0.92), ("u", 0.90, 1.12), ("u", 1.05, 1.35)), "cool": (("u", 1.05, 1.30), ("u", 0.90, 1.05), ("u", 0.70, 0.95))}),
        "brightness_contrast": (1.0, ("u", 0.50, 1.35), ("u", -55, 35)),
        "noise": (1.0, ("u", 5, 28)),
        "vignette": (1.0, ("u", 0.30, 0.70), ("u", 0.38, 0.62), ("u", 0.38, 0.62)),
        "jpeg": (1.0, ("int", 22, 65)),
        "blur": (0.60,),
        "motion_blur": (0.40, ("of", 3, 5, 7, 9), ("of", 0, 1)),
        "occlusion": (0.35, ("of", 0, 1, 2, 3)),
    },
    "holdout": {
        "low_resolution": (1.0, ("u", 0.32, 0.62)),
        "cast": (1.0, {"holdout": (("u", 0.72, 0.95), ("u", 0.95, 1.12), ("u", 1.05, 1.28))}),
        "brightness_contrast": (1.0, ("u", 0.58, 1.28), ("u", -48, 28)),
        "noise": (1.0, ("u", 6, 24)),
        "vignette": (1.0, ("u", 0.35, 0.65), ("u", 0.42, 0.58), ("u", 0.42, 0.58)),
        "jpeg": (1.0, ("int", 28, 62)),
        "blur": (0.60,),
        "motion_blur": (0.35, ("of", 3, 5, 7), ("of", 0, 1)),
        "occlusion": (0.35, ("of", 0, 1, 2, 3)),
    },
}
#: Tries for an occluder that spares the boxes, by profile, and its colours (blue, green, red).
OCCLUDER_TRIES = {"train": 15, "holdout": 12}
OCCLUDER_COLOURS = ((35, 35, 35), (70, 55, 45), (115, 95, 75), (25, 25, 30))


def content_hash(files: DataFrame) -> DataFrame:
    """files with content_md5."""
    return files.withColumn("content_md5", F.md5("content"))


def _drawn(unit: Column, kind: str, *values) -> Column:
    """A parameter from a number in [0, 1)."""
    if kind == "of":
        return F.get(F.array(*(F.lit(float(v)) for v in values)), F.floor(unit * len(values)).cast("int"))
    lo, hi = map(float, values)
    return F.lit(lo) + unit * (hi - lo) if kind == "u" else F.lit(lo) + F.floor(unit * (hi - lo + 1))


def degrade_plan(plan: DataFrame, seed=42, profile: str = "train") -> DataFrame:
    """plan(image_id, pass) with ops(op, p1, p2, p3): the operations that a hash of image, pass and operation picks, in the order of the hash.

    Occlusion, when picked, comes last; its p1 is the number of its colour. Parameters are drawn by further digits of the hash. A pass
    that the profile has no cast for gets the profile's first.
    """
    entries, picks, digests = [], [], {}
    for at, (name, (chance, *draws)) in enumerate(PROFILES[profile].items()):
        # a column of its own, so a digest is worked out once for all that is drawn from it
        digests[f"_h{at}"] = F.md5(F.concat_ws("|", F.lit("plan"), F.lit(str(seed)), "image_id", "pass", F.lit(name)))
        h = F.col(f"_h{at}")
        unit = lambda at: F.conv(F.substring(h, at, 6), 16, 10).cast("double") / 16777216.0  # noqa: B023, E731
        kinds = draws[0] if name == "cast" else {"": draws}
        made = {k: [_drawn(unit(7 + 6 * n), *d) for n, d in enumerate(own)] + [F.lit(None).cast("double")] * (3 - len(own)) for k, own in kinds.items()}
        first = next(iter(made))
        chosen = made[first]
        for k in list(made)[1:]:
            chosen = [F.when(F.col("pass") == k, mine).otherwise(other) for mine, other in zip(made[k], chosen, strict=True)]
        op = F.concat(F.when(F.col("pass").isin(*made), F.col("pass")).otherwise(first), F.lit("_cast")) if name == "cast" else F.lit(name)
        on = F.lit(True) if chance >= 1 else unit(1) < chance  # a unit is below 1
        drawn = [c.cast("double") if chance >= 1 else F.when(on, c.cast("double")) for c in chosen]
        entries.append(F.struct((~on).alias("off"), F.lit(name == "occlusion").alias("last"), F.substring(h, 7, 26).alias("h"), op.alias("op"), *(c.alias(f"p{n}") for n, c in enumerate(drawn, 1))))
        picks.append(on.cast("int"))
    # functions of lambdas are not compiled, nor is what stands inside them: entries are sorted and cut without any
    told = plan.repartition(*(F.col(c) for c in ("image_id", "pass"))).withColumns(digests)  # digests cost more than dealing the keys to all cores
    told = told.withColumn("_s", F.slice(F.sort_array(F.array(*entries)), F.lit(1), reduce(Column.__add__, picks)))
    return told.withColumn("ops", F.arrays_zip("_s.op", "_s.p1", "_s.p2", "_s.p3")).drop("_s", *digests)


def with_occluders(plan: DataFrame, sizes: DataFrame, boxes: DataFrame, profile: str = "train") -> DataFrame:
    """plan(image_id, pass, ops) with occluder: the rectangle that spares the boxes of the image, null where no try does.

    sizes(image_id, width, height); boxes(image_id, cx, cy, w, h).
    """
    per = boxes.groupBy("image_id").agg(F.collect_list(F.struct("cx", "cy", "w", "h")).alias("_boxes"))
    wide = plan.join(sizes.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id").join(per, "image_id", "left")
    size, none = (F.col("_w"), F.col("_h")), F.expr("cast(array() as array<struct<cx:double,cy:double,w:double,h:double>>)")
    found = g.occluder(F.concat_ws("|", "image_id", "pass"), F.coalesce("_boxes", none), *size, OCCLUDER_TRIES[profile])
    return wide.select(*plan.columns, F.explode_outer(found).alias("occluder"))


def _resize_weights(n: int, m: int) -> np.ndarray:
    """Area weights from n to m cells, rows summing to 1; for growing sizes the nearest cells by overlap."""
    edges = np.linspace(0, n, m + 1)
    at = np.arange(n)
    w = np.clip(np.minimum(edges[1:, None], at[None, :] + 1) - np.maximum(edges[:-1, None], at[None, :]), 0, None)
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area resize of an H x W x C array, as two matrix products."""
    return np.einsum("ij,jkc,lk->ilc", _resize_weights(pixels.shape[0], height), pixels.astype(np.float64), _resize_weights(pixels.shape[1], width))


def perceptual_hash(pixels: np.ndarray) -> int:
    """Sign bits of the 8 x 8 lowest DCT terms of a 32 x 32 grey image against the median of the 63 that are not constant."""
    grey = resized(pixels.astype(np.float64) @ np.array([0.114, 0.587, 0.299])[:, None], 32, 32)[:, :, 0]
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:8, None] / 64)
    basis[0] *= np.sqrt(0.5)
    low = (basis @ grey @ basis.T / 16).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return int("".join("1" if b else "0" for b in bits), 2)


def _arrays(pdf: pd.DataFrame):
    for h, w, data in zip(pdf["height"], pdf["width"], pdf["data"], strict=True):
        yield np.frombuffer(data, np.uint8).reshape(h, w, 3)


def phash(pixels: DataFrame) -> DataFrame:
    """(path, h) from pixels(path, height, width, data as raw BGR bytes)."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "h": [perceptual_hash(a) for a in _arrays(pdf)]})

    return pixels.select("path", "height", "width", "data").mapInPandas(run, "path string, h bigint")


def _enlarged(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Linear resize between cell centres, as two matrix products."""

    def weights(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        out = np.zeros((m, n))
        out[np.arange(m), low] += 1 - (at - low)
        out[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
        return out

    return np.einsum("ij,jkc,lk->ilc", weights(pixels.shape[0], height), pixels.astype(np.float64), weights(pixels.shape[1], width))


def _along(x: np.ndarray, kernel: list[float], axis: int) -> np.ndarray:
    """An odd kernel along an axis; borders are mirrored without repeating the edge."""
    half = len(kernel) // 2
    pad = [(0, 0)] * 3
    pad[axis] = (half, half)
    wide = np.pad(x, pad, mode="reflect" if x.shape[axis] > half else "edge")
    return sum(k * np.take(wide, range(i, i + x.shape[axis]), axis) for i, k in enumerate(kernel))


def applied(a: np.ndarray, op: str, p1, p2, p3, rng) -> np.ndarray:
    """One operation on an H x W x 3 array; the JPEG pass is a codec and leaves pixels as they are, an occlusion needs its rectangle."""
    h, w = a.shape[:2]
    x = a.astype(np.float64)
    if op == "hflip":
        return a[:, ::-1]
    if op == "low_resolution":
        x = np.rint(_enlarged(np.rint(resized(x, max(64, int(h * p1)), max(64, int(w * p1)))), h, w))
    elif op.endswith("_cast"):
        x = x * [p1, p2, p3]
    elif op in ("brightness_contrast", "brightness"):
        x = np.rint(np.abs(x * (p1 if p1 is not None else 1.0) + (p2 if p2 is not None else 0.0)))
    elif op == "noise":
        x = x + rng.normal(0, p1 if p1 is not None else 8, x.shape)
    elif op == "blur":
        x = np.rint(_along(_along(x, [0.25, 0.5, 0.25], 0), [0.25, 0.5, 0.25], 1))
    elif op == "motion_blur":
        n = int(p1)
        x = np.rint(_along(x, [1 / n] * n, 1 if p2 < 0.5 else 0))
    elif op == "vignette":
        cx, cy = w * p2, h * p3
        yy, xx = np.ogrid[:h, :w]
        x = x * (1 - p1 * np.clip(np.hypot(xx - cx, yy - cy) / max(np.hypot(cx, cy), 1), 0, 1))[:, :, None]
    return np.clip(x, 0, 255).astype(np.uint8)


def apply_plan(pixels: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, pass, height, width, data): pixels after the operations of plan(path, pass, ops).

    An occlusion fills the rectangle of the column occluder with its colour, and nothing where that is null or the column is not there.
    """
    placed = "occluder" in plan.columns

    def run(frames):
        import zlib

        for pdf in frames:
            out = []
            places = pdf["occluder"] if placed else [None] * len(pdf)
            for a, ops, name, place in zip(_arrays(pdf), pdf["ops"], pdf["path"].astype(str) + pdf["pass"].astype(str), places, strict=True):
                rng = np.random.default_rng(zlib.crc32(name.encode()))
                for o in ops:
                    if o["op"] == "occlusion" and place is not None:
                        a = a.copy()
                        top, bottom, left, right = map(int, place)
                        a[top:bottom, left:right] = OCCLUDER_COLOURS[int(o["p1"])]
                    else:
                        a = applied(a, o["op"], o["p1"], o["p2"], o["p3"], rng)
                out.append(np.ascontiguousarray(a).tobytes())
            yield pdf[["path", "pass", "height", "width"]].assign(data=out)

    edges = F.expr("if(occluder is null, null, array(occluder.y1, occluder.y1 + occluder.h, occluder.x1, occluder.x1 + occluder.w))").alias("occluder")
    joined = pixels.select("path", "height", "width", "data").join(plan.select("path", "pass", "ops", *[edges] * placed), "path")
    return joined.mapInPandas(run, "path string, pass string, height int, width int, data binary")


def copy_hasher(pixels: DataFrame):
    """For topup_plan: a function that gives copies(copy_id, image_id, ops, ..) the perceptual hash h of the image made by their operations.

    image_id is the path of pixels(path, height, width, data); a copy of an image without pixels has a null hash.
    """

    def hashed(copies: DataFrame) -> DataFrame:
        none = F.lit(None).cast("double")
        steps = F.transform("ops", lambda o: F.struct(o.alias("op"), none.alias("p1"), none.alias("p2"), none.alias("p3")))
        made = apply_plan(pixels, copies.select(F.col("image_id").alias("path"), F.col("copy_id").alias("pass"), steps.alias("ops")))
        hashes = phash(made.drop("path").withColumnRenamed("pass", "path"))
        return copies.join(hashes.withColumnRenamed("path", "copy_id"), "copy_id", "left")

    return hashed


CACHE = "path string, height int, width int, data binary"


def _resized_rows(pixels: DataFrame, size: int) -> DataFrame:
    def run(frames):
        for pdf in frames:
            data = [np.clip(np.rint(resized(a, size, size)), 0, 255).astype(np.uint8).tobytes() for a in _arrays(pdf)]
            yield pd.DataFrame({"path": pdf["path"], "height": size, "width": size, "data": data})

    return pixels.select("path", "height", "width", "data").mapInPandas(run, CACHE)


def resize_cache(pixels: DataFrame, done: DataFrame, size: int = 320) -> DataFrame:
    """(path, height, width, data) of pixels whose path is not in done, at size x size; append it to the cache."""
    return _resized_rows(pixels.join(done.select("path"), "path", "left_anti"), size)


def build_cache(pixels: DataFrame, path: str, size: int = 320, overwrite: bool = False) -> dict:
    """Appends resized pixels to the cache at `path` and returns {"written", "skipped", "total"}; images in the cache are skipped.

    The numbers are observed in the pass that writes, so nothing is read twice. overwrite replaces the cache by these pixels.
    """
    spark = pixels.sparkSession
    spark.createDataFrame([], CACHE).write.mode("overwrite" if overwrite else "ignore").parquet(path)
    done = spark.read.schema(CACHE).parquet(path).select("path").distinct().withColumn("_done", F.lit(True))
    seen = Observation("cache")
    told = pixels.select("path", "height", "width", "data").join(done, "path", "left").observe(seen, F.count(F.lit(1)).alias("total"), F.count("_done").alias("skipped"))
    _resized_rows(told.where("_done is null"), size).write.mode("append").parquet(path)
    total, skipped = seen.get["total"], seen.get["skipped"]
    return {"written": total - skipped, "skipped": skipped, "total": total}
