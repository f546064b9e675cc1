"""Splits, caps, balance, top-up plans and samples, all in a hash order that does not hang on partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.names import CLASSES
from boxloom.operators.dedup import band_index, dedup_exact, probed
from boxloom.sources.folders import shared_path

UPTO = (Window.unboundedPreceding, Window.currentRow)


def turn(seed, *parts) -> Column:
    """The place of a row in a shuffled order: md5 of the seed and its keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows in the shared folder, written once and read back."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def global_rank(rows: DataFrame, order: str, ties: str, groups: tuple = ()) -> DataFrame:
    """rows with rank (from 1) and total in the order of a hash column, of all rows or of each group, without sorting them in one task.

    Rows are counted in buckets by the first three hex digits; a row's rank is its place in the bucket after all smaller buckets. The
    groups are few (classes), so their buckets are a small table.
    """
    keyed = rows.withColumn("_b", F.substring(order, 1, 3))
    sums = keyed.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    sums = sums.select(*groups, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*groups)).alias("total"))
    place = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(order, ties))
    return keyed.withColumn("_p", place).join(F.broadcast(sums), [*groups, "_b"]).withColumn("rank", F.col("_p") + F.col("_before")).drop("_b", "_p", "_before")


def image_classes(boxes: DataFrame) -> DataFrame:
    """(image_id, class_id, n)."""
    return boxes.groupBy("image_id", "class_id").agg(F.count("*").alias("n"))


def stratified_split(images: DataFrame, boxes: DataFrame, seed=42, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """(image_id, split): each class cuts its shuffled images, the lowest class of an image decides; images without boxes train."""
    per = image_classes(boxes).withColumn("_t", turn(seed, "class_id", "image_id"))
    placed = global_rank(per, "_t", "image_id", ("class_id",))
    n_train, n_valid = F.greatest(F.lit(1), F.floor(F.col("total") * train)), F.greatest(F.lit(1), F.floor(F.col("total") * valid))
    cut = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_valid, "valid").otherwise("test")
    decided = placed.groupBy("image_id").agg(F.min_by(cut, "class_id").alias("split"))
    return images.select("image_id").join(decided, "image_id", "left").select("image_id", F.coalesce("split", F.lit("train")).alias("split"))


def ratio_split(images: DataFrame, seed=42, train: float = 0.70, valid: float = 0.20) -> DataFrame:
    """(image_id, split) by place in one shuffled order."""
    ranked = global_rank(images.select("image_id").withColumn("_t", turn(seed, "image_id")), "_t", "image_id")
    n_train, n_valid = F.floor(F.col("total") * train), F.floor(F.col("total") * valid)
    return ranked.select("image_id", F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_valid, "valid").otherwise("test").alias("split"))


def cap_per_source(images: DataFrame, most: int, seed=42, source: str = "source_id") -> DataFrame:
    """At most `most` images of a source, by hash."""
    by = Window.partitionBy(source).orderBy(turn(seed, "image_id"), "image_id")
    return images.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= most).drop("_k")


def _take_below(boxes: DataFrame, keep: DataFrame, limit: int, seed) -> DataFrame:
    """Images of `keep`, then others in hash order while some class of theirs is below the limit, as one windowed sum.

    While a class is below the limit, every earlier image with it was taken, so its count is what `keep` has plus the sum over all
    earlier images; once above, it stays above. An image is taken if the least of these counts over its classes is below.
    """
    per = image_classes(boxes)
    kept = per.join(keep, "image_id", "left_semi")
    base = kept.groupBy("class_id").agg(F.sum("n").alias("base"))
    others = per.join(keep, "image_id", "left_anti").withColumn("_t", turn(seed, "image_id")).withColumn("_b", F.substring("_t", 1, 2))
    blocks = others.groupBy("class_id", "_b").agg(F.sum("n").alias("_n"))
    before_block = Window.partitionBy("class_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("class_id", "_b", F.coalesce(F.sum("_n").over(before_block), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("class_id", "_b").orderBy("_t", "image_id").rowsBetween(Window.unboundedPreceding, -1)
    run = others.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["class_id", "_b"]).join(base, "class_id", "left")
    sofar = F.coalesce("base", F.lit(0)) + F.col("_before") + F.col("_in")
    taken = run.groupBy("image_id").agg(F.min(sofar).alias("least")).where(F.col("least") < limit)
    return keep.select("image_id").unionByName(taken.select("image_id"))


def balance(boxes: DataFrame, target_min: int = 4000, soft_cap: int = 12000, hard_cap: int = 18000, seed=42) -> DataFrame:
    """(image_id) selected: every image with a class below the soft cap, then others while one of their classes is below it."""
    if soft_cap > hard_cap or target_min > hard_cap:
        raise ValueError("soft_cap and target_min may not exceed hard_cap")
    scarce = boxes.groupBy("class_id").agg(F.count("*").alias("c")).where(F.col("c") < soft_cap)
    keep = boxes.join(F.broadcast(scarce), "class_id", "left_semi").select("image_id").distinct()
    return _take_below(boxes, keep, max(soft_cap, target_min), seed)


def greedy_cap(boxes: DataFrame, minority=(3, 4, 5, 7), most: int = 12000, seed=42) -> DataFrame:
    """(image_id) selected: every image with a minority class, then others while one of their classes is below `most`."""
    return _take_below(boxes, boxes.where(F.col("class_id").isin(*minority)).select("image_id").distinct(), most, seed)


def _before(rows: DataFrame, names: dict, spans: tuple = ()) -> DataFrame:
    """rows(k, _t, image_id) with sums (name -> column) over all rows before them in the order of these three; with spans=("k",) in their pass only.

    Rows meet by pass and first two digits of the hash; the sums of these blocks, far fewer than rows, are added up in one window.
    """
    keyed = rows.withColumn("_b", F.substring("_t", 1, 2)).withColumns({f"_v_{n}": c for n, c in names.items()})
    blocks = keyed.groupBy("k", "_b").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names))
    upto = Window.partitionBy(*spans).orderBy("k", "_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("k", "_b", *(F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)).alias(f"_s_{n}") for n in names))
    inside = Window.partitionBy("k", "_b").orderBy("_t", "image_id").rowsBetween(Window.unboundedPreceding, -1)
    for n in names:
        keyed = keyed.withColumn(f"_i_{n}", F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)))
    joined = keyed.join(blocks, ["k", "_b"])
    return joined.select(*rows.columns, *((F.col(f"_s_{n}") + F.col(f"_i_{n}")).alias(n) for n in names))


def topup_plan(boxes: DataFrame, target: int, most: int = 4000, seed=42, least_ops: int = 1, most_ops: int = 3, ops=("brightness", "noise", "blur", "hflip"), hashed=None, forbidden: DataFrame | None = None, within: int = 8, bits: int = 63, tries: int = 20, told: dict | None = None) -> DataFrame:
    """(new_id, class_id, image_id, ops): copies to make until every class has `target` boxes, neediest class first.

    One round per class, neediest first. Its queue is all its images in a hash order, then all of them in another, and so on; copies are
    made along the queue until their boxes cover what is missing, or until there are `most` copies in all. Counts are updated between
    rounds from per-class sums, eight numbers.

    With forbidden(h) and hashed, a copy whose hash is within `within` bits of a forbidden one is rejected and the queue goes on, for at
    most `tries` times `most` copies tried in all. hashed takes copies(copy_id, image_id, ops, ..) and returns them with h, null where
    no copy can be made; such a copy counts as tried. The forbidden hashes are indexed by bands and written once. A stretch of the queue
    is hashed at a time, just what would be enough without rejections, then twice as much, so that rounds stay few when most are rejected.

    told, if given, takes the numbers of copies added, tried and rejected (near or not made).
    """
    per = _written(image_classes(boxes), "topup")
    index = None if forbidden is None else _written(band_index(forbidden, within, bits), "forbidden")
    had = {r.class_id: (r.n, r.images) for r in per.groupBy("class_id").agg(F.sum("n").alias("n"), F.count("*").alias("images")).collect()}
    counts, made, left, tries_left = {c: n for c, (n, _) in had.items()}, [], most, tries * most
    names = F.array_sort(F.array(*(F.struct(F.md5(F.concat_ws("|", "_t", F.lit(o))).alias("h"), F.lit(o).alias("op")) for o in ops)))
    n_ops = least_ops + F.conv(F.substring("_t", 29, 4), 16, 10).cast("int") % (most_ops - least_ops + 1)
    for c in sorted(range(len(CLASSES)), key=lambda k: (counts.get(k, 0), k)):
        if c not in had:
            continue
        (own, images), need = had[c], target - counts[c]
        tried, boxes_tried, at, ahead, picks = 0, 0, 0, 1, []
        while need > 0 and left > 0 and tries_left > 0:
            until_boxes, until = boxes_tried + need * ahead, tried + min(tries_left, left * ahead)
            passes = F.sequence(F.lit(tried // images + 1), F.lit(min((until_boxes - 1) // own, (until - 1) // images) + 1))
            queue = per.where(F.col("class_id") == c).withColumn("k", F.explode(passes)).withColumn("_t", turn(seed, F.lit(c), "k", "image_id"))
            queue = _before(queue, {"_boxes": F.col("n"), "_place": F.lit(1)}, ("k",))
            place = (F.col("k") - 1) * images + F.col("_place")
            stretch = queue.where((place >= tried) & (place < until) & ((F.col("k") - 1) * own + F.col("_boxes") < until_boxes)).select("class_id", "image_id", "n", "k", "_t", F.slice(F.transform(names, lambda s: s["op"]), F.lit(1), n_ops).alias("ops"))
            if index is None:
                tested = stretch.withColumn("ok", F.lit(1))
            else:
                copies = _written(hashed(stretch.withColumn("copy_id", F.concat_ws("_", "class_id", "k", "image_id"))), "copies")
                near = probed(copies.select("h"), index, within, bits).select(F.col("left_h").alias("h")).distinct().withColumn("_near", F.lit(1))
                tested = copies.join(near, "h", "left").select(*stretch.columns, F.expr("int(h is not null and _near is null)").alias("ok"))
            ranked = _before(tested, {"_had": F.col("n") * F.col("ok"), "_made": F.col("ok")})
            used = _written(ranked.where((F.col("_had") < need) & (F.col("_made") < left)).withColumn("at", F.col("_made") + at), "tried")
            sums = used.agg(F.count("*").alias("tried"), F.sum("n").alias("boxes"), F.sum("ok").alias("made"), F.sum(F.col("n") * F.col("ok")).alias("got")).first()
            tried, boxes_tried, at, ahead = tried + sums.tried, boxes_tried + sums.boxes, at + sums.made, ahead * 2
            need, left, tries_left = need - sums.got, left - sums.made, tries_left - sums.tried
            picks.append(used.where("ok = 1"))
        if picks:
            new = reduce(DataFrame.unionByName, picks)
            for r in new.select("image_id").join(per, "image_id").groupBy("class_id").agg(F.sum("n").alias("n")).collect():
                counts[r.class_id] += r.n
            made.append(new)
    if told is not None:
        told.update(added=most - left, tried=tries * most - tries_left, rejected=tries * most - tries_left - (most - left))
    if not made:
        return per.where("false").select(F.lit("").alias("new_id"), "class_id", "image_id", F.array().cast("array<string>").alias("ops"))
    new_id = F.concat_ws("_", F.lit("aug"), "class_id", F.lpad(F.col("at").cast("string"), 6, "0"))
    return reduce(DataFrame.unionByName, made).select(new_id.alias("new_id"), "class_id", "image_id", "ops")


def topup_floor(boxes: DataFrame, floor: int = 2000, seed=42, **near) -> DataFrame:
    """topup_plan with a floor, 2 to 4 of five operations and at most 60,000 copies tried.

    The rule's ceiling of three times what a class had never binds, as it is never below the floor.
    """
    return topup_plan(boxes, floor, 60000, seed, 2, 4, ("brightness", "noise", "blur", "hflip", "rotate"), **{"tries": 1} | near)


def sample_balanced(boxes: DataFrame, per_class: int = 20, seed=42) -> DataFrame:
    """(image_id, copy): class after class, images until `per_class` hold it, counting those taken before; then reused images.

    Every image that a round takes adds one to its class, so the round takes the first per_class - covered unselected images.
    Eight rounds of at most per_class rows each.
    """
    per = image_classes(boxes).select("image_id", "class_id")
    spark = boxes.sparkSession
    chosen = spark.createDataFrame([], per.select("image_id").schema)
    counts = dict.fromkeys(range(len(CLASSES)), 0)
    for c in counts:
        need = per_class - counts[c]
        if need <= 0:
            continue
        pool = per.where(F.col("class_id") == c).join(F.broadcast(chosen), "image_id", "left_anti")
        new = spark.createDataFrame(pool.orderBy(turn(seed, "class_id", "image_id"), "image_id").limit(need).select("image_id").collect(), chosen.schema)  # need rows
        chosen = chosen.union(new)
        for r in per.join(F.broadcast(new), "image_id").groupBy("class_id").count().collect():
            counts[r.class_id] += r["count"]
    out = chosen.withColumn("copy", F.lit(0))
    for c in counts:
        need = per_class - counts[c]
        pool = per.where(F.col("class_id") == c).orderBy(turn(seed, F.lit("fill"), "class_id", "image_id"), "image_id").limit(per_class)
        have = pool.count() if need > 0 else 0
        if have:
            fill = pool.withColumn("_i", F.row_number().over(Window.orderBy(turn(seed, F.lit("fill"), "class_id", "image_id"), "image_id")))  # per_class rows
            fill = fill.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(-(-need // have))))).where((F.col("copy") - 1) * have + F.col("_i") <= need).select("image_id", "copy")
            for r in per.join(F.broadcast(fill), "image_id").groupBy("class_id").count().collect():
                counts[r.class_id] += r["count"]
            out = out.union(fill)
    return out


def priority_sample(images: DataFrame, boxes: DataFrame, n: int, priority=(4, 5, 7, 3), seed=42) -> DataFrame:
    """(image_id): of each priority class the first max(1, n / 8) of its shuffled images, without repeats; the rest at random."""
    share = max(1, n // 8)
    per = image_classes(boxes).where(F.col("class_id").isin(*priority))
    by = Window.partitionBy("class_id").orderBy(turn(seed, "class_id", "image_id"), "image_id")
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("class_id"))
    first = per.withColumn("k", F.row_number().over(by)).where(F.col("k") <= share).groupBy("image_id").agg(F.min(order * 1000000 + F.col("k")).alias("o"))
    rest = images.select("image_id").join(first, "image_id", "left_anti").orderBy(turn(seed, "image_id"), "image_id").limit(n)
    both = first.select("image_id", "o").union(rest.select("image_id", F.lit(None).cast("long")))
    return both.orderBy(F.col("o").asc_nulls_last(), turn(seed, "image_id"), "image_id").limit(n).select("image_id")


def webcam_plan(images: DataFrame, fraction: float = 0.4, dual: bool = True, seed=42) -> DataFrame:
    """(new_index, image_id, pass): the first max(1, n * fraction) images of the shuffle, for one or two passes."""
    ranked = global_rank(images.select("image_id").withColumn("_t", turn(seed, "image_id")), "_t", "image_id")
    n = F.greatest(F.lit(1), F.floor(F.col("total") * fraction))
    picked = (ranked if fraction == 1 else ranked.where(F.col("rank") <= n)).select("image_id", "rank", n.alias("n"))  # without a cut nothing is ranked for whom the index does not matter
    passes = F.array(*map(F.lit, ["warm", "cool"] if dual else ["warm"]))
    return picked.select("image_id", "rank", "n", F.posexplode(passes).alias("p", "pass")).select((F.col("p") * F.col("n") + F.col("rank") - 1).alias("new_index"), "image_id", "pass")


def label_queue(images: DataFrame, drafts: DataFrame, most: int, seed=42) -> DataFrame:
    """Images to review: one per digest over all sources, then at most `most` of a source, with draft labels where there are any."""
    return cap_per_source(dedup_exact(images), most, seed).join(drafts, "image_id", "left")


def first_n(rows: DataFrame, n: int, order: str = "image_id") -> DataFrame:
    """The first n rows in path order."""
    return rows.orderBy(order).limit(n)
