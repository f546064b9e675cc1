"""Exact and near duplicates of images, leakage between splits, and quarantine."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT_PAIRS = (("train", "valid"), ("train", "test"), ("valid", "test"))


def first_of(rows: DataFrame, key, order) -> DataFrame:
    """The first row of each key; a window group limit keeps one row per key before the shuffle."""
    by = Window.partitionBy(*([key] if isinstance(key, (str, Column)) else key)).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def dedup_exact(images: DataFrame, digest: str = "content_md5", order=("source_id", "image_id")) -> DataFrame:
    """One image per digest, by source rank and then path."""
    return first_of(images, digest, [F.col(c) for c in order])


def dedup_prefix(files: DataFrame, n: int = 16384, content: str = "content", order=("path",)) -> DataFrame:
    """One file per MD5 of its first n bytes; cheaper, and may merge different files."""
    return first_of(files.withColumn("prefix_md5", F.md5(F.substring(content, 1, n))), "prefix_md5", [F.col(c) for c in order])


def dedup_path(files: DataFrame) -> DataFrame:
    """One row per source and path."""
    return files.dropDuplicates(["source", "path"])


def leak_exact(items: DataFrame, digest: str = "content_md5") -> DataFrame:
    """(digest, splits, items): digests in more than one split."""
    found = items.groupBy(digest).agg(F.sort_array(F.collect_set("split")).alias("splits"), F.count("*").alias("items"))
    return found.where(F.size("splits") > 1)


def removals_exact(items: DataFrame, digest: str = "content_md5", item: str = "item_id") -> DataFrame:
    """Items to remove where a digest spans splits: its train members, or without any its valid members.

    Splits are told per digest by an aggregate, so copies of one file never meet in one task; the join back is on digests that span.
    """
    facts = items.groupBy(digest).agg(F.min("split").alias("_a"), F.max("split").alias("_z"), F.bool_or(F.col("split") == "train").alias("_train"))
    told = facts.where("_a <> _z").select(digest, F.when(F.col("_train"), "train").otherwise("valid").alias("split"))
    return items.join(told, [digest, "split"], "left_semi").select(item)


def _bands(h: Column, bits: int, n: int) -> list[Column]:
    """h cut into n bands of nearly equal width, each with its number in front."""
    out, at = [], 0
    for k in range(n):
        width = bits // n + (k < bits % n)
        out.append(F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return out


def band_index(hashes: DataFrame, within: int = 8, bits: int = 63) -> DataFrame:
    """(right_h, band, value): distinct hashes by the bands that `probed` looks in; a null hash has none. Write it down to probe it often."""
    n = within // 3 + 1
    return hashes.where("h is not null").select(F.col("h").alias("right_h")).distinct().select("right_h", F.posexplode(F.array(*_bands(F.col("right_h"), bits, n))).alias("band", "value"))


def probed(left: DataFrame, index: DataFrame, within: int = 8, bits: int = 63) -> DataFrame:
    """(left_h, right_h, dist) of the hashes of left(h) and those of a band_index of the same bounds, at Hamming distance `within` or less."""
    n = within // 3 + 1
    width = bits // n + (bits % n > 0)
    flips = [0, *(1 << i for i in range(width)), *((1 << i) | (1 << j) for i, j in combinations(range(width), 2))]
    masks = left.sparkSession.createDataFrame([(f,) for f in flips], "mask bigint")  # 1 + w + w(w-1)/2 rows
    own = band_index(left, within, bits).withColumnRenamed("right_h", "left_h")
    probes = own.crossJoin(F.broadcast(masks)).select("left_h", "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    dist = F.bit_count(F.col("left_h").bitwiseXOR(F.col("right_h")))
    return probes.join(index, ["band", "value"]).where(dist <= within).select("left_h", "right_h", dist.alias("dist")).distinct()


def _turned(hashes: DataFrame, name: str, within: int, bits: int) -> DataFrame:
    """Rows of hashes(name, ..) by each value at distance 0 or 1 of each band: band, key (band and value), and the bit turned, or 0, as name_m."""
    n = within // 3 + 1
    width = bits // n + (bits % n > 0)
    masks = F.array(*(F.lit(m) for m in (0, *(1 << i for i in range(width)))))
    rows = hashes.select("*", F.posexplode(F.array(*_bands(F.col(name), bits, n))).alias("band", "_v"))
    rows = rows.withColumn(f"{name}_m", F.explode(masks))
    key = F.shiftleft(F.col("band").cast("bigint"), width).bitwiseOR(F.col("_v").bitwiseXOR(F.col(f"{name}_m")))
    return rows.withColumn("key", key).drop("_v")


def _near(left: DataFrame, right: DataFrame, within: int, bits: int) -> DataFrame:
    """Rows of left(left_h, ..) and right(right_h, ..), distinct hashes, at Hamming distance `within` or less, each pair once, with dist.

    Cut into `within // 3 + 1` wide bands, two such hashes differ by at most 2 bits in one band. Both sides take every value at
    distance 0 or 1 of each band, so such bands share a value: 1 + w rows a band on each side, where one side alone would need
    1 + w + w(w-1)/2. Of the values they share one counts (a single turned bit is the left's, of two the left turns the lower), and
    of the bands the first, so no pair comes twice and none is missed. Bands of about 21 bits keep candidates rare.
    Spark sizes a side by its hashes, not by the rows they become, and would broadcast it: a merge join is asked for.
    """
    n = within // 3 + 1
    b = _turned(right, "right_h", within, bits).withColumnRenamed("band", "_band")
    apart = F.col("left_h").bitwiseXOR(F.col("right_h"))
    once = (F.col("right_h_m") == 0) | ((F.col("left_h_m") > 0) & (F.col("left_h_m") < F.col("right_h_m")))
    for k, x in enumerate(_bands(apart, bits, n)[:-1]):
        once &= (F.col("band") <= k) | (F.bit_count(x) > 2)
    dist = F.bit_count(apart)
    met = _turned(left, "left_h", within, bits).join(b.hint("merge"), "key").where(once & (dist <= within))
    return met.select(*left.columns, *right.columns, dist.alias("dist"))


def near_pairs(left: DataFrame, right: DataFrame, within: int = 8, bits: int = 63) -> DataFrame:
    """(left_h, right_h, dist) of distinct hashes at Hamming distance `within` or less, by exact search. left(h), right(h)."""
    own = lambda side, name: side.where("h is not null").select(F.col("h").alias(name)).distinct()
    return _near(own(left, "left_h"), own(right, "right_h"), within, bits)


def _across(items: DataFrame, within: int, bits: int) -> DataFrame:
    """(left_h, right_h, dist, splits): near hashes with those of SPLIT_PAIRS (left_split, right_split) that they stand in; one search for all of them."""
    has = lambda s: F.bool_or(F.col("split") == s)
    names = sorted({s for pair in SPLIT_PAIRS for s in pair})
    hashes = items.where("h is not null").groupBy("h").agg(*(has(s).alias(s) for s in names))
    side = lambda name, own: hashes.where(" or ".join(own)).select(F.col("h").alias(f"{name}_h"), F.struct(*own).alias(name))
    pairs = _near(side("left", sorted({a for a, _ in SPLIT_PAIRS})), side("right", sorted({b for _, b in SPLIT_PAIRS})), within, bits)
    both = [F.when(F.col("left")[a] & F.col("right")[b], F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"))) for a, b in SPLIT_PAIRS]
    return pairs.select("left_h", "right_h", "dist", F.array_compact(F.array(*both)).alias("splits")).where(F.size("splits") > 0)


def leak_near(items: DataFrame, within: int = 8, bits: int = 63, item: str = "item_id") -> DataFrame:
    """(left_split, left, right_split, right, dist): near duplicates across split pairs. items(item, split, h)."""
    pairs = _across(items, within, bits).select("left_h", "right_h", "dist", F.inline("splits"))
    side = lambda name: items.select(F.col("h").alias(f"{name}_h"), F.col("split").alias(f"{name}_split"), F.col(item).alias(name))
    found = pairs.join(side("left"), ["left_h", "left_split"]).join(side("right"), ["right_h", "right_split"])
    return found.select("left_split", "left", "right_split", "right", "dist")


def removals_near(items: DataFrame, within: int = 8, bits: int = 63, item: str = "item_id") -> DataFrame:
    """The left member of every near pair. One pass is enough: every left item with a match goes in it; pairs of items are not made."""
    hit = _across(items, within, bits).select(F.col("left_h").alias("h"), F.explode("splits.left_split").alias("split")).distinct()
    return items.join(hit, ["h", "split"], "left_semi").select(item).distinct()


def quarantine(images: DataFrame, removals: DataFrame, item: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined)."""
    ids = removals.select(item).distinct()
    return images.join(ids, item, "left_anti"), images.join(ids, item, "left_semi")


def reject_near(candidates: DataFrame, forbidden: DataFrame, within: int = 8, bits: int = 63) -> DataFrame:
    """Candidates(h, ...) that are not near any forbidden hash."""
    hits = near_pairs(candidates.select("h"), forbidden.select("h"), within, bits).select(F.col("left_h").alias("h")).distinct()
    return candidates.join(hits, "h", "left_anti")
