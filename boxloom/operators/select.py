"""Exact order statistics and running sums of large groups, without bringing a group together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.sources.folders import shared_path


def exact_median(rows: DataFrame, key: str, value: str, buckets: int = 1024, small: int = 10_000) -> DataFrame:
    """(key, median): the mean of the two middle values of each key, the middle one if their number is odd; null and NaN do not count, nor rows without a key.

    Selection by counting: the values between the bounds of a key's middle are counted in even buckets, and the bounds become the least
    and greatest value of the bucket that holds the middle, until it has at most `small` values or only one. Buckets are counted before
    the shuffle, so whatever the size of a key, no more than `small` of its values are ever in one place.
    """
    x = F.col(value).cast("double")
    own = rows.select(F.col(key).alias("_k"), x.alias("_x")).where("_k is not null and _x is not null and not isnan(_x)")
    bounds = own.groupBy("_k").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    bounds = bounds.withColumn("rank", F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))))).withColumn("at", F.col("rank"))
    path = shared_path(rows.sparkSession, "bounds")
    step, same = 0, ["_k", "rank"]

    def stored(frame):
        nonlocal step
        step += 1
        frame.write.parquet(f"{path}/{step}")
        return rows.sparkSession.read.schema(frame.schema).parquet(f"{path}/{step}")

    bounds = stored(bounds)
    while not bounds.where(f"n > {small} and lo < hi").isEmpty():
        near = own.join(bounds, "_k").where("_x between lo and hi")
        width, least = F.col("hi") / 2 - F.col("lo") / 2, F.col("_x") > F.col("lo")  # halves, as the whole could pass the greatest double
        bucket = F.when(width > 0, F.least(F.floor((F.col("_x") / 2 - F.col("lo") / 2) / width * buckets), F.lit(buckets - 1))).otherwise(least.cast("bigint"))
        counted = near.groupBy(*same, "at", bucket.alias("b")).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*same).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bounds = stored(counted.withColumn("before", before).where("at >= before and at < before + n").select("_k", "n", "lo", "hi", "rank", (F.col("at") - F.col("before")).alias("at")))
    left = own.join(bounds.where("lo < hi"), "_k").where("_x between lo and hi").groupBy(*same, "at").agg(F.sort_array(F.collect_list("_x")).alias("_all"))
    found = left.select("_k", F.expr("_all[cast(at as int)]").alias("_v")).unionByName(bounds.where("lo = hi").select("_k", F.col("lo").alias("_v")))
    return found.groupBy(F.col("_k").alias(key)).agg(F.expr("(min(_v) + max(_v)) / 2").alias("median"))


def in_ranges(rows: DataFrame, groups: list[str], order: list, parts: int | None = None) -> DataFrame:
    """rows with part: ranges of (groups, order), numbered along it and written down, so that running values can be carried over them.

    A range holds about as many rows as any other, whatever the group sizes; a group over several ranges has rising part numbers.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "ranges")
    dealt = rows.repartitionByRange(parts, *groups, *order).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def carried(rows: DataFrame, groups: list[str], totals: dict, falling: bool = False) -> DataFrame:
    """rows of in_ranges with columns of what lies in the earlier ranges of the group, or the later ones if falling.

    totals: name -> (aggregate of a range, function that joins the ranges' values). One row per group and range meets in a window.
    """
    own = rows.groupBy(*groups, "part").agg(*(a.alias(f"_{n}") for n, (a, _) in totals.items()))
    order = F.desc("part") if falling else F.asc("part")
    before = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    told = own.select(*groups, "part", *(f(f"_{n}").over(before).alias(n) for n, (_, f) in totals.items()))
    return rows.join(told, [*groups, "part"])
