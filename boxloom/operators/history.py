"""Run histories, telemetry rows, and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history_summary(history: DataFrame, patience: int = 20) -> DataFrame:
    """history with value (the last validated map50 or the best so far), best, is_best, streak and stopped.

    An epoch without a validated map50 (null or NaN) carries the best so far. streak counts validated epochs since the last gain;
    a run stops when it reaches `patience`.
    """
    order = Window.partitionBy("run").orderBy("epoch")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valid = F.when(~F.isnan("map50"), F.col("map50"))
    rows = history.withColumn("_v", valid).withColumn("_b", F.max("_v").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("is_best", F.coalesce(F.col("_v") > F.coalesce("_b", F.lit(0.0)), F.lit(False))).withColumn("best", F.coalesce(F.greatest(F.max("_v").over(upto), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("_g", F.sum(F.col("is_best").cast("int")).over(upto))
    streak = F.count_if(F.col("_v").isNotNull() & ~F.col("is_best")).over(Window.partitionBy("run", "_g").orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("value", F.coalesce("_v", "best")).withColumn("streak", streak).withColumn("stopped", F.col("streak") >= patience).drop("_v", "_b", "_g")


def active_run(files: DataFrame) -> DataFrame:
    """(run) with the newest results file, else directory: files(run, csv_mtime, dir_mtime)."""
    return files.agg(F.max_by("run", F.struct(F.coalesce("csv_mtime", "dir_mtime"), F.col("run"))).alias("run"))


def normalize_gpu(line: Column) -> Column:
    """Seven comma-separated fields as a struct: whole numbers, MB as GB with 2 places, an unknown power as 0; all zero on failure."""
    f = F.transform(F.split(line, ","), lambda x: F.trim(x))
    part = lambda k: F.try_element_at(f, F.lit(k + 1))
    number = lambda k: part(k).try_cast("double")
    power = F.when(part(4).isin("N/A", "[N/A]"), F.lit(0.0)).otherwise(number(4))
    values = [number(0), number(1), number(2), number(3), power, number(5), number(6)]
    ok = values[0].isNotNull()
    for v in values[1:]:
        ok = ok & v.isNotNull()
    whole = lambda v: F.coalesce(F.when(ok, v.cast("int")), F.lit(0))
    gb = lambda v: F.coalesce(F.when(ok, F.round(v.cast("int") / 1024.0, 2)), F.lit(0.0))
    return F.struct(
        whole(values[0]).alias("gpu_util_percent"), gb(values[1]).alias("vram_used_gb"), gb(values[2]).alias("vram_total_gb"), whole(values[3]).alias("gpu_temp_c"),
        F.coalesce(F.when(ok, F.round(power, 1)), F.lit(0.0)).alias("gpu_power_w"), whole(values[5]).alias("gpu_graphics_clock_mhz"), whole(values[6]).alias("gpu_memory_clock_mhz"),
    )


def ema(rows: DataFrame, alpha: float = 0.1, key: str = "run", value: str = "cpu_util", order=("ts", "event_id")) -> DataFrame:
    """(key, smooth): exponential smoothing from 0 over a key's rows, the batch twin of the stream.

    The weight of a row hangs on its place from the end alone, so it is a weighted sum after a ranking; weights below any double
    are 0, and no key's rows are gathered in one value.
    """
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("_k", F.row_number().over(w)).groupBy(key).agg(F.sum(F.col(value) * alpha * F.pow(F.lit(1 - alpha), F.col("_k") - 1)).alias("smooth"))


def failure_streak(rows: DataFrame, failed: Column, n: int = 10, key: str = "run", order=("ts", "event_id")) -> DataFrame:
    """(key, longest, stopped): longest run of failures, and whether one exceeds n; the batch twin of the stream."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("_f", failed.cast("int")).withColumn("_g", F.sum(1 - F.col("_f")).over(upto))
    runs = marked.groupBy(key, "_g").agg(F.sum("_f").alias("s"))
    return runs.groupBy(key).agg(F.max("s").alias("longest")).withColumn("stopped", F.col("longest") > n)


def latest_snapshot(rows: DataFrame, key: str = "run", order=("ts", "event_id"), values=("cpu_util", "vram_used_mb")) -> DataFrame:
    """The newest row of each key: one aggregate, in batch or as a stream in update mode."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("s")).select(key, "s.*")
