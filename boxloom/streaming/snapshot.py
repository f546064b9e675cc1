"""The latest row of every run as a table that is replaced whole: numbered versions and a pointer to the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current.json"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says: batch, version and active run; None before the first snapshot."""
    _, where, files = _hadoop(spark, f"{path}/{POINTER}")
    return json.loads(spark.read.text(f"{path}/{POINTER}").first()[0]) if files.exists(where) else None


def _point(spark: SparkSession, path: str, value: dict) -> None:
    """Replaces the pointer by a rename, so a reader finds the old one or the new one."""
    jvm, fresh, files = _hadoop(spark, f"{path}/.{POINTER}.{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), options)


def read_snapshot(spark: SparkSession, path: str, key: str = "run") -> DataFrame | None:
    """The current snapshot: a row per run with its latest values and whether it is the active run; None before the first one."""
    now = pointer(spark, path)
    if not now:
        return None
    return spark.read.parquet(f"{path}/{now['version']}").withColumn("active", F.coalesce(F.col(key).cast("string") == F.lit(now["active"]), F.lit(False)))


def snapshot_writer(path: str, key: str = "run", order: tuple = ("ts", "event_id"), values: tuple = ("cpu_util", "vram_used_mb"), keep: int = 3):
    """A function for foreachBatch: merges a batch into the snapshot and moves the pointer to the new version.

    The active run is the one with the newest row, the greatest key of equal ones. A batch that comes again after the pointer has moved
    past it changes nothing; one that broke off before left a version that no pointer names, and is written anew. Only the last `keep` versions stay,
    so a reader that has just read the pointer finds its files. The state merged with is one row per run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = pointer(spark, path)
        if now and now["batch"] >= batch_id:
            return
        rows = batch.select(key, *order, *values).where(F.col(order[0]).isNotNull())
        if now:
            rows = rows.unionByName(spark.read.parquet(f"{path}/{now['version']}").select(rows.columns))
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*order, *values), F.struct(*order)).alias("_s")).select(key, "_s.*")
        version = f"version={batch_id:09}-{uuid.uuid4().hex[:8]}"
        newest.write.parquet(f"{path}/{version}")
        active = spark.read.parquet(f"{path}/{version}").agg(F.max_by(F.col(key).cast("string"), F.struct(order[0], key))).first()
        kept = [*(now["kept"] if now else []), version][-keep:]
        _point(spark, path, {"batch": batch_id, "version": version, "active": active[0], "kept": kept})
        _, root, files = _hadoop(spark, path)
        for item in files.listStatus(root):
            name = item.getPath().getName()
            if name.startswith("version=") and name not in kept and int(name[8:17]) <= batch_id:
                files.delete(item.getPath(), True)

    return write


def snapshot_stream(stream: DataFrame, path: str, checkpoint: str, seconds: float | None = 2, **how):
    """Starts the snapshot of a stream, replaced every `seconds`; None reads what is there and ends."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return stream.writeStream.foreachBatch(snapshot_writer(path, **how)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
