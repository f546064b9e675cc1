"""Queries that run a stream over the given tables, written as files in slices, to its end; their SQL is that of the batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.plans.box_queries import query
from boxloom.sources.folders import shared_path
from boxloom.streaming import monitor, snapshot

#: Files that a table is dealt to; a batch reads one.
SLICES = 3
#: Longer than the telemetry of the tables, so that no row is late whatever slice it is in.
LATE = "10000 days"
TELEMETRY = "event_id bigint, run bigint, ts timestamp, event_type string, cpu_util double, vram_used_mb double"


def _telemetry(v, flush: bool) -> DataFrame:
    """fx_telemetry as a stream of slices without any order, then a row so late that all others are released."""
    rows, path = v("fx_telemetry"), shared_path(v("part").sparkSession, "telemetry")
    rows = rows.select(F.col("event_id").cast("bigint"), F.col("run").cast("bigint"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("cpu_util").cast("double"), F.col("vram_used_mb").cast("double"))
    rows.repartition(SLICES, "event_id").write.parquet(path)
    if flush:
        last = rows.agg(F.max("ts").alias("ts")).where("ts is not null").select(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("run"), (F.col("ts") + F.expr("interval 20000 days")).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(0.0).alias("cpu_util"), F.lit(0.0).alias("vram_used_mb"))
        last.coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", 1).parquet(path)


def _ended(frame: DataFrame, key: str) -> DataFrame:
    """The last row of each key when the stream has read all."""
    spark = frame.sparkSession
    out, checkpoint = shared_path(spark, "stream"), shared_path(spark, "offsets")
    put = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    with monitor.keyed_state(spark):
        run = frame.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    columns = frame.columns
    found = spark.read.schema(frame.withColumn("batch", F.lit(0)).schema).parquet(out)
    return found.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), "batch").alias("_s")).select("_s.*")


@query("t3_ema_stream", "SELECT run, sum(cpu_util * 0.1e0 * pow(0.9e0, k - 1)) AS smooth FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC) AS k FROM fx_telemetry) GROUP BY 1")
def _(v):
    return _ended(monitor.ema_stream(_telemetry(v, True), tie="event_id", late=LATE, idle_seconds=1e9), "run")


@query("t4_failure_streak_stream", "WITH g AS (SELECT run, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM fx_telemetry), s AS (SELECT run, g, count(*) FILTER (f) AS s FROM g GROUP BY 1, 2) SELECT run, max(s) AS longest, max(s) > 1 AS stopped FROM s GROUP BY 1")
def _(v):
    stream = _telemetry(v, True).withColumn("failed", F.col("event_type") == "error")
    return _ended(monitor.failure_streak_stream(stream, 1, tie="event_id", late=LATE, idle_seconds=1e9), "run")


@query("t1_snapshot_stream", "SELECT *, run = (SELECT max_by(run, (ts, run)) FROM (SELECT run, max(ts) AS ts FROM fx_telemetry GROUP BY 1)) AS active FROM (SELECT run, event_id, cpu_util, vram_used_mb FROM fx_telemetry QUALIFY row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC) = 1)")
def _(v):
    stream = _telemetry(v, False)
    path, checkpoint = shared_path(stream.sparkSession, "snapshot"), shared_path(stream.sparkSession, "offsets")
    snapshot.snapshot_stream(stream, path, checkpoint, None).awaitTermination()
    return snapshot.read_snapshot(stream.sparkSession, path).drop("ts")


@query("t2_active_run_stream", "SELECT max_by(run, (ts, run)) AS run FROM (SELECT run, max(ts) AS ts FROM fx_telemetry GROUP BY 1)")
def _(v):
    return _ended(monitor.active_run_stream(_telemetry(v, False), LATE).withColumn("all", F.lit(1)), "all").select("run")


def frame_model():
    """A stand-in for a detector: each line of a frame file is an image, its class and confidence the best of the first eight numbers after its id."""
    import numpy as np
    import pandas as pd

    def predict(frames: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for content in frames["content"]:
            for line in bytes(content).decode().splitlines():
                image, *numbers = line.split(",")
                x = np.array(numbers, float)
                best = int(x[:8].argmax())
                rows.append((image, best, 1 / (1 + np.exp(-x[best])), *x[8:12]))
        return pd.DataFrame(rows, columns=["path", "class_id", "conf", "x1", "y1", "x2", "y2"])

    return predict


@query("t5_detect_stream", "SELECT CAST(vec_id AS VARCHAR) AS path, CAST(list_position(v, list_max(v)) - 1 AS INT) AS class_id, 1 / (1 + exp(-list_max(v))) AS conf, x1 FROM (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS v, CAST(embedding[9] AS DOUBLE) AS x1 FROM embeddings) WHERE 1 / (1 + exp(-list_max(v))) >= 0.55")
def _(v):
    """Frame files of fifty images each, read by a stream of whole files and scored by a model made once per task."""
    images = v("embeddings")
    spark, path = images.sparkSession, shared_path(v("part").sparkSession, "frames")
    line = F.concat_ws(",", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ","))
    files = images.groupBy(F.floor(F.col("vec_id") / 50).alias("frame")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", 20).load(path)
    found = monitor.detect_stream(stream.select("path", "content"), frame_model, 0.55)
    out, checkpoint = shared_path(spark, "found"), shared_path(spark, "offsets")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("path", "class_id", "conf", "x1")
