"""Streams over telemetry and frames. Each has a batch twin in operators/history.py that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.operators.history import latest_snapshot  # noqa: F401  T1 is the same aggregate on a stream
from boxloom.streaming.ordered import keyed_state, ordered_fold  # noqa: F401  started inside keyed_state

#: Fixed fields of a telemetry document.
TELEMETRY = "timestamp double, cpu_util_percent double, ram_used_gb double, ram_total_gb double, gpu_util_percent int, vram_used_gb double, vram_total_gb double, gpu_temp_c int, gpu_power_w double, gpu_graphics_clock_mhz int, gpu_memory_clock_mhz int"


def telemetry_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Telemetry documents of a folder as they come, with ts and the run (its folder)."""
    raw = spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).json(path)
    return raw.select("*", F.timestamp_seconds("timestamp").alias("ts"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run"))


def active_run_stream(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The run that sent the newest sample, for update mode."""
    return stream.withWatermark("ts", late).agg(F.max_by("run", F.struct("ts", "run")).alias("run"), F.max("ts").alias("ts"))


def ema_stream(stream: DataFrame, key: str = "run", value: str = "cpu_util", order: str = "ts", tie: str | None = None, alpha: float = 0.1, late: str = "1 minute", idle_seconds: float = 86_400) -> DataFrame:
    """(key, smooth): s = (1 - alpha) s + alpha x from 0 over a key's rows in time order; see ordered_fold for late rows and silent keys."""

    def fold(state, x):
        return ((1 - alpha) * (state[0] if state else 0.0) + alpha * x,)

    return ordered_fold(stream, key, F.col(value), order, F.col(tie) if tie else F.lit(0), "s double", fold, lambda state: state, "smooth double", late, idle_seconds)


def failure_streak_stream(stream: DataFrame, n: int = 10, key: str = "run", failed: str = "failed", order: str = "ts", tie: str | None = None, late: str = "1 minute", idle_seconds: float = 86_400) -> DataFrame:
    """(key, longest, stopped): the longest run of failures in time order, and whether one exceeds n; see ordered_fold for late rows and silent keys."""

    def fold(state, bad):
        now, longest = state or (0, 0)
        now = now + 1 if bad else 0
        return now, max(longest, now)

    return ordered_fold(stream, key, F.col(failed), order, F.col(tie) if tie else F.lit(0), "now bigint, longest bigint", fold, lambda state: (state[1], state[1] > n), "longest bigint, stopped boolean", late, idle_seconds)


def detect_stream(stream: DataFrame, predict_fn, conf: float = 0.15, schema: str = "path string, class_id int, conf double, x1 double, y1 double, x2 double, y2 double") -> DataFrame:
    """Detections from conf on in a stream of frames; predict_fn() makes the model once per task."""

    def run(frames):
        model = predict_fn()
        for pdf in frames:
            yield model(pdf)

    return stream.mapInPandas(run, schema).where(F.col("conf") >= conf)
