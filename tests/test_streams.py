"""Streams against their batch twins: order, late rows, silent keys, restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import history
from boxloom.streaming import monitor, snapshot
from boxloom.streaming.ordered import keyed_state

SCHEMA = "run string, ts timestamp, event_id bigint, cpu_util double, failed boolean"


def slices(path, rows, size):
    """Rows (run, seconds, id, value, failed) as JSON files of `size` rows, numbered in the order they come."""
    path.mkdir(parents=True, exist_ok=True)
    at = len(list(path.glob("*.json")))
    for k in range(0, len(rows), size):
        lines = [json.dumps({"run": r, "ts": f"2024-01-01T{int(t) // 3600:02}:{int(t) // 60 % 60:02}:{t % 60:09.6f}Z", "event_id": i, "cpu_util": x, "failed": f}) for r, t, i, x, f in rows[k : k + size]]
        (path / f"{at + k // size:05}.json").write_text("\n".join(lines))


def last(spark, frame, path):
    """The last row of each key after everything there has been read."""
    rows = {}
    with keyed_state(spark):
        q = frame.writeStream.outputMode("update").foreachBatch(lambda b, _: rows.update((r.run, tuple(r)[1:]) for r in b.collect())).trigger(availableNow=True).option("checkpointLocation", str(path)).start()
        q.awaitTermination(300)
    assert q.exception() is None
    return rows, q


def shuffled(n):
    rng = random.Random(7)
    rows = [("a", k * 0.5, k, rng.uniform(0, 100), rng.random() < 0.6) for k in range(n)] + [("b", 10.0, k, float(k), k % 5 > 0) for k in range(50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [500, 3050])
def test_folds_take_time_order(spark, tmp_path, size):
    rows = shuffled(3000)
    slices(tmp_path / "in", rows, size)
    slices(tmp_path / "in", [("end", 3 * 3600.0, 0, 0.0, False)], 1)  # its time lets all others go
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    batch = spark.createDataFrame(rows, "run string, ts double, event_id bigint, cpu_util double, failed boolean")
    got, _ = last(spark, monitor.ema_stream(stream, tie="event_id", late="1 hour"), tmp_path / "c1")
    assert {k: pytest.approx(v[0]) for k, v in got.items() if k != "end"} == {r.run: r.smooth for r in history.ema(batch).collect()}
    got, _ = last(spark, monitor.failure_streak_stream(stream, 9, tie="event_id", late="1 hour"), tmp_path / "c2")
    assert {k: v for k, v in got.items() if k != "end"} == {r.run: tuple(r)[1:] for r in history.failure_streak(batch, F.col("failed"), 9).collect()}


def test_late_rows_silent_keys_and_restarts(spark, tmp_path):
    """After a restart the state goes on; a row behind the watermark is dropped; a key silent for an hour starts anew."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    frame = monitor.failure_streak_stream(stream, 2, late="10 seconds", idle_seconds=3600)
    slices(tmp_path / "in", [("a", 1.0, 0, 0.0, True), ("a", 3.0, 0, 0.0, True), ("b", 60.0, 0, 0.0, False)], 3)
    got, _ = last(spark, frame, tmp_path / "c")
    assert got == {"a": (2, False)}
    slices(tmp_path / "in", [("a", 2.0, 0, 0.0, False), ("a", 55.0, 0, 0.0, True), ("b", 120.0, 0, 0.0, True)], 3)
    got, q = last(spark, frame, tmp_path / "c")
    assert got == {"a": (3, True), "b": (0, False)}
    assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) == 1
    slices(tmp_path / "in", [("b", 3 * 3600.0, 0, 0.0, False)], 1)
    slices(tmp_path / "in", [("a", 3 * 3600.0 + 1, 0, 0.0, True), ("b", 4 * 3600.0, 0, 0.0, False)], 2)
    got, _ = last(spark, frame, tmp_path / "c")
    assert got["a"] == (1, False)


def test_snapshots_are_whole_and_batches_count_once(spark, tmp_path):
    path, schema = str(tmp_path / "snap"), "run string, ts double, event_id bigint, cpu_util double, vram_used_mb double"
    write = snapshot.snapshot_writer(path, keep=2)
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    assert snapshot.read_snapshot(spark, path) is None
    write(batch(("a", 1.0, 1, 10.0, 1.0), ("a", 2.0, 1, 20.0, 2.0), ("b", 1.5, 1, 30.0, 3.0)), 0)
    first = snapshot.read_snapshot(spark, path)
    assert {(r.run, r.cpu_util, r.active) for r in first.collect()} == {("a", 20.0, True), ("b", 30.0, False)}
    write(batch(("b", 9.0, 1, 40.0, 4.0)), 1)
    before = snapshot.pointer(spark, path)
    write(batch(("a", 99.0, 1, 99.0, 9.0)), 1)  # the same batch again
    write(batch(("a", 99.0, 1, 99.0, 9.0)), 0)
    assert snapshot.pointer(spark, path) == before and before["active"] == "b"
    assert {(r.run, r.cpu_util, r.active) for r in snapshot.read_snapshot(spark, path).collect()} == {("a", 20.0, False), ("b", 40.0, True)}
    assert first.count() == 2  # a reader of the version before still has its files
    write(batch(("a", 0.5, 1, 77.0, 7.0), (None, None, 1, 0.0, 0.0)), 2)  # an older row changes nothing
    assert {(r.run, r.cpu_util) for r in snapshot.read_snapshot(spark, path).collect()} == {("a", 20.0), ("b", 40.0)}
    assert len([p for p in (tmp_path / "snap").iterdir() if p.name.startswith("version=")]) == 2


def test_snapshot_survives_a_broken_batch(spark, tmp_path, monkeypatch):
    """A batch that breaks off before the pointer moves leaves the old snapshot, and the restart leaves one snapshot of all rows."""
    slices(tmp_path / "in", [("a", 1.0, 0, 5.0, True)], 1)
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    run = lambda: snapshot.snapshot_stream(stream, str(tmp_path / "snap"), str(tmp_path / "c"), None, values=("cpu_util",))
    run().awaitTermination(120)
    slices(tmp_path / "in", [("a", 2.0, 0, 6.0, True), ("b", 3.0, 0, 7.0, True)], 2)
    with monkeypatch.context() as m:
        m.setattr(snapshot, "_point", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError|division"):
            run().awaitTermination(120)
    assert [(r.run, r.cpu_util) for r in snapshot.read_snapshot(spark, str(tmp_path / "snap")).collect()] == [("a", 5.0)]
    run().awaitTermination(120)
    assert {(r.run, r.cpu_util, r.active) for r in snapshot.read_snapshot(spark, str(tmp_path / "snap")).collect()} == {("a", 6.0, False), ("b", 7.0, True)}
    versions = [p.name for p in (tmp_path / "snap").iterdir() if p.name.startswith("version=")]
    assert sorted(versions) == sorted(snapshot.pointer(spark, str(tmp_path / "snap"))["kept"])
