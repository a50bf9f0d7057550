"""Event-time windows in a stream and in batch, and the registry."""

import datetime as dt

import pytest

from arterion.operators import models
from arterion.sources import registry
from arterion.streaming import windows


def test_windows_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [(1, start + dt.timedelta(seconds=k), float(k), k % 5 == 0) for k in range(120)] + [(2, start + dt.timedelta(seconds=60 * k), 1.0, False) for k in (0, 1, 50)]
    kinds = "session_id long, ts timestamp, value double, dropped boolean"
    frames = spark.createDataFrame(rows, kinds)
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = windows.hop_means(frames)
    assert batch.where("session_id = 1 AND frames = 30").count() == 46
    assert windows.gap_sessions(frames).where("session_id = 2").count() == 2
    source = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
    query = windows.hop_means(source).writeStream.format("memory").queryName("hops_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hops_out").collect())) == sorted(map(tuple, batch.collect()))


def test_registry(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"weights")
    one = registry.entry("bp_ridge", "1.2.0", "blood_pressure", "VALIDATED", "m/a.bin", b"weights")
    two = registry.entry("bp_ridge", "1.10.0", "blood_pressure", "VALIDATED", "m/b.bin", b"other")
    table = registry.add(spark, spark.createDataFrame([], registry.SCHEMA), one, two)
    assert registry.add(spark, table, one).count() == 2
    assert {(r["version"], r["ok"]) for r in registry.verified(spark, table, str(tmp_path)).collect()} == {("1.2.0", True), ("1.10.0", False)}
    assert models.latest_version(table, ("VALIDATED",)).first()["version"] == "1.10.0"
    for bad in (("X", "1.0.0", "rppg", "RETIRED", "p"), ("x", "1.0", "rppg", "RETIRED", "p"), ("x", "1.0.0", "rppg", "RETIRED", "../p"), ("x", "1.0.0", "other", "RETIRED", "p")):
        with pytest.raises(ValueError):
            registry.entry(*bad, b"")
