"""The data source of recordings, versioned tables, nested contracts, own methods, and beats as rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arterion.functions import features, rppg
from arterion.operators import methods, vectors
from arterion.sources import recordings, schemas, synthetic
from arterion.sources.versions import VersionedTable


def test_recordings_are_written_and_read_by_their_format(spark, tmp_path):
    from arterion.sources import files

    recordings.register(spark)
    made = [synthetic.record(synthetic.Scenario(seconds=2, seed=k)) for k in range(5)]
    rows = [(f"r{k}", r.ts.tolist(), {n: v.tolist() for n, v in r.rgb.items()}, r.face.tolist(), None if k == 3 else r.beats.tolist()) for k, r in enumerate(made)]
    df = spark.createDataFrame(rows, files.RECORDING).repartition(3)
    path = str(tmp_path / "study")
    df.write.format("recordings").mode("append").save(path)
    back = spark.read.format("recordings").load(path)
    assert back.rdd.getNumPartitions() == 5 and sorted(p.name for p in (tmp_path / "study").iterdir()) == [f"r{k}.npz" for k in range(5)]
    assert {r["recording_id"]: (r["timestamps"], r["beats"]) for r in back.collect()} == {r[0]: (r[1], r[4]) for r in rows}
    assert files.read_recordings(spark, path).count() == 5
    df.where("recording_id = 'r1'").write.format("recordings").mode("overwrite").save(path)
    assert [r["recording_id"] for r in spark.read.format("recordings").load(path).collect()] == ["r1"]

    def broken(batches):
        for pdf in batches:
            yield pdf
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        df.mapInPandas(broken, files.RECORDING).write.format("recordings").mode("append").save(path)
    assert [p.name for p in (tmp_path / "study").iterdir() if not p.name.startswith("_")] == ["r1.npz"]


SCHEMA = "key int, version int, state string, deleted boolean"


def test_upserts_are_idempotent_and_commit_by_one_rename(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ("key",))
    of = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert table.read().count() == 0
    table.upsert(of((1, 1, "a", None), (2, 1, "b", None), (1, 2, "c", None)))
    table.upsert(of((1, 1, "old", None), (2, 3, "gone", True), (3, 1, "d", False)))
    state = lambda: sorted((r["key"], r["version"], r["state"]) for r in table.read().collect())
    assert state() == [(1, 2, "c"), (3, 1, "d")]
    assert table.upsert(of((4, 1, "e", None)), ("s", 7)) and not table.upsert(of((4, 2, "twice", None)), ("s", 7)) and len(state()) == 3
    before = state()
    monkeypatch.setattr(table, "_commit", lambda manifest: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        table.upsert(of((1, 9, "lost", None)))
    with pytest.raises(OSError, match="stopped"):
        table.compact()
    assert state() == before
    monkeypatch.undo()
    table.compact()
    assert state() == before and len(table.manifest()["parts"]) == 1 and not table.upsert(of((4, 3, "x", None)), ("s", 5))


def test_a_stream_upserts_each_batch_once(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, 1, f"s{k}", None), (9, k, f"v{k}", None)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ("key",))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        source.writeStream.foreachBatch(table.writer("in")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r["key"]: r["version"] for r in table.read().collect()} == {0: 1, 1: 1, 2: 1, 9: 2} and table.manifest()["batches"] == {"in": 2}


def test_nested_contracts_refuse_unknown_and_missing_keys(spark, tmp_path):
    vital = T.StructType([T.StructField("code", T.StringType(), False), T.StructField("value", T.DoubleType())])
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("vitals", T.ArrayType(vital, False)), T.StructField("meta", T.StructType([T.StructField("source", T.StringType())])), T.StructField("rois", T.MapType(T.StringType(), T.DoubleType(), False))])
    texts = ['{"id": 1, "vitals": [{"code": "a", "value": 2.0}], "meta": {"source": "x"}, "rois": {"any": 1.0}}', '{"id": 2, "vitals": [{"code": "a", "more": 1}, {"code": "b"}]}', '{"id": 3, "meta": {"source": "x", "deep": {}}, "top": 1}', '{"id": 4, "vitals": [{"value": 1.0}]}', '{"vitals": null}', "{broken", "[]", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r["k"]: (r["value"]["id"] if r["value"] else None, r["refused"]) for r in schemas.parsed(rows, "text", schema).collect()}
    assert got[0] == (1, []) and got[1] == (None, ["vitals[].more"]) and got[2] == (None, ["top", "meta.deep"]) and got[3] == (None, ["vitals[].code"]) and got[4] == (None, ["id"])
    assert all(got[k] == (None, ["not JSON of these types"]) for k in (5, 6, 7))
    null = {"type": "null"}
    want = {
        "type": "object", "additionalProperties": False, "required": ["id"],
        "properties": {
            "id": {"type": "integer"}, "meta": {"anyOf": [{"type": "object", "additionalProperties": False, "required": [], "properties": {"source": {"anyOf": [{"type": "string"}, null]}}}, null]},
            "rois": {"anyOf": [{"type": "object", "additionalProperties": {"type": "number"}}, null]},
            "vitals": {"anyOf": [{"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["code"], "properties": {"code": {"type": "string"}, "value": {"anyOf": [{"type": "number"}, null]}}}}, null]},
        },
    }
    assert schemas.json_schema(schema) == want
    schemas.export(spark, {"result": schema}, str(tmp_path / "s"))
    held = json.loads(spark.read.json(str(tmp_path / "s")).first()["schema"])
    assert held["title"] == "result" and {k: held[k] for k in want} == want


def test_own_methods_are_called_from_sql_and_from_project(spark):
    scale = 3.0
    name = methods.register(spark, "mean_of_two", lambda rgb, fs: scale * (rgb[:, 0] + rgb[:, 1]) / fs)
    rows = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0], [0.0, 0.0]), (2, None, [1.0], [1.0]), (3, [1.0], [1.0, 2.0], [1.0])], "id int, r array<double>, g array<double>, b array<double>")
    rows.createOrReplaceTempView("own_method")
    got = {r["id"]: r["p"] for r in spark.sql(f"SELECT id, {name}(r, g, b, 2.0D) AS p FROM own_method").collect()}
    assert got == {1: [6.0, 9.0], 2: None, 3: None}
    methods.register(spark, "green")
    wave = synthetic.record(synthetic.Scenario(seconds=8)).rgb["forehead"]
    one = spark.createDataFrame([(1, *[wave[:, k].tolist() for k in range(3)])], "id int, r array<double>, g array<double>, b array<double>")
    assert np.allclose(one.selectExpr("pulse_green(r, g, b, 30.0D) AS p").first()["p"], rppg.green(wave, 30.0))
    del rppg.METHODS["MEAN_OF_TWO"]
    assert vectors is not None


def test_beats_are_rows_of_a_lateral_join(spark):
    windows = {k: synthetic.pulse_window(seconds=8.0, seed=k).samples.tolist() for k in range(3)} | {8: [0.0] * 50, 9: None}
    rows = spark.createDataFrame(list(windows.items()), "id int, x array<double>")
    got = methods.beats(rows, "x", 30.0, "id")
    want = [(k, n, b["foot"], b["peak"], b["end"]) for k, x in windows.items() if x for n, b in enumerate(features.segment(np.array(x), 30.0))]
    assert sorted((r["id"], r["beat"], r["foot"], r["peak"], r["finish"]) for r in got.collect()) == sorted(want) and len(want) > 12
    assert {r["id"] for r in got.groupBy("id").agg(F.sum("seconds").alias("s")).where("s > 5").collect()} == {0, 1, 2}
