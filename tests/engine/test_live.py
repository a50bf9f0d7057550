"""Live measurement, frame operators, health operators, tensors and further sources."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arterion.functions import features, rppg, video
from arterion.operators import accuracy, arrays, contracts, frames, health, inference, models, rules
from arterion.sources import files, recordings, registry, synthetic
from arterion.streaming import live


def camera(seconds=14.0, lost=(), seed=5, **more):
    """Frames of a made-up session as a table."""
    r = synthetic.record(synthetic.Scenario(seconds=seconds, seed=seed, **more))
    rgb = np.mean(list(r.rgb.values()), 0)
    t = r.ts - r.ts[0]
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"session_id": 1, "t": t, "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2], "x": 100 + rng.normal(0, 0.3, len(t)), "y": 80 + rng.normal(0, 0.3, len(t)), "w": 120.0, "h": 150.0, "frame_w": 640.0, "luma": 120.0 + rng.normal(0, 1, len(t))})
    gone = np.zeros(len(t), bool)
    for a, b in lost:
        gone |= (t >= a) & (t < b)
    pdf.loc[gone, ["r", "g", "b", "x", "y", "w", "h"]] = None
    return pdf, r


def run(pdf, regions=None, session=None, **more):
    """What a session says of frames; ``regions``: colours of the three regions, (n, 9)."""
    table = pdf.assign(control=pdf.get("control"), **{c: None if regions is None else regions[:, k] for k, c in enumerate(live._REGION_COLUMNS)})
    session, rows = live._steps(session or live.Session(**more), table, more.get("method", "POS"))
    return live._table(1, rows)


def test_a_session_gives_vitals_once_a_second():
    pdf, r = camera(20.0)
    out = run(pdf)
    assert out["status"].iloc[0] == "BUFFERING" and out["status"].iloc[-1] == "OK"
    at = out.loc[out["vitals"].notna(), "t"].to_numpy()
    assert len(at) >= 8 and at[0] >= 8.0 and (np.diff(at) >= 1.0 - 1e-9).all()
    last = {v["code"]: v for v in out["vitals"].dropna().iloc[-1]}
    assert abs(last["heart_rate"]["value"] - r.reference(10, 20)["bpm"]) < 4 and last["hrv_rmssd"]["status"] == "INVALID"


def test_a_short_loss_is_borne_and_a_long_one_starts_anew():
    short, long = run(camera(12.0, [(6.0, 6.6)])[0]), run(camera(12.0, [(6.0, 7.6)])[0])
    assert (short["status"] == "FACE_LOST").sum() in (18, 19) and short.loc[short["t"] > 6.7, "status"].isin(["OK", "LOW_QUALITY"]).all()
    after = long[long["t"] > 7.7]
    assert after["status"].iloc[0] == "BUFFERING" and after["warnings"].iloc[0] == [] and after["status"].iloc[-1] in ("OK", "LOW_QUALITY")


def test_warnings_of_light_motion_size_and_rate():
    pdf, _ = camera(8.0)
    dark, small, moving, varying = (pdf.copy() for _ in range(4))
    dark["luma"] = 20.0
    small["frame_w"] = 1200.0
    moving["x"] += 25 * np.sin(2 * np.pi * 1.5 * moving["t"])
    varying["luma"] = np.where(varying["t"] % 1 < 0.5, 90.0, 140.0)
    for table, code in ((dark, "TOO_DARK"), (small, "FACE_TOO_SMALL"), (moving, "MOTION_HIGH"), (varying, "LIGHT_UNSTABLE"), (pdf.iloc[::3], "LOW_FPS")):
        said = run(table)["warnings"]
        assert code in said.iloc[-1], code
    assert run(moving)["status"].iloc[-1] == "LOW_QUALITY" and run(pdf)["warnings"].iloc[-1] == []
    jump = pdf.copy()
    jump.loc[jump["t"] > 5, "x"] += 300
    out = run(jump)
    assert out.loc[out["t"] > 5.05, "status"].iloc[0] == "BUFFERING"


def test_batches_of_any_size_give_the_same():
    pdf, _ = camera(12.0, [(4.0, 4.3), (7.0, 8.4)])
    whole, session, parts = run(pdf), live.Session(), []
    for k in range(0, len(pdf), 50):
        parts += session.advance(np.column_stack([pdf.iloc[k : k + 50][list(live.IN)].to_numpy(float), np.full((len(pdf.iloc[k : k + 50]), 9), np.nan)]))
    assert [p["status"] for p in parts] == whole["status"].tolist() and [p["warnings"] for p in parts] == whole["warnings"].tolist()
    assert np.allclose(np.array([p["sqi"] for p in parts], float), whole["sqi"].astype(float), equal_nan=True) and [p["progress"] for p in parts] == whole["progress"].tolist()


def test_regions_are_compared_and_named_when_they_disagree():
    pdf, r = camera(12.0)
    colours = np.concatenate([r.rgb[n] for n in sorted(r.rgb)], axis=1)
    alike = run(pdf, colours)
    assert alike["agreement"].dropna().iloc[-1] > 0.6 and "ROI_DISAGREE" not in alike["reasons"].iloc[-1]
    noise = colours.copy()
    noise[:, 3:] = 120 + np.random.default_rng(1).normal(0, 1, (len(pdf), 6))
    apart = run(pdf, noise)
    assert apart["agreement"].dropna().iloc[-1] < 0.4 and "ROI_DISAGREE" in apart["reasons"].iloc[-1]
    issues = {i for v in apart["vitals"].dropna().iloc[-1] for i in v["issues"]}
    assert issues & {"ROI_INCONSISTENT", "ROI_DISAGREEMENT", "CROSS_ROI_INCONSISTENT", "LOW_ROI_AGREEMENT"} or len(issues) > len({i for v in alike["vitals"].dropna().iloc[-1] for i in v["issues"]})


def test_a_control_row_begins_anew():
    pdf, _ = camera(10.0)
    pdf["control"] = None
    pdf.loc[200, "control"] = "reset"
    out = run(pdf)
    assert out["status"].iloc[200] == "RESET" and out["status"].iloc[201] == "BUFFERING" and out["progress"].iloc[201] == 0.0 and out["status"].iloc[-1] in ("OK", "LOW_QUALITY")


def streamed(spark, tmp_path, parts, name):
    """The rows that the stream gives of ``parts``, a file each, and its query."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    stream = live.stream_live(spark, spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).toPandas(), query


def test_live_stream_equals_batch_and_writes_what_is_new(spark, tmp_path):
    a, _ = camera(24.0)
    b = camera(24.0, [(3.0, 3.5)], seed=6)[0].assign(session_id=2)
    rows = spark.createDataFrame(pd.concat([a, b]))
    got, query = streamed(spark, tmp_path, [rows.where((F.col("t") >= 2 * k) & (F.col("t") < 2 * k + 2)) for k in range(12)], "live_out")
    want = live.measure_live(rows).toPandas().sort_values(["session_id", "t"]).reset_index(drop=True)
    # The sessions end together, so the last watermark tells that both fell silent.
    got = got[~((got["status"] == "FACE_LOST") & (got["t"] > 24.0))].sort_values(["session_id", "t"]).reset_index(drop=True)
    assert got["status"].tolist() == want["status"].tolist() and got["vitals"].notna().sum() == want["vitals"].notna().sum() > 20
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert max(written[5:]) <= max(written[1:5]) + 4 and held[-1] > held[2]
    state = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "long").load()
    assert state.selectExpr("sum(size(user_map_value.rows)) AS n").first()["n"] >= 13 * 2 * 600


def test_silence_is_told_and_a_session_ends(spark, tmp_path):
    one = camera(4.0)[0]
    other = lambda at: one.iloc[:3].assign(session_id=2, t=at + np.arange(3) / 30)
    parts = [spark.createDataFrame(x) for x in (one, other(10.0), other(20.0), other(1000.0), other(1900.0), other(1901.0))]
    got, _ = streamed(spark, tmp_path, parts, "live_silence")
    first = got[got["session_id"] == 1]
    assert list(first["status"].iloc[-2:]) == ["FACE_LOST", "EXPIRED"] and first["t"].iloc[-1] - one["t"].max() >= live.IDLE_S
    marks = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "marks").load()
    assert [r["key"]["session_id"] for r in marks.collect()] == [2]
    for name in live.LiveProcessor.KEPT:
        left = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", name).load()
        assert {r["key"]["session_id"] for r in left.select("key").collect()} <= {2}


def test_tensors():
    rng = np.random.default_rng(1)
    crops = rng.uniform(0, 255, (2, 23, 4, 4, 3))
    x = inference.tensors(crops, video.SPECS["tscan"])
    assert x.shape == (2 * 20, 6, 4, 4) and inference.tensors(crops, video.SPECS["physnet"]).shape == (2, 3, 23, 4, 4)
    change = inference.difference(crops)
    assert not change[:, -1].any() and np.allclose(change[:, :-1].std((1, 2, 3, 4)), 1, atol=1e-4) and np.allclose(inference.standard(crops).mean((1, 2, 3, 4)), 0, atol=1e-9)
    assert np.allclose(x[20:40, 3:], np.moveaxis(inference.standard(crops)[1, :20], -1, 1)) and not inference.standard(np.full((1, 3, 2, 2, 3), 5.0)).any()
    waves = inference.pulses(np.ones((2, 50)), video.SPECS["tscan"])
    assert np.allclose(waves, 0, atol=1e-9) and np.allclose(np.polyfit(np.arange(30), inference.pulses(rng.normal(size=(1, 30)), video.SPECS["physnet"])[0], 1), 0, atol=1e-9)
    assert video.preprocess_rgb(np.ones((2, 3))).tolist() == [[1, 1, 1]] * 2 and np.allclose(video.preprocess_rgb(rng.normal(100, 3, (90, 3))).std(0), 1)
    assert video.edge_errors(np.zeros(10), np.r_[[1.0] * 2, [2.0] * 6, [3.0] * 2], 2) == (1.0, 3.0, 2.0) and np.isnan(video.edge_errors(np.zeros(4), np.zeros(4), 2)[0])
    some = np.array([[200.0, 150, 130]] * 3 + [[0.0, 0, 255]] * 5)
    assert len(video.skin(some)) == 3 and len(video.skin(some[3:])) == 5 and len(video.skin(np.empty((0, 3)))) == 0


def test_pixels_and_arrays(spark):
    px = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0), (1, "a", 255.0, 255.0, 255.0), (1, "b", 100.0, 100.0, 100.0)], "k int, roi string, r double, g double, b double")
    light = frames.lighting(px, "k").first()
    assert abs(light["luma"] - 355 / 3) < 1e-9 and abs(light["clipped"] - 2 / 3) < 1e-9
    colours = frames.region_colours(px, "k")
    assert {r["roi"]: (r["r"], r["n"]) for r in colours.collect()} == {"a": (127.5, 2), "b": (100.0, 1)} and abs(frames.weighted_colour(colours, "k").first()["g"] - 355 / 3) < 1e-9
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [True, False, True], {"b": None, "a": 1.0})], "x array<double>, m array<boolean>, d map<string,double>")
    got = row.select(arrays.where_mask("x", "m").alias("a"), arrays.running_sum("x").alias("b"), arrays.present("d").alias("c"), arrays.keys_in_order("d").alias("e"), arrays.green_intensity("x").alias("f"), health.roi(F.col("d"), "a").alias("g")).first()
    assert got["a"] == [1.0, 3.0] and got["b"] == [1.0, 3.0, 6.0] and got["c"] == {"a": 1.0} and got["e"] == ["a", "b"] and got["f"] == [0.5, 0.0, -0.5] and got["g"] == 1.0
    one = spark.createDataFrame([(0.5, -1.0), (1.5, 2.0), (None, float("nan"))], "a double, b double").select(health.unit_interval(F.col("a")).alias("u"), health.correlation_range(F.col("b")).alias("c")).collect()
    assert [tuple(r) for r in one] == [(True, True), (False, False), (False, False)]


VITAL = "struct<code:string,value:double,unit:string,status:string,quality:double,confidence:double,issues:array<string>>"


def results(spark):
    v = lambda code, value, status="OK": (code, value, "bpm", status, 0.8, 0.9, [])
    rows = [(1, 7, 0.0, "OK", [v("heart_rate", 72.04), v("hrv_rmssd", 41.0), v("respiratory_rate", 25.0, "BAD")]), (2, 7, 9.0, "OK", [v("heart_rate", 101.0)]), (3, 8, 0.0, "INVALID", [v("heart_rate", None, "INVALID")])]
    return spark.createDataFrame(rows, f"result_id int, person_id int, at double, status string, vitals array<{VITAL}>")


def test_pressure_features_and_assessments(spark):
    waves = spark.createDataFrame([(1, 0.2, float("nan"))], "result_id int, aix_proxy double, bvp_skewness double")
    people = spark.createDataFrame([(7, 40, True, 180.0, 81.0), (8, None, None, 0.0, 70.0)], "person_id int, age_years int, sex_male boolean, height_cm double, weight_kg double")
    got = {r["result_id"]: r for r in health.bp_features(results(spark), waves, people).withColumn("gone", health.missing_share()).collect()}
    assert len(health.BP_FEATURES) == 31 and got[1]["heart_rate_bpm"] == 72.04 and got[1]["respiratory_rate_brpm"] is None and got[1]["bvp_skewness"] is None and got[1]["aix_proxy"] == 0.2
    assert got[1]["bmi"] == 25.0 and got[1]["sex_male"] == 1.0 and got[3]["bmi"] is None and got[3]["gone"] == 1.0
    data = models.synthetic_pressure(90, 3)
    names = ["age_years", "sex_male", "bmi", "aix_proxy", "mean_rise_time_ms"]
    report, model = models.baseline(spark.createDataFrame(data), names, "subject_id", 3)
    assert report["gate"]["subjects"] == 90 and report["grades"]["sbp_mmhg"]["mae"] < 9 and "sex_male" in model.features
    judged = health.pressure_assessments(model, spark.createDataFrame(data.head(50))).toPandas()
    assert set(judged["risk_category"].dropna()) <= {"LOW", "MODERATE", "ELEVATED"} and judged["risk_score"].between(0, 1).all()
    assert health.pressure_assessments(None, results(spark)) is None
    row, content = registry.save_model(model, "bp", "1.0.0", "blood_pressure")
    again = registry.load_model(models.Ridge, content, row[5])
    assert np.allclose(again.weights, model.weights)
    with pytest.raises(ValueError):
        registry.load_model(models.Ridge, content + b" ", row[5])


def test_explanations(spark):
    knowledge = spark.createDataFrame([("resting_heart_rate_within_typical_range", ("Between 60 and 100.", "Rest 5 minutes.")), ("resting_heart_rate_above_typical_range", ("Over 100.", "x")), ("hrv_single_measurement_context", ("One of many.", "y"))], "code string, text struct<interpretation:string,caution:string>")
    found = health.assessments(results(spark), knowledge)
    by = {r["result_id"]: r for r in found.collect()}
    assert [x["code"] for x in by[1]["findings"]] == ["hrv_single_measurement_context", "resting_heart_rate_within_typical_range"] and by[1]["excluded"] == ["respiratory_rate"] and by[3]["findings"] == []
    out = {r["result_id"]: r for r in health.payloads(results(spark), found).collect()}
    assert set(out) == {1, 2} and sorted(out[1]["allowed"]) == [5.0, 41.0, 60.0, 72.0, 100.0]
    body = json.loads(out[1]["payload"])
    assert body["unavailable_metrics"] == ["respiratory_rate"] and [v["metric"] for v in body["vitals"]] == ["heart_rate", "hrv_rmssd"]
    trend = {r["code"]: r for r in health.trends(results(spark)).collect()}
    assert set(trend) == {"heart_rate"} and (trend["heart_rate"]["first"], trend["heart_rate"]["last"], trend["heart_rate"]["n"]) == (72.0, 101.0, 2)
    with pytest.raises(Exception, match="validated"):
        health.require_validated(results(spark)).collect()


def test_reports_and_labels(spark):
    rows = spark.createDataFrame([(1, "hr", 72.0), (1, "RR", 14.0), (2, "heart_rate", 300.0), (3, "mood", 1.0), (4, "rmssd", None)], "key int, name string, value double")
    moved = health.jumps(spark.createDataFrame([(1, 0, 70.0), (1, 1, 100.0), (2, 0, 70.0)], "key int, at int, v double"), "key", "at", "v")
    got = {r["key"]: (r["status"], r["is_valid"], [x["reason"] for x in r["failed"]]) for r in health.reports(rows, moved).collect()}
    assert got == {1: ("SUSPICIOUS", True, ["SUDDEN_JUMP"]), 2: ("REJECTED", False, ["OUT_OF_RANGE"]), 3: ("REJECTED", False, ["NO_RANGE"]), 4: ("REJECTED", False, ["NO_VALUE"])}
    signals = spark.createDataFrame([([1.0] * 150,), ([1.0] * 60,), ([],), ([1.0, float("nan")],)], "x array<double>")
    assert [r[0] for r in signals.select(health.signal_reason(F.col("x"), F.lit(30.0))).collect()] == [None, "TOO_SHORT", "NOT_FINITE", "NOT_FINITE"]
    assert [r[0] for r in spark.createDataFrame([("BAD",), ("OK",)], "s string").select(health.reported(F.col("s"))).collect()] == ["SUSPICIOUS", "ACCEPTED"]
    good = {"sync_error_ms": 20.0, "has_timestamps": True, "has_reference": True, "reference_usable": True, "readable": True, "variable_rate": False, "dropped_share": 0.01, "face_seen": True, "occluded_share": 0.1, "seconds": 60.0, "least_seconds": 30.0, "lux": 300.0, "deviations": []}
    cases = [good, good | {"sync_error_ms": 101.0, "lux": 701.0}, good | {"deviations": ["glasses"]}, good | {"dropped_share": 0.06, "face_seen": False}]
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'array<string>'}" for k, v in good.items())
    out = health.sample_labels(spark.createDataFrame([tuple(c.values()) for c in cases], kinds)).collect()
    assert [(r["label"], r["exclusion_reasons"]) for r in out] == [("PASS", []), ("REJECT", ["SYNC_ERROR", "INVALID_ILLUMINANCE"]), ("WARNING", []), ("REJECT", ["FRAME_DROP_GT_5_PERCENT", "FACE_NOT_DETECTED"])]


def test_own_rules_and_extractors(spark):
    row = spark.createDataFrame([("heart_rate", 150.0)], "code string, value double")
    own = (lambda c: F.when(c.value > 140, rules.issue("WARNING", "HIGH", c.value)),)
    found = row.select(rules.issues(own).alias("f")).select("f", rules.status(F.col("f")).alias("s")).first()
    assert [x["code"] for x in found["f"]] == ["HIGH"] and found["s"] == "BAD"

    def broken(x, fs, beats):
        raise ValueError

    w = synthetic.pulse_window(seconds=8.0)
    got = features.extract(w.samples, 30.0, (broken, features.trend, lambda x, fs, beats: {"other": 1.0, "bvp_kurtosis": 9.0}))
    assert got["ibi_mean_ms"] is None and got["bvp_kurtosis"] == 9.0 and "other" not in got
    assert len(features.vector(got)) == 23 and json.loads(features.as_json(got))["ibi_mean_ms"] is None


def test_ranks_intervals_and_grids(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.arange(3000), "s": rng.integers(0, 50, 3000).astype(float), "y": rng.integers(0, 2, 3000)})
    order = pdf.sort_values(["s", "k"]).reset_index(drop=True)
    ranks, p = order.index[order["y"] == 1] + 1, int(pdf["y"].sum())
    want = (ranks.to_numpy().sum() - p * (p + 1) / 2) / (p * (3000 - p))
    assert abs(accuracy.rank_auc(spark.createDataFrame(pdf).repartition(4), "s", "y", "k", 7).first()["auc"] - want) < 1e-12
    samples = spark.createDataFrame([(1, 1, 0.0, 1.0), (2, 1, 9.9, 3.0), (3, 1, 10.0, 5.0), (4, 2, 5.0, 7.0)], "id int, user int, t double, value double")
    got = {r["id"]: (r["samples"], r["reference"]) for r in accuracy.interval_means(samples.where("id in (1, 3)"), samples, "user", 10).collect()}
    assert got == {1: (3, 3.0), 3: (1, 5.0)}
    grid = {(r["user"], r["t"]): r["value"] for r in accuracy.interpolated(samples, "user", ["t", "id"], 2.5).collect()}
    assert {k: round(v, 6) for k, v in grid.items()} == {(1, 0.0): 1.0, (1, 2.5): 1.505051, (1, 5.0): 2.010101, (1, 7.5): 2.515152, (1, 10.0): 5.0}


def test_further_sources_and_sinks(spark, tmp_path):
    r = synthetic.record(synthetic.Scenario(seconds=2, missing=0.3))
    rec = spark.createDataFrame([("a", r.ts.tolist(), {k: v.tolist() for k, v in r.rgb.items()}, r.face.tolist(), r.beats.tolist())], files.RECORDING)
    files.write_recordings(rec, str(tmp_path / "j"))
    assert files.read_json_recordings(spark, str(tmp_path / "j")).first()["face_detected"] == r.face.tolist()
    recordings.register(spark)
    rec.write.format("recordings").mode("append").save(str(tmp_path / "n"))
    back = files.read_recordings(spark, str(tmp_path / "n")).first()
    assert back["recording_id"] == "a" and np.allclose(back["roi_rgb"]["forehead"], r.rgb["forehead"])
    files.write_wave(spark.createDataFrame([(1, 30.0, [0.5, 1.0])], "key int, fs double, samples array<double>"), str(tmp_path / "w"))
    assert [tuple(x) for x in spark.read.option("header", True).csv(str(tmp_path / "w")).orderBy("k").collect()][1][3] == "1.000000"
    lines = files.markdown_lines(spark.createDataFrame([("POS", 3, 0.5), ("CHROM", 4, None)], "m string, n int, mae double"), {"m": "Method", "n": "Windows", "mae": "MAE"})
    files.write_markdown("Report", {"version": "1"}, {"By method": lines}, str(tmp_path / "m"))
    text = "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "m")).collect())
    assert "# Report" in text and "| CHROM | 4 | - |\n| POS | 3 | 0.50 |" in text
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    (tmp_path / "ok.json").write_text('{"a": 1, "b": "x"}\n')
    (tmp_path / "more.json").write_text('{"a": 1, "c": 2}\n')
    assert files.read_contract(spark, str(tmp_path / "ok.json"), schema).first()["b"] == "x"
    with pytest.raises(Exception, match="not of the contract"):
        files.read_contract(spark, str(tmp_path / "more.json"), schema).collect()
    files.export_contracts(spark, {"one": schema}, str(tmp_path / "s"))
    assert T.StructType.fromJson(json.loads(spark.read.json(str(tmp_path / "s")).first()["schema"])) == schema


def test_registry_life_cycle(spark, tmp_path):
    rows = [registry.entry("m", v, "rppg", "RESEARCH", f"m/{v}", v.encode()) for v in ("1.9.0", "1.10.0")]
    reg = registry.add(spark, spark.createDataFrame([], registry.SCHEMA), *rows)
    reg = registry.updated(reg, "m", "1.9.0", "VALIDATED")
    registry.save(spark, reg, str(tmp_path / "r"))
    again = registry.load(spark, str(tmp_path / "r"))
    assert [r["version"] for r in registry.listed(again).collect()] == ["1.10.0", "1.9.0"] and registry.listed(again, "rppg", ("VALIDATED",)).first()["version"] == "1.9.0"
    registry.save(spark, spark.createDataFrame(registry.removed(again, "m", "1.9.0").collect(), registry.SCHEMA), str(tmp_path / "r"))
    assert registry.load(spark, str(tmp_path / "r")).count() == 1
    with pytest.raises(ValueError):
        registry.updated(again, "m", "1.9.0", "BEST")


def test_a_benchmark_calibrates_on_other_rows(spark):
    rows = spark.range(600).select((F.col("id") % 2 == 0).alias("train"), (F.col("id") % 3).alias("scenario"), (F.col("id") % 100 / 100).alias("conf"), F.lit(70.0).alias("ref"), (70 + F.when(F.col("id") % 10 < F.col("id") % 100 / 20, 1).otherwise(20)).cast("double").alias("est"))
    out = models.benchmark(rows.where("train"), rows.where("NOT train"), ["scenario"], "est", "ref", "conf", 5.0)
    assert out["errors"].count() == 3 and out["after"].first()["ece"] < out["before"].first()["ece"] and out["after"].first()["windows"] == 300


def test_sessions_are_listed(spark):
    pdf, _ = camera(2.0)
    got = live.sessions(spark.createDataFrame(pdf), 1900.0).first()
    assert got["frames"] == 60 and got["expired"] and rppg.method("pos") is not None and contracts.NAMES
