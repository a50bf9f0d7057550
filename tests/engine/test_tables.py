"""Queries against their SQL counterparts, sources, models, guards and the stream against its batch form."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arterion.operators import models, text_guard, vectors
from arterion.plans import catalog
from arterion.sources import files, synthetic
from arterion.streaming import processors

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = [None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else f"{float(v):.9g}" if isinstance(v, (int, float, np.number, np.bool_)) else str(v) for v in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = plain(catalog.queries()[name](spark, SF).toPandas()), plain(duck.sql(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_every_other_query_gives_rows(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got) and len(got.columns) and not got.isna().all(axis=None)


def test_ridge_is_the_closed_form(spark):
    data = models.synthetic_pressure()
    names = ["age_years", "sex_male", "bmi", "aix_proxy", "mean_rise_time_ms"]
    model = models.Ridge(names).fit(spark.createDataFrame(data))
    x = data[names].fillna(data[names].median()).to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    y = data[["sbp_mmhg", "dbp_mmhg"]].to_numpy()
    w = np.linalg.solve(z.T @ z + np.eye(len(names)), z.T @ (y - y.mean(0)))
    assert np.allclose(model.weights, w, atol=1e-8)
    assert np.allclose(model.residual, (y - y.mean(0) - z @ w).std(0), atol=1e-8)
    got = model.judged(spark.createDataFrame(data.head(20))).toPandas()
    assert set(got["status"]) <= {"OK", "BAD"} and (got["confidence"] > 0).all()
    with pytest.raises(ValueError):
        models.Ridge(names).fit(spark.createDataFrame(data.head(3)))


def test_groups_stay_together(spark):
    rows = spark.createDataFrame(models.synthetic_pressure(20))
    folds = models.group_folds(rows, "subject_id", 4)
    assert folds.count() == folds.select("subject_id").distinct().count() == 20 and folds.select("fold").distinct().count() == 4


def test_isotonic_is_monotonic(spark):
    rows = spark.range(200).select((F.col("id") / 200).alias("score"), (F.col("id") * 7 % 200 < F.col("id")).alias("hit"))
    got = models.calibrate(rows, "score", "hit").orderBy("score").toPandas()["calibrated"].to_numpy()
    assert (np.diff(got) >= 0).all() and 0 <= got.min() <= got.max() <= 1


def test_latest_version(spark):
    rows = spark.createDataFrame([("m", "1.9.0", "ok"), ("m", "1.10.0", "ok"), ("m", "2.0.0", "draft")], "name string, version string, status string")
    assert models.latest_version(rows, ("ok",)).first()["version"] == "1.10.0"


def test_text_guard(spark):
    rows = spark.createDataFrame([("Your rate is 72,5 bpm and 15 brpm",), ("Nhịp 90 bpm, bạn bị bệnh",), ("this is not you have",), ("",), ("you have flu. no, you have not",)], "t string")
    got = [r[0] for r in rows.select(text_guard.check(F.col("t"), F.array(F.lit(72.5), F.lit(15.0)))).collect()]
    assert got == [[], ["UNVERIFIED_NUMBER", "DIAGNOSTIC_CLAIM"], [], ["EMPTY_OUTPUT"], ["DIAGNOSTIC_CLAIM"]]
    assert rows.limit(1).select(text_guard.numbers(F.col("t"))).first()[0] == [72.5, 15.0]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,Red,GREEN,b\n0,1,2,3\n33,4,5,6\n66,7,8,9\n")
    rows = files.read_sample(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in rows.orderBy("t").collect()][1] == (33.0, 4.0, 5.0, 6.0)
    assert abs(files.sampling_rate(rows).first()["fs"] - 1000 / 33) < 1e-9
    (tmp_path / "b.csv").write_text("x,y,z\n1,2,3\n4,5,6\n")
    plain_rows = files.read_rgb_csv(spark, str(tmp_path / "b.csv"))
    assert plain_rows.where("t IS NULL").count() == 2 and files.sampling_rate(plain_rows).first()["fs"] == 30.0
    with pytest.raises(ValueError):
        files.read_sample(spark, "film.mp4")
    (tmp_path / "c.csv").write_text("subject_id,sbp_mmhg,dbp_mmhg,bmi\ns1,120.0,80.0,\ns2,130.5,85.2,22.5\n")
    bp = files.read_pressure_csv(spark, str(tmp_path / "c.csv"), ["bmi", "age_years"])
    assert [tuple(r) for r in bp.orderBy("subject_id").collect()] == [("s1", 120.0, 80.0, None, None), ("s2", 130.5, 85.2, 22.5, None)]
    files.write_pressure_csv(bp, str(tmp_path / "out"), ["bmi"])
    assert files.read_pressure_csv(spark, str(tmp_path / "out"), ["bmi"]).count() == 2
    (tmp_path / "d.csv").write_text("subject_id,sbp_mmhg,dbp_mmhg\ns1,,80\n")
    with pytest.raises(Exception, match="sbp_mmhg"):
        files.read_pressure_csv(spark, str(tmp_path / "d.csv"), []).collect()


def test_recordings_and_knowledge(spark, tmp_path):
    r = synthetic.record(synthetic.Scenario(seconds=2, missing=0.3))
    np.savez(tmp_path / "one.npz", timestamps=r.ts, roi_names=np.array(list(r.rgb)), roi_rgb=np.stack(list(r.rgb.values())), face_detected=r.face, reference_beat_times_s=r.beats)
    rows = files.read_recordings(spark, str(tmp_path))
    frames = files.frames_of(rows).withColumn("rgb", files.mean_rgb("roi_rgb", "face"))
    assert frames.count() == 60 and frames.where("rgb IS NULL").count() == int((~r.face).sum())
    (tmp_path / "k.json").write_text('{"knowledge_version": "1", "findings": {"a": {"interpretation": "x", "caution": "y", "severity": "INFO"}}}')
    known = files.read_knowledge(spark, str(tmp_path / "k.json"))
    assert [x["code"] for x in files.uncovered(known, spark.createDataFrame([("a",), ("b",)], "code string")).collect()] == ["b"]


def test_filtered_rows_equal_one_by_one(spark):
    from arterion.functions import dsp

    data = [(k, np.random.default_rng(k).normal(size=64 + k % 2).tolist()) for k in range(6)]
    got = {r["k"]: r["x"] for r in vectors.filtered(spark.createDataFrame(data, "k int, s array<double>"), ["k"], "s", 30.0, 0.7, 3.0).collect()}
    assert all(np.allclose(got[k], dsp.pulse_band_pass(dsp.linear_detrend(np.array(x)), 0.7, 3.0, 30.0)) for k, x in data)


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(s, k / 30, 100 + rng.normal(), 90 + rng.normal(), 80 + rng.normal() if k % 40 else 200.0) for s in (1, 2) for k in range(80)]
    kinds = "session_id long, t double, r double, g double, b double"
    for part in range(2):
        spark.createDataFrame([x for x in rows if (x[1] >= 1.3) == bool(part)], kinds).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    want = processors.fold_frames(spark.createDataFrame(rows, kinds)).toPandas()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.STORE)
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = processors.stream_frames(spark, source).writeStream.format("memory").queryName("frames_out").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("frames_out").toPandas()
    by = ["session_id", "t"]
    pd.testing.assert_frame_equal(got.sort_values(by).reset_index(drop=True), want.sort_values(by).reset_index(drop=True), check_dtype=False)


def test_agreement_of_regions_matches_the_kernel(spark):
    from arterion.functions import quality
    from arterion.plans import signals

    got = {r["trace"]: (r["r_mean"], r["r_min"]) for r in signals.cross_roi_corr(spark, SF).collect()}
    rows = signals.traces(spark, SF).collect()
    assert len(got) == len(rows) > 10
    for row in rows:
        rgb = np.array([row["r"], row["g"], row["b"]]).T
        other = rgb[:, [1, 2, 0]]
        want = quality.cross_roi({f"roi{k}": rgb * (1 - w) + other * w for k, w in enumerate((0.0, 0.1, 0.25))}, signals.FS)
        assert np.allclose(got[row["trace"]], (want["r_mean"], want["r_min"]), atol=2e-6)
