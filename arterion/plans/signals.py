"""Signal queries: embeddings stand for windows of 64 samples at 30 Hz, three in a row for an RGB trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arterion.functions.video import ModelSpec
from arterion.operators import inference, rules, vectors
from arterion.streaming.processors import fold_frames

FS = 30.0


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _total(x):
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _dot(x, y):
    return _total(F.zip_with(x, y, lambda a, b: a * b))


def linear_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and residual power of the least-squares line: array expressions, no shuffle."""
    w = windows(spark, sf_dir).withColumn("n", F.size("x")).withColumn("t", F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: i - (F.size("x") - 1) / 2))
    w = w.withColumn("m", _total(F.col("x")) / F.col("n")).withColumn("slope", _dot(F.col("x"), F.col("t")) / _dot(F.col("t"), F.col("t")))
    rest = F.zip_with("x", "t", lambda a, b: a - F.col("m") - F.col("slope") * b)
    return w.withColumn("rest", rest).select("vec_id", F.round("slope", 6).alias("slope"), F.round(_dot(F.col("rest"), F.col("rest")), 6).alias("residual"))


def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows(spark, sf_dir).withColumn("m", _total(F.col("x")) / F.size("x")).withColumn("s", rules.std(F.col("x")))
    return w.select("vec_id", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), F.round((F.array_max("x") - F.col("m")) / F.col("s"), 6).alias("top_z"))


def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows(spark, sf_dir)
    at = F.filter(F.sequence(F.lit(1), F.size("x") - 2), lambda i: (F.get("x", i) > F.get("x", i - 1)) & (F.get("x", i) > F.get("x", i + 1)))
    return w.select("vec_id", F.size(at).cast("long").alias("peaks"), F.array_min(at).alias("first_peak"))


def trend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows(spark, sf_dir).withColumn("m", _total(F.col("x")) / F.size("x"))
    w = w.withColumn("d", F.transform("x", lambda v: v - F.col("m")))
    moment = lambda k: _total(F.transform("d", lambda v: F.pow(v, F.lit(float(k))))) / F.size("d")
    w = w.select("vec_id", moment(2).alias("m2"), moment(3).alias("m3"), moment(4).alias("m4"))
    return w.select("vec_id", F.round(F.col("m3") / F.pow("m2", F.lit(1.5)), 6).alias("skewness"), F.round(F.col("m4") / (F.col("m2") * F.col("m2")) - 3, 6).alias("kurtosis"))


def dft_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.spectrum(windows(spark, sf_dir), ["vec_id"], "x", wanted=("fft_bpm",)).select("vec_id", F.round("fft_bpm", 6).alias("bpm"))


def snr_sqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.spectrum(windows(spark, sf_dir), ["vec_id"], "x", wanted=("snr_db",)).select("vec_id", F.round("snr_db", 5).alias("snr_db"))


def acf_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.spectrum(windows(spark, sf_dir), ["vec_id"], "x", wanted=("periodicity", "acf_peak")).select("vec_id", F.col("acf_peak"), F.col("periodicity"))


def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.waveform_features(windows(spark, sf_dir), ["vec_id"], "x")
    return rows.select("vec_id", *[F.round(c, 5).alias(c) for c in ("fundamental_freq_hz", "harmonic_ratio_h2", "spectral_entropy", "in_band_power_ratio")])


def bvp_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.waveform_features(windows(spark, sf_dir), ["vec_id"], "x")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace, r, g, b): three windows in a row around a level of 128."""
    w = windows(spark, sf_dir).select((F.col("vec_id") / 3).cast("long").alias("trace"), (F.col("vec_id") % 3).alias("k"), F.transform("x", lambda v: 128 + 20 * v).alias("x"))
    one = lambda k: F.max_by("x", F.when(F.col("k") == k, 1)).alias("rgb"[k])
    return w.groupBy("trace").agg(one(0), one(1), one(2), F.count(F.lit(1)).alias("n")).where(F.col("n") == 3).drop("n")


def cross_roi_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of three regions: the POS wave of each, and the Pearson of each two."""
    t = traces(spark, sf_dir)
    # A region's colour is the trace's, each channel mixed with another one.
    mix = lambda a, b, w: F.zip_with(a, b, lambda x, y: x * (1 - w) + y * w)
    regions = [F.struct(F.lit(k).alias("roi"), *[mix(a, b, w).alias(c) for c, a, b in (("r", "r", "g"), ("g", "g", "b"), ("b", "b", "r"))]) for k, w in enumerate((0.0, 0.1, 0.25))]
    rows = t.select("trace", F.explode(F.array(*regions)).alias("x")).select("trace", "x.*")
    waves = vectors.project(rows, ["trace", "roi"], "POS", "r", "g", "b")
    return vectors.agreement(waves, ["trace"], "roi", "bvp").select("trace", F.round("r_mean", 6).alias("r_mean"), F.round("r_min", 6).alias("r_min"))


def projected(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wave = vectors.project(traces(spark, sf_dir), ["trace"], method, "r", "g", "b")
        return vectors.spectrum(wave, ["trace"], "bvp", wanted=("fft_bpm", "sqi")).select("trace", F.round("fft_bpm", 6).alias("bpm"), F.round("sqi", 2).alias("sqi"))

    return run


def band_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.filtered(windows(spark, sf_dir), ["vec_id"], "x", FS, 0.7, 3.0)
    return rows.select("vec_id", F.round(_dot(F.col("x"), F.col("x")), 6).alias("power"))


def vitals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of eight windows put in a row: the five vitals of each session."""
    w = windows(spark, sf_dir).select((F.col("vec_id") / 8).cast("long").alias("session_id"), "vec_id", "x")
    rows = w.groupBy("session_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda s: s["x"])).alias("samples"))
    rows = rows.select("session_id", F.lit(0.0).alias("start"), F.lit(FS).alias("fs"), "samples", F.col("samples").alias("raw"), F.lit(0.7).alias("quality"), F.lit(0.0).alias("missing"))
    return vectors.measure_sessions(rows)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600
    return e.select(F.col("user_id").alias("session_id"), t.alias("t"), F.col("value").alias("r"), (F.col("value") / 2).alias("g"), (F.col("event_id") % 50).cast("double").alias("b"))


def artifact_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_frames(frames(spark, sf_dir), gap_s=48.0, window_s=200.0, fps=5.0)


def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    return e.select(
        "event_id", F.lit("heart_rate").alias("code"), F.when(k % 11 != 0, F.col("value") / 2).alias("value"), ((k % 100) / 100).alias("confidence"), (k % 13).cast("double").alias("seconds"),
        F.when(k % 5 != 0, (k * 7 % 100) / 100).alias("quality"), ((k * 3 % 50) / 100).alias("missing"), F.array(F.col("value") / 2, F.col("value") / 2 + k % 15).alias("roi_values"),
        F.when(k % 3 == 0, (k * 9 % 100) / 100).alias("roi_agreement"), F.when(k % 4 == 0, F.array(F.lit("MOTION_HIGH"), F.lit("TOO_DARK"))).alias("warnings"),
        F.when(k % 2 == 0, F.lit(100.0)).alias("previous_value"), (k % 9).cast("double").alias("elapsed"), F.array(F.lit(90.0), F.lit(100.0), F.lit(110.0)).alias("recent_values"),
    )


def rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_candidates(spark, sf_dir).withColumn("found", rules.issues())
    return rows.select("event_id", rules.status(F.col("found")).alias("status"), F.array_join(F.transform("found", lambda x: x["code"]), ",").alias("issues"))


_SIG = "s AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS n FROM embeddings)"
_DFT = f"""WITH {_SIG}, k AS (SELECT unnest(range(0, 257)) AS k),
p AS (SELECT vec_id, k, (pow(sum(x * cos(2 * pi() * k * i / 512)), 2) + pow(sum(x * sin(2 * pi() * k * i / 512)), 2)) / (30.0 * 64) * CASE WHEN k IN (0, 256) THEN 1 ELSE 2 END AS w, k * 30.0::DOUBLE / 512 AS f FROM s, k GROUP BY vec_id, k),
b AS (SELECT *, f BETWEEN 0.75 AND 2.5 AS band FROM p),
t AS (SELECT vec_id, arg_max(f, w) AS f0 FROM b WHERE band GROUP BY vec_id)"""
_RULES = """WITH c AS (SELECT event_id AS k, CASE WHEN event_id % 11 <> 0 THEN value / 2 END AS v, (event_id % 100) / 100.0::DOUBLE AS conf, (event_id % 13)::DOUBLE AS sec, CASE WHEN event_id % 5 <> 0 THEN (event_id * 7 % 100) / 100.0::DOUBLE END AS q,
 (event_id * 3 % 50) / 100.0::DOUBLE AS mis, (event_id % 15) AS roi, CASE WHEN event_id % 3 = 0 THEN (event_id * 9 % 100) / 100.0::DOUBLE END AS agree, (event_id % 9) AS el, value FROM events),
 i AS (SELECT k, list_filter([CASE WHEN v IS NULL THEN 'E:COMPUTATION_FAILED' END, CASE WHEN sec < 6 THEN 'E:WINDOW_TOO_SHORT' END, CASE WHEN mis > 0.3 THEN 'E:MISSING_DATA_EXCESSIVE' WHEN mis > 0.1 THEN 'W:MISSING_DATA_HIGH' END,
 CASE WHEN v IS NULL THEN NULL WHEN q < 0.4 THEN 'E:SIGNAL_QUALITY_UNUSABLE' WHEN q < 0.6 THEN 'W:SIGNAL_QUALITY_LOW' END, CASE WHEN v NOT BETWEEN 40 AND 180 THEN 'E:OUT_OF_PHYSIOLOGICAL_RANGE' END,
 CASE WHEN k % 2 = 0 AND abs(v - 100) > 8 + 3 * el THEN 'W:SUDDEN_JUMP' END,
 CASE WHEN sqrt((pow(90 - (300 + v) / 4, 2) + pow(100 - (300 + v) / 4, 2) + pow(110 - (300 + v) / 4, 2) + pow(v - (300 + v) / 4, 2)) / 4) > 8 THEN 'W:TEMPORAL_UNSTABLE' END,
 CASE WHEN v IS NOT NULL AND greatest((v + roi) - v, abs((v + (v + roi)) / 2 - v)) > 10 THEN 'W:CROSS_ROI_INCONSISTENT' END, CASE WHEN v IS NOT NULL AND agree < 0.35 THEN 'W:ROI_SIGNAL_DISAGREEMENT' END,
 CASE WHEN v IS NOT NULL AND k % 4 = 0 THEN 'W:SIGNAL_CONDITION_BLOCKING' END, CASE WHEN v IS NULL THEN NULL WHEN conf < 0.3 THEN 'E:VERY_LOW_CONFIDENCE' WHEN conf < 0.6 THEN 'W:LOW_CONFIDENCE' END], lambda x: x IS NOT NULL) AS a FROM c)
 SELECT k AS event_id, CASE WHEN len([x for x in a if x[1] = 'E']) > 0 THEN 'INVALID' WHEN len(a) > 0 THEN 'BAD' ELSE 'OK' END AS status, array_to_string([x[3:] for x in a], ',') AS issues FROM i"""

CHUNK = ModelSpec("stand-in", ("standard",), "stack", True, 4, 16, None)
STRIDE = 6


def stand_in():
    """A network of no weights: the mean of each frame's channels and places."""
    return lambda x: x.mean(axis=(1, 2, 3))


def chunked_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of four by four pixels, labels as sessions: the pulse of a stand-in over chunks of frames."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    frames = e.select("label", k.alias("k"), F.transform(F.slice("embedding", 1, 48), lambda x: x.cast("double")).alias("crop"))
    waves = inference.inferred(inference.chunked(frames, CHUNK, STRIDE, "label"), stand_in, CHUNK)
    return inference.at_frames(waves, STRIDE, "label").select("label", "k", F.round("pulse", 6).alias("pulse"))


_CHUNKED = f"""WITH f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, [CAST(x AS DOUBLE) for x in embedding[1:48]] AS x FROM embeddings),
c AS (SELECT label, k, x, unnest(range(CAST(greatest(0, ceil((k - {CHUNK.frames - 1}) / {STRIDE}.0)) AS BIGINT), k // {STRIDE} + 1)) AS chunk FROM f),
w AS (SELECT label, chunk FROM c GROUP BY ALL HAVING count(*) = {CHUNK.frames}),
p AS (SELECT c.label, c.chunk, c.k, unnest(x) AS x FROM c JOIN w USING (label, chunk)),
s AS (SELECT label, chunk, avg(x) AS m, stddev_pop(x) AS d FROM p GROUP BY ALL),
v AS (SELECT p.label, p.chunk, p.k, avg((x - m) / d) AS v FROM p JOIN s USING (label, chunk) GROUP BY ALL),
y AS (SELECT label, chunk, k, k - chunk * {STRIDE} AS i, sum(v) OVER (PARTITION BY label, chunk ORDER BY k) AS y FROM v),
r AS (SELECT label, chunk, regr_slope(y, i) AS slope, regr_intercept(y, i) AS base FROM y GROUP BY ALL)
SELECT label, k, round(arg_max(y - base - slope * i, chunk), 6) AS pulse FROM y JOIN r USING (label, chunk) GROUP BY ALL"""

# One frame after another: the window, its counters, and the followed level, as lists that grow and are cut.
_BUFFER = """WITH RECURSIVE f AS (SELECT user_id AS session_id, epoch_us(ts) / 1000000.0::DOUBLE / 3600 AS t, value AS r, value / 2 AS g, CAST(event_id % 50 AS DOUBLE) AS b FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, r, g, b) AS k FROM f),
s AS (
 SELECT session_id, 0::BIGINT AS k, 0.0::DOUBLE AS t, '' AS status, []::STRUCT(t DOUBLE, r DOUBLE, g DOUBLE, b DOUBLE)[] AS w, 0 AS artifacts, 0 AS in_a_row, 0 AS gaps, 0 AS adapted, []::DOUBLE[] AS v, NULL::DOUBLE AS smooth, 0 AS strikes, false AS outlier FROM (SELECT DISTINCT session_id FROM e)
 UNION ALL
 SELECT session_id, k, t, CASE WHEN NOT odd THEN 'ACCEPTED' WHEN in_a_row < 10 THEN 'ARTIFACT' ELSE 'ADAPTED' END,
  CASE WHEN odd AND in_a_row < 10 THEN w WHEN odd THEN [x] ELSE CASE WHEN len(late) < 2 THEN list_append(w, x)[-2:] ELSE late END END,
  artifacts, CASE WHEN odd AND in_a_row < 10 THEN in_a_row ELSE 0 END, gaps, adapted + CASE WHEN odd AND in_a_row >= 10 THEN 1 ELSE 0 END,
  CASE WHEN far AND strikes < 3 THEN v WHEN far THEN [x.g] ELSE list_append(v, x.g)[-10:] END,
  CASE WHEN far AND strikes < 3 THEN smooth WHEN far OR smooth IS NULL THEN x.g ELSE (x.g + smooth) / 2 END, strikes, far AND strikes < 3
 FROM (SELECT * REPLACE (artifacts + CASE WHEN odd THEN 1 ELSE 0 END AS artifacts, CASE WHEN odd THEN in_a_row + 1 ELSE 0 END AS in_a_row, CASE WHEN far THEN strikes + 1 ELSE 0 END AS strikes),
   list_filter(list_append(w, x), lambda y: x.t - y.t <= 200 + 1e-6) AS late FROM (SELECT *,
    len(w) >= 10 AND (CASE WHEN abs(x.r - list_avg([y.r for y in w])) / greatest(sqrt(list_var_pop([y.r for y in w])), 1e-6) > 3.5 THEN 1 ELSE 0 END
     + CASE WHEN abs(x.g - list_avg([y.g for y in w])) / greatest(sqrt(list_var_pop([y.g for y in w])), 1e-6) > 3.5 THEN 1 ELSE 0 END
     + CASE WHEN abs(x.b - list_avg([y.b for y in w])) / greatest(sqrt(list_var_pop([y.b for y in w])), 1e-6) > 3.5 THEN 1 ELSE 0 END) > 1 AS odd,
    len(v) >= 3 AND abs(x.g - list_median(v)) > 3.5 * greatest(1.4826 * list_median([abs(y - m) for y in v]), 3.0) AS far
    FROM (SELECT s.session_id, e.k, e.t, {'t': e.t, 'r': e.r, 'g': e.g, 'b': e.b} AS x, list_median(s.v) AS m, s.v, s.smooth, s.strikes, s.adapted, len(s.w) > 0 AND e.t - s.w[-1].t > 48 AS gap,
      CASE WHEN gap THEN [] ELSE s.w END AS w, s.gaps + CASE WHEN gap THEN 1 ELSE 0 END AS gaps, CASE WHEN gap THEN 0 ELSE s.artifacts END AS artifacts, CASE WHEN gap THEN 0 ELSE s.in_a_row END AS in_a_row
     FROM s JOIN e ON e.session_id = s.session_id AND e.k = s.k + 1) z) q) o)
SELECT session_id, t, status, CAST(len(w) AS INTEGER) AS held, artifacts, gaps, adapted, len(w) > 1 AND w[-1].t - w[1].t >= 3 AS ready, smooth AS tracked, outlier FROM s WHERE k > 0"""

QUERIES = {
    "linear_detrend": linear_detrend, "zscore": z_scores, "local_maxima": local_maxima, "trend_features": trend_features, "dft_peak": dft_peak, "snr_sqi": snr_sqi, "acf_periodicity": acf_periodicity,
    "spectral_features": spectral_features, "bvp_features": bvp_features, "cross_roi_corr": cross_roi_corr, "pos_full": projected("POS"), "chrom_full": projected("CHROM"), "green_full": projected("GREEN"),
    "op_h04_bandpass": band_passed, "vitals_batch": vitals_batch, "artifact_buffer": artifact_buffer, "chunked_pulses": chunked_pulses, "rules_r01_r13": rules_all,
}
ORACLES = {
    "linear_detrend": f"""WITH {_SIG}, r AS (SELECT vec_id, regr_slope(x, i) AS slope, regr_intercept(x, i) AS base FROM s GROUP BY vec_id)
SELECT vec_id, round(any_value(slope), 6) AS slope, round(sum(pow(x - base - slope * i, 2)), 6) AS residual FROM s JOIN r USING (vec_id) GROUP BY vec_id""",
    "zscore": f"WITH {_SIG} SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round((max(x) - avg(x)) / stddev_pop(x), 6) AS top_z FROM s GROUP BY vec_id",
    "local_maxima": f"""WITH {_SIG}, n AS (SELECT *, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS a, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS b FROM s)
SELECT vec_id, count(*) FILTER (WHERE x > a AND x > b) AS peaks, CAST(min(i) FILTER (WHERE x > a AND x > b) AS INTEGER) AS first_peak FROM n GROUP BY vec_id""",
    "trend_features": f"""WITH {_SIG}, m AS (SELECT vec_id, avg(x) AS m FROM s GROUP BY vec_id), k AS (SELECT vec_id, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM s JOIN m USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM k""",
    "dft_peak": f"{_DFT} SELECT vec_id, round(f0 * 60, 6) AS bpm FROM t",
    "snr_sqi": f"""{_DFT}, o AS (SELECT b.*, (f BETWEEN f0 - 0.1 AND f0 + 0.1) OR (f BETWEEN 2 * f0 - 0.1 AND 2 * f0 + 0.1) AS own FROM b JOIN t USING (vec_id))
SELECT vec_id, round(10 * log10(sum(w) FILTER (WHERE own) / sum(w) FILTER (WHERE band AND NOT own)), 5) AS snr_db FROM o GROUP BY vec_id""",
    "acf_periodicity": f"""WITH {_SIG}, m AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS d FROM s), v AS (SELECT vec_id, sum(d * d) AS v FROM m GROUP BY vec_id),
r AS (SELECT a.vec_id, b.i - a.i AS lag, sum(a.d * b.d) AS r FROM m a JOIN m b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 12 AND 40 GROUP BY ALL)
SELECT vec_id, round_even(max(r / v), 4) AS acf_peak, round_even(least(1.0, greatest(0.0, max(r / v))), 2) AS periodicity FROM r JOIN v USING (vec_id) GROUP BY vec_id""",
    "spectral_features": f"""{_DFT}, o AS (SELECT b.*, f0, f BETWEEN f0 - 0.1 AND f0 + 0.1 AS h1, f BETWEEN 2 * f0 - 0.1 AND 2 * f0 + 0.1 AS h2, sum(w) FILTER (WHERE band) OVER (PARTITION BY vec_id) AS total FROM b JOIN t USING (vec_id))
SELECT vec_id, round(any_value(f0), 5) AS fundamental_freq_hz, round(sum(w) FILTER (WHERE h2) / sum(w) FILTER (WHERE h1), 5) AS harmonic_ratio_h2,
round(-sum(w / total * ln(w / total)) FILTER (WHERE band) / ln(count(*) FILTER (WHERE band)), 5) AS spectral_entropy, round(sum(w) FILTER (WHERE band) / sum(w), 5) AS in_band_power_ratio FROM o GROUP BY vec_id""",
    "rules_r01_r13": _RULES, "artifact_buffer": _BUFFER, "chunked_pulses": _CHUNKED,
}
