"""Queries over camera frames, by the operators of :mod:`arterion.operators.frames`.

Events stand for frames: a user is a session, three hundred thousand seconds are one, an ``error`` is a frame without a
face.  The SQL beside each query is written from the definition, not from the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arterion.operators import arrays, frames, rules
from arterion.streaming.state import walked


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, has = F.col("event_id"), F.col("event_type") != "error"
    w = (60 + k % 41).cast("double")
    face = F.when(has, F.struct((100.0 + (k % 13) * 5 + F.when(k % 29 == 0, 200).otherwise(0)).alias("x"), (50.0 + k % 7).alias("y"), w.alias("w"), (w * 1.2).alias("h")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("session_id"), "event_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 300000).alias("t"), face.alias("face"),
        (320 + (k % 7) * 40).cast("double").alias("frame_w"), F.col("value").alias("luma"), ((k % 11) / 100).alias("clipped"),
    )


_VIEW = """v AS (SELECT user_id AS session_id, event_id, event_type, value, epoch_us(ts) / 1000000.0::DOUBLE / 300000 AS t, event_type <> 'error' AS has, 100.0::DOUBLE + (event_id % 13) * 5 + CASE WHEN event_id % 29 = 0 THEN 200 ELSE 0 END AS x,
 50.0::DOUBLE + event_id % 7 AS y, CAST(60 + event_id % 41 AS DOUBLE) AS w, CAST(60 + event_id % 41 AS DOUBLE) * 1.2::DOUBLE AS h, CAST(320 + (event_id % 7) * 40 AS DOUBLE) AS frame_w, value AS luma, (event_id % 11) / 100.0::DOUBLE AS clipped FROM events)"""


def face_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ("detection", "motion", "light", "size_score", "overall")
    return frames.face_quality(view(spark, sf_dir), order=("t", "event_id")).select("session_id", *[F.round(c, 6).alias(c) for c in parts], F.array_join("issues", ",").alias("issues"))


def frame_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.light_history(view(spark, sf_dir), order=("t", "event_id")).select("event_id", F.round("smooth_luma", 6).alias("smooth_luma"), "unstable")


def frame_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.motion_history(view(spark, sf_dir)).select("event_id", "jumped", "moving", F.round("reach", 6).alias("reach"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    seen = {"artifact_ratio": (k * 7 % 100) / 250, "snr": F.when(k % 6 != 0, F.col("value") / 500), "periodicity": (k * 37 % 100) / 100, "r_mean": F.when(k % 5 != 0, (k * 61 % 100) / 100), "motion_score": (k * 17 % 100) / 100}
    return view(spark, sf_dir).withColumn("g", frames.gate(F.when(k % 8 != 0, k % 240), F.lit(20), **seen))


_GATE = """g AS (SELECT *, CASE WHEN event_id % 8 = 0 OR event_id % 240 < 20 THEN ['WINDOW_TOO_SHORT'] ELSE [x for x in [CASE WHEN (event_id * 7 % 100) / 250.0::DOUBLE > 0.25 THEN 'HIGH_ARTIFACT' END, CASE WHEN event_id % 6 <> 0 AND value / 500 < 0.4 THEN 'LOW_SNR' END,
 CASE WHEN (event_id * 37 % 100) / 100.0::DOUBLE < 0.46 THEN 'NOT_PERIODIC' END, CASE WHEN event_id % 5 <> 0 AND (event_id * 61 % 100) / 100.0::DOUBLE < 0.4 THEN 'ROI_DISAGREE' END, CASE WHEN (event_id * 17 % 100) / 100.0::DOUBLE > 0.5 THEN 'HIGH_MOTION' END] if x IS NOT NULL] END AS reasons FROM v),
q AS (SELECT *, CASE WHEN len(reasons) > 1 OR list_contains(reasons, 'WINDOW_TOO_SHORT') OR list_contains(reasons, 'HIGH_ARTIFACT') THEN 'REJECTED' WHEN len(reasons) = 1 THEN 'SUSPICIOUS' ELSE 'ACCEPTED' END AS raw FROM g)"""


def gate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("event_id", F.array_join("g.reasons", ",").alias("reasons"), F.col("g.raw").alias("state"))


def gate_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("session_id").orderBy("t", "event_id")
    # A third of the frames is rejected; otherwise everything would be held.
    raw = F.when(F.col("value") < 3, "REJECTED").when(F.col("value") < 200, "SUSPICIOUS").otherwise("ACCEPTED")
    return view(spark, sf_dir).select("event_id", frames.held_state(raw, F.col("t"), by).alias("state"))


def frame_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = _metrics(spark, sf_dir)
    codes = frames.frame_warnings(F.col("face").isNull(), F.col("face.w") / (F.col("frame_w") * 2), F.col("luma"), k % 9 == 0, k % 10 == 0, k % 14 == 0, k % 15 == 0)
    rows = rows.withColumn("codes", frames.union_codes(codes, F.col("g.reasons")))
    return rows.select("event_id", F.array_join("codes", ",").alias("codes"), frames.blocking(F.col("codes")).alias("blocked"), frames.status(F.col("value") / 60, F.col("codes"), F.col("g.raw")).alias("status"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a wave that is handed on, of windows of 0 to 63 samples at 30 Hz."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, (F.col("vec_id") % 64).cast("int")).alias("x"))
    p = frames.packet(F.col("x"), F.lit(30.0), (F.col("vec_id") % 10) / 10, 1.5)
    return rows.select("vec_id", p.alias("p")).select("vec_id", "p.status", "p.progress", F.size("p.signal").cast("long").alias("held"), F.round(arrays.total("p.signal"), 6).alias("total"))


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, before = F.col("event_id"), Window.partitionBy("session_id").orderBy("t", "event_id").rowsBetween(-3, 0)
    rows = view(spark, sf_dir).withColumn("recent", F.collect_list(F.when(k % 3 != 0, F.col("value") / 10)).over(before))
    c = frames.confidence(F.when(k % 7 != 0, F.col("value") / 25 - 10), F.when(F.col("event_type") != "view", (k % 101) / 100), F.when(F.col("event_type") != "click", frames.clip(1 - F.abs(F.col("value") - 250) / 250)), F.col("recent"), (k % 7) / 20)
    return rows.select("event_id", F.round(c, 6).alias("confidence"), F.round(frames.method_agreement(F.col("value"), F.when(k % 4 != 0, F.col("value") + k % 12)), 6).alias("agreement"))


def missing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).select("event_id", F.round(frames.missing_ratio(F.col("face").isNull(), 4.0), 6).alias("missing"))


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kinds = F.col("event_id"), {"click": "OK", "view": "LOW_QUALITY", "signup": "BUFFERING", "error": "FACE_LOST", "purchase": "ARTIFACT"}
    status = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    rows = view(spark, sf_dir).select(
        "session_id", "t", status.alias("status"), F.when(k % 4 == 0, "REJECTED").when(k % 4 == 1, "SUSPICIOUS").otherwise("ACCEPTED").alias("state"), (F.col("value") / 500).alias("sqi"), ((k % 10) / 10).alias("periodicity"),
        F.when(k % 3 != 0, (k % 20) / 20).alias("r_mean"), ((k % 8) / 8).alias("motion_score"), F.when(k % 5 != 0, F.col("value")).alias("bpm"), (F.col("value") / 7).alias("latency_ms"), F.lit(72.0).alias("reference_bpm"),
    )
    out = frames.run_statistics(rows, "session_id")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def bbox_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed positions of each session; frames without a face hold the last one.

    Shown as logarithms: means of numbers of two places often end in a 5, where rounding would depend on the last bit.
    """
    rows = view(spark, sf_dir).withColumn("v", F.when(F.col("face").isNotNull(), F.col("value")))
    return frames.smoothed_boxes(rows, "v", order=("t", "event_id")).select("event_id", F.round(F.log1p("smooth"), 8).alias("box"))


def largest_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.largest_face(view(spark, sf_dir), "session_id")
    at = frames.region(F.col("face"), 0.25, 0.08, 0.50, 0.18, F.lit(200), F.lit(60))
    return out.select("session_id", F.round("face.x", 6).alias("x"), F.round("face.w", 6).alias("w"), at.alias("r")).select("session_id", "x", "w", "r.*")


def ibi_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in range and near the local median of five, the ends repeated: by window functions, and counted."""
    by = Window.partitionBy("session_id").orderBy("t", "event_id")
    all_of = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = (F.col("value") * 3).alias("v")
    rows = view(spark, sf_dir).select("session_id", "t", "event_id", v)
    first, last = F.first("v").over(all_of), F.last("v").over(all_of)
    near = [F.coalesce(F.lag("v", k).over(by), first) for k in (2, 1)] + [F.col("v")] + [F.coalesce(F.lead("v", k).over(by), last) for k in (1, 2)]
    # A session of fewer than five has a kernel of its own size, which leans left if that is even.
    rows = rows.withColumns({f"near{k}": c for k, c in enumerate(near)}).withColumn("size", F.least(F.lit(5), F.count(F.lit(1)).over(Window.partitionBy("session_id"))).cast("int"))
    left = F.floor(F.col("size") / 2).cast("int")
    rows = rows.withColumn("middle", F.get(F.array_sort(F.slice(F.array(*[f"near{k}" for k in range(5)]), 3 - left, F.col("size"))), left))
    clean = F.col("v").between(60000.0 / 180.0, 60000.0 / 40.0) & (F.abs(F.col("v") - F.col("middle")) <= 0.25 * F.col("middle"))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(clean).alias("clean"), F.round(1 - F.avg(clean.cast("double")), 6).alias("artifact_ratio"))


def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each session stands after its events, taken as protocol events; refused ones are counted and change nothing."""
    names = ["REQUEST_CAMERA", "PERMISSION_GRANTED", "START_MEASUREMENT", "FACE_FOUND", "ACQUISITION_STARTED", "WINDOW_FILLED", "QUALITY_FAILED", "WINDOW_FILLED", "QUALITY_PASSED", "FACE_LOST"]
    e = view(spark, sf_dir).select("session_id", "t", "event_id", F.get(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % len(names)).cast("int")).alias("event"))
    return walked(e, "session_id", "t", "event_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "face_quality": face_quality, "frame_light": frame_light, "frame_motion": frame_motion, "gate_states": gate_states, "gate_hysteresis": gate_hysteresis, "frame_status": frame_status, "packets": packets,
    "confidence": confidence, "missing_ratio": missing_ratio, "run_statistics": run_statistics, "bbox_ema": bbox_ema, "largest_face": largest_face, "ibi_mask": ibi_mask, "state_machine": state_machine,
}

_EMA = f"""WITH RECURSIVE {_VIEW}, e AS (SELECT session_id, event_id, CASE WHEN has THEN value END AS v, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS k FROM v),
r AS (SELECT session_id, event_id, k, v AS box, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS missing FROM e WHERE k = 1
 UNION ALL SELECT e.session_id, e.event_id, e.k, CASE WHEN e.v IS NOT NULL THEN CASE WHEN r.box IS NULL THEN e.v ELSE 0.65::DOUBLE * e.v + 0.35::DOUBLE * r.box END WHEN r.missing + 1 > 10 THEN NULL ELSE r.box END, CASE WHEN e.v IS NULL THEN r.missing + 1 ELSE 0 END
 FROM r JOIN e ON e.session_id = r.session_id AND e.k = r.k + 1)
SELECT event_id, round(ln(1 + box), 8) AS box FROM r"""

# The protocol as a list of moves; after the fourth failure of quality it fails.
_MOVES = """m(s, e, t) AS (VALUES ('IDLE', 'REQUEST_CAMERA', 'CAMERA_PERMISSION'), ('CAMERA_PERMISSION', 'PERMISSION_GRANTED', 'CAMERA_READY'), ('CAMERA_READY', 'START_MEASUREMENT', 'FACE_SEARCH'), ('FACE_SEARCH', 'FACE_FOUND', 'FACE_LOCKED'),
 ('FACE_LOCKED', 'ACQUISITION_STARTED', 'SIGNAL_ACQUIRING'), ('SIGNAL_ACQUIRING', 'WINDOW_FILLED', 'QUALITY_CHECK'), ('QUALITY_CHECK', 'QUALITY_PASSED', 'COMPUTING'), ('QUALITY_CHECK', 'QUALITY_FAILED', 'SIGNAL_ACQUIRING'),
 ('FACE_LOCKED', 'FACE_LOST', 'FACE_SEARCH'), ('SIGNAL_ACQUIRING', 'FACE_LOST', 'FACE_SEARCH'), ('QUALITY_CHECK', 'FACE_LOST', 'FACE_SEARCH'))"""

ORACLES = {
    "face_quality": f"""WITH {_VIEW}, d AS (SELECT session_id, event_id, t, x + w / 2 AS cx, y + h / 2 AS cy, w, w / frame_w AS share FROM v WHERE has),
l AS (SELECT *, lag(cx) OVER s AS px, lag(cy) OVER s AS py, lag(w) OVER s AS pw, lag(t) OVER s AS pt FROM d WINDOW s AS (PARTITION BY session_id ORDER BY t, event_id)),
a AS (SELECT session_id, avg((sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) / w + abs(w - pw) / w) / greatest(t - pt, 1e-9)) AS speed, median(share) AS width FROM l GROUP BY session_id),
b AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE has) / count(*) AS detection, avg(luma) AS level, stddev_pop(luma) / greatest(avg(luma), 1e-9) AS variation, avg(clipped) AS clipped FROM v GROUP BY session_id),
m AS (SELECT session_id, n, detection, round(level, 9) AS level, round(variation, 9) AS variation, round(clipped, 9) AS clipped, round(coalesce(speed, 0), 9) AS speed, round(coalesce(width, 0), 9) AS width FROM b LEFT JOIN a USING (session_id)),
c AS (SELECT *, exp(-speed / 0.25) AS motion, least(1, width / 0.25) AS size_score,
 CASE WHEN level < 80 THEN greatest(0, (level - 50) / 30) WHEN level > 190 THEN greatest(0, (230 - level) / 40) ELSE 1 END * greatest(0, 1 - variation / 0.16) * greatest(0, 1 - clipped / 0.1) AS light FROM m)
SELECT session_id, CASE WHEN n < 10 THEN 0 ELSE round(detection, 6) END AS detection, CASE WHEN n < 10 THEN 0 ELSE round(motion, 6) END AS motion, CASE WHEN n < 10 THEN 0 ELSE round(light, 6) END AS light, CASE WHEN n < 10 THEN 0 ELSE round(size_score, 6) END AS size_score,
 CASE WHEN n < 10 THEN 0 ELSE round(pow(detection * motion * light * size_score, 0.25), 6) END AS overall,
 CASE WHEN n < 10 THEN 'INSUFFICIENT_OBSERVATIONS' ELSE concat_ws(',', CASE WHEN detection < 0.9 THEN 'FACE_NOT_DETECTED' END, CASE WHEN width < 0.12 THEN 'FACE_TOO_SMALL' END, CASE WHEN speed > 0.35 THEN 'EXCESSIVE_MOTION' END,
  CASE WHEN level < 80 THEN 'TOO_DARK' END, CASE WHEN level > 190 THEN 'TOO_BRIGHT' END, CASE WHEN variation > 0.08 THEN 'LIGHTING_UNSTABLE' END, CASE WHEN clipped > 0.05 THEN 'PIXEL_CLIPPING' END) END AS issues FROM c""",
    "frame_light": f"""WITH {_VIEW}, u AS (SELECT *, CAST(round(t * 1000000) AS BIGINT) AS us FROM v WHERE luma > 0), w AS (SELECT *, median(luma) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m, count(*) OVER s AS n, min(t) OVER s AS t0, avg(luma) OVER s AS a, stddev_pop(luma) OVER s AS d
 FROM u WINDOW s AS (PARTITION BY session_id ORDER BY us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW)) SELECT event_id, round(m, 6) AS smooth_luma, n >= 10 AND t - t0 >= 1 AND a > 1e-6 AND d / a > 0.1 AS unstable FROM w
UNION ALL SELECT event_id, 0, false FROM v WHERE coalesce(luma, 0) <= 0""",
    "frame_motion": f"""WITH {_VIEW}, d AS (SELECT session_id, event_id, t, CAST(round(t * 1000000) AS BIGINT) AS us, x + w / 2 AS cx, y + h / 2 AS cy, w FROM v WHERE has),
j AS (SELECT *, coalesce(sqrt(pow(cx - lag(cx) OVER s, 2) + pow(cy - lag(cy) OVER s, 2)) > 0.6 * greatest(w, lag(w) OVER s), false) AS jumped FROM d WINDOW s AS (PARTITION BY session_id ORDER BY t)),
p AS (SELECT *, count(*) FILTER (WHERE jumped) OVER (PARTITION BY session_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM j),
r AS (SELECT *, count(*) OVER s AS n, greatest(max(cx) OVER s - min(cx) OVER s, max(cy) OVER s - min(cy) OVER s) / avg(w) OVER s AS reach FROM p WINDOW s AS (PARTITION BY session_id, part ORDER BY us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW))
SELECT event_id, jumped, jumped OR (n >= 5 AND reach > 0.12) AS moving, round(reach, 6) AS reach FROM r""",
    "gate_states": f"WITH {_VIEW}, {_GATE} SELECT event_id, array_to_string(reasons, ',') AS reasons, raw AS state FROM q",
    "gate_hysteresis": f"""WITH {_VIEW} SELECT a.event_id, CASE WHEN a.value < 3 OR EXISTS (SELECT 1 FROM v b WHERE b.session_id = a.session_id AND b.value < 3 AND b.t <= a.t AND a.t - b.t < 2) THEN 'REJECTED' WHEN a.value < 200 THEN 'SUSPICIOUS' ELSE 'ACCEPTED' END AS state FROM v a""",
    "frame_status": f"""WITH {_VIEW}, {_GATE}, c AS (SELECT *, CASE WHEN NOT has THEN ['FACE_NOT_FOUND'] ELSE [x for x in [CASE WHEN w / (frame_w * 2) < 0.12 THEN 'FACE_TOO_SMALL' END, CASE WHEN luma <= 0 THEN NULL WHEN luma < 40 THEN 'TOO_DARK' WHEN luma > 225 THEN 'TOO_BRIGHT' END, CASE WHEN event_id % 9 = 0 THEN 'LIGHT_UNSTABLE' END,
 CASE WHEN event_id % 10 = 0 THEN 'MOTION_HIGH' END, CASE WHEN event_id % 15 = 0 THEN 'TIME_GAP' END, CASE WHEN event_id % 14 = 0 THEN 'LOW_FPS' END] if x IS NOT NULL] END || reasons AS codes FROM q), b AS (SELECT *, list_contains(codes, 'FACE_NOT_FOUND') OR list_contains(codes, 'MOTION_HIGH') AS blocked FROM c)
SELECT event_id, array_to_string(codes, ',') AS codes, blocked, CASE WHEN value / 60 >= 0.4 AND NOT blocked AND raw <> 'REJECTED' THEN 'OK' ELSE 'LOW_QUALITY' END AS status FROM b""",
    "packets": """WITH w AS (SELECT vec_id, CAST(embedding[1 : vec_id % 64] AS DOUBLE[]) AS x, vec_id % 64 AS n, (vec_id % 10) / 10.0::DOUBLE AS q FROM embeddings)
SELECT vec_id, CASE WHEN n < 45 THEN 'BUFFERING' WHEN q < 0.4 THEN 'LOW_QUALITY' ELSE 'OK' END AS status, CASE WHEN n >= 45 THEN 1.0 ELSE round_even(n / 45.0::DOUBLE, 2) END AS progress, least(n, 45) AS held, round(coalesce(list_sum(x[greatest(1, n - 44) : n]), 0), 6) AS total FROM w""",
    "confidence": f"""WITH {_VIEW}, r AS (SELECT *, stddev_pop(CASE WHEN event_id % 3 <> 0 THEN value / 10 END) OVER s AS sd, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) OVER s AS m FROM v WINDOW s AS (PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
p AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN 1 / (1 + exp(-0.5 * (value / 25 - 12))) END AS a, CASE WHEN event_type <> 'view' THEN (event_id % 101) / 100.0::DOUBLE END AS b, CASE WHEN event_type <> 'click' THEN greatest(0, least(1, 1 - abs(value - 250) / 250)) END AS c, CASE WHEN m >= 2 THEN exp(-sd / 5) END AS d FROM r),
q AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN d IS NULL THEN 0 ELSE 0.15::DOUBLE END AS weight FROM p)
SELECT event_id, CASE WHEN weight > 0 THEN round((coalesce(a, 0) * 0.35::DOUBLE + coalesce(b, 0) * 0.3::DOUBLE + coalesce(c, 0) * 0.2::DOUBLE + coalesce(d, 0) * 0.15::DOUBLE) / weight * (1 - (event_id % 7) / 20.0::DOUBLE), 6) ELSE 0 END AS confidence,
 CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE round(greatest(0, 1 - (event_id % 12) / 10.0::DOUBLE), 6) END AS agreement FROM q""",
    "missing_ratio": f"""WITH {_VIEW}, u AS (SELECT *, CAST(round(t * 1000000) AS BIGINT) AS us FROM v) SELECT event_id, round(avg(CASE WHEN has THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) OVER (PARTITION BY session_id ORDER BY us RANGE BETWEEN 4000000 PRECEDING AND CURRENT ROW), 6) AS missing FROM u""",
    "run_statistics": f"""WITH {_VIEW} SELECT session_id, count(*) AS frames, count(*) FILTER (WHERE event_type = 'click') AS n_ok, count(*) FILTER (WHERE event_type = 'view') AS n_low_quality, count(*) FILTER (WHERE event_type = 'signup') AS n_buffering, count(*) FILTER (WHERE event_type = 'error') AS n_face_lost,
 count(*) FILTER (WHERE event_type = 'purchase') AS n_artifact, count(*) FILTER (WHERE event_id % 4 > 1) AS n_accepted, count(*) FILTER (WHERE event_id % 4 = 1) AS n_suspicious, count(*) FILTER (WHERE event_id % 4 = 0) AS n_rejected, round(avg(value / 500), 6) AS mean_sqi,
 round(avg((event_id % 10) / 10.0::DOUBLE), 6) AS mean_periodicity, round(avg(CASE WHEN event_id % 3 <> 0 THEN (event_id % 20) / 20.0::DOUBLE END), 6) AS mean_r_mean, round(avg((event_id % 8) / 8.0::DOUBLE), 6) AS mean_motion_score, round(median(value / 7), 6) AS median_latency_ms,
 round(median(value) FILTER (WHERE event_type = 'click' AND event_id % 5 <> 0), 6) AS median_bpm, round(arg_max(value, t) FILTER (WHERE event_id % 5 <> 0), 6) AS last_bpm, 72.0::DOUBLE AS reference_bpm, round(abs(median(value) FILTER (WHERE event_type = 'click' AND event_id % 5 <> 0) - 72), 6) AS error_bpm FROM v GROUP BY session_id""",
    "bbox_ema": _EMA,
    "largest_face": f"""WITH {_VIEW}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY w * h DESC, x, y) AS n FROM v WHERE has),
b AS (SELECT session_id, x, y, w, h, CAST(trunc(x + 0.25::DOUBLE * w) AS INTEGER) AS l, CAST(trunc(y + 0.08::DOUBLE * h) AS INTEGER) AS t, CAST(trunc(0.5::DOUBLE * w) AS INTEGER) AS dw, CAST(trunc(0.18::DOUBLE * h) AS INTEGER) AS dh FROM r WHERE n = 1)
SELECT session_id, round(x, 6) AS x, round(w, 6) AS w, least(l, 200) AS x1, least(t, 60) AS y1, least(l + dw, 200) AS x2, least(t + dh, 60) AS y2 FROM b""",
    "ibi_mask": f"""WITH {_VIEW}, s AS (SELECT session_id, list(value * 3 ORDER BY t, event_id) AS a FROM v GROUP BY session_id), e AS (SELECT session_id, a, len(a) AS n, least(5, len(a)) AS size, unnest(range(1, len(a) + 1)) AS i FROM s),
m AS (SELECT session_id, a[i] AS v, list_sort([a[greatest(1, least(n, j))] for j in range(i - size // 2, i - size // 2 + size)])[size // 2 + 1] AS middle FROM e),
c AS (SELECT session_id, v >= 60000.0::DOUBLE / 180 AND v <= 1500 AND abs(v - middle) <= 0.25 * middle AS ok FROM m) SELECT session_id, count(*) AS n, count(*) FILTER (WHERE ok) AS clean, round(1 - count(*) FILTER (WHERE ok) / count(*), 6) AS artifact_ratio FROM c GROUP BY session_id""",
    "state_machine": f"""WITH RECURSIVE {_VIEW}, {_MOVES}, e AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS k, ['REQUEST_CAMERA', 'PERMISSION_GRANTED', 'START_MEASUREMENT', 'FACE_FOUND', 'ACQUISITION_STARTED', 'WINDOW_FILLED', 'QUALITY_FAILED', 'WINDOW_FILLED', 'QUALITY_PASSED', 'FACE_LOST'][event_id % 10 + 1] AS e FROM v),
r AS (SELECT DISTINCT session_id, 0::BIGINT AS k, 'IDLE' AS state, 0 AS retries, 0::BIGINT AS refused FROM e
 UNION ALL SELECT r.session_id, r.k + 1, CASE WHEN m.t IS NULL THEN r.state WHEN m.e = 'QUALITY_FAILED' AND r.retries >= 3 THEN 'FAILED' ELSE m.t END, CASE WHEN m.e = 'QUALITY_FAILED' THEN r.retries + 1 ELSE r.retries END, r.refused + CASE WHEN m.t IS NULL THEN 1 ELSE 0 END
 FROM r JOIN e ON e.session_id = r.session_id AND e.k = r.k + 1 LEFT JOIN m ON m.s = r.state AND m.e = e.e)
SELECT session_id, arg_max(state, k) AS state, arg_max(retries, k) AS retries, arg_max(refused, k) AS refused FROM r GROUP BY session_id""",
}
