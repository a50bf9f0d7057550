"""Operators on tables of camera frames: lighting, motion, face quality, gate, status and confidence, all as Columns.

A frame is a row (session_id, t, face, frame_w, luma, clipped, r, g, b): seconds, a box struct<x,y,w,h> or null, the
frame's width, mean luma and clipped share of the face, and its mean colour.  Windows run over a session by time; the
ones that say ``by`` take any other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the frame checks.
LUMA = (0.299, 0.587, 0.114)
CLIPPED = (5, 250)
FACE = {"observations": 10, "detection": 0.9, "ideal_width": 0.25, "width": 0.12, "speed_scale": 0.25, "speed": 0.35, "variation": 0.08, "clipped": 0.05}
LEVELS = (50.0, 80.0, 190.0, 230.0)
LIGHT_FRAMES, LIGHT_S, LIGHT_LEAST, UNSTABLE = 7, 2.0, 10, 0.10
DARK, BRIGHT, SMALL = 40.0, 225.0, 0.12
MOTION_S, MOTION_LEAST, AMPLITUDE, JUMP = 1.0, 5, 0.12, 0.60
GATE = {"HIGH_ARTIFACT": ("artifact_ratio", ">", 0.25), "LOW_SNR": ("snr", "<", 0.4), "NOT_PERIODIC": ("periodicity", "<", 0.46), "ROI_DISAGREE": ("r_mean", "<", 0.4), "HIGH_MOTION": ("motion_score", ">", 0.5)}
HOLD_S, LEAST_SQI = 2.0, 0.4
SEVERITIES = {
    "FACE_NOT_FOUND": "block", "FACE_TOO_SMALL": "warn", "TOO_DARK": "warn", "TOO_BRIGHT": "warn", "LIGHT_UNSTABLE": "warn", "MOTION_HIGH": "block", "LOW_FPS": "warn", "TIME_GAP": "info", "ARTIFACT_DETECTED": "info",
}
WEIGHTS = {"snr": 0.35, "quality": 0.30, "agreement": 0.20, "steady": 0.15}


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def there(*marks: Column) -> Column:
    """The codes among ``marks`` that aren't null, in order."""
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def _trailing(seconds: float, by: tuple[str, ...] = ("session_id",)) -> Window:
    """A window of seconds up to the row, as whole microseconds, since ranges of floating numbers are not exact."""
    return Window.partitionBy(*by).orderBy(F.round(F.col("t") * 1_000_000).cast("long")).rangeBetween(-round(seconds * 1_000_000), 0)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def lighting(pixels: DataFrame, *by: str) -> DataFrame:
    """(by, luma, clipped): mean luma and the share of clipped pixels of rows (by, r, g, b)."""
    y = luma(F.col("r"), F.col("g"), F.col("b"))
    out = (y <= CLIPPED[0]) | (y >= CLIPPED[1])
    return pixels.groupBy(*by).agg(F.avg(y).alias("luma"), F.avg(out.cast("double")).alias("clipped"))


def region_colours(pixels: DataFrame, *by: str) -> DataFrame:
    """(by, roi, r, g, b, n): mean colour and number of pixels of each region; pixels are rows (by, roi, r, g, b)."""
    return pixels.groupBy(*by, "roi").agg(*[F.avg(c).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("n"))


def weighted_colour(regions: DataFrame, *by: str) -> DataFrame:
    """(by, r, g, b): the mean of regions, weighted by their pixels."""
    return regions.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"])


def largest_face(boxes: DataFrame, *by: str) -> DataFrame:
    """(by, face): the box of the largest area; of equal ones the first by place."""
    key = F.struct((F.col("face.w") * F.col("face.h")).alias("area"), (-F.col("face.x")).alias("x"), (-F.col("face.y")).alias("y"))
    return boxes.where(F.col("face").isNotNull()).groupBy(*by).agg(F.max_by("face", key).alias("face"))


def region(face: Column, x: float, y: float, w: float, h: float, frame_w: Column, frame_h: Column) -> Column:
    """The part of a face box at shares of it, in whole pixels, within the frame: struct<x1,y1,x2,y2>."""
    left, top = (face["x"] + x * face["w"]).cast("int"), (face["y"] + y * face["h"]).cast("int")
    within = lambda v, most: F.greatest(F.lit(0), F.least(v, most)).cast("int")
    return F.struct(
        within(left, frame_w).alias("x1"), within(top, frame_h).alias("y1"), within(left + (w * face["w"]).cast("int"), frame_w).alias("x2"), within(top + (h * face["h"]).cast("int"), frame_h).alias("y2")
    )


def face_quality(frames: DataFrame, *by: str, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """(by, detection, motion, light, size_score, overall, issues): one row per session.

    Motion compares each frame that has a face with the last one that had.  Under ten frames nothing is scored.  Means
    are compared with bounds to nine places: their last bits depend on the order of adding up.
    """
    by = by or ("session_id",)
    middle = F.struct((F.col("face.x") + F.col("face.w") / 2).alias("x"), (F.col("face.y") + F.col("face.h") / 2).alias("y"), F.greatest(F.col("face.w").cast("double"), F.lit(1e-9)).alias("w"), F.col("t").alias("t"))
    rows = frames.withColumn("m", F.when(F.col("face").isNotNull(), middle))
    before = F.last("m", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    m, p = F.col("m"), F.col("p")
    moved = F.sqrt((m["x"] - p["x"]) * (m["x"] - p["x"]) + (m["y"] - p["y"]) * (m["y"] - p["y"])) / m["w"] + F.abs(m["w"] - p["w"]) / m["w"]
    rows = rows.withColumn("p", before).withColumn("speed", moved / F.greatest(m["t"] - p["t"], F.lit(1e-9)))
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("face").isNotNull().cast("double")).alias("detection"), F.coalesce(F.avg("speed"), F.lit(0.0)).alias("speed"), F.avg("luma").alias("level"),
        F.stddev_pop("luma").alias("swing"), F.coalesce(F.avg("clipped"), F.lit(0.0)).alias("clipped"), F.coalesce(F.percentile(F.col("face.w") / F.col("frame_w"), 0.5), F.lit(0.0)).alias("width"),
    )
    level, few = F.col("level"), F.col("n") < FACE["observations"]
    s = s.withColumn("variation", F.col("swing") / F.greatest(level, F.lit(1e-9)))
    s = s.withColumns({c: F.round(c, 9) for c in ("speed", "level", "variation", "clipped", "width")})
    ramp = F.when(level < LEVELS[1], clip((level - LEVELS[0]) / (LEVELS[1] - LEVELS[0]))).when(level > LEVELS[2], clip((LEVELS[3] - level) / (LEVELS[3] - LEVELS[2]))).otherwise(1.0)
    light = ramp * clip(1 - F.col("variation") / (2 * FACE["variation"])) * clip(1 - F.col("clipped") / (2 * FACE["clipped"]))
    s = s.withColumns({"motion": F.exp(-F.col("speed") / FACE["speed_scale"]), "light": light, "size_score": clip(F.col("width") / FACE["ideal_width"])})
    issues = there(
        F.when(F.col("detection") < FACE["detection"], "FACE_NOT_DETECTED"), F.when(F.col("width") < FACE["width"], "FACE_TOO_SMALL"), F.when(F.col("speed") > FACE["speed"], "EXCESSIVE_MOTION"),
        F.when(level < LEVELS[1], "TOO_DARK"), F.when(level > LEVELS[2], "TOO_BRIGHT"), F.when(F.col("variation") > FACE["variation"], "LIGHTING_UNSTABLE"), F.when(F.col("clipped") > FACE["clipped"], "PIXEL_CLIPPING"),
    )
    parts = ["detection", "motion", "light", "size_score"]
    overall = F.sqrt(F.sqrt(F.col("detection") * F.col("motion") * F.col("light") * F.col("size_score")))
    return s.select(*by, *[F.when(few, 0.0).otherwise(F.col(c)).alias(c) for c in parts], F.when(few, 0.0).otherwise(overall).alias("overall"), F.when(few, F.array(F.lit("INSUFFICIENT_OBSERVATIONS"))).otherwise(issues).alias("issues"))


def light_history(frames: DataFrame, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """``frames`` with smooth_luma, the median of the last seven measured, and unstable: variation over two seconds.

    A luma that isn't over 0 was not measured: it counts in neither, and its own row has 0 and false.
    """
    measured = F.when(F.col("luma") > 0, F.col("luma"))
    # Rows without a measurement don't count among the seven, so those with one are looked back over.
    some = frames.where(F.col("luma") > 0)
    recent, span = Window.partitionBy("session_id").orderBy(*order).rowsBetween(1 - LIGHT_FRAMES, 0), _trailing(LIGHT_S)
    level, swing = F.avg(measured).over(span), F.stddev_pop(measured).over(span)
    unstable = (F.count(measured).over(span) >= LIGHT_LEAST) & (F.col("t") - F.min("t").over(span) >= LIGHT_S / 2) & (level > 1e-6) & (swing / level > UNSTABLE)
    some = some.withColumns({"smooth_luma": F.percentile(measured, 0.5).over(recent), "unstable": F.coalesce(unstable, F.lit(False))})
    rest = frames.where(~(F.coalesce("luma", F.lit(0.0)) > 0)).withColumns({"smooth_luma": F.lit(0.0), "unstable": F.lit(False)})
    return some.unionByName(rest)


def motion_history(frames: DataFrame) -> DataFrame:
    """``frames`` that have a face, with jumped: the box's centre is far from the last one, and moving: that, or a wide
    reach of the centre over the last second since the last jump."""
    rows = frames.where(F.col("face").isNotNull() & (F.col("face.w") > 0)).withColumns({"cx": F.col("face.x") + F.col("face.w") / 2, "cy": F.col("face.y") + F.col("face.h") / 2})
    by_time = Window.partitionBy("session_id").orderBy("t")
    step = F.sqrt(F.pow(F.col("cx") - F.lag("cx").over(by_time), 2) + F.pow(F.col("cy") - F.lag("cy").over(by_time), 2))
    rows = rows.withColumn("jumped", F.coalesce(step > JUMP * F.greatest(F.lag("face.w").over(by_time), F.col("face.w")), F.lit(False)))
    rows = rows.withColumn("calm", F.sum(F.col("jumped").cast("int")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    span = _trailing(MOTION_S, ("session_id", "calm"))
    reach = F.greatest(F.max("cx").over(span) - F.min("cx").over(span), F.max("cy").over(span) - F.min("cy").over(span)) / F.greatest(F.avg("face.w").over(span), F.lit(1e-6))
    wide = (F.count(F.lit(1)).over(span) >= MOTION_LEAST) & (reach > AMPLITUDE)
    return rows.withColumn("reach", reach).withColumn("moving", F.col("jumped") | wide).drop("cx", "cy", "calm")


def frame_warnings(lost: Column, width_share: Column, smooth_luma: Column, unstable: Column, moving: Column, slow: Column, gap: Column) -> Column:
    """The warning codes of a frame, in their order."""
    return F.when(lost, F.array(F.lit("FACE_NOT_FOUND"))).otherwise(there(
        F.when((width_share > 0) & (width_share < SMALL), "FACE_TOO_SMALL"), F.when(smooth_luma > 0, F.when(smooth_luma < DARK, "TOO_DARK").when(smooth_luma > BRIGHT, "TOO_BRIGHT")),
        F.when(unstable, "LIGHT_UNSTABLE"), F.when(moving, "MOTION_HIGH"), F.when(gap, "TIME_GAP"), F.when(slow, "LOW_FPS"),
    ))


def severity(code: Column) -> Column:
    """How grave a warning is: block, warn or info; of an unknown code info."""
    table = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("info"))


def blocking(warnings: Column) -> Column:
    return F.coalesce(F.exists(warnings, lambda w: severity(w) == "block"), F.lit(False))


def gate(window_len: Column, least_len: Column, **metrics: Column) -> Column:
    """struct<raw,reasons>: what a window's metrics (artifact_ratio, snr, periodicity, r_mean, motion_score) say.  A
    metric that is null, or not given, has nothing to say."""
    marks = []
    for reason, (name, side, bound) in GATE.items():
        if name in metrics:
            marks.append(F.when(metrics[name] > bound if side == ">" else metrics[name] < bound, reason))
    short = F.coalesce(window_len, F.lit(0)) < F.coalesce(least_len, F.lit(1))
    reasons = F.when(short, F.array(F.lit("WINDOW_TOO_SHORT"))).otherwise(there(*marks) if marks else F.expr("cast(array() as array<string>)"))
    n = F.size(reasons)
    raw = F.when(short | F.array_contains(reasons, "HIGH_ARTIFACT") | (n > 1), "REJECTED").when(n == 1, "SUSPICIOUS").otherwise("ACCEPTED")
    return F.struct(raw.alias("raw"), reasons.alias("reasons"))


def held_state(raw: Column, t: Column, window: Window) -> Column:
    """The gate's state: a rejection lasts for two seconds after the last window that was rejected."""
    last = F.max(F.when(raw == "REJECTED", t)).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(t - last < HOLD_S, "REJECTED").otherwise(raw)


def status(sqi: Column, warnings: Column, state: Column) -> Column:
    return F.when((sqi >= LEAST_SQI) & ~blocking(warnings) & F.coalesce(state != "REJECTED", F.lit(True)), "OK").otherwise("LOW_QUALITY")


def union_codes(warnings: Column, reasons: Column) -> Column:
    """Warnings and the gate's reasons, each code once."""
    return F.array_union(warnings, reasons)


def packet(samples: Column, fs: Column, quality: Column, seconds: float = 8.0) -> Column:
    """struct<signal,status,progress>: the last seconds of a wave as they are handed on."""
    n, want = F.size(samples), F.bround(fs * seconds, 0).cast("int")
    full = n >= want
    return F.struct(
        F.when(full & (n > 0), F.slice(samples, F.greatest(F.lit(1), n - want + 1), F.greatest(F.lit(1), want))).otherwise(samples).alias("signal"),
        F.when((n == 0) | ~full, "BUFFERING").when(quality < LEAST_SQI, "LOW_QUALITY").otherwise("OK").alias("status"),
        F.when(n == 0, 0.0).when(full, 1.0).otherwise(F.bround(n / want, 2)).cast("double").alias("progress"),
    )


def method_agreement(a: Column, b: Column, tolerance: float = 5.0) -> Column:
    """1 of equal rates, 0 from twice the tolerance on, 0.5 if either is unknown."""
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(clip(1 - F.abs(a - b) / (2 * tolerance)))


def steadiness(recent: Column, scale: float = 5.0) -> Column:
    """exp(-deviation / scale) of two values or more; null of fewer."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = total(recent) / F.size(recent)
    spread = F.sqrt(total(F.transform(recent, lambda v: (v - mean) * (v - mean))) / F.size(recent))
    return F.when(F.size(recent) >= 2, F.exp(-spread / scale))


def confidence(snr_db: Column, quality: Column, agreement: Column, recent: Column, missing: Column) -> Column:
    """The weighted mean of the scores there are, times what isn't missing; 0 without any."""
    parts = {"snr": 1 / (1 + F.exp(-0.5 * (snr_db - 2))), "quality": quality, "agreement": agreement, "steady": steadiness(recent)}
    total = sum((F.coalesce(x * WEIGHTS[k], F.lit(0.0)) for k, x in parts.items()), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, x in parts.items()), F.lit(0.0))
    return F.when(weight > 0, clip(total / weight * (1 - missing))).otherwise(0.0)


def missing_ratio(lost: Column, seconds: float = 60.0) -> Column:
    """The share of lost frames over the trailing seconds of a session."""
    return F.avg(lost.cast("double")).over(_trailing(seconds))


def run_statistics(frames: DataFrame, *by: str) -> DataFrame:
    """One row per run of (by, t, status, state, sqi, periodicity, r_mean, motion_score, bpm, latency_ms, reference_bpm):
    frames by status and by gate, means of the scores, and of frames that are OK the median rate and its error."""
    ok = F.col("status") == "OK"
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{v.lower()}")
    out = frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), *[count("status", v) for v in ("OK", "LOW_QUALITY", "BUFFERING", "FACE_LOST", "ARTIFACT")], *[count("state", v) for v in ("ACCEPTED", "SUSPICIOUS", "REJECTED")],
        *[F.avg(c).alias(f"mean_{c}") for c in ("sqi", "periodicity", "r_mean", "motion_score")], F.percentile("latency_ms", 0.5).alias("median_latency_ms"),
        F.percentile(F.when(ok, F.col("bpm")), 0.5).alias("median_bpm"), F.max_by("bpm", F.when(F.col("bpm").isNotNull(), F.col("t"))).alias("last_bpm"), F.avg("reference_bpm").alias("reference_bpm"),
    )
    return out.withColumn("error_bpm", F.abs(F.col("median_bpm") - F.col("reference_bpm")))


def smoothed_boxes(frames: DataFrame, value: str, alpha: float = 0.65, hold: int = 10, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """``frames`` with smooth: the exponential mean of ``value``, held over up to ``hold`` rows without one, after which
    it starts anew.  A weight of (1 - alpha) ** 60 is none, so sixty values back are enough; no session is held whole."""
    by = Window.partitionBy("session_id").orderBy(*order)
    rows = frames.withColumn("_k", F.row_number().over(by))
    seen = rows.where(F.col(value).isNotNull())
    new = F.coalesce(F.col("_k") - F.lag("_k").over(by) > hold + 1, F.lit(True)).cast("int")
    seen = seen.withColumn("_new", new).withColumn("_part", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    back = F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col("_new").alias("first"))).over(Window.partitionBy("session_id", "_part").orderBy("_k").rowsBetween(-59, 0))
    weighed = F.transform(back, lambda x, i: x["v"] * F.pow(F.lit(1 - alpha), F.size(back) - 1 - i) * F.when(x["first"] == 1, 1.0).otherwise(alpha))
    seen = seen.select("session_id", "_k", F.aggregate(weighed, F.lit(0.0), lambda s, v: s + v).alias("_mean"))
    both = rows.join(seen, ["session_id", "_k"], "left")
    return both.withColumn("smooth", F.last("_mean", ignorenulls=True).over(by.rowsBetween(-hold, 0))).drop("_k", "_mean")
