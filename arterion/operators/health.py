"""From measured vitals to health: feature vectors for blood pressure, assessments, explanation payloads, and the checks
of measurements that come from elsewhere.

A result is a row (result_id, at, status, vitals), as :mod:`arterion.operators.contracts` makes it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arterion.functions import features, vitals
from arterion.operators import contracts, text_guard

# Fixed order of the feature vector: vitals, waveform, person.
VITALS = {"heart_rate": "heart_rate_bpm", "hrv_rmssd": "hrv_rmssd_ms", "hrv_sdnn": "hrv_sdnn_ms", "hrv_mean_ibi": "mean_ibi_ms", "respiratory_rate": "respiratory_rate_brpm"}
PERSON = ("age_years", "sex_male", "bmi")
BP_FEATURES = (*VITALS.values(), *features.NAMES, *PERSON)
# Names by which vitals are known elsewhere, and the rules of their check.
ALIASES = {
    "hr": "heart_rate", "heart_rate": "heart_rate", "rr": "respiratory_rate", "respiration_rate": "respiratory_rate", "respiratory_rate": "respiratory_rate", "rmssd": "hrv_rmssd", "hrv_rmssd": "hrv_rmssd",
    "sdnn": "hrv_sdnn", "hrv_sdnn": "hrv_sdnn", "mean_ibi": "hrv_mean_ibi", "hrv_mean_ibi": "hrv_mean_ibi",
}
MOST_JUMP, LEAST_SIGNAL_S = 25.0, 4.0
REPORTED = {"OK": "ACCEPTED", "BAD": "SUSPICIOUS", "INVALID": "REJECTED"}
CONTEXT = {"hrv_rmssd": "hrv_single_measurement_context"}
PLACES, LEAST_TREND = 1, 2


def unit_interval(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)


def correlation_range(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & x.between(-1.0, 1.0)


def by_name(names: dict[str, str], name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.lower(name))


def roi(colours: Column, name: str) -> Column:
    """One region's colour of a map of regions."""
    return F.try_element_at(colours, F.lit(name))


# --- blood pressure


def bp_features(results: DataFrame, waveforms: DataFrame, people: DataFrame) -> DataFrame:
    """(result_id, BP_FEATURES): accepted vitals of results (result_id, person_id, vitals), waveform features
    (result_id, ...) and persons (person_id, age_years, sex_male, height_cm, weight_kg).  What isn't there is null."""
    clean = lambda c: F.when(~F.isnan(c), c)
    value = lambda code: F.get(F.filter(contracts.accepted(F.col("vitals")), lambda v: v["code"] == code), F.lit(0))["value"]
    rows = results.select("result_id", "person_id", *[clean(value(code)).alias(name) for code, name in VITALS.items()])
    height = F.col("height_cm") / 100
    who = people.select("person_id", F.col("age_years").cast("double").alias("age_years"), F.col("sex_male").cast("double").alias("sex_male"), F.when((F.col("height_cm") > 0) & (F.col("weight_kg") > 0), F.col("weight_kg") / (height * height)).alias("bmi"))
    waves = waveforms.select("result_id", *[clean(F.col(c).cast("double")).alias(c) if c in waveforms.columns else F.lit(None).cast("double").alias(c) for c in features.NAMES])
    return rows.join(waves, "result_id", "left").join(who, "person_id", "left").select("result_id", *BP_FEATURES)


def missing_share(names: tuple[str, ...] = BP_FEATURES) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in names), F.lit(0)) / len(names)


class PressureModel(Protocol):
    """What assesses feature rows: adds sbp_mmhg_estimate, dbp_mmhg_estimate, status, confidence and issues."""

    def judged(self, rows: DataFrame) -> DataFrame: ...


def pressure_category(sbp: Column, dbp: Column) -> Column:
    return F.when((sbp >= 140) | (dbp >= 90), "ELEVATED").when((sbp >= 120) | (dbp >= 80), "MODERATE").otherwise("LOW")


def pressure_score(sbp: Column, dbp: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest((sbp - 110) / 50, (dbp - 70) / 30))), 3)


def pressure_assessments(model: PressureModel | None, rows: DataFrame) -> DataFrame | None:
    """Estimates with their category and score, both null of an invalid one; None without a model."""
    if model is None:
        return None
    s, d = F.col("sbp_mmhg_estimate"), F.col("dbp_mmhg_estimate")
    sound = F.col("status") != "INVALID"
    return model.judged(rows).withColumns({"risk_category": F.when(sound, pressure_category(s, d)), "risk_score": F.when(sound, pressure_score(s, d))})


# --- explanations


def validated(result: DataFrame) -> DataFrame:
    """The results that may be explained: not invalid, and with an accepted vital."""
    return result.where((F.col("status") != "INVALID") & (F.size(contracts.accepted(F.col("vitals"))) > 0))


def require_validated(result: DataFrame) -> DataFrame:
    """The same results; a query over one that may not be explained fails."""
    sound = (F.col("status") != "INVALID") & (F.size(contracts.accepted(F.col("vitals"))) > 0)
    return result.withColumn("status", F.when(sound, F.col("status")).otherwise(F.raise_error(F.lit("a result that isn't validated can't be explained"))))


def assessments(found: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(result_id, findings, excluded): typical-range findings of accepted vitals, with what the knowledge (code, text)
    says of each, and the vitals that were left out."""
    rows = found.select("result_id", "vitals", F.explode_outer(contracts.accepted(F.col("vitals"))).alias("v"))
    side = F.lit(None).cast("string")
    for code, (low, high, name) in contracts.FINDINGS.items():
        where = F.when(F.col("v.value") < low, "below").when(F.col("v.value") > high, "above").otherwise("within")
        side = F.when(F.col("v.code") == code, F.concat(F.lit(f"{name}_"), where, F.lit("_typical_range"))).otherwise(side)
    for code, name in CONTEXT.items():
        side = F.when(F.col("v.code") == code, name).otherwise(side)
    rows = rows.withColumn("code", side).join(F.broadcast(knowledge.select("code", "text")), "code", "left")
    one = F.struct("code", F.col("v.code").alias("metric"), F.col("v.value").alias("value"), F.col("v.unit").alias("unit"), F.col("text.interpretation").alias("interpretation"), F.col("text.caution").alias("caution"))
    left_out = F.transform(F.filter(F.first("vitals"), lambda v: v["status"] != "OK"), lambda v: v["code"])
    return rows.groupBy("result_id").agg(F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), one))).alias("findings"), left_out.alias("excluded"))


def payloads(results: DataFrame, assessed: DataFrame) -> DataFrame:
    """(result_id, payload, allowed): what an explanation is made from, as JSON, and the numbers that it may name: the
    accepted values, and those in the findings' texts."""
    shown = lambda v: F.struct(v["code"].alias("metric"), F.bround(v["value"], PLACES).alias("value"), v["unit"].alias("unit"), v["confidence"].alias("confidence"))
    rows = validated(results).join(assessed, "result_id", "left")
    ok = contracts.accepted(F.col("vitals"))
    said = F.flatten(F.transform(F.coalesce("findings", F.expr("array()").cast(assessed.schema["findings"].dataType)), lambda f: text_guard.numbers(F.concat_ws(" ", f["interpretation"], f["caution"]))))
    body = F.struct("result_id", F.transform(ok, shown).alias("vitals"), F.transform(F.filter("vitals", lambda v: v["status"] != "OK"), lambda v: v["code"]).alias("unavailable_metrics"), "findings")
    return rows.select("result_id", F.to_json(body).alias("payload"), F.concat(F.transform(ok, lambda v: F.bround(v["value"], PLACES)), said).alias("allowed"))


def trends(results: DataFrame, by: str = "person_id") -> DataFrame:
    """(by, code, n, first, last, mean, low, high): accepted values of a person by time, of two at least."""
    rows = validated(results).select(by, "at", F.explode(contracts.accepted(F.col("vitals"))).alias("v")).select(by, "at", F.col("v.code").alias("code"), F.col("v.value").alias("value"))
    rows = rows.where(F.col("value").isNotNull()).groupBy(by, "code").agg(
        F.count(F.lit(1)).alias("n"), *[F.bround(x, PLACES).alias(n) for n, x in (("first", F.min_by("value", "at")), ("last", F.max_by("value", "at")), ("mean", F.avg("value")), ("low", F.min("value")), ("high", F.max("value")))]
    )
    return rows.where(F.col("n") >= LEAST_TREND)


# --- checks of measurements that come from elsewhere


def checks(rows: DataFrame) -> DataFrame:
    """``rows`` (key, name, value) with code, passed, severity and reason: is each value known and in its range."""
    code = by_name(ALIASES, F.col("name"))
    low, high = (F.try_element_at(F.create_map(*[x for k, r in vitals.RANGES.items() for x in (F.lit(k), F.lit(float(r[i])))]), code) for i in (0, 1))
    value = F.col("value")
    reason = F.when(low.isNull(), "NO_RANGE").when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "NO_VALUE").when(~value.between(low, high), "OUT_OF_RANGE")
    return rows.withColumns({"code": code, "passed": reason.isNull(), "severity": F.when(reason.isNull(), "INFO").otherwise("ERROR"), "reason": reason})


def jumps(rows: DataFrame, by: str, order: str, value: str, most: float = MOST_JUMP) -> DataFrame:
    """``rows`` with jump: the change since the last value of a session, and jumped: is it too large."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order)))
    return rows.withColumns({"jump": step, "jumped": F.coalesce(step > most, F.lit(False))})


def signal_reason(samples: Column, fs: Column, least: float = LEAST_SIGNAL_S) -> Column:
    """Why a signal can't be used; null of one that can."""
    bad = (F.size(samples) == 0) | F.exists(samples, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(bad, "NOT_FINITE").when(F.size(samples) / fs < least, "TOO_SHORT")


def summary(severities: Column) -> Column:
    """The status of a report with failed checks of these severities."""
    return F.when(F.array_contains(severities, "ERROR"), "REJECTED").when(F.array_contains(severities, "WARNING"), "SUSPICIOUS").otherwise("ACCEPTED")


def reported(status: Column) -> Column:
    """The report's word for a result's status."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in REPORTED.items() for x in pair]), status)


def reports(rows: DataFrame, jump_of: DataFrame | None = None) -> DataFrame:
    """(key, status, is_valid, failed): checks by key, and jumps (key, jumped) besides."""
    failed = checks(rows).where(~F.col("passed")).select("key", F.struct("name", "severity", "reason").alias("x"))
    if jump_of is not None:
        jumped = F.struct(F.lit("sudden_jump").alias("name"), F.lit("WARNING").alias("severity"), F.lit("SUDDEN_JUMP").alias("reason"))
        failed = failed.unionByName(jump_of.where("jumped").select("key", jumped.alias("x")))
    keys = rows.select("key").distinct()
    out = keys.join(failed.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("failed")), "key", "left")
    status = summary(F.coalesce(F.transform("failed", lambda x: x["severity"]), F.expr("cast(array() as array<string>)")))
    return out.select("key", status.alias("status"), (status != "REJECTED").alias("is_valid"), F.coalesce("failed", F.expr("array()").cast(out.schema["failed"].dataType)).alias("failed"))


# Fixed reasons for which a reference sample is left out, and the conditions on its columns.
EXCLUSIONS: dict[str, Callable[[], Column]] = {
    "SYNC_ERROR": lambda: (F.col("sync_error_ms") > 100) | ~F.col("has_timestamps"),
    "MISSING_REFERENCE": lambda: ~F.col("has_reference"),
    "REFERENCE_SIGNAL_POOR": lambda: ~F.col("reference_usable"),
    "VIDEO_CORRUPTED": lambda: ~F.col("readable"),
    "FPS_INVALID": lambda: F.col("variable_rate"),
    "FRAME_DROP_GT_5_PERCENT": lambda: F.col("dropped_share") > 0.05,
    "FACE_NOT_DETECTED": lambda: ~F.col("face_seen"),
    "ROI_OCCLUSION_GT_50_PERCENT": lambda: F.col("occluded_share") > 0.5,
    "INSUFFICIENT_DURATION": lambda: F.col("seconds") < F.col("least_seconds"),
    "INVALID_ILLUMINANCE": lambda: ~F.col("lux").between(5, 700),
}


def sample_labels(samples: DataFrame) -> DataFrame:
    """``samples`` with exclusion_reasons and label: REJECT with a reason, WARNING with a noted deviation, else PASS."""
    marks = F.array(*[F.when(F.coalesce(test(), F.lit(False)), code) for code, test in EXCLUSIONS.items()])
    reasons = F.filter(marks, lambda x: x.isNotNull())
    noted = F.coalesce(F.size("deviations") > 0, F.lit(False))
    return samples.withColumn("exclusion_reasons", reasons).withColumn("label", F.when(F.size("exclusion_reasons") > 0, "REJECT").when(noted, "WARNING").otherwise("PASS"))


def window_guard(samples: Column, fs: Column, sqi: Column, blocking: Column, artifact: Column) -> Column:
    """Reasons against extracting features of a window, in their order: the guard of functions.features as a Column."""
    real = F.coalesce(fs, F.lit(float("nan")))
    usable = ~F.isnan(real) & (F.abs(real) < float("inf"))
    finite = F.filter(samples, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    flat = (F.size(finite) == 0) | (F.array_max(finite) - F.array_min(finite) < 1e-9)
    short = ~(usable & (real > 0)) | (F.size(samples) / F.when(usable & (real > 0), real).otherwise(1.0) < 4.0)
    marks = ((~usable | (real < 15.0), "LOW_FS"), (short, "SIGNAL_TOO_SHORT"), (F.size(finite) < F.size(samples), "NON_FINITE_SAMPLES"), (flat, "SIGNAL_DEGENERATE"), (sqi < 0.4, "LOW_SQI"), (blocking, "BLOCKING_WARNING"), (artifact > 0.25, "HIGH_ARTIFACT"))
    return F.filter(F.array(*[F.when(bad, code) for bad, code in marks]), lambda x: x.isNotNull())
