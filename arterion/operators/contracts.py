"""The result contract: measured vitals as rows, and the shapes that stores and callers take them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = {"heart_rate": "heartRate", "hrv_rmssd": "hrvRmssd", "respiratory_rate": "respirationRate"}
FINDINGS = {"heart_rate": (60.0, 100.0, "resting_heart_rate"), "respiratory_rate": (12.0, 20.0, "respiratory_rate")}


def finite(x: Column) -> Column:
    """NaN as null, as it has to be before comparing or averaging."""
    return F.when(~F.isnan(x), x)


def accepted(vitals: Column) -> Column:
    return F.filter(vitals, lambda v: v["status"] == "OK")


def find(vitals: Column, code: str) -> Column:
    return F.get(F.filter(vitals, lambda v: v["code"] == code), F.lit(0))


def metrics(vitals: Column) -> Column:
    """map of interface name to value of accepted vitals."""
    name = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    known = F.filter(accepted(vitals), lambda v: v["value"].isNotNull() & F.map_contains_key(name, v["code"]))
    return F.map_from_entries(F.transform(known, lambda v: F.struct(F.element_at(name, v["code"]), v["value"])))


def label(quality: Column, status: Column) -> Column:
    return F.when(status == "INVALID", "REJECTED").when(quality >= 0.7, "GOOD").when(quality >= 0.4, "FAIR").otherwise("POOR")


def results(rows: DataFrame) -> DataFrame:
    """(session_id, at, status, vitals): one result per window; its status is that of the heart rate."""
    vital = F.struct("code", finite(F.col("value")).alias("value"), "unit", "status", "quality", "confidence", "issues")
    return rows.groupBy("session_id", "at").agg(F.sort_array(F.collect_list(vital)).alias("vitals")).withColumn("status", find(F.col("vitals"), "heart_rate")["status"])


#: Versions that a result says it is made by; callers may give their own.
ENGINE_VERSION, SCHEMA_VERSION = "1.0.0", "1.0"


def full_results(rows: DataFrame, engine_version: str = ENGINE_VERSION, schema_version: str = SCHEMA_VERSION) -> DataFrame:
    """One whole result per window of rows (session_id, start, end, method, method_version, fs, code, value, unit, status,
    quality, confidence, issues, model): versions, source and window of the signal, vitals with their algorithm and
    model, and the issues of all of them, each once, in order.

    A vital that is INVALID or has no finite value has none and is INVALID; values have one place, quality and
    confidence three within [0, 1]; the result's status is that of the heart rate, INVALID without one.
    """
    value = finite(F.col("value").cast("double"))
    void = (F.col("status") == "INVALID") | value.isNull() | (F.abs(value) == float("inf"))
    unit = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)))), 3).alias(c)
    issues = F.coalesce("issues", F.expr("cast(array() as array<string>)"))
    vital = F.struct(
        "code", F.when(~void, F.bround(value, 1)).alias("value"), "unit", F.when(void, "INVALID").otherwise(F.col("status")).alias("status"), unit("quality"), unit("confidence"), issues.alias("issues"),
        F.concat_ws("-", F.lower("method"), "method_version").alias("algorithm"), "model",
    )
    key = ["session_id", "start", "end", "method", "method_version", "fs"]
    out = rows.groupBy(*key).agg(F.sort_array(F.collect_list(vital)).alias("vitals"))
    source, window = F.struct("method", "method_version", F.col("fs").alias("sampling_rate_hz")), F.struct("start", "end", (F.col("end") - F.col("start")).alias("seconds"))
    heart = find(F.col("vitals"), "heart_rate")["status"]
    return out.select(
        "session_id", F.lit(schema_version).alias("schema_version"), F.lit(engine_version).alias("engine_version"), source.alias("source"), window.alias("window"), "vitals",
        F.coalesce(heart, F.lit("INVALID")).alias("status"), F.array_sort(F.array_distinct(F.flatten("vitals.issues"))).alias("issues"),
    )


def measurement_rows(found: DataFrame) -> DataFrame:
    """What a measurement becomes when its result arrives."""
    hr = find(F.col("vitals"), "heart_rate")
    return found.select(
        "session_id", "at", F.when(F.col("status") == "INVALID", "REJECTED").otherwise("READY").alias("state"), metrics(F.col("vitals")).alias("metrics"), label(hr["quality"], F.col("status")).alias("label"),
        F.bround(hr["quality"] * 100, 0).cast("int").alias("score"), F.to_json("vitals").alias("json"), F.date_format(F.to_utc_timestamp(F.timestamp_micros((F.col("at") * 1000000).cast("long")), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("measured_at"),
    )


def validation_rows(found: DataFrame) -> DataFrame:
    """A row per vital: whether it passed, and its issues as a reason."""
    v = found.select("session_id", "at", F.explode("vitals").alias("v"))
    return v.select("session_id", "at", "v.code", (F.col("v.status") == "OK").alias("passed"), F.array_join("v.issues", ", ").alias("reason"))


def findings(found: DataFrame) -> DataFrame:
    """A row per accepted vital that has a typical range, below, within or above it."""
    v = found.select("session_id", "at", F.explode(accepted(F.col("vitals"))).alias("v")).select("session_id", "at", "v.code", "v.value")
    side = F.lit(None).cast("string")
    for code, (low, high, name) in FINDINGS.items():
        where = F.when(F.col("value") < low, "below").when(F.col("value") > high, "above").otherwise("within")
        side = F.when(F.col("code") == code, F.concat(F.lit(f"{name}_"), where, F.lit("_typical_range"))).otherwise(side)
    return v.withColumn("finding", side).where("finding IS NOT NULL")


def request_is_within_limits(samples: Column, fs: Column, rois: Column, warnings: Column) -> Column:
    """Limits of a window that is handed in."""
    return F.size(samples).between(8, 36000) & (fs > 0) & (fs <= 1000) & (F.size(rois) <= 16) & (F.size(warnings) <= 32)
