"""Queries over results, persons and samples, by the operators of :mod:`arterion.operators.health` and array helpers.

An order stands for a result, its items for vitals, its customer for the person, an embedding for a window or for the
pixels of a face.  The SQL is written from the definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.operators import arrays, contracts, frames, health

_CODES = ("heart_rate", "hrv_rmssd", "hrv_sdnn", "hrv_mean_ibi", "respiratory_rate")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", F.struct(
            F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("l_linenumber") - 1) % 5).alias("code"), (F.col("l_quantity").cast("double") * 3).alias("value"), F.lit("u").alias("unit"),
            F.when(F.col("l_returnflag") == "R", "INVALID").otherwise("OK").alias("status"), F.col("l_discount").cast("double").alias("confidence"), (F.col("l_tax").cast("double") * 10).alias("quality"),
            F.when(F.col("l_returnflag") == "A", F.array(F.lit("LOW"))).when(F.col("l_returnflag") == "R", F.array(F.lit("X"), F.lit("Y"))).otherwise(F.expr("cast(array() as array<string>)")).alias("issues"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"),
        ).alias("v"),
    )
    # Several items of an order stand for one code, as codes repeat after five: the last by its keys counts.
    one = items.groupBy("l_orderkey", F.col("v.code").alias("code")).agg(F.max_by("v", F.struct("v.k", "v.s", "v.value", "v.status")).alias("v")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("v")).alias("vitals"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    rows = orders.join(one, orders["o_orderkey"] == one["l_orderkey"])
    return rows.select(F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderkey").cast("double").alias("at"), F.when(F.col("o_orderstatus") == "P", "INVALID").otherwise("OK").alias("status"), "vitals", "o_totalprice")


_RESULTS = """i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) % 5 ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_returnflag = 'R' ASC) AS n FROM lineitem),
v AS (SELECT l_orderkey AS result_id, o_custkey AS person_id, o_orderstatus, o_totalprice, (l_linenumber - 1) % 5 + 1 AS k, CAST(l_quantity AS DOUBLE) * 3 AS value, l_returnflag <> 'R' AS ok, CAST(l_tax AS DOUBLE) * 10 AS quality, l_returnflag AS flag FROM i JOIN orders ON l_orderkey = o_orderkey WHERE n = 1)"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("person_id"), (18 + k % 60).alias("age_years"), (k % 2 == 0).alias("sex_male"), F.when(k % 7 != 0, 150.0 + k % 50).alias("height_cm"), (50.0 + k % 45).alias("weight_kg"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select(F.col("result_id").alias("session_id"), "at", "status", "vitals")


def measurement_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contracts.measurement_rows(_found(spark, sf_dir))
    return out.select("session_id", "state", "label", "score", "measured_at", F.size("metrics").alias("n_metrics"), F.round(F.element_at("metrics", F.lit("heartRate")), 6).alias("heart_rate"), F.size(F.from_json("json", "array<struct<code:string>>")).alias("n_json"))


def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.validation_rows(_found(spark, sf_dir)).drop("at")


def health_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.findings(_found(spark, sf_dir)).select("session_id", "code", F.round("value", 6).alias("value"), "finding")


def bp_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    waves = rows.select("result_id", (F.col("o_totalprice") / 1000).cast("double").alias("aix_proxy"), F.when(F.col("result_id") % 3 == 0, float("nan")).otherwise(1.5).alias("bvp_kurtosis"))
    out = health.bp_features(rows, waves, _people(spark, sf_dir)).withColumn("missing", health.missing_share())
    shown = ["heart_rate_bpm", "hrv_rmssd_ms", "respiratory_rate_brpm", "aix_proxy", "bvp_kurtosis", "age_years", "sex_male", "bmi", "missing"]
    return out.select("result_id", *[F.round(c, 6).alias(c) for c in shown])


def value_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.trends(_results(spark, sf_dir))


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {"resting_heart_rate_below_typical_range": "Below 60", "resting_heart_rate_within_typical_range": "60 to 100", "resting_heart_rate_above_typical_range": "Over 100", "hrv_single_measurement_context": "Once", "respiratory_rate_above_typical_range": "Over 20,5"}
    knowledge = spark.createDataFrame([(c, (t, "Rest 5 minutes")) for c, t in text.items()], "code string, text struct<interpretation:string,caution:string>")
    found = health.assessments(_results(spark, sf_dir), knowledge)
    out = health.payloads(_results(spark, sf_dir), found)
    body = F.from_json("payload", "vitals array<struct<metric:string,value:double>>, unavailable_metrics array<string>, findings array<struct<code:string>>")
    out = out.withColumn("b", body)
    return out.select("result_id", F.size("b.vitals").alias("n_vitals"), F.array_join(F.array_sort("b.unavailable_metrics"), ",").alias("unavailable"), F.array_join(F.array_sort("b.findings.code"), ",").alias("findings"), F.size("allowed").alias("n_allowed"), F.round(arrays.total("allowed"), 4).alias("allowed"))


def vital_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), F.get(F.array(*[F.lit(x) for x in ("HR", "rr", "rmssd", "sdnn", "mood", "mean_ibi", "heart_rate")]), F.col("l_linenumber") - 1).alias("name"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("double") * 5).alias("value"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"), "o_custkey", (F.col("o_totalprice") / 1000).cast("double").alias("v"))
    out = health.reports(rows, health.jumps(orders, "o_custkey", "key", "v"))
    return out.select("key", "status", "is_valid", F.size("failed").alias("n_failed"), F.array_join(F.array_sort(F.array_distinct("failed.reason")), ",").alias("reasons"))


def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k, (k % 104).cast("double").alias("sync_error_ms"), (k % 31 != 0).alias("has_timestamps"), (k % 29 != 0).alias("has_reference"), (k % 23 != 0).alias("reference_usable"), (k % 37 != 0).alias("readable"), (k % 41 == 0).alias("variable_rate"),
        (k % 52 / 1000).alias("dropped_share"), F.when(k % 5 != 0, k % 43 != 0).alias("face_seen"), (k % 53 / 100).alias("occluded_share"), (25 + k % 60).alias("seconds"), F.lit(30).alias("least_seconds"), (k % 720).alias("lux"), F.when(k % 3 == 0, F.array(F.lit("glasses"))).alias("deviations"),
    )
    return health.sample_labels(rows).select("o_orderkey", "label", F.array_join("exclusion_reasons", ",").alias("reasons"))


def pixel_lighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as pixels: luma and clipping of each label's, and the weighted colour of its two regions."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    px = e.select("label", F.when(F.col("i") < 20, "a").otherwise("b").alias("roi"), *[(128 + F.col("x") * w).alias(c) for c, w in (("r", 500.0), ("g", 300.0), ("b", 200.0))])
    light, colour = frames.lighting(px, "label"), frames.weighted_colour(frames.region_colours(px, "label"), "label")
    return light.join(colour, "label").select("label", *[F.round(c, 6).alias(c) for c in ("luma", "clipped", "r", "g", "b")])


def array_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    mask = F.transform("x", lambda v: v > 0)
    some = F.map_from_arrays(F.array(F.lit("b"), F.lit("a"), F.lit("c")), F.array(F.get("x", F.lit(0)), F.when(F.get("x", F.lit(1)) > 0, F.get("x", F.lit(1))), F.lit(1.0)))
    return w.select(
        "vec_id", F.size(arrays.where_mask("x", mask)).alias("positive"), F.round(F.array_max(arrays.running_sum("x")), 6).alias("highest_sum"), F.array_join(arrays.keys_in_order(arrays.present(some)), ",").alias("keys"),
        F.round(F.array_max(arrays.green_intensity(F.transform("x", lambda v: 100 + v))), 9).alias("intensity"), health.unit_interval(F.get("x", F.lit(0))).alias("in_unit"), health.correlation_range(F.get("x", F.lit(1)) * 8).alias("in_range"),
    )


QUERIES = {
    "bp_features_31": bp_features, "value_trends": value_trends, "explanations": explanations, "vital_reports": vital_reports, "sample_labels": sample_labels, "pixel_lighting": pixel_lighting, "array_helpers": array_helpers,
    "measurement_results": measurement_results, "validation_rows": validation_rows, "health_findings": health_findings,
}
ORACLES = {
    "bp_features_31": f"""WITH {_RESULTS}, p AS (SELECT result_id, any_value(person_id) AS person_id, any_value(o_totalprice) AS price, max(value) FILTER (WHERE ok AND k = 1) AS hr, max(value) FILTER (WHERE ok AND k = 2) AS rm, max(value) FILTER (WHERE ok AND k = 5) AS rr, count(*) FILTER (WHERE ok) AS n FROM v GROUP BY result_id)
SELECT result_id, round(hr, 6) AS heart_rate_bpm, round(rm, 6) AS hrv_rmssd_ms, round(rr, 6) AS respiratory_rate_brpm, round(CAST(price / 1000 AS DOUBLE), 6) AS aix_proxy, CASE WHEN result_id % 3 <> 0 THEN 1.5::DOUBLE END AS bvp_kurtosis, CAST(18 + person_id % 60 AS DOUBLE) AS age_years,
 CASE WHEN person_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sex_male, CASE WHEN person_id % 7 <> 0 THEN round((50 + person_id % 45) / pow((150 + person_id % 50) / 100.0::DOUBLE, 2), 6) END AS bmi,
 round((31 - n - 1 - CASE WHEN result_id % 3 <> 0 THEN 1 ELSE 0 END - 2 - CASE WHEN person_id % 7 <> 0 THEN 1 ELSE 0 END) / 31.0::DOUBLE, 6) AS missing FROM p JOIN customer ON c_custkey = person_id""",
    "value_trends": f"""WITH {_RESULTS} SELECT person_id, ['heart_rate', 'hrv_rmssd', 'hrv_sdnn', 'hrv_mean_ibi', 'respiratory_rate'][k] AS code, count(*) AS n, round_even(arg_min(value, result_id), 1) AS first, round_even(arg_max(value, result_id), 1) AS last, round_even(avg(value), 1) AS mean, round_even(min(value), 1) AS low, round_even(max(value), 1) AS high
FROM v WHERE ok AND o_orderstatus <> 'P' GROUP BY person_id, k HAVING count(*) >= 2""",
    "explanations": f"""WITH {_RESULTS}, f AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN k = 1 THEN 'resting_heart_rate_' || CASE WHEN value < 60 THEN 'below' WHEN value > 100 THEN 'above' ELSE 'within' END || '_typical_range' WHEN k = 2 THEN 'hrv_single_measurement_context'
 WHEN k = 5 THEN 'respiratory_rate_' || CASE WHEN value < 12 THEN 'below' WHEN value > 20 THEN 'above' ELSE 'within' END || '_typical_range' END AS code FROM v WHERE o_orderstatus <> 'P'),
s AS (SELECT *, CASE code WHEN 'resting_heart_rate_below_typical_range' THEN [60, 5] WHEN 'resting_heart_rate_within_typical_range' THEN [60, 100, 5] WHEN 'resting_heart_rate_above_typical_range' THEN [100, 5] WHEN 'hrv_single_measurement_context' THEN [5] WHEN 'respiratory_rate_above_typical_range' THEN [20.5, 5] ELSE [] END AS said FROM f)
SELECT result_id, CAST(count(*) FILTER (WHERE ok) AS INTEGER) AS n_vitals, coalesce(string_agg(['heart_rate', 'hrv_rmssd', 'hrv_sdnn', 'hrv_mean_ibi', 'respiratory_rate'][k], ',' ORDER BY ['heart_rate', 'hrv_rmssd', 'hrv_sdnn', 'hrv_mean_ibi', 'respiratory_rate'][k]) FILTER (WHERE NOT ok), '') AS unavailable,
 coalesce(string_agg(code, ',' ORDER BY code), '') AS findings, CAST(count(*) FILTER (WHERE ok) + sum(len(said)) AS INTEGER) AS n_allowed, round(sum(CASE WHEN ok THEN round_even(value, 1) ELSE 0 END) + sum(coalesce(list_sum(said), 0)), 4) AS allowed FROM s GROUP BY result_id HAVING count(*) FILTER (WHERE ok) > 0""",
    "vital_reports": """WITH c AS (SELECT l_orderkey AS key, CASE WHEN l_linenumber = 5 THEN 'NO_RANGE' WHEN l_returnflag = 'R' THEN 'NO_VALUE'
 WHEN l_quantity * 5 NOT BETWEEN CASE l_linenumber WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 5 WHEN 6 THEN 330 ELSE 40 END AND CASE l_linenumber WHEN 2 THEN 30 WHEN 3 THEN 250 WHEN 4 THEN 300 WHEN 6 THEN 1500 ELSE 180 END THEN 'OUT_OF_RANGE' END AS reason FROM lineitem),
j AS (SELECT o_orderkey AS key, abs(CAST(o_totalprice / 1000 AS DOUBLE) - lag(CAST(o_totalprice / 1000 AS DOUBLE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) > 25 AS jumped FROM orders),
a AS (SELECT key, reason FROM c UNION ALL SELECT key, 'SUDDEN_JUMP' FROM j WHERE jumped AND key IN (SELECT l_orderkey FROM lineitem))
SELECT key, CASE WHEN count(*) FILTER (WHERE reason <> 'SUDDEN_JUMP') > 0 THEN 'REJECTED' WHEN count(reason) > 0 THEN 'SUSPICIOUS' ELSE 'ACCEPTED' END AS status, count(*) FILTER (WHERE reason <> 'SUDDEN_JUMP') = 0 AS is_valid, CAST(count(reason) AS INTEGER) AS n_failed, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM a GROUP BY key""",
    "sample_labels": """WITH r AS (SELECT o_orderkey, o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 104 > 100 OR o_orderkey % 31 = 0 THEN 'SYNC_ERROR' END, CASE WHEN o_orderkey % 29 = 0 THEN 'MISSING_REFERENCE' END, CASE WHEN o_orderkey % 23 = 0 THEN 'REFERENCE_SIGNAL_POOR' END, CASE WHEN o_orderkey % 37 = 0 THEN 'VIDEO_CORRUPTED' END,
 CASE WHEN o_orderkey % 41 = 0 THEN 'FPS_INVALID' END, CASE WHEN o_orderkey % 52 > 50 THEN 'FRAME_DROP_GT_5_PERCENT' END, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 43 = 0 THEN 'FACE_NOT_DETECTED' END, CASE WHEN o_orderkey % 53 > 50 THEN 'ROI_OCCLUSION_GT_50_PERCENT' END,
 CASE WHEN o_orderkey % 60 < 5 THEN 'INSUFFICIENT_DURATION' END, CASE WHEN o_orderkey % 720 NOT BETWEEN 5 AND 700 THEN 'INVALID_ILLUMINANCE' END) AS reasons FROM orders) SELECT o_orderkey, CASE WHEN reasons <> '' THEN 'REJECT' WHEN k % 3 = 0 THEN 'WARNING' ELSE 'PASS' END AS label, reasons FROM r""",
    "pixel_lighting": """WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), p AS (SELECT label, 128 + x * 500 AS r, 128 + x * 300 AS g, 128 + x * 200 AS b FROM e), l AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y FROM p)
SELECT label, round(avg(y), 6) AS luma, round(count(*) FILTER (WHERE y <= 5 OR y >= 250) / count(*), 6) AS clipped, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM l GROUP BY label""",
    "array_helpers": """WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT *, sum(x) OVER (PARTITION BY vec_id ORDER BY i) AS c FROM e)
SELECT vec_id, CAST(count(*) FILTER (WHERE x > 0) AS INTEGER) AS positive, round(max(c), 6) AS highest_sum, CASE WHEN max(x) FILTER (WHERE i = 1) > 0 THEN 'a,b,c' ELSE 'b,c' END AS keys, round(1 - (100 + min(x)) / (100 + avg(x)), 9) AS intensity,
 max(x) FILTER (WHERE i = 0) BETWEEN 0 AND 1 AS in_unit, max(x) FILTER (WHERE i = 1) * 8 BETWEEN -1 AND 1 AS in_range FROM s GROUP BY vec_id""",
    "measurement_results": f"""WITH {_RESULTS}, h AS (SELECT result_id, any_value(o_orderstatus) AS o, max(quality) FILTER (WHERE k = 1) AS q, max(value) FILTER (WHERE k = 1 AND ok) AS hr, count(*) FILTER (WHERE ok AND k IN (1, 2, 5)) AS m, count(*) AS n FROM v GROUP BY result_id)
SELECT result_id AS session_id, CASE WHEN o = 'P' THEN 'REJECTED' ELSE 'READY' END AS state, CASE WHEN o = 'P' THEN 'REJECTED' WHEN q >= 0.7 THEN 'GOOD' WHEN q >= 0.4 THEN 'FAIR' ELSE 'POOR' END AS label, CAST(round_even(q * 100, 0) AS INTEGER) AS score,
 strftime(make_timestamp(CAST(result_id AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS measured_at, CAST(m AS INTEGER) AS n_metrics, round(hr, 6) AS heart_rate, CAST(n AS INTEGER) AS n_json FROM h""",
    "validation_rows": f"""WITH {_RESULTS} SELECT result_id AS session_id, ['heart_rate', 'hrv_rmssd', 'hrv_sdnn', 'hrv_mean_ibi', 'respiratory_rate'][k] AS code, ok AS passed, CASE flag WHEN 'A' THEN 'LOW' WHEN 'R' THEN 'X, Y' ELSE '' END AS reason FROM v""",
    "health_findings": f"""WITH {_RESULTS} SELECT result_id AS session_id, CASE k WHEN 1 THEN 'heart_rate' ELSE 'respiratory_rate' END AS code, round(value, 6) AS value,
 CASE k WHEN 1 THEN 'resting_heart_rate' ELSE 'respiratory_rate' END || '_' || CASE WHEN value < CASE k WHEN 1 THEN 60 ELSE 12 END THEN 'below' WHEN value > CASE k WHEN 1 THEN 100 ELSE 20 END THEN 'above' ELSE 'within' END || '_typical_range' AS finding FROM v WHERE ok AND k IN (1, 5)""",
}
