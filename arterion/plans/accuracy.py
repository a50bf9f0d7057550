"""Accuracy reporting: the estimate-versus-reference fact view and its aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.operators import accuracy as ops
from arterion.plans.dialect import both, oracle


def fact(spark: SparkSession, sf_dir: str, how: str = "left") -> DataFrame:
    """The accuracy fact view: an estimate and a reference per line item."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus",
        F.col("l_quantity").cast("double").alias("qty"), F.col("l_extendedprice").cast("double").alias("est"), F.col("l_discount").cast("double").alias("disc"), F.col("l_tax").cast("double").alias("tax"),
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    return item.join(part, item.l_partkey == part.p_partkey, how).select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("scenario"),
        "est", (F.col("qty") * F.col("price")).alias("ref"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 10 * F.col("disc"))).alias("conf"), "qty", "price", "tax",
    )


FACT_SQL = """
SELECT l_orderkey, l_linenumber, l_returnflag AS method, l_linestatus AS scenario,
       CAST(l_extendedprice AS DOUBLE) AS est,
       CAST(l_quantity AS DOUBLE) * CAST(p_retailprice AS DOUBLE) AS ref,
       greatest(0.0, least(1.0, 1 - 10 * CAST(l_discount AS DOUBLE))) AS conf, CAST(l_quantity AS DOUBLE) AS qty, CAST(p_retailprice AS DOUBLE) AS price, CAST(l_tax AS DOUBLE) AS tax
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
"""


def scenario_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    err = F.col("est") - F.col("ref")
    return fact(spark, sf_dir).groupBy("method", "scenario").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.count(err) / F.count(F.lit(1)), 6).alias("coverage"),
        F.round(F.avg(F.abs(err)), 4).alias("mae"),
    )


TOLERANCE = 5000.0


def status():
    return F.when(F.col("conf") < 0.3, "INVALID").when(F.col("conf") < 0.6, "BAD").otherwise("OK")


STATUS_SQL = "CASE WHEN conf < 0.3 THEN 'INVALID' WHEN conf < 0.6 THEN 'BAD' ELSE 'OK' END"


def _metrics_sql(where: str = "true", prefix: str = "", est: str = "est", ref: str = "ref", tolerance: float = TOLERANCE) -> str:
    f = f"FILTER (WHERE {est} IS NOT NULL AND {ref} IS NOT NULL AND {where})"
    e = f"({est} - ({ref}))"
    wide = f"1.96 * coalesce(CASE WHEN count({e}) {f} > 1 THEN stddev_samp({e}) {f} END, 0.0)"
    out = {
        "count": f"count({e}) {f}", "mae": f"avg(abs({e})) {f}", "rmse": f"sqrt(avg({e} * {e}) {f})", "mape": f"100.0 * avg(abs({e}) / greatest(abs({ref}), 1e-9)) {f}", "bias": f"avg({e}) {f}",
        "loa_lower": f"avg({e}) {f} - {wide}", "loa_upper": f"avg({e}) {f} + {wide}",
        "pearson_r": f"CASE WHEN count({e}) {f} >= 3 THEN covar_pop({est}, {ref}) {f} / nullif(stddev_pop({est}) {f} * stddev_pop({ref}) {f}, 0) END",
        "within_tolerance": f"avg(CASE WHEN abs({e}) <= {tolerance} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) {f}",
    }
    return ", ".join(f"{v} AS {prefix}{k}" if k == "count" else f"round({v}, 4) AS {prefix}{k}" for k, v in out.items())


def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).groupBy("method").agg(*ops.error_metrics(F.col("est"), F.col("ref"), TOLERANCE))


def legacy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).where("ref IS NOT NULL").groupBy("method").agg(*ops.legacy_metrics(F.col("est"), F.col("ref")))


def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, confidence, four blocks of errors on four choices of rows, in one aggregation, and latencies."""
    f = fact(spark, sf_dir).withColumn("status", status())
    e, r, n = F.col("est"), F.col("ref"), F.count(F.lit(1))
    out = f.groupBy("method").agg(
        n.alias("windows"), F.round(F.count_if(F.col("status") != "INVALID") / n, 6).alias("coverage"), F.round(F.count_if(F.col("status") == "OK") / n, 6).alias("ok_ratio"), F.round(F.avg("conf"), 6).alias("mean_confidence"),
        *ops.error_metrics(e, r, TOLERANCE, F.col("status") != "INVALID", "accepted_"), *ops.error_metrics(e, r, TOLERANCE, F.col("status") == "OK", "ok_"),
        *ops.error_metrics(F.col("qty"), F.col("qty") + F.col("tax") * 100 - 4, 2.0, F.col("tax") < 0.07, "rmssd_"), *ops.error_metrics(F.col("price"), F.col("price") + F.col("qty") - 25, 10.0, F.col("qty") > 5, "rr_"),
    )
    latencies = ops.percentiles(f, {"signal": F.col("est"), "vitals": F.col("qty")}, "method").withColumnRenamed("method", "_method")
    return out.join(latencies, out["method"].eqNullSafe(latencies["_method"]), "left").drop("_method")


def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fact(spark, sf_dir, "inner").select("method", "est")
    found = ops.percentiles(f, {"est": F.col("est")}, "method").select(F.col("method").alias("_method"), F.col("est_p50").alias("p50"), F.col("est_p95").alias("p95"))
    out = f.groupBy("method").agg(F.round(F.avg("est"), 4).alias("mean"), F.max("est").alias("top"))
    return out.join(found, out["method"].eqNullSafe(found["_method"]), "left").select("method", "p50", "p95", "mean", "top")


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(F.when(F.col("conf") < 0.3, "VERY_LOW_CONFIDENCE").when(F.col("conf") < 0.6, "LOW_CONFIDENCE"), F.when(F.col("est") > 60000, "OUT_OF_PHYSIOLOGICAL_RANGE"))
    return ops.issue_counts(fact(spark, sf_dir).select("method", F.filter(codes, lambda x: x.isNotNull()).alias("codes")), ["method"], "codes")


def data_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", (F.col("l_extendedprice") / 300).alias("s"), (F.col("l_quantity") * 3).cast("double").alias("d"))
    out = ops.sufficiency(rows, "l_suppkey", "s", "d")
    return out.select("subjects", "samples", *[F.round(k, 6).alias(k) for k in ops.SUFFICIENT], F.array_join("lacking", ",").alias("lacking"), "passed")


def ranked_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return ops.rank_auc(spark.read.parquet(f"{sf_dir}/labels.parquet").join(docs, "doc_id"), "n_chars", "toxic", "doc_id").select(F.round("auc", 8).alias("auc"))


def interval_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", "event_type")
    out = ops.interval_means(e.where("event_type = 'purchase'"), e, "user_id", 43200)
    return out.select(F.col("id").alias("event_id"), "samples", F.round("reference", 6).alias("reference"))


def interpolation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on whole hours between the samples of each user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    out = ops.interpolated(e, "user_id", ["t", "event_id"], 3600.0)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 4).alias("total"))


def grouped_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By scenario, by status and by confidence bin in one pass over GROUPING SETS."""
    f = fact(spark, sf_dir).select("method", "scenario", status().alias("status"), ops.confidence_bin(F.col("conf")).alias("bin"), "est", "ref")
    e = F.col("est") - F.col("ref")
    sets = [[F.col("method"), F.col(c)] for c in ("scenario", "status", "bin")]
    return f.groupingSets(sets, "method", "scenario", "status", "bin").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


BIN_SQL = "CASE WHEN conf >= 0.8 AND conf < 1.0001 THEN '0.8-1.0' WHEN conf >= 0.6 AND conf < 0.8 THEN '0.6-0.8' WHEN conf >= 0.3 AND conf < 0.6 THEN '0.3-0.6' WHEN conf >= 0 AND conf < 0.3 THEN '0.0-0.3' END"


def confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and error of each bin; bins without windows stay."""
    f = fact(spark, sf_dir).groupBy(ops.confidence_bin(F.col("conf")).alias("bin")).agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg(F.abs(F.col("est") - F.col("ref"))), 4).alias("mae"))
    names = spark.createDataFrame([(f"{a:.1f}-{min(b, 1.0):.1f}",) for a, b in ops.CONFIDENCE_BINS], "bin string")
    return names.join(f, "bin", "left").select("bin", F.coalesce("windows", F.lit(0)).cast("long").alias("windows"), "mae")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.calibration_error(fact(spark, sf_dir).withColumn("hit", F.abs(F.col("est") - F.col("ref")) <= TOLERANCE).where("hit IS NOT NULL"), "conf", "hit")


def worst_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fact(spark, sf_dir).where("ref IS NOT NULL")
    tie = ["l_orderkey", "l_linenumber", "est", "ref"]
    return ops.worst(f, "method", F.col("est") - F.col("ref"), tie).select("method", "scenario", "rank", F.round(F.col("est") - F.col("ref"), 4).alias("error"), F.round("ref", 4).alias("ref"))


QUERIES = {
    "acc_scenario_breakdown": scenario_breakdown, "acc_error_metrics": error_metrics, "acc_legacy_metrics": legacy_metrics, "acc_method_summary": method_summary,
    "acc_grouping_sets": grouped_errors, "acc_conf_bins": confidence_bins, "ece": calibration, "worst_k": worst_windows, "acc_issue_counts": issue_counts,
    "two_level_gate": data_sufficiency, "rank_auc": ranked_auc, "range_join_reference": interval_reference, "interpolation_join": interpolation_join,
}
ORACLES = {
    "acc_scenario_breakdown": f"""
WITH f AS ({FACT_SQL})
SELECT method, scenario, count(*) AS windows, round(count(est - ref) / count(*), 6) AS coverage,
       round(avg(abs(est - ref)), 4) AS mae
FROM f GROUP BY method, scenario
""",
    "acc_error_metrics": f"WITH f AS ({FACT_SQL}) SELECT method, {_metrics_sql()} FROM f GROUP BY method",
    "acc_legacy_metrics": f"""
WITH f AS ({FACT_SQL})
SELECT method, round(avg(abs(est - ref)), 4) AS mae, round(sqrt(avg((est - ref) * (est - ref))), 4) AS rmse,
       round(100.0 * avg(CASE WHEN ref <> 0 THEN abs(est - ref) / abs(ref) END), 4) AS mape,
       round(coalesce(covar_pop(est, ref) / nullif(stddev_pop(est) * stddev_pop(ref), 0), 0.0), 4) AS pearson
FROM f WHERE ref IS NOT NULL GROUP BY method
""",
    "acc_method_summary": f"""
WITH f AS (SELECT *, {STATUS_SQL} AS status FROM ({FACT_SQL}))
SELECT method, count(*) AS windows, round(count(*) FILTER (WHERE status <> 'INVALID') / count(*), 6) AS coverage,
       round(count(*) FILTER (WHERE status = 'OK') / count(*), 6) AS ok_ratio, round(avg(conf), 6) AS mean_confidence,
       {_metrics_sql("status <> 'INVALID'", "accepted_")}, {_metrics_sql("status = 'OK'", "ok_")},
       {_metrics_sql("tax < 0.07", "rmssd_", "qty", "qty + tax * 100 - 4", 2.0)}, {_metrics_sql("qty > 5", "rr_", "price", "price + qty - 25", 10.0)},
       round(quantile_cont(est, 0.5), 4) AS signal_p50, round(quantile_cont(est, 0.95), 4) AS signal_p95, round(quantile_cont(qty, 0.5), 4) AS vitals_p50, round(quantile_cont(qty, 0.95), 4) AS vitals_p95
FROM f GROUP BY method
""",
    "acc_issue_counts": f"""
WITH f AS ({FACT_SQL}), c AS (SELECT method, unnest([CASE WHEN conf < 0.3 THEN 'VERY_LOW_CONFIDENCE' END, CASE WHEN conf >= 0.3 AND conf < 0.6 THEN 'LOW_CONFIDENCE' END, CASE WHEN est > 60000 THEN 'OUT_OF_PHYSIOLOGICAL_RANGE' END]) AS code FROM f)
SELECT method, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY method, code
""",
    "two_level_gate": """
WITH m AS (SELECT l_suppkey, avg(l_extendedprice / 300) AS s, avg(CAST(l_quantity * 3 AS DOUBLE)) AS d, count(*) AS n FROM lineitem GROUP BY l_suppkey),
r AS (SELECT count(*) AS subjects, CAST(sum(n) AS BIGINT) AS samples, count(*) FILTER (WHERE s <= 100) / count(*) AS systolic_low, count(*) FILTER (WHERE s >= 160) / count(*) AS systolic_high, count(*) FILTER (WHERE s >= 140) / count(*) AS systolic_elevated,
 count(*) FILTER (WHERE d <= 60) / count(*) AS diastolic_low, count(*) FILTER (WHERE d >= 100) / count(*) AS diastolic_high, count(*) FILTER (WHERE d >= 85) / count(*) AS diastolic_elevated FROM m),
l AS (SELECT *, concat_ws(',', CASE WHEN subjects < 85 THEN 'subjects' END, CASE WHEN samples < 255 THEN 'samples' END, CASE WHEN systolic_low < 0.05 THEN 'systolic_low' END, CASE WHEN systolic_high < 0.05 THEN 'systolic_high' END, CASE WHEN systolic_elevated < 0.2 THEN 'systolic_elevated' END,
 CASE WHEN diastolic_low < 0.05 THEN 'diastolic_low' END, CASE WHEN diastolic_high < 0.05 THEN 'diastolic_high' END, CASE WHEN diastolic_elevated < 0.2 THEN 'diastolic_elevated' END) AS lacking FROM r)
SELECT subjects, samples, round(systolic_low, 6) AS systolic_low, round(systolic_high, 6) AS systolic_high, round(systolic_elevated, 6) AS systolic_elevated, round(diastolic_low, 6) AS diastolic_low, round(diastolic_high, 6) AS diastolic_high, round(diastolic_elevated, 6) AS diastolic_elevated, lacking, lacking = '' AS passed FROM l
""",
    "rank_auc": """
WITH x AS (SELECT toxic, row_number() OVER (ORDER BY n_chars, d.doc_id) AS r FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
s AS (SELECT sum(r) FILTER (WHERE toxic = 1) AS ranks, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE toxic = 0) AS q FROM x) SELECT round((ranks - p * (p + 1) / 2) / (p * q), 8) AS auc FROM s
""",
    "range_join_reference": """
SELECT w.event_id, count(*) AS samples, round(avg(e.value), 6) AS reference FROM events w JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN w.ts AND w.ts + INTERVAL 12 HOURS WHERE w.event_type = 'purchase' GROUP BY w.event_id
""",
    "interpolation_join": """
WITH s AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, value, lead(epoch_us(ts) / 1000000.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t2, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v2, max(epoch_us(ts) / 1000000.0::DOUBLE) OVER (PARTITION BY user_id) AS e FROM events),
g AS (SELECT *, 3600 * unnest(range(CAST(ceil(t / 3600) AS BIGINT), CAST(ceil(t2 / 3600) AS BIGINT) + CASE WHEN t2 = e AND ceil(t2 / 3600) = t2 / 3600 THEN 1 ELSE 0 END)) AS x FROM s WHERE t2 > t) SELECT user_id, count(*) AS points, round(sum(value + (v2 - value) * (x - t) / (t2 - t)), 4) AS total FROM g GROUP BY user_id
""",
    "acc_grouping_sets": f"""
WITH f AS (SELECT method, scenario, {STATUS_SQL} AS status, {BIN_SQL} AS bin, est, ref FROM ({FACT_SQL}))
SELECT method, scenario, status, bin, count(*) AS windows, round(avg(abs(est - ref)), 4) AS mae, round(sqrt(avg((est - ref) * (est - ref))), 4) AS rmse
FROM f GROUP BY GROUPING SETS ((method, scenario), (method, status), (method, bin))
""",
    "acc_conf_bins": f"""
WITH f AS (SELECT {BIN_SQL} AS bin, est, ref FROM ({FACT_SQL})), g AS (SELECT bin, count(*) AS windows, round(avg(abs(est - ref)), 4) AS mae FROM f GROUP BY bin)
SELECT n.bin, coalesce(windows, 0) AS windows, mae FROM (VALUES ('0.0-0.3'), ('0.3-0.6'), ('0.6-0.8'), ('0.8-1.0')) n(bin) LEFT JOIN g ON g.bin = n.bin
""",
    "ece": f"""
WITH f AS (SELECT conf, abs(est - ref) <= {TOLERANCE} AS hit FROM ({FACT_SQL}) WHERE ref IS NOT NULL),
g AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS h FROM f GROUP BY 1)
SELECT round(sum(n * abs(c - h)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS windows FROM g
""",
    "worst_k": f"""
WITH f AS ({FACT_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY abs(est - ref) DESC, l_orderkey, l_linenumber, est, ref) AS rank FROM f WHERE ref IS NOT NULL)
SELECT method, scenario, CAST(rank AS INTEGER) AS rank, round(est - ref, 4) AS error, round(ref, 4) AS ref FROM r WHERE rank <= 5
""",
}

# Written once for both engines.
_F = """WITH f AS (SELECT l_returnflag AS method, l_linestatus AS scenario, l_suppkey AS subject, DBL(l_extendedprice) AS est, DBL(l_quantity) * DBL(p_retailprice) AS ref,
 greatest(DBL(0), least(DBL(1), 1 - 10 * DBL(l_discount))) AS conf FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_Q, _O = both({
    "bp_style_grades": f"""{_F}, e AS (SELECT method, (est - ref) / 1000 AS e FROM f),
 s AS (SELECT method, avg(abs(e)) AS mae, avg(e) AS me, stddev_samp(e) AS sd, avg(CASE WHEN abs(e) <= 5 THEN DBL(1) ELSE DBL(0) END) AS w5, avg(CASE WHEN abs(e) <= 10 THEN DBL(1) ELSE DBL(0) END) AS w10,
  avg(CASE WHEN abs(e) <= 15 THEN DBL(1) ELSE DBL(0) END) AS w15 FROM e GROUP BY method)
 SELECT method, round(mae, 6) AS mae, round(me, 6) AS me, round(sd, 6) AS sd, round(w5, 6) AS within_5, round(w10, 6) AS within_10, round(w15, 6) AS within_15, abs(me) <= 5 AND sd <= 8 AS meets_aami,
  CASE WHEN w5 >= 0.6 AND w10 >= 0.85 AND w15 >= 0.95 THEN 'A' WHEN w5 >= 0.5 AND w10 >= 0.75 AND w15 >= 0.9 THEN 'B' WHEN w5 >= 0.4 AND w10 >= 0.65 AND w15 >= 0.85 THEN 'C' ELSE 'D' END AS bhs_grade FROM s""",
    "training_bounds": "SELECT p_brand AS feature, min(p_retailprice) AS lowest, max(p_retailprice) AS highest, PCT(p_retailprice, 0.5) AS middle FROM part GROUP BY p_brand",
})
QUERIES |= _Q | {"acc_percentiles": price_percentiles}
ORACLES |= _O | {"acc_percentiles": oracle(f"{_F} SELECT method, round(PCT(est, 0.5), 4) AS p50, round(PCT(est, 0.95), 4) AS p95, round(avg(est), 4) AS mean, max(est) AS top FROM f GROUP BY method")}
