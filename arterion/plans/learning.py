"""Regression, calibration and text-guard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.operators import models, text_guard
from arterion.plans.dialect import both

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_suppkey").alias("subject_id"), *FEATURES, (F.col("l_extendedprice") / 500).alias("sbp_mmhg"), (F.col("l_quantity") + 40).alias("dbp_mmhg"))


def ridge_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = models.Ridge(FEATURES).fit(_pressure(spark, sf_dir))
    return spark.createDataFrame([(c, *map(float, w)) for c, w in zip(FEATURES, model.weights / model.scale[:, None], strict=True)], "feature string, sbp double, dbp double").select("feature", (F.round("sbp", 4) + 0.0).alias("sbp"), (F.round("dbp", 4) + 0.0).alias("dbp"))  # a zero without a sign


def bp_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pressure(spark, sf_dir)
    return models.Ridge(FEATURES).fit(rows).judged(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sbp_mmhg_estimate"), 2).alias("sbp"))


def bp_cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.cross_validated(_pressure(spark, sf_dir), FEATURES, "subject_id", 3)
    return rows.agg(*models.grades(F.col("pred_sbp_mmhg"), F.col("sbp_mmhg")))


def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(docs, "doc_id").withColumn("score", F.least(F.lit(1.0), F.col("n_chars") / 10000))
    return models.calibrate(rows, "score", "quality").select("doc_id", F.round("calibrated", 6).alias("calibrated"))


def number_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_guard.numbers(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.array_max("x").alias("top"))


def phrase_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_guard.claims(F.col("text"), ("under the", "the with"), ("licensed", "no ")).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", ",").alias("claims"))


QUERIES = {"ridge_bp": ridge_bp, "bp_predictions": bp_predictions, "bp_cross_validated": bp_cross_validated, "isotonic": isotonic, "number_guard": number_guard, "phrase_guard": phrase_guard}
# Cramer's rule for the three scaled features: (Z'Z + 1) w = Z'y.
_RIDGE = """WITH r AS (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(l_tax AS DOUBLE) AS c, CAST(l_extendedprice / 500 AS DOUBLE) AS s, CAST(l_quantity + 40 AS DOUBLE) AS d FROM lineitem),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(s) AS ms, avg(d) AS md, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM r),
z AS (SELECT (a - ma) / sa AS x, (b - mb) / sb AS y, (c - mc) / sc AS w, s - ms AS s, d - md AS d FROM r, m),
g AS (SELECT sum(x * x) + 1 AS p, sum(x * y) AS q, sum(x * w) AS u, sum(y * y) + 1 AS v, sum(y * w) AS n, sum(w * w) + 1 AS o, sum(x * s) AS s1, sum(y * s) AS s2, sum(w * s) AS s3, sum(x * d) AS d1, sum(y * d) AS d2, sum(w * d) AS d3 FROM z),
i AS (SELECT *, p * (v * o - n * n) - q * (q * o - n * u) + u * (q * n - v * u) AS det, v * o - n * n AS i11, u * n - q * o AS i12, q * n - u * v AS i13, p * o - u * u AS i22, u * q - p * n AS i23, p * v - q * q AS i33 FROM g)
SELECT 'l_quantity' AS feature, round((i11 * s1 + i12 * s2 + i13 * s3) / det / sa, 4) + 0.0 AS sbp, round((i11 * d1 + i12 * d2 + i13 * d3) / det / sa, 4) + 0.0 AS dbp FROM i, m
UNION ALL SELECT 'l_discount', round((i12 * s1 + i22 * s2 + i23 * s3) / det / sb, 4) + 0.0, round((i12 * d1 + i22 * d2 + i23 * d3) / det / sb, 4) + 0.0 FROM i, m
UNION ALL SELECT 'l_tax', round((i13 * s1 + i23 * s2 + i33 * s3) / det / sc, 4) + 0.0, round((i13 * d1 + i23 * d2 + i33 * d3) / det / sc, 4) + 0.0 FROM i, m"""
ORACLES = {
    "ridge_bp": _RIDGE,
    "number_guard": r"""WITH x AS (SELECT doc_id, [CAST(replace(v, ',', '.') AS DOUBLE) for v in regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')] AS x FROM documents)
SELECT doc_id, len(x) AS n, list_max(x) AS top FROM x""",
    "phrase_guard": """WITH b AS (
 SELECT doc_id, 'under the' AS phrase, 1 AS ord, k, right(array_to_string(parts[1:k], 'under the'), 30) AS before FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS k FROM (SELECT doc_id, string_split(lower(text), 'under the') AS parts FROM documents))
 UNION ALL
 SELECT doc_id, 'the with', 2, k, right(array_to_string(parts[1:k], 'the with'), 30) FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS k FROM (SELECT doc_id, string_split(lower(text), 'the with') AS parts FROM documents))),
f AS (SELECT * FROM b WHERE NOT contains(before, 'licensed') AND NOT contains(before, 'no '))
SELECT d.doc_id, count(phrase) AS n, coalesce(string_agg(phrase, ',' ORDER BY ord, k), '') AS claims FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
}
_Q, _O = both({
    # Category and score of a pressure
    "pressure_risk": """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 500 AS s, l_quantity + 50 AS d FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s >= 140 OR d >= 90 THEN 'ELEVATED' WHEN s >= 120 OR d >= 80 THEN 'MODERATE' ELSE 'LOW' END AS category,
 HALF_EVEN(greatest(DBL(0), least(DBL(1), greatest((s - 110) / 50, (d - 70) / 30))), 3) AS score FROM p""",
    # Canonical text of settings and its hash
    "config_manifest": "SELECT p_partkey, SHA(concat('{\"brand\":\"', p_brand, '\",\"size\":', TEXT(p_size), '}')) AS config_hash FROM part",
})
QUERIES |= _Q
ORACLES |= _O
