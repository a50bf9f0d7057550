"""Queries of exact quantiles, closed contracts, own methods and beats as rows; the SQL is written from the definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arterion.operators import contracts, health, methods
from arterion.operators.quantiles import quantiles
from arterion.plans import care, signals
from arterion.sources import schemas

SHARES = (0.05, 0.5, 0.95)
CONTRACT = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("vitals", T.ArrayType(T.StructType([T.StructField("code", T.StringType(), False), T.StructField("value", T.DoubleType())])))])
#: A text of each kind: right, and wrong in one way each; ID stands for the row's id.
TEXTS = ('{"id": ID, "vitals": [{"code": "a", "value": 1.5}, {"code": "b"}]}', '{"id": ID, "vitals": [{"code": "a", "extra": 1}]}', '{"id": ID, "vitals": [{"value": 2.0}]}', '{"id": ID, "vitals": null, "more": {}}', '{"vitals": []}', '{"id": ')
REFUSED = ("", "vitals[].extra", "vitals[].code", "more", "id", "not JSON of these types")


def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by flag: quantiles of groups that no task holds."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    return quantiles(rows, "price", SHARES, "l_returnflag").select("l_returnflag", "share", "n", F.round("value", 6).alias("value"))


def closed_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as nested JSON, some of them with keys too many or too few, read by a closed contract."""
    kind = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(TEXTS)).cast("int")
    text = F.replace(F.get(F.array(*[F.lit(t) for t in TEXTS]), kind), F.lit("ID"), F.col("l_orderkey").cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", text.alias("text"))
    out = schemas.parsed(rows, "text", CONTRACT)
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("value.id"), F.lit(-1)).alias("id"), F.max(F.array_join("refused", ",")).alias("refused"), F.coalesce(F.max(F.size("value.vitals")), F.lit(0)).alias("vitals"))


def own_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection of one's own, called from SQL: twice the green channel less the two others."""
    name = methods.register(spark, "greenest", lambda rgb, fs: 2 * rgb[:, 1] - rgb[:, 0] - rgb[:, 2])
    waves = signals.traces(spark, sf_dir).select("trace", F.call_function(name, "r", "g", "b", F.lit(30.0)).alias("x"))
    return waves.select("trace", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v), 6).alias("power"), F.size("x").alias("n"))


def beat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of sessions of eight windows in a row: how many, their time and their height together."""
    w = signals.windows(spark, sf_dir).select((F.col("vec_id") / 8).cast("long").alias("session_id"), "vec_id", "x")
    rows = w.groupBy("session_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda s: s["x"])).alias("x"))
    out = methods.beats(rows, "x", 30.0, "session_id")
    return out.groupBy("session_id").agg(F.count(F.lit(1)).alias("beats"), F.round(F.sum("seconds"), 6).alias("seconds"), F.round(F.sum("height"), 6).alias("height"))


def window_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of several rates and lengths, some flat, cut or with holes: what speaks against their features."""
    k = F.col("vec_id")
    x = F.transform("embedding", lambda v, i: F.when((k % 17 == 0) & (i == 3), float("nan")).when(k % 19 == 0, 1.0).otherwise(v.cast("double")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.slice(x, 1, F.when(k % 7 == 0, 40).otherwise(64)).alias("x"))
    reasons = health.window_guard(F.col("x"), (10 + k % 9).cast("double"), F.when(k % 5 != 0, (k % 10) / 10), k % 11 == 0, F.when(k % 4 != 0, (k % 13) / 20))
    return rows.select("vec_id", F.array_join(reasons, ",").alias("reasons"))


def full_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results with all their parts."""
    rows = care._results(spark, sf_dir).select("result_id", F.explode("vitals").alias("v"))
    rows = rows.select(
        F.col("result_id").alias("session_id"), F.col("result_id").cast("double").alias("start"), (F.col("result_id") + 30).cast("double").alias("end"), F.lit("POS").alias("method"), F.lit("1.0").alias("method_version"), F.lit(30.0).alias("fs"),
        "v.code", "v.value", "v.unit", "v.status", "v.quality", "v.confidence", "v.issues", F.lit(None).cast("string").alias("model"),
    )
    out = contracts.full_results(rows)
    return out.select("session_id", "engine_version", F.col("window.seconds").alias("seconds"), "status", F.array_join("issues", ",").alias("issues"), F.size("vitals").alias("n_vitals"), F.size(F.filter("vitals", lambda v: v["value"].isNull())).alias("n_void"), F.element_at("vitals.algorithm", 1).alias("algorithm"))


_KIND = f"(l_orderkey * 7 + l_linenumber) % {len(TEXTS)}"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"exact_quantiles": exact_quantiles, "closed_contracts": closed_contracts, "own_method": own_method, "beat_rows": beat_rows, "window_guard": window_guard, "full_results": full_results}
ORACLES = {
    "exact_quantiles": "SELECT l_returnflag, share, count(*) AS n, round(CASE share WHEN 0.05 THEN quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.05) WHEN 0.5 THEN quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) ELSE quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.95) END, 6) AS value FROM lineitem, (SELECT CAST(unnest([0.05, 0.5, 0.95]) AS DOUBLE) AS share) s GROUP BY l_returnflag, share",
    "closed_contracts": f"SELECT l_orderkey, l_linenumber, count(*) AS n, CASE WHEN {_KIND} = 0 THEN l_orderkey ELSE -1 END AS id, {list(REFUSED)}[{_KIND} + 1] AS refused, CAST(CASE WHEN {_KIND} = 0 THEN 2 ELSE 0 END AS INTEGER) AS vitals FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "window_guard": """WITH w AS (SELECT vec_id AS k, [CASE WHEN vec_id % 17 = 0 AND i = 4 THEN 'nan'::DOUBLE WHEN vec_id % 19 = 0 THEN 1.0::DOUBLE ELSE CAST(embedding[i] AS DOUBLE) END for i in range(1, CASE WHEN vec_id % 7 = 0 THEN 41 ELSE 65 END)] AS x FROM embeddings),
f AS (SELECT *, [y for y in x if isfinite(y)] AS f, 10 + k % 9 AS fs FROM w)
SELECT k AS vec_id, concat_ws(',', CASE WHEN fs < 15 THEN 'LOW_FS' END, CASE WHEN len(x) / fs < 4 THEN 'SIGNAL_TOO_SHORT' END, CASE WHEN len(f) < len(x) THEN 'NON_FINITE_SAMPLES' END, CASE WHEN len(f) = 0 OR list_max(f) - list_min(f) < 1e-9 THEN 'SIGNAL_DEGENERATE' END,
 CASE WHEN k % 5 <> 0 AND (k % 10) / 10.0::DOUBLE < 0.4::DOUBLE THEN 'LOW_SQI' END, CASE WHEN k % 11 = 0 THEN 'BLOCKING_WARNING' END, CASE WHEN k % 4 <> 0 AND (k % 13) / 20.0::DOUBLE > 0.25 THEN 'HIGH_ARTIFACT' END) AS reasons FROM f""",
    "full_results": f"""WITH {care._RESULTS}, u AS (SELECT result_id, unnest(CASE flag WHEN 'A' THEN ['LOW'] WHEN 'R' THEN ['X', 'Y'] ELSE [] END) AS issue FROM v), s AS (SELECT result_id, string_agg(DISTINCT issue, ',' ORDER BY issue) AS issues FROM u GROUP BY result_id)
SELECT v.result_id AS session_id, '1.0.0' AS engine_version, 30.0::DOUBLE AS seconds, CASE WHEN max(CASE WHEN k = 1 AND ok THEN 1 ELSE 0 END) = 1 THEN 'OK' ELSE 'INVALID' END AS status, coalesce(any_value(issues), '') AS issues, CAST(count(*) AS INTEGER) AS n_vitals, CAST(count(*) FILTER (WHERE NOT ok) AS INTEGER) AS n_void, 'pos-1.0' AS algorithm
FROM v LEFT JOIN s ON s.result_id = v.result_id GROUP BY v.result_id""",
    "own_method": """WITH e AS (SELECT vec_id // 3 AS trace, vec_id % 3 AS k, generate_subscripts(embedding, 1) AS i, 128 + 20 * CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
p AS (SELECT trace, i, 2 * max(x) FILTER (WHERE k = 1) - max(x) FILTER (WHERE k = 0) - max(x) FILTER (WHERE k = 2) AS v FROM e GROUP BY ALL HAVING count(*) = 3)
SELECT trace, round(sum(v * v), 6) AS power, CAST(count(*) AS INTEGER) AS n FROM p GROUP BY trace""",
}
