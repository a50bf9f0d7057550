"""Array, fold and contract queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.operators import arrays, vectors
from arterion.plans import signals


def window_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = signals.windows(spark, sf_dir)
    return w.select(
        "vec_id", arrays.finite("x").alias("finite"), F.round(F.size("x") / signals.FS, 6).alias("seconds"), F.round(arrays.total(arrays.tail("x", signals.FS, 1.0)), 6).alias("tail_sum"), F.round(F.sqrt(arrays.total(F.transform(arrays.difference("x"), lambda d: d * d)) / (F.size("x") - 1)), 6).alias("rmssd"),
        F.round(arrays.trapezoid("x"), 6).alias("area"), F.size(arrays.turning_points("x")).cast("long").alias("turns"), arrays.width_above("x", 0.5).cast("long").alias("width"), arrays.arg_min("x").alias("lowest"), F.round(arrays.total(arrays.min_max("x")), 6).alias("scaled_sum"), F.round(F.array_max(arrays.gradient("x")), 6).alias("steepest"),
    )


def reason_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered sets of codes by user: distinct, union and difference."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    g = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("codes"))
    seen = F.array_distinct("codes")
    return g.select("user_id", F.array_join(seen, ",").alias("codes"), F.array_join(F.array_union(F.array(F.lit("gate")), F.array_sort(seen)), ",").alias("all_codes"), F.array_join(F.array_except(F.array(*[F.lit(x) for x in ("click", "view", "other")]), seen), ",").alias("lacking"))


QUERIES = {
    "window_arrays": window_arrays, "reason_sets": reason_sets,
    "filtered_features": lambda s, d: vectors.waveform_features(vectors.filtered(signals.windows(s, d), ["vec_id"], "x", signals.FS, 0.7, 3.0), ["vec_id"], "x"),
}
ORACLES = {
    "window_arrays": """WITH s AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS n FROM embeddings),
d AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b, max(x) OVER (PARTITION BY vec_id) AS hi, min(x) OVER (PARTITION BY vec_id) AS lo FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, bool_and(isfinite(x)) AS finite, round(any_value(n) / 30.0::DOUBLE, 6) AS seconds, round(sum(x) FILTER (WHERE i >= n - 30), 6) AS tail_sum, round(sqrt(sum(pow(x - a, 2)) / (any_value(n) - 1)), 6) AS rmssd,
round(sum(x) - (sum(x) FILTER (WHERE i = 0) + sum(x) FILTER (WHERE i = n - 1)) / 2, 6) AS area, count(*) FILTER (WHERE (x - a) * (b - x) < 0) AS turns, max(i) FILTER (WHERE x >= 0.5 * hi) - min(i) FILTER (WHERE x >= 0.5 * hi) AS width,
min(i) FILTER (WHERE x = lo) AS lowest, round(sum((x - lo) / (hi - lo)), 6) AS scaled_sum, round(max(CASE WHEN a IS NULL THEN b - x WHEN b IS NULL THEN x - a ELSE (b - a) / 2 END), 6) AS steepest FROM d GROUP BY vec_id""",
    "reason_sets": """WITH f AS (SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY ALL), g AS (SELECT user_id, list(event_type ORDER BY place) AS codes, list(event_type ORDER BY event_type) AS in_order FROM f GROUP BY user_id)
SELECT user_id, array_to_string(codes, ',') AS codes, array_to_string(['gate'] || in_order, ',') AS all_codes, array_to_string([x for x in ['click', 'view', 'other'] if NOT list_contains(codes, x)], ',') AS lacking FROM g""",
}
