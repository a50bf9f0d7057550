"""Sources and sinks: RGB sample CSV, pressure CSV, recordings, knowledge JSON, reports, database tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arterion.sources import synthetic

ALIASES = {"r": ("r", "red"), "g": ("g", "green"), "b": ("b", "blue"), "t": ("timestamp", "time", "t", "ts")}
NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def read_rgb_csv(spark: SparkSession, path: str) -> DataFrame:
    """(t, r, g, b): columns by header in any case, else the first three numeric ones; t is null without a time column."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    named = {c.strip().lower(): c for c in raw.columns}
    found = {k: next((named[a] for a in names if a in named), None) for k, names in ALIASES.items()}
    if not all(found[k] for k in "rgb"):
        numeric = [c for c, kind in raw.dtypes if (kind in NUMERIC or kind.startswith("decimal")) and c != found["t"]][:3]
        if len(numeric) < 3:
            raise ValueError("a file of RGB samples needs three numeric columns")
        found |= dict(zip("rgb", numeric, strict=True))
    col = lambda k: F.col(f"`{found[k]}`").cast("double").alias(k)
    return raw.select(col("t") if found["t"] else F.lit(None).cast("double").alias("t"), *map(col, "rgb"))


def sampling_rate(rows: DataFrame, key: list[str] | None = None, default: float = 30.0) -> DataFrame:
    """(key, fs) from the mean positive step of t: seconds under 10, else milliseconds; else the default."""
    from pyspark.sql import Window

    keys = key or []
    step = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t")) if keys else None
    if step is None:  # one file: its rows are one session
        return sampling_rate(rows.withColumn("_all", F.lit(1)), ["_all"], default).drop("_all")
    mean = rows.withColumn("_dt", step).groupBy(*keys).agg(F.avg(F.when(F.col("_dt") > 0, F.col("_dt"))).alias("_m"))
    fs = F.when(F.col("_m") < 10, 1 / F.col("_m")).otherwise(1000 / F.col("_m"))
    return mean.select(*keys, F.coalesce(F.when(fs.between(5, 120), fs), F.lit(default)).alias("fs"))


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """By extension; videos have to be decoded before they come here."""
    if path.lower().rsplit(".", 1)[-1] in ("csv", "txt"):
        return read_rgb_csv(spark, path)
    raise ValueError(f"{path}: only csv and txt samples are read")


def read_pressure_csv(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """(subject_id, sbp_mmhg, dbp_mmhg, features): blanks are null, columns that are not there null too; a target
    that is blank or not finite fails the query."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    if lacking := [c for c in ("subject_id", "sbp_mmhg", "dbp_mmhg") if c not in names]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    number = lambda c: F.trim(F.col(f"`{names[c]}`")).try_cast("double")
    sure = lambda c: F.when(number(c).isNotNull() & ~F.isnan(number(c)), number(c)).otherwise(F.raise_error(F.lit(f"{c} is blank or invalid")).cast("double"))
    return raw.select(F.col(f"`{names['subject_id']}`").alias("subject_id"), *[sure(c).alias(c) for c in ("sbp_mmhg", "dbp_mmhg")], *[(number(c) if c in names else F.lit(None).cast("double")).alias(c) for c in features])


def write_pressure_csv(rows: DataFrame, path: str, features: list[str]) -> None:
    """Targets to one place, features to six digits, nulls blank."""
    shown = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string("%.6g", F.col(c)))
    rows.select("subject_id", *[F.format_string("%.1f", F.col(c)).alias(c) for c in ("sbp_mmhg", "dbp_mmhg")], *[shown(c).alias(c) for c in features]).write.mode("overwrite").option("header", True).csv(path)


RECORDING = T.StructType([
    T.StructField("recording_id", T.StringType()), T.StructField("timestamps", T.ArrayType(T.DoubleType())), T.StructField("roi_rgb", T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.DoubleType())))),
    T.StructField("face_detected", T.ArrayType(T.BooleanType())), T.StructField("beats", T.ArrayType(T.DoubleType())),
])


def recording_of(path: str, content: bytes) -> tuple:
    """A row of RECORDING of an .npz file (timestamps, roi_names, roi_rgb, face_detected and, if there, reference_beat_times_s)."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        beats = z["reference_beat_times_s"].tolist() if "reference_beat_times_s" in z.files else None
        regions = {str(n): v.tolist() for n, v in zip(z["roi_names"], z["roi_rgb"], strict=True)}
        return path.rsplit("/", 1)[-1].removesuffix(".npz"), z["timestamps"].tolist(), regions, z["face_detected"].tolist(), beats


def recording_bytes(row) -> tuple[str, bytes]:
    """(file name, content) of a row of RECORDING as an .npz file."""
    names, held = sorted(row.roi_rgb), io.BytesIO()
    more = {} if row.beats is None else {"reference_beat_times_s": np.array(row.beats)}
    traces = np.array([np.stack([np.asarray(v, float) for v in row.roi_rgb[n]]) for n in names])
    np.savez_compressed(held, timestamps=np.array(row.timestamps), roi_names=np.array(names), roi_rgb=traces, face_detected=np.array(row.face_detected, bool), **more)
    return f"{row.recording_id}.npz", held.getvalue()


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """One row per .npz file, read by Spark's own reader of files, so in any store that Spark knows."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([recording_of(name, content) for name, content in zip(pdf["path"], pdf["content"], strict=True)], columns=RECORDING.names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInPandas(load, RECORDING)


def frames_of(recordings: DataFrame) -> DataFrame:
    """(recording_id, k, t, roi_rgb, face): a row per frame."""
    at = recordings.select("recording_id", "roi_rgb", "face_detected", F.posexplode("timestamps").alias("k", "t"))
    return at.select("recording_id", "k", "t", F.transform_values("roi_rgb", lambda _, v: F.get(v, F.col("k"))).alias("roi_rgb"), F.get("face_detected", F.col("k")).alias("face"))


def mean_rgb(roi_rgb: str, face: str):
    """Mean of the regions' vectors, null without a face."""
    values = F.map_values(roi_rgb)
    total = F.aggregate(values, F.array(*[F.lit(0.0)] * 3), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.col(face), F.transform(total, lambda x: x / F.size(values)))


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """(code, text) of a JSON file of findings by code; ``uncovered`` tells what it lacks."""
    schema = "knowledge_version string, findings map<string,struct<interpretation:string,caution:string,severity:string>>"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select("knowledge_version", F.explode("findings").alias("code", "text"))


def uncovered(knowledge: DataFrame, used: DataFrame) -> DataFrame:
    """The codes of ``used`` that the knowledge lacks."""
    return used.select("code").distinct().join(knowledge, "code", "left_anti")


def write_report(rows: DataFrame, path: str, codes: str = "hr_issue_codes") -> None:
    """Window records as JSON lines and as CSV, issue codes joined by a bar."""
    rows.write.mode("overwrite").json(f"{path}/json")
    rows.withColumn(codes, F.array_join(codes, "|")).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table, read in parts by a numeric column if bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, parts: int = 8, **options: str) -> None:
    """Rows into a database table, over ``parts`` connections at most."""
    rows.coalesce(parts).write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()


def write_recordings(recordings: DataFrame, path: str) -> None:
    """One file of JSON lines per task, each line a recording; read again by read_json_recordings()."""
    recordings.write.mode("overwrite").option("compression", "gzip").json(path)


def read_json_recordings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDING).option("mode", "FAILFAST").json(path)


def write_wave(rows: DataFrame, path: str) -> None:
    """(key, k, t, value) of pulse waves (key, fs, samples), as CSV."""
    out = rows.select("key", "fs", F.posexplode("samples").alias("k", "value")).select("key", "k", (F.col("k") / F.col("fs")).alias("t"), F.format_string("%.6f", "value").alias("value"))
    out.write.mode("overwrite").option("header", True).csv(path)


def markdown_lines(summary: DataFrame, columns: dict[str, str], places: int = 2) -> DataFrame:
    """(k, line): a table of a report, one row per row of ``summary``, in order of the first column; "-" for null.
    A report has a row per method or scenario, so its lines are few."""
    kinds = dict(summary.dtypes)
    text = lambda c: F.format_string(f"%.{places}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    shown = [F.when(F.col(c).isNull(), "-").otherwise(text(c)) for c in columns]
    head = summary.sparkSession.createDataFrame([(0, "| " + " | ".join(columns.values()) + " |"), (1, "|" + "---|" * len(columns))], "k long, line string")
    from pyspark.sql import Window

    first = next(iter(columns))
    body = summary.select((F.row_number().over(Window.orderBy(first)) + 1).cast("long").alias("k"), F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("line"))
    return head.unionByName(body)


def write_markdown(title: str, facts: dict[str, str], tables: dict[str, DataFrame], path: str) -> None:
    """A report: title, facts, and tables of markdown_lines() under their headings, as one text file."""
    parts = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()]]
    for heading, lines in tables.items():
        parts += ["", f"## {heading}", "", *[r["line"] for r in lines.orderBy("k").collect()]]
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([("\n".join(parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def closed_json(text: str, schema: T.StructType) -> tuple:
    """(value, unknown) Columns of a JSON text: its value by a closed schema, and the top-level keys that the schema lacks."""
    unknown = F.array_except(F.coalesce(F.json_object_keys(text), F.expr("cast(array() as array<string>)")), F.array(*[F.lit(n) for n in schema.names]))
    return F.when(F.size(unknown) == 0, F.from_json(text, schema, {"mode": "PERMISSIVE"})), unknown


def read_contract(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines by a closed schema; a line with further keys or of other types fails the query."""
    lines = spark.read.text(path)
    value, unknown = closed_json("value", schema)
    sure = F.when((F.size(unknown) > 0) | value.isNull(), F.raise_error(F.concat(F.lit("not of the contract: "), F.substring("value", 1, 200))).cast(schema)).otherwise(value)
    return lines.select(sure.alias("x")).select("x.*")


def export_contracts(spark: SparkSession, schemas: dict[str, T.StructType], path: str) -> None:
    """Each schema by name, as JSON lines."""
    spark.createDataFrame([(n, s.json()) for n, s in sorted(schemas.items())], "name string, schema string").coalesce(1).write.mode("overwrite").json(path)


def resolve(spark: SparkSession, source: str, seed: int = 3, seconds: float = 60.0) -> DataFrame:
    """Recordings by what names them: "synthetic" for made-up ones, else a folder of .npz files, in order of name."""
    if source != "synthetic":
        return read_recordings(spark, source).orderBy("recording_id")
    made = [synthetic.record(s) for s in synthetic.suite(seed, seconds)]
    rows = [(r.scenario.name, r.ts.tolist(), {k: v.tolist() for k, v in r.rgb.items()}, r.face.tolist(), r.beats.tolist()) for r in made]
    return spark.createDataFrame(rows, RECORDING)
