"""A registry of model artifacts: one row per version, its file's SHA-256 beside it."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.sources.versions import VersionedTable

SCHEMA = "name string, version string, kind string, status string, path string, sha256 string, metrics map<string,double>"
KINDS, STATUSES = ("rppg", "blood_pressure", "calibration", "risk"), ("RESEARCH", "VALIDATED", "PRODUCTION", "RETIRED")


def entry(name: str, version: str, kind: str, status: str, path: str, content: bytes, metrics: dict[str, float] | None = None) -> tuple:
    """A checked row: names and versions of the allowed form, and a path that stays inside the registry."""
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name) or not re.fullmatch(r"\d+\.\d+\.\d+", version):
        raise ValueError("a name in lower case and a version of three numbers are needed")
    if kind not in KINDS or status not in STATUSES:
        raise ValueError("unknown kind or status")
    if PurePosixPath(path).is_absolute() or ".." in PurePosixPath(path).parts:
        raise ValueError("the path leaves the registry")
    return name, version, kind, status, path, hashlib.sha256(content).hexdigest(), metrics or {}


def add(spark: SparkSession, registry: DataFrame, *rows: tuple) -> DataFrame:
    """The registry with further entries; one that is there already, by name and version, stays as it is."""
    new = spark.createDataFrame(list(rows), SCHEMA)
    return registry.unionByName(new.join(registry.select("name", "version"), ["name", "version"], "left_anti"))


def verified(spark: SparkSession, registry: DataFrame, folder: str) -> DataFrame:
    """(name, version, ok): does each artifact's file under ``folder`` have its checksum.  A missing file does not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("found"))
    base = folder.rstrip("/").removeprefix("file://")
    files = files.select(F.regexp_replace("path", f"^.*\\Q{base}\\E/", "").alias("path"), "found")
    return registry.join(files, "path", "left").select("name", "version", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("ok"))


def updated(registry: DataFrame, name: str, version: str, status: str) -> DataFrame:
    """The registry with another status for one entry."""
    if status not in STATUSES:
        raise ValueError("unknown status")
    own = (F.col("name") == name) & (F.col("version") == version)
    return registry.withColumn("status", F.when(own, status).otherwise(F.col("status")))


def removed(registry: DataFrame, name: str, version: str) -> DataFrame:
    return registry.where(~((F.col("name") == name) & (F.col("version") == version)))


def listed(registry: DataFrame, kind: str | None = None, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Entries of a kind and of these statuses, by name and by version, newest first."""
    out = registry.where(F.col("status").isin(*statuses))
    out = out if kind is None else out.where(F.col("kind") == kind)
    return out.orderBy("name", F.transform(F.split("version", "[.]"), lambda x: x.cast("int")).desc())


def save(spark: SparkSession, registry: DataFrame, path: str) -> None:
    """The registry as it is now: a new part, which counts instead of the others by one rename."""
    table(spark, path).replace(registry)


def load(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path).every()


def table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, SCHEMA, ("name", "version"))


def save_model(model: object, name: str, version: str, kind: str, status: str = "RESEARCH", metrics: dict[str, float] | None = None) -> tuple[tuple, bytes]:
    """(registry entry, content): a model's parameters as JSON.  ``model`` has parameters(), a dictionary of plain values."""
    content = json.dumps(model.parameters(), sort_keys=True).encode()
    return entry(name, version, kind, status, f"{name}/{version}.json", content, metrics), content


def load_model(kind: type, content: bytes, sha256: str) -> object:
    """The model of ``content``, if that has the checksum it was entered with; else it is refused."""
    if hashlib.sha256(content).hexdigest() != sha256:
        raise ValueError("the model's file doesn't have its checksum")
    return kind.of(json.loads(content))
