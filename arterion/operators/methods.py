"""Own methods and models: a registry of projections that SQL and DataFrames call by name, protocols of models as
Columns, and beats as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.functions import features, rppg

Projection = Callable[[np.ndarray, float], np.ndarray]


class RiskModel(Protocol):
    """What judges assembled features: Columns category and score of a row."""

    def risk(self, features: dict[str, Column]) -> tuple[Column, Column]: ...


class Regressor(Protocol):
    """What estimates targets: rows with a column pred_* per target."""

    targets: tuple[str, ...]

    def predict(self, rows: DataFrame) -> DataFrame: ...


class ConfidenceTransform(Protocol):
    """What turns a raw confidence into a calibrated one."""

    def confidence(self, raw: Column) -> Column: ...


def register(spark: SparkSession, name: str, projection: Projection | None = None) -> str:
    """Makes a projection, (n, 3) and a rate to (n,), known by ``name`` to project(), to the live operators and to SQL;
    without one, that of the name.  The SQL function's name: ``pulse_<name>(r, g, b, fs)``, arrays in and an array out.

    The projection goes with the function to where it runs, so it may be a closure.
    """
    if projection is not None:
        rppg.METHODS[name.upper()] = projection
    run = rppg.method(name)

    @F.pandas_udf("array<double>")
    def pulse(r: pd.Series, g: pd.Series, b: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for *rgb, rate in zip(r, g, b, fs, strict=True):
            whole = all(x is not None for x in rgb) and len({len(x) for x in rgb}) == 1 and len(rgb[0]) and rate == rate
            out.append(np.asarray(run(np.column_stack(rgb).astype(float), float(rate)), float) if whole else None)
        return pd.Series(out)

    spark.udf.register(f"pulse_{name.lower()}", pulse)
    return f"pulse_{name.lower()}"


BEAT = "beat int, foot int, peak int, finish int, seconds double, height double"


class Beats:
    """A table function: a window of samples and its rate to its beats, from foot to foot."""

    def eval(self, samples: list[float], fs: float) -> Iterator[tuple]:
        if samples is None or fs is None or not fs > 0:
            return
        for k, b in enumerate(features.segment(np.array([np.nan if x is None else x for x in samples], float), float(fs))):
            yield k, int(b["foot"]), int(b["peak"]), int(b["end"]), (b["end"] - b["foot"]) / float(fs), float(b["height"])


def register_beats(spark: SparkSession, name: str = "beats") -> None:
    """SQL: ``SELECT w.id, b.* FROM w, LATERAL beats(w.samples, w.fs) b``."""
    spark.udtf.register(name, F.udtf(Beats, returnType=BEAT, useArrow=True))


def beats(windows: DataFrame, samples: str, fs: Column | float, *by: str) -> DataFrame:
    """(by, BEAT): a row for each beat of each window; a window without beats has none."""
    spark = windows.sparkSession
    register_beats(spark)
    rate = fs if isinstance(fs, Column) else F.lit(float(fs))
    windows.select(*by, F.col(samples).cast("array<double>").alias("_samples"), rate.cast("double").alias("_fs")).createOrReplaceTempView("_beat_windows")
    names = ", ".join(f"w.`{c}`" for c in by)
    return spark.sql(f"SELECT {names}, b.* FROM _beat_windows w, LATERAL beats(w._samples, w._fs) b")
